"""Packing by power-of-two decomposition: a document's tokens are cut into pieces whose lengths are
powers of two, and each piece is a sequence of its own, so none crosses documents and none is padded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHED_BYTES, documents, one_row_texts, own_cache, table_batches

MAX_LENGTH = 4096
END_ID = 2
#: Distinct words (of ``CACHED_BYTES`` at most) whose ids each worker remembers; others are tokenised again.
CACHE_WORDS = 600_000

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


#: ASCII characters that are neither letters nor digits nor white space.
_STOPS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class WordIds(dict):
    """Ids of white-space separated words, as little-endian unsigned 32-bit integers.

    The tokenizer drops white space before it splits, so a text's ids are those of its words in turn.
    Words of Latin letters with or without punctuation after them, which is a token run of its own,
    share what is known of their letters.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most, self.cores = Tokenizer.from_file(path), most, {}
        self.ends = frozenset(i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>"))

    def encode(self, words: str) -> list[int]:
        return self.tokenizer.encode(words, add_special_tokens=False).ids

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that aren't known; as many as there is room for are kept."""
        found, split, new, cores = {}, [], {}, self.cores
        for word in words:
            core = word.rstrip(_STOPS)
            if core.isalpha():  # ASCII letters
                letters = core.lower()
            else:
                text = core.decode("utf-8", "replace")
                if not text.isalpha() or max(text) >= "\u0100":
                    found[word] = _packed(self.encode(word.decode("utf-8", "replace")))
                    continue
                letters = text.lower().encode()  # in Latin 1 lower case goes by the character and nothing composes
            split.append((word, letters, len(core)))
            if letters not in cores:
                new[letters] = b""
        if new:
            # Each is one word of the tokenizer, whose last id alone marks a word's end.
            ids = self.encode(b" ".join(new).decode())
            packed, at, ends = _packed(ids), 0, self.ends
            words_ends = [4 * k for k, i in enumerate(ids, 1) if i in ends]
            for letters, end in zip(new, words_ends, strict=True):
                new[letters] = packed[at:end]
                at = end
            if len(cores) < self.most:
                cores.update((w, i) for w, i in new.items() if len(w) <= CACHED_BYTES)
        for word, letters, size in split:
            ids = new[letters] if letters in new else cores[letters]
            found[word] = ids if size == len(word) else ids + self.stops(word[size:])
        if len(self) < self.most:
            self.update((w, i) for w, i in found.items() if len(w) <= CACHED_BYTES)
        return found

    def stops(self, stops: bytes) -> bytes:
        if (found := self.get(stops)) is None:
            found = _packed(self.encode(stops.decode()))
            if len(stops) <= CACHED_BYTES:
                self[stops] = found
        return found

    def text(self, text: bytes) -> bytes:
        words = text.split()
        ids = list(map(self.get, words))
        if None in ids:
            new = self.learn({w for w, i in zip(words, ids, strict=True) if i is None})
            ids = [new[w] if i is None else i for w, i in zip(words, ids, strict=True)]
        return b"".join(ids)


def _packed(ids: list[int]) -> bytes:
    import array
    import sys

    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    own_cache("packing", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def cuts(n: int, most: int = MAX_LENGTH) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences first, then the set bits of the rest, largest first."""
    at = 0
    while n - at >= most:
        yield at, most
        at += most
    while at < n:
        length = 1 << ((n - at).bit_length() - 1)
        yield at, length
        at += length


def pack(docs: DataFrame, path: str, max_length: int = MAX_LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, ids (little-endian uint32 bytes),
    sequence_id, offset, bucket (the sequence's length, which all sequences of a bucket share).

    One pass without a shuffle: a piece fills its sequence, so no sequence needs a second document.
    ``max_length`` is a power of two. Ids are integers. A null or empty text is a document of the end id alone; a null
    id stays null; rows that repeat are packed each by themselves. Other columns are not read.
    """
    if max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    end = end_id.to_bytes(4, "little")

    def cut(batches):
        table = word_ids(path)

        def rows():
            for (doc_id,), text in one_row_texts(batches, "text", ["doc_id"]):
                ids = table.text(text) + end
                n = len(ids) // 4
                for start, length in cuts(n, max_length):
                    yield doc_id, start, length, n, ids[4 * start : 4 * (start + length)]

        yield from table_batches(rows(), _SCHEMA)

    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("bucket", F.col("length"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences by length, so that a reader takes batches of equal lengths from one folder."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
