"""Exact BPE encoding with a sentencepiece model through prefix tables, and decoding.

For a string without a forced boundary, the BPE tokens of each prefix end in one token. The table
holds it for every prefix: of the pieces that end there (found by an automaton over all pieces), it
is the one that is compatible with the table's entry where the piece begins. Two tokens are
compatible if merging their joined text gives these two again. The ids are then read backwards.
"""

from __future__ import annotations

import re

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHED_BYTES, documents, one_row_texts, own_cache, table_batches

SPACE = "▁"
#: Words and parts of words (of ``CACHED_BYTES`` at most) and token pairs that each worker remembers; others are worked out again.
CACHE_WORDS = 500_000
CACHE_PARTS = 300_000
CACHE_PAIRS = 300_000

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class MergePrefixEncoder:
    """Encodes with the pieces of one BPE model with byte fallback and without text normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a BPE model with byte fallback, a dummy prefix and identity normalisation is needed")
        self.id_of: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id = [0] * 256
        self.surface: list[bytes] = []
        self.bos = self.eos = self.unk = 0
        for i, piece in enumerate(model.pieces):
            surface = b""
            if piece.type == 1:
                self.id_of[piece.piece], self.score[piece.piece] = i, piece.score
                surface = piece.piece.replace(SPACE, " ").encode()
            elif piece.type == 6:
                byte = int(piece.piece[3:5], 16)
                self.byte_id[byte] = i
                surface = bytes([byte])
            elif piece.type == 2:
                self.unk, surface = i, model.trainer_spec.unk_surface.encode()
            elif piece.type != 3:
                raise ValueError(f"pieces of type {piece.type} are not supported")
            self.surface.append(surface)
        by_name = {p.piece: i for i, p in enumerate(model.pieces)}
        self.bos, self.eos = by_name["<s>"], by_name["</s>"]
        self.pieces = ahocorasick.Automaton()
        self.joints: set[str] = set()  # pairs of neighbouring characters within some piece
        for piece in self.score:
            self.pieces.add_word(piece, piece)
            self.joints.update(map("".join, zip(piece, piece[1:])))
        for letter in {c for joint in self.joints for c in joint} - set(self.score):  # begins as a token too, whatever it becomes
            self.pieces.add_word(letter, letter)
        self.pieces.make_automaton()
        self.longest_run = max((len(p) for p in self.score if not p.strip(SPACE)), default=1)
        self.inner_space = any(x[1] == SPACE and x[0] != SPACE for x in self.joints)
        if self.inner_space or any("\n" in x for x in self.score):
            raise ValueError("pieces that span words or lines are not supported")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, bytes] = {}
        self.spaced, self.bare = _Words(self, SPACE), _Words(self, "")

    def merged(self, text: str) -> list[str]:
        """The definition: join the neighbours whose joined piece scores best, the leftmost of equals, until none is a piece."""
        out = list(text)
        while len(out) > 1:
            best, at = None, -1
            for i in range(len(out) - 1):
                s = self.score.get(out[i] + out[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def compatible(self, left: str, right: str) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            found = self.merged(left + right) == ([left, right] if left else [right])
            if len(self.pairs) < CACHE_PAIRS:
                self.pairs[left, right] = found
        return found

    def tokens(self, part: str) -> list[str]:
        """Tokens of a part by its prefix table."""
        last: list[str] = [""] * (len(part) + 1)
        for end, piece in self.pieces.iter(part):
            end += 1
            if not last[end]:
                start = end - len(piece)
                if (last[start] or not start) and self.compatible(last[start], piece):
                    last[end] = piece
        out, at = [], len(part)
        while at:
            if not last[at]:  # no piece of the model ends here
                return self.merged(part)
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(part) == 1 or part.startswith(SPACE * 2):
                # Pieces of several spaces share one score, so a prefix doesn't fix its last token: merge by definition.
                tokens = [part] if len(part) == 1 else self.long_run(part)
            else:
                tokens = self.tokens(part)
            found = b"".join(self.id_of[t].to_bytes(4, "little") if t in self.id_of else b"".join(self.byte_id[b].to_bytes(4, "little") for b in t.encode()) for t in tokens)
            if len(self.parts) < CACHE_PARTS and len(part) <= CACHED_BYTES:
                self.parts[part] = found
        return found

    def long_run(self, part: str) -> list[str]:
        """A run of spaces and what follows it. A space that begins a better piece leaves the run first;
        pieces of spaces only come last, from the left, each as long as a piece can be."""
        spaces = len(part) - len(part.lstrip(SPACE))
        rest = self.tokens(part[spaces - 1 :]) if spaces < len(part) else []
        if rest and rest[0] == SPACE:
            rest = rest[1:]
        elif rest:
            spaces -= 1
        out = []
        while spaces:
            n = min(self.longest_run, spaces)
            while n > 1 and SPACE * n not in self.score:
                n -= 1
            out.append(SPACE * n)
            spaces -= n
        return out + rest

    def word(self, word: str) -> bytes:
        """Ids of a run of spaces and the characters up to the next space, cut where no piece can span."""
        out, start, joints = [], 0, self.joints
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in joints:
                out.append(self.part(word[start:i]))
                start = i
        out.append(self.part(word[start:]))
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """Ids of a text as little-endian uint32, without begin and end."""
        if not text:
            return b""
        if text[:1] == b" " or b"  " in text or b"\xe2\x96\x81" in text:
            return b"".join(self.word(w) for w in _RUNS.findall(SPACE + text.decode("utf-8", "replace").replace(" ", SPACE)))
        out, spaced, bare, newline = [], self.spaced.__getitem__, self.bare.__getitem__, self.byte_id[10].to_bytes(4, "little")
        for k, line in enumerate(text.split(b"\n")):
            if k:
                out.append(newline)
            first, *rest = line.split(b" ")
            if not k:
                out.append(spaced(first))
            elif first:
                out.append(bare(first))
            out += map(spaced, rest)
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids in UTF-8: the dummy prefix goes, broken bytes become U+FFFD."""
        out = b"".join(map(self.surface.__getitem__, ids))
        for i in ids[:8]:
            if self.surface[i]:
                out = out[1:] if out[:1] == b" " and i not in self.byte_id else out
                break
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode("utf-8", "replace").encode()
        return out


class _Words(dict):
    def __init__(self, encoder: MergePrefixEncoder, prefix: str):
        super().__init__()
        self.encoder, self.prefix = encoder, prefix

    def __missing__(self, word: bytes) -> bytes:
        found = self.encoder.word(self.prefix + word.decode("utf-8", "replace"))
        if len(self) < CACHE_WORDS and len(word) <= CACHED_BYTES:
            self[word] = found
        return found


_LOADED: dict[str, MergePrefixEncoder] = {}


def encoder(path: str) -> MergePrefixEncoder:
    own_cache("sentencepieces", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = MergePrefixEncoder(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32 bytes with begin and end ids), decoded (UTF-8 bytes).

    One pass without a shuffle. A null text is an empty one: begin and end ids, empty decoded text.
    Ids are integers; null ids stay null, repeated rows are encoded each, other columns are not read.
    """
    import array

    def run(batches):
        coder = encoder(path)
        begin, end = coder.bos.to_bytes(4, "little"), coder.eos.to_bytes(4, "little")

        def rows():
            for (doc_id,), text in one_row_texts(batches, "text", ["doc_id"]):
                ids = begin + coder.encode(text) + end
                yield doc_id, len(ids) // 4, ids, coder.decode(array.array("I", ids).tolist())

        yield from table_batches(rows(), _SCHEMA)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def op9_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


