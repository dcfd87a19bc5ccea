"""Language-model scores by a subword lattice: the probability of a text is the sum over all its
segmentations into pieces of an existing vocabulary, by a forward recursion in log space.

Pieces never span words, so a text's sum is the product of its words' sums and of an end, and each
distinct word is worked out once for the whole corpus. The model is a unigram one: the pieces and the
end share one distribution. A vocabulary of merges has ranks for scores, not probabilities, so
these are learned by expectation maximisation from the words of all training texts, each as often as
it occurs, starting from the vocabulary's order.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, documents, remainder

SPACE = "▁"
#: Added to a piece's expected count, and passes of expectation maximisation over all training words.
SMOOTHING = 0.01
PASSES = 3
#: Added to a rank where a pass begins from the vocabulary's order, by Zipf's law.
RANK_SHIFT = 100
#: Added to a word's count by the word model that the scores are compared with.
BASE_SMOOTHING = 0.1
#: Words that a worker counts before it hands them on, and bytes of text that it takes meanwhile at most.
COUNTED_WORDS, COUNTED_BYTES = 250_000, 128 << 20
#: The most frequent words, at most so many, are sent to all workers; the others meet their scores in a join.
HOT_WORDS = 200_000
#: Bytes of a word up to which recursions run over many words at once; a longer word goes through the same recursion alone.
LONG_WORD = 256
#: Words of a vectorised recursion.
BATCH = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[bytes]:
    """Pieces in the vocabulary's order, A-Z in lower case, a space for the mark of a word's beginning; then the single bytes that are missing."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    pieces = dict.fromkeys(p.piece.replace(SPACE, " ").encode().lower() for p in model.pieces if p.type == 1)
    pieces |= dict.fromkeys(bytes([b]) for b in range(256))
    # A piece that no word can hold: white space beyond a leading mark.
    return [p for p in pieces if p[:1] == b" " and len(p[1:].split()) <= 1 and not set(p[1:]) & set(b" \t\n\v\f\r") or not set(p) & set(b" \t\n\v\f\r")]


@dataclass
class Lattice:
    """Pieces with their natural log probabilities, laid out for look-up by length and hash. Those of the pieces and of the end sum to one."""

    pieces: list[bytes]
    log_p: np.ndarray
    log_end: float = 0.0

    def __post_init__(self) -> None:
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(self.pieces):
            by_length.setdefault(len(p), []).append(i)
        self.tables = {}
        for length, ids in sorted(by_length.items()):
            h = np.array([_hash(self.pieces[i]) for i in ids], dtype=np.uint64)
            order = np.argsort(h)
            present = np.zeros(1 << 16, dtype=bool)
            present[h >> np.uint64(48)] = True
            self.tables[length] = (h[order], np.array(ids)[order], present)

    def edges(self, words: np.ndarray) -> dict[int, list[tuple[int, np.ndarray, np.ndarray]]]:
        """For words of one length (rows of bytes): by end, (begin, which words, which pieces)."""
        n, length = words.shape
        prefix = np.zeros((length + 1, n), dtype=np.uint64)
        for k in range(length):
            prefix[k + 1] = prefix[k] * _BASE + (words[:, k].astype(np.uint64) + np.uint64(1))
        out: dict[int, list] = {}
        powers = np.full(max(self.tables) + 1, _BASE)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        for end in range(1, length + 1):
            own = out.setdefault(end, [])
            for size, (hashes, ids, present) in self.tables.items():
                if size > end:
                    break
                h = prefix[end] - prefix[end - size] * powers[size]
                h = (h ^ (h >> np.uint64(31))) * _BASE
                at = np.flatnonzero(present[h >> np.uint64(48)])
                if len(at):
                    h = h[at]
                    place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    ok = hashes[place] == h
                    if ok.any():
                        own.append((end - size, at[ok], ids[place[ok]]))
        return out

    def forward(self, n: int, length: int, edges: dict) -> np.ndarray:
        """Log probability of all ways to each offset."""
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0
        for end in range(1, length + 1):
            for begin, at, ids in edges[end]:
                alpha[end, at] = np.logaddexp(alpha[end, at], alpha[begin, at] + self.log_p[ids])
        return alpha

    def word_log_p(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability, over all ways to spell it with the space before it."""
        out = np.empty(len(words))
        short = [i for i, w in enumerate(words) if len(w) < LONG_WORD]
        for length, at, matrix in _by_length([b" " + words[i] for i in short]):
            out[np.array(short)[at]] = self.forward(len(at), length, self.edges(matrix))[length]
        for i in sorted(set(range(len(words))) - set(short)):
            out[i] = self.long_forward(b" " + words[i])[-1]
        return out

    def spelled(self, word: bytes, end: int) -> list[tuple[int, int, float]]:
        """(begin, piece, log probability) of the pieces of one word that end there."""
        if not hasattr(self, "places"):
            self.places = {p: (i, x) for i, (p, x) in enumerate(zip(self.pieces, self.log_p.tolist(), strict=True))}
        return [(begin, *found) for begin in range(max(0, end - max(self.tables)), end) if (found := self.places.get(word[begin:end]))]

    def long_forward(self, word: bytes) -> list[float]:
        """``forward`` of one word, a position at a time."""
        alpha = [0.0]
        for end in range(1, len(word) + 1):
            alpha.append(_log_sum([alpha[begin] + p for begin, _, p in self.spelled(word, end)]))
        return alpha

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces in words that occur so often."""
        out = np.zeros(len(self.pieces))
        short = [i for i, w in enumerate(words) if len(w) < LONG_WORD]
        for length, at, matrix in _by_length([b" " + words[i] for i in short]):
            n, edges = len(at), self.edges(matrix)
            alpha = self.forward(n, length, edges)
            beta = np.full((length + 1, n), -np.inf)
            beta[length] = 0
            times = counts[np.array(short)[at]]
            for end in range(length, 0, -1):
                for begin, own, ids in edges[end]:
                    through = beta[end, own] + self.log_p[ids]
                    out += np.bincount(ids, np.exp(alpha[begin, own] + through - alpha[length, own]) * times[own], len(out))
                    beta[begin, own] = np.logaddexp(beta[begin, own], through)
        for k in sorted(set(range(len(words))) - set(short)):
            word = b" " + words[k]
            alpha, beta = self.long_forward(word), [-math.inf] * len(word) + [0.0]
            for end in range(len(word), 0, -1):
                for begin, i, p in self.spelled(word, end):
                    through = beta[end] + p
                    out[i] += math.exp(alpha[begin] + through - alpha[-1]) * counts[k]
                    beta[begin] = _log_sum([beta[begin], through])
        return out


def _log_sum(terms: list[float]) -> float:
    most = max(terms)
    return most + math.log(math.fsum(math.exp(t - most) for t in terms)) if most > -math.inf else most


def _hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(_BASE) + b + 1) % (1 << 64)
    return (h ^ (h >> 31)) * int(_BASE) % (1 << 64)


def _by_length(parts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, which parts, their bytes as rows) for each length that occurs."""
    sizes = np.array([len(w) for w in parts], dtype=np.int64)
    for length in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == length)
        yield length, at, np.frombuffer(b"".join(parts[i] for i in at.tolist()), dtype=np.uint8).reshape(-1, length)


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, A-Z in lower case."""
    return text.lower().split()


def word_counts(docs: DataFrame, train: Column, text_col: str = "text") -> DataFrame:
    """word, n (in all texts), c (in training texts). Workers count before they shuffle, so a word of a third of all tokens is a few rows."""

    def run(batches):
        held, taken = (Counter(), Counter()), 0

        def rows():
            for learn, counter in enumerate(held):
                words, counts = list(counter), list(counter.values())
                for at in range(0, len(words), 1 << 14):
                    n = pa.array(counts[at : at + (1 << 14)], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(words[at : at + (1 << 14)], pa.binary()), n, n if learn else pa.array(np.zeros(len(n), dtype=np.int64))], names=["word", "n", "c"])
                counter.clear()

        for batch in batches:
            for learn, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                held[bool(learn)].update(tokens(text))
                taken += len(text)
                if len(held[0]) + len(held[1]) > COUNTED_WORDS or taken > COUNTED_BYTES:
                    yield from rows()
                    taken = 0
        yield from rows()

    counted = docs.select(train.alias("learn"), F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long, c long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def _word_batches(batches) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BATCH:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def weighted(pieces: list[bytes], counts: np.ndarray, ends: float) -> Lattice:
    """Pieces and an end by these counts."""
    total = counts.sum() + ends
    return Lattice(pieces, np.log(counts / total), math.log(ends / total))


def learn(words: DataFrame, texts: int, path: str, passes: int = PASSES) -> Lattice:
    """The probabilities from all training words (word, c) and the number of training texts. What comes to the driver is one number per piece."""
    pieces = vocabulary(path)
    lattice = weighted(pieces, 1 / (np.arange(len(pieces)) + float(RANK_SHIFT)), 1 / RANK_SHIFT)
    for _ in range(passes):
        shared = words.sparkSession.sparkContext.broadcast(lattice)

        def run(batches, shared=shared):
            out = np.zeros(len(shared.value.pieces))
            for table in _word_batches(batches):
                out += shared.value.expected(table["word"].to_pylist(), table["c"].to_numpy())
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], names=["piece", "count"])

        found = words.where("c > 0").select("word", "c").mapInArrow(run, "piece int, count double").groupBy("piece").agg(F.sum("count").alias("count")).toArrow()
        counts = np.full(len(pieces), SMOOTHING)
        counts[found["piece"].to_numpy()] += found["count"].to_numpy()
        lattice = weighted(pieces, counts, texts + SMOOTHING)
        shared.unpersist()
    return lattice


def score(docs: DataFrame, train: Column, path: str, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score for every row, all logs to base 10.

    Words are what ASCII white space separates, with A-Z in lower case; an end follows them. A null
    text is an empty one, whose only token is the end; ids are integers, and null ids stay null; rows that repeat are
    scored each, whole, however long. With no training text, counts are 0 and the vocabulary's order and the smoothing
    alone speak. An empty table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lattice")
    words = scratch.write(word_counts(docs, train, text_col), "words")
    texts = docs.where(train).count()
    tokens_, types = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    train_tokens, distinct = tokens_ + texts, types + (texts > 0)
    lattice = learn(words, texts, path)
    shared = spark.sparkContext.broadcast(lattice)

    def weigh(batches):
        for table in _word_batches(batches):
            found = shared.value.word_log_p(table["word"].to_pylist()) / math.log(10)
            yield from table.append_column("l", pa.array(found)).combine_chunks().to_batches()

    weighed = scratch.write(words.mapInArrow(weigh, "word binary, n long, c long, l double"), "weighed")
    # The frequent words: the smallest count, on a scale of bounded length, above which there are few enough.
    step = lambda c: F.floor(F.log2(c) * 16)
    bins = weighed.groupBy(step("n").alias("step")).count().orderBy(F.desc("step")).collect()
    least, held = None, 0
    for row in bins:
        held += row["count"]
        if held > hot_words:
            break
        least = row["step"]
    frequent = F.lit(False) if least is None else step("n") >= least
    scale = train_tokens + BASE_SMOOTHING * (distinct + 1)
    base = lambda c: np.log10((c + BASE_SMOOTHING) / scale)
    table = weighed.where(frequent).select("word", "c", "l").toArrow()
    known = table["c"].to_numpy()
    places = {w: i for i, w in enumerate(table["word"].to_pylist())}
    hot = spark.sparkContext.broadcast((places, np.column_stack([known > 0, base(known), table["l"].to_numpy()]).reshape(len(places), 3)))
    end = np.array([int(texts > 0), float(base(np.float64(texts))), lattice.log_end / math.log(10)])
    kinds = {"row": pa.int64(), "id": pa.int64(), "word": pa.binary(), "times": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "s": pa.float64()}

    def run(batches):
        (places, values), part, at = hot.value, TaskContext.get().partitionId() << 40, 0
        whole, rows, words, times, size = [], [], [], [], 0

        def flush():
            row, key, n, sums = zip(*whole, strict=True)
            sums = np.array(sums)
            # A space is in no word: these rows' keys are their own and meet no word in the join.
            columns = [row, key, [b" %d" % r for r in row], [0] * len(row), n, sums[:, 0].astype(np.int64), sums[:, 1], sums[:, 2]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))
            for k in range(0, len(rows), 1 << 14):
                own = slice(k, k + (1 << 14))
                n = len(rows[own])
                yield pa.RecordBatch.from_arrays([pa.array(rows[own], pa.int64()), pa.nulls(n, pa.int64()), pa.array(words[own], pa.binary()), pa.array(times[own], pa.int64()), *(pa.nulls(n, kinds[x]) for x in ("n_tokens", "n_known", "base", "s"))], names=list(kinds))
            for c in (whole, rows, words, times):
                c.clear()

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                own = tokens(text)
                found = list(map(places.get, own))
                if None in found:
                    rare = Counter(w for w, f in zip(own, found, strict=True) if f is None)
                    rows.extend([part | at] * len(rare))
                    words.extend(rare)
                    times.extend(rare.values())
                    found = [f for f in found if f is not None]
                    size += len(text)
                whole.append((part | at, key, len(own) + 1, end + values[found].sum(0) if found else end))
                at += 1
                if len(rows) + len(whole) >= 1 << 15 or size > 32 << 20:
                    yield from flush()
                    size = 0
        if whole:
            yield from flush()

    ddl = "row long, id long, word binary, times long, n_tokens long, n_known long, base double, s double"
    parts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)
    met = parts.join(weighed.where(~frequent).drop("n"), "word", "left")
    times, count = F.col("times"), F.coalesce("c", F.lit(0))
    rare_base = times * F.log10((count + F.lit(BASE_SMOOTHING)) / F.lit(float(scale)))
    return met.groupBy("row").agg(
        F.max("id").alias(id_col),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(count > 0, times).otherwise(0))).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        F.sum(F.coalesce("base", rare_base)).alias("base_score"),
        F.sum(F.coalesce("s", times * F.col("l"))).alias("score"),
    ).drop("row")


def op4_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 10) == 0
    scored = score(documents(spark, sf_dir), ~held_out, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
