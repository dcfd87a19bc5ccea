"""A quality classifier: Naive Bayes support vectors.

n-gram indicators are scaled by the log ratio of their class counts, over all labelled training
rows; a linear model with hinge loss is fitted to them by dual coordinate descent. Indicators have
64-bit keys and are counted each for itself; one that the fit hasn't met weighs nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHED_BYTES, Scratch, as_bytes, documents, own_cache, remainder, sliced, table_batches

#: The linear model is fitted to at most so many labelled rows, the first by a hash of their ids; the class counts take all.
SAMPLE_ROWS = 6000
#: Labels that are sent to all workers (16 MB); more of them are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Indicators of fewer labelled rows are dropped.
MIN_ROWS = 3
#: Smoothing of the class counts, the hinge loss' weight, passes over the sample.
ALPHA = 1.0
COST = 1.0
PASSES = 12
THRESHOLD = 0.7

#: Places of known words in ``_HASHES``, which has each word's two hashes.
_WORDS: dict[bytes, int] = {}
_HASHES = np.empty((2, 1 << 12), dtype=np.uint64)
_KEEP_WORDS = 300_000
_PUNCTUATION = b".,;:!?\"'()[]{}#*$%&|<>=+-_/\\^~@`"


def _word(word: bytes) -> tuple[int, int]:
    """A word's hash (its letters in lower case) and the hash of its form: case, digits and what stands around the letters."""
    import xxhash

    core = word.strip(_PUNCTUATION)
    text = core.decode("utf-8", "replace")
    if not core:
        case = "none"
    elif text.isdigit():
        case = "digits"
    elif not text.isalpha():
        case = "mixed"
    elif text.isupper() and len(text) > 1:
        case = "upper"
    elif text[:1].isupper():
        case = "title"
    else:
        case = "lower"
    around = word.replace(core, b"~", 1) if core else word
    return xxhash.xxh3_64_intdigest(text.lower().encode()), xxhash.xxh3_64_intdigest(case.encode() + b"\0" + around)


def features(text: bytes) -> np.ndarray:
    """Distinct keys, in order, of the indicators that a text has: words, pairs of words, forms, pairs and triples of forms,
    repetition of the word before or of a recent one, length."""
    global _HASHES
    words = text.split()
    if len(_WORDS) > _KEEP_WORDS:
        _WORDS.clear()
    ids = list(map(_WORDS.get, words))
    long = []
    if None in ids:
        for i, w in enumerate(words):
            if ids[i] is None:
                if len(w) > CACHED_BYTES:
                    ids[i] = 0
                    long.append(i)
                    continue
                if (at := _WORDS.setdefault(w, len(_WORDS))) == _HASHES.shape[1]:
                    _HASHES = np.concatenate([_HASHES, np.empty_like(_HASHES)], axis=1)
                ids[i] = at
                _HASHES[:, at] = _word(w)
    x = np.array(ids, dtype=np.int64)
    word, form = _HASHES[0][x], _HASHES[1][x]
    for i in long:
        word[i], form[i] = _word(words[i])
    m = np.uint64(0x9E3779B97F4A7C15)
    mixed = lambda v, salt: ((v + np.uint64(salt)) * m ^ (v >> np.uint64(7))) * m
    found = [mixed(word, 1), mixed(word[1:] * m + word[:-1], 2), mixed(form, 3), mixed(form[1:] * m + form[:-1], 4)]
    if len(x) > 2:
        found.append(mixed((form[2:] * m + form[1:-1]) * m + form[:-2], 5))
    same = word[1:] == word[:-1]
    extra = [np.uint64(11 + min(15, int(math.log2(len(x) + 1))))]
    if len(x) > 3:
        share = int(4 * same.mean() + 0.999)
        extra += [np.uint64(40 + s) for s in range(1, share + 1)]
        variety = len(np.unique(word)) / len(x)
        extra += [np.uint64(60 + s) for s in range(8) if variety < (s + 1) / 10]
        common = np.unique(form, return_counts=True)[1].max() / len(x)
        extra += [np.uint64(80 + s) for s in range(10) if common > s / 10]
    found.append(mixed(np.array(extra, dtype=np.uint64), 6))
    every = np.concatenate(found)
    every.sort()
    return every[np.append(True, every[1:] != every[:-1])]


def places(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where those of the found keys that are among ``keys`` (in order) stand there."""
    if not len(keys):
        return np.empty(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return at[keys[at] == found]


@dataclass
class Model:
    """Indicators' keys in order, weights on them (log ratios included), an intercept, and the sigmoid that turns margins into probabilities."""

    keys: np.ndarray
    weights: np.ndarray
    scales: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        norm = math.sqrt(float(self.scales[found].sum()))
        return float(self.weights[found].sum()) / norm + self.bias if norm else self.bias

    def score(self, text: bytes) -> float:
        z = self.slope * self.margin(places(self.keys, features(text))) + self.offset
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, passes: int, seed: int = 5, n: int | None = None, least: float = 1e-3) -> np.ndarray:
    """Weights on ``n`` features and the intercept (last) of a linear model with hinge loss, by dual coordinate descent; rows have unit length."""
    n = max((int(f.max()) + 1 for f in rows if len(f)), default=0) if n is None else n
    w, alpha, rng = np.zeros(n + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(len(rows)):
            at, x = rows[i], values[i]
            g = y[i] * (float(w[at] @ x) + w[-1]) - 1
            new = min(max(alpha[i] - g / 2, 0.0), cost[i])  # a row's squared length is 1, the intercept's 1
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[at] += step * y[i] * x
                w[-1] += step * y[i]
                most = max(most, abs(step))
        if most < least:
            break
    return w


def sigmoid(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(label 1) over margins by Newton's method, with targets drawn in from 0 and 1."""
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margins**2).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, train_fold, scratch: Scratch, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on the labelled rows for which ``train_fold`` (a column on the id) holds.

    Ids are integers. Labels but 0 and 1, null ones among them, and labels without an id mark nothing; a label
    that is given twice counts once, and an id with both labels is a row of either. Rows that share a
    labelled id have its label each. Without rows of both labels (an empty table, say) every text has
    the same score, the labels' smoothed share.
    """
    marked = labels.where(train_fold & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    texts = docs.where(train_fold).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    few = marked.count() <= BROADCAST_LABELS
    rows = scratch.write(texts.join(F.broadcast(marked) if few else marked.hint("merge"), "id"), "labelled")

    totals = dict(rows.groupBy("label").count().collect())
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    none = np.empty(0)
    flat = Model(none.astype(np.uint64), none, none, 0.0, 1.0, math.log((n1 + 1) / (n0 + 1)))
    if not n0 or not n1:
        return flat

    def indexed(batches):
        own_cache("classifier", _WORDS.clear)
        found, held = [], []
        for batch in batches:
            found += map(features, as_bytes(batch.column(0)))
            held += batch.column(1).to_pylist()
        keys, at = np.unique(np.concatenate(found) if found else none.astype(np.uint64), return_inverse=True)
        ends = np.cumsum([len(f) for f in found])

        def out():
            for part in np.array_split(keys, len(keys) // (1 << 17) + 1):
                yield part.astype("<u8").tobytes(), -1
            for part, label in zip(np.split(at.astype("<i4"), ends[:-1]), held, strict=True) if found else ():
                yield part.tobytes(), label

        yield from table_batches(out(), pa.schema([("found", pa.binary()), ("label", pa.int32())]), 256)

    # One task: the rows that are fitted are at most ``sample_rows``. Only their indicators can have a weight.
    # The first by hash: what is sorted is cut to little more than these rows before.
    share = min(1.0, (sample_rows + 8 * math.sqrt(sample_rows) + 16) / (n0 + n1))
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    sample = rows.where(chance <= int(share * (1 << 40))).orderBy(chance, "id", "label").limit(sample_rows)
    table = sample.select("text", "label").coalesce(1).mapInArrow(indexed, "found binary, label int").toArrow()
    is_row = table["label"].to_numpy() >= 0
    blobs = table["found"].to_pylist()
    known = np.frombuffer(b"".join(x for x, r in zip(blobs, is_row, strict=True) if not r), dtype="<u8")
    found = [np.frombuffer(x, dtype="<i4") for x, r in zip(blobs, is_row, strict=True) if r]
    asked = docs.sparkSession.sparkContext.broadcast(known)

    def counted(batches):
        own_cache("classifier", _WORDS.clear)
        keys = asked.value
        held = np.zeros((2, len(keys)), dtype=np.int64)
        for batch in batches:
            for text, label in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                held[label, places(keys, features(text))] += 1
        at = np.flatnonzero(held[0] | held[1])
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(held[0][part]), pa.array(held[1][part])], names=["feature", "n0", "n1"])

    # Exact counts over all labelled rows of every indicator that the fitted rows have.
    counts = rows.select("text", "label").mapInArrow(counted, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= MIN_ROWS).toArrow()
    asked.unpersist()
    feature, c0, c1 = (counts[c].to_numpy() for c in ("feature", "n0", "n1"))
    ratio = np.log((c1 + ALPHA) / (n1 + 2 * ALPHA)) - np.log((c0 + ALPHA) / (n0 + 2 * ALPHA))
    order = np.argsort(feature)
    order = order[ratio[order] != 0]
    feature, ratio = feature[order], ratio[order]
    renamed = np.full(len(known), -1, dtype=np.int32)
    renamed[feature] = np.arange(len(feature))
    keys = known[feature]
    found = [g[g >= 0] for g in (renamed[f] for f in found)]
    y = np.where(table["label"].to_numpy()[is_row] > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return flat
    values = [ratio[f] / max(1e-12, math.sqrt(float((ratio[f] ** 2).sum()))) for f in found]
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * COST
    part = np.arange(len(y)) % 5
    margins = np.zeros(len(y))
    for fold in range(5):  # margins of rows that the fit has not seen, for the sigmoid
        use = np.flatnonzero(part != fold)
        w = descend([found[i] for i in use], [values[i] for i in use], y[use], weight[use], PASSES, n=len(keys))
        for i in np.flatnonzero(part == fold):
            margins[i] = float(w[found[i]] @ values[i]) + w[-1]
    w = descend(found, values, y, weight, PASSES, n=len(keys))
    slope, offset = sigmoid(margins, y)
    return Model(keys, w[:-1] * ratio, ratio**2, float(w[-1]), slope, offset)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row; a null text is an empty one, and nulls in the id stay. The model travels as a broadcast: it holds no indicator but those of the fitted rows, whatever the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own_cache("classifier", _WORDS.clear)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.score(t) for t in as_bytes(batch.column(1))], pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = remainder("doc_id", 4) == 2
    model = fit(docs, labels, ~held_out, Scratch(spark, "classifier"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
