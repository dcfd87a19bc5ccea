"""Near-duplicate documents by a chosen-path join on word shingles.

Every set of shingles walks the same random tree: at a node it takes the branches of one or two
sampled tokens (min-hashes), so similar sets share leaves. Buckets that are small are compared by
brute force; large ones are split again by further tokens; the walk is repeated until a pair at the
threshold is found with the target probability. What a bucket suggests is gathered into groups, and
within these every pair is verified exactly on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHED_BYTES, NO_ID, Scratch, as_bytes, documents, hot_join, keyed, own_cache, place, sliced, table_batches
from .components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Min-hashes of a sketch; a bucket's pairs go on if their sketches agree in ``SLACK`` less than the threshold.
SKETCH = 64
SLACK = 0.2
#: Levels of the walk; buckets up to ``SMALL`` sets aren't split any more, and splits that keep this share of a bucket end it.
DEPTH = 3
SMALL = 128
TOGETHER = 0.7
#: Sets of one side of a task of brute force, and the tokens of these.
BLOCK = 1024
BLOCK_TOKENS = 1 << 20
SECOND_CHILD = 4  # one node in so many has a second branch

_WORDS: dict[bytes, int] = {}
_KEEP_WORDS = 250_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: words are what ASCII white space separates; a shorter text is one shingle, a text without words has none."""
    words = text.split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_WORDS) > _KEEP_WORDS:
        _WORDS.clear()
    ids = list(map(_WORDS.get, words))
    if None in ids:
        for i, w in enumerate(words):
            if ids[i] is None:
                ids[i] = xxhash.xxh3_64_intdigest(w)
                if len(w) <= CACHED_BYTES:
                    _WORDS[w] = ids[i]
    x = np.array(ids, dtype=np.uint64)
    width = min(width, len(x))
    n = len(x) - width + 1
    h = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        h = (h ^ (h >> np.uint64(29))) * _ODD[k % 5] + x[k : k + n]
    h ^= h >> np.uint64(32)
    h *= _ODD[0]
    h ^= h >> np.uint64(29)
    return np.unique(h)


_SEEDS = np.random.default_rng(41).integers(0, 1 << 63, (2, SKETCH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Min-hash values, 32 bits each."""
    least = np.full(SKETCH, np.uint64((1 << 64) - 1))
    for at in range(0, len(tokens), 512):
        x = tokens[at : at + 512, None] * _SEEDS[0] + _SEEDS[1]
        np.minimum(least, x.min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def found_with(depth: int, threshold: float = THRESHOLD) -> float:
    """Probability that two sets at the threshold share a leaf at this depth in one run."""
    p = 1.0
    for _ in range(depth):
        p = 1 - ((1 - 1 / SECOND_CHILD) * (1 - threshold * p) + (1 - threshold * p) ** 2 / SECOND_CHILD)
    return p


def runs_for(recall: float = RECALL, depth: int = DEPTH, threshold: float = THRESHOLD) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - found_with(depth, threshold))))


def sketched(rows: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """row, doc (its id), k1, k2 (digest of the whole set), n (its size), sketch; n is 0 for a text without words."""

    def run(batches):
        own_cache("jaccard", _WORDS.clear)
        for batch in sliced(batches, 2):
            keys, sizes, found = [], [], []
            for text in as_bytes(batch.column(2)):
                tokens = shingles(text, width)
                keys.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                sizes.append(len(tokens))
                found.append(sketch(tokens))
            k = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * SKETCH), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.ascontiguousarray(k[:, 0])), pa.array(np.ascontiguousarray(k[:, 1])), pa.array(sizes, pa.int32()), lists], names=["row", "doc", "k1", "k2", "n", "sketch"])

    return rows.select("row", F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, "row long, doc long, k1 long, k2 long, n int, sketch array<int>")


def consecutive(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of rows that agree in the first so many columns, from sorted batches; only an open group is carried on."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.zeros(batch.num_rows, dtype=bool)
        for k in range(keys):
            x = batch.column(k).to_numpy(zero_copy_only=False)
            marks[1:] |= x[1:] != x[:-1]
        first = tuple(batch.column(k)[0].as_py() for k in range(keys))
        cuts = [0, *np.flatnonzero(marks).tolist(), batch.num_rows]
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if b == batch.num_rows:
                held.append(part)
            else:
                yield pa.Table.from_batches([*held, part])
                held = []
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in range(keys))
    if held:
        yield pa.Table.from_batches(held)


def buckets(reps: DataFrame, scratch: Scratch, runs: int, depth: int, small: int) -> DataFrame:
    """bucket, node, size of the leaves that hold at least two sets."""
    rng = np.random.default_rng(43)
    roots = [(r, int(c)) for r in range(runs) for c in rng.choice(SKETCH, 1 + (r % SECOND_CHILD == 0), replace=False)]
    first = F.array(*(F.xxhash64(F.lit(r), F.lit(c), F.col("sketch")[c]) for r, c in roots))
    level = reps.select("node", F.explode(first).alias("bucket"), F.lit(None).cast("long").alias("parent_size"))
    leaves = None
    for d in range(1, depth + 1):
        sizes = scratch.write(level.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("n", F.col("size")), f"sizes{d}")
        sized = scratch.write(hot_join(level, sizes, ["bucket"]), f"level{d}")
        ends = (F.col("size") <= small) | (F.lit(d) == depth) | F.coalesce(F.col("size") >= TOGETHER * F.col("parent_size"), F.lit(False))
        leaf = sized.where(ends).select("bucket", "node", "size")
        leaves = leaf if leaves is None else leaves.unionAll(leaf)
        if d == depth:
            break
        chosen = lambda j: F.pmod(F.xxhash64("bucket", F.lit(j)), F.lit(SKETCH)).cast("int")
        child = lambda j: F.xxhash64("bucket", F.lit(j), chosen(j), F.col("sketch")[chosen(j)])
        more = F.pmod(F.xxhash64("bucket", F.lit("branches")), F.lit(SECOND_CHILD)) == 0
        level = sized.where(~ends).join(reps.select("node", "sketch"), "node").select("node", F.explode(F.when(more, F.array(child(1), child(2))).otherwise(F.array(child(1)))).alias("bucket"), F.col("size").alias("parent_size"))
    return leaves


def tiles(rows: DataFrame, group: str, parts) -> DataFrame:
    """Deals each group over blocks i and the pairs (i, j) of these, so that no task holds more than two blocks. One block is one tile."""
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("parts")).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("own", own)
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("parts", "other")


def suggested(leaves: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """a, b: for each bucket a forest over the sets whose sketches agree enough."""
    rows = leaves.join(reps.select("node", "sketch"), "node")
    dealt = tiles(rows, "bucket", F.ceil(F.col("size") / BLOCK)).select("bucket", "i", "j", "node", "own", "sketch")
    need = least * SKETCH

    def run(batches):
        def edges():
            for table in consecutive(batches, 3):
                node = table["node"].to_numpy()
                s = np.asarray(table["sketch"].combine_chunks().flatten()).reshape(-1, SKETCH)
                left = np.arange(len(node))
                while len(left) > 1:  # take whole groups out: what is alike to one of them is not compared again
                    todo, left = [left[0]], left[1:]
                    while todo and len(left):
                        x = todo.pop()
                        near = (s[left] == s[x]).sum(1) >= need
                        for y in left[near].tolist():
                            yield int(node[x]), int(node[y])
                            todo.append(y)
                        left = left[~near]

        yield from table_batches(edges(), pa.schema([("a", pa.int64()), ("b", pa.int64())]), 1 << 15)

    return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a long, b long").where("a <> b")


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """node, links, toward: exact similarities of all pairs of each group, a tile at a time. Pairs are counted, not written."""

    def run(batches):
        def rows():
            for table in consecutive(batches, 3):
                node, own, copies = (table[c].to_numpy() for c in ("node", "own", "copies"))
                _, once = np.unique(node, return_index=True)
                if len(once) < 2:
                    continue
                node, own, copies = node[once], own[once], copies[once]
                texts = table["tokens"]
                sets = [np.frombuffer(texts[int(k)].as_py(), dtype="<u8") for k in once]
                across = table["i"][0].as_py() != table["j"][0].as_py()
                yield from tile(node, own, copies, sets, across, threshold)

        yield from table_batches(rows(), pa.schema([("node", pa.int64()), ("links", pa.int64()), ("toward", pa.int64())]), 1 << 15)

    return members.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(run, "node long, links long, toward long")


def tile(node, own, copies, sets, across: bool, threshold: float) -> Iterator[tuple[int, int, int]]:
    size = np.array([len(s) for s in sets])
    common = intersections(sets)
    near = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
    np.fill_diagonal(near, False)
    if across:  # pairs within a block belong to that block's own tile
        near &= own[:, None] != own[None, :]
    links = near @ copies
    todo = np.flatnonzero(links)
    toward = np.arange(len(node))
    left = set(todo.tolist())
    while left:
        root = min(left)
        left.discard(root)
        queue = [root]
        while queue:
            for y in np.flatnonzero(near[queue.pop()]).tolist():
                if y in left:
                    left.discard(y)
                    toward[y] = root
                    queue.append(y)
    for k in todo.tolist():
        yield int(node[k]), int(links[k]), int(node[toward[k]])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections."""
    n = len(sets)
    if n == 2:
        c = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), c], [c, len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    count = np.diff(np.r_[start, len(token)])
    # Tokens that the same sets hold are one column with a weight; tokens of a single set don't meet.
    out = np.zeros((n, n), dtype=np.float64)
    keep = np.repeat(count > 1, count)
    token, owner = token[keep], owner[keep]
    column = np.cumsum(np.r_[True, token[1:] != token[:-1]]) - 1 if len(token) else np.empty(0, np.int64)
    columns = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, columns, 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((n, min(4096, columns - at)), dtype=np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += m @ m.T
    return np.rint(out).astype(np.int64)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, class_id, n_links, kept for every row.

    Two rows link if their texts' sets of shingles have this Jaccard similarity or more. class_id is
    the smallest id reachable by links, n_links how many other rows link directly, kept whether the
    row has its class's smallest id. Equal sets are joined as one and counted as many. A text
    without words (null, empty, white space) links with nothing, and its class is its own id. Ids
    are integers. Null ids come last: their rows have the class of their links, null if these all lack an id, and are
    kept only then. Rows that repeat an id are documents of their own. Other columns are not read.
    An empty table gives an empty one.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    return _judged(keyed(docs, id_col, text_col, scratch), place(docs, id_col), place(docs, text_col), threshold, recall, width, scratch).drop("row")


def _judged(rows: DataFrame, id_col: str, text_col: str, threshold: float, recall: float, width: int, scratch: Scratch) -> DataFrame:
    """``near_duplicates`` of ``keyed`` rows, with their keys."""
    sets = scratch.write(sketched(rows, id_col, text_col, width), "sketched")
    known = sets.where("n > 0")
    reps = known.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row"), F.min(F.coalesce("doc", F.lit(NO_ID))).alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = scratch.write(reps.withColumn("node", F.monotonically_increasing_id()), "reps")

    leaves = buckets(reps, scratch, runs_for(recall, DEPTH, threshold), DEPTH, SMALL)
    groups = connected_components(suggested(leaves, reps, threshold - SLACK), scratch, "groups").withColumnRenamed("component", "grp")
    members = scratch.write(groups.join(reps.select("node", "copies", "row", "n"), "node"), "members")
    sizes = members.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("parts"), F.count(F.lit(1)).alias("members"))
    members = hot_join(members.drop("n"), scratch.write(sizes, "sizes"), ["grp"], "members")
    texts = rows.select("row", F.col(text_col).alias("text")).join(members, "row")

    def tokens(batches):
        own_cache("jaccard", _WORDS.clear)
        for batch in sliced(batches, 0, 256):
            found = [shingles(text, width).tobytes() for text in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (1, 2, 3, 4)), pa.array(found, pa.binary())], names=["node", "copies", "grp", "parts", "tokens"])

    whole = texts.select("text", "node", "copies", "grp", "parts").mapInArrow(tokens, "node long, copies long, grp long, parts long, tokens binary")
    dealt = tiles(whole, "grp", F.col("parts")).select("grp", "i", "j", "node", "own", "copies", "tokens")
    found = scratch.write(verified(dealt, threshold), "found")

    component = connected_components(found.select(F.col("node").alias("a"), F.col("toward").alias("b")), scratch, "classes")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = reps.select("node", "k1", "k2", "copies", "least").join(links, "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = scratch.write(classes, "classes")
    least = scratch.write(classes.groupBy("component").agg(F.min("least").alias("of"), F.count(F.lit(1)).alias("n")), "least")
    by_set = hot_join(classes, least, ["component"]).select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "of", F.col("copies").alias("rows"))
    out = hot_join(known.select("row", "doc", "k1", "k2"), scratch.write(by_set, "by_set"), ["k1", "k2"], "rows")
    of = F.when(F.col("of") != NO_ID, F.col("of"))
    joined = out.select("row", F.col("doc").alias("doc_id"), of.alias("class_id"), F.col("links").cast("long").alias("n_links"), F.col("doc").eqNullSafe(of).alias("kept"))
    bare = sets.where("n = 0").select("row", F.col("doc").alias("doc_id"), F.col("doc").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return joined.unionByName(bare)


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The documents, all columns, of which none has a near-duplicate with a smaller id in its class.

    Each row goes or stays by its own text, also where rows share an id. Rows without an id stay.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    rows = keyed(docs, id_col, text_col, scratch)
    judged = _judged(rows, place(docs, id_col), place(docs, text_col), threshold, RECALL, SHINGLE, scratch)
    gone = scratch.write(judged.where("doc_id is not null and not kept").select("row"), "gone")
    return rows.join(gone, "row", "left_anti").drop("row").toDF(*docs.columns)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
