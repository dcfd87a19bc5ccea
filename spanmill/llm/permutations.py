"""Nearest neighbours by a permutation index.

Vectors are represented by their nearest pivots in order. Blocks of vectors are posted in inverted
files: for each pivot the vectors that have it among their nearest and in which place. A query adds
up, over the lists of its own nearest pivots, what tells the footrule distance to each vector of a
block; in the order of these, vectors are reranked by their inner products in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, Scratch

#: Pivots, and how many of them stand for a vector.
PIVOTS, PREFIX = 256, 128
#: Share of a block's distinct vectors that are reranked for a query at a time, and how many are at least. This goes on
#: until so many times in turn none of them was among the best, so a large group of near copies is gone through. Recall is measured.
RERANKED, LEAST, IDLE = 1 / 32, 128, 2
#: Bytes of the vectors of an index block and of a block of queries.
BLOCK_BYTES = 4 << 20
TOP = 20
SEED = 17
#: How far two sums of the same products may be apart, relative to the largest.
ROUNDING = 1e-9


class Index:
    """What is written: pivots; vectors (row, vec_id, v); blocks (block, rows, ids and vectors, each with its copies); lists (block, pivot, members, places)."""

    def __init__(self, pivots: np.ndarray, norm: float, vectors: DataFrame, blocks: DataFrame, lists: DataFrame, n_blocks: int, width: int):
        self.pivots, self.norm, self.vectors, self.blocks, self.lists, self.n_blocks, self.width = pivots, norm, vectors, blocks, lists, n_blocks, width


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """row, vec_id, v of the vectors that are neither null nor zero and hold neither null nor non-finite components."""
    v = F.col("v")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return base.where(v.isNotNull() & finite).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros to the width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])] = flat
    return out


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """One coordinate more, with which all vectors are as long as the longest: then the largest inner product with a query is the least distance."""
    return np.column_stack([x, np.sqrt(np.maximum(0, norm * norm - (x * x).sum(1)))])


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each vector's nearest pivots, nearest first, the first of equals."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]


def chosen(vectors: DataFrame, n: int, width: int, norm: float) -> np.ndarray:
    """The vectors with the smallest hashes, each but once: a sample of n rows at most that no order of the rows changes."""
    key = F.xxhash64(F.lit(SEED), "v")
    least = vectors.select(key.alias("key")).distinct().orderBy("key").limit(n)
    rows = vectors.withColumn("key", key).join(F.broadcast(least), "key").groupBy("key").agg(F.first("v").alias("v")).orderBy("key").collect()
    x = np.array([[*r.v, *[0.0] * (width - len(r.v))] for r in rows], dtype=np.float64).reshape(-1, width)
    x = lifted(x, norm)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def build(vectors: DataFrame, scratch: Scratch, pivots: int = PIVOTS, prefix: int = PREFIX, block_bytes: int = BLOCK_BYTES, id_col: str = "vec_id", vec_col: str = "embedding") -> Index | None:
    """The index of all usable vectors, written; None if there are none.

    Pivots are a sample of at most ``pivots`` distinct vectors; every vector is indexed. Vectors are dealt
    to blocks by a hash of their rows, so copies of one vector are spread, and are posted once a block.
    """
    own = scratch.write(usable(vectors, id_col, vec_col), "usable")
    width, norm, n = own.agg(F.max(F.size("v")), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))), F.count(F.lit(1))).first()
    if not n:
        return None
    points = chosen(own, pivots, width, norm)
    prefix = min(prefix, len(points))
    n_blocks = -(-n * width * 8 // block_bytes)

    def post(key, table):
        block = key[0].as_py()
        ids = np.where(table["vec_id"].is_valid().to_numpy(), table["vec_id"].fill_null(NO_ID).to_numpy(), NO_ID)
        rows, x = table["row"].to_numpy(), _matrix(table["v"], width)
        first: dict[bytes, int] = {}
        order = np.lexsort((rows, ids))
        of = np.array([first.setdefault(x[i].tobytes(), len(first)) for i in order.tolist()])
        by = np.argsort(of, kind="stable")  # a vector's copies, smallest ids first
        copies, distinct = order[by], order[np.unique(of, return_index=True)[1]]
        near = nearest_pivots(lifted(x[distinct], norm), points, prefix)
        pivot, member, place = near.ravel(), np.repeat(np.arange(len(near)), prefix), np.tile(np.arange(prefix), len(near))
        turn = np.argsort(pivot, kind="stable")
        at = np.searchsorted(pivot[turn], np.arange(len(points) + 1))
        heads = [[block], [rows[copies].astype("<i8").tobytes()], [ids[copies].astype("<i8").tobytes()], [np.bincount(of).astype("<i4").tobytes()], [x[distinct].astype("<f8").tobytes()], [None], [None], [None]]
        lists = [(p, member[turn[i:j]].astype("<i4").tobytes(), place[turn[i:j]].astype("<i4").tobytes()) for p, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
        p, m, s = zip(*lists, strict=True)
        for k, column in enumerate(([block] * len(lists), *([None] * len(lists) for _ in range(4)), p, m, s)):
            heads[k] += column
        return pa.table(heads, schema=schema)

    schema = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("rows", "ids", "copies", "vectors")), ("pivot", pa.int32()), ("members", pa.binary()), ("places", pa.binary())])
    dealt = own.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)))
    posted = scratch.write(dealt.groupBy("block").applyInArrow(post, "block long, rows binary, ids binary, copies binary, vectors binary, pivot int, members binary, places binary"), "posted")
    return Index(points, norm, own, posted.where("pivot is null").select("block", "rows", "ids", "copies", "vectors"), posted.where("pivot is not null").select("block", "pivot", "members", "places"), n_blocks, width)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, added up from the first component to the last, so that equal vectors have equal products wherever they are worked out."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * x[:, k]
    return out


def search(index: Index, queries: DataFrame, scratch: Scratch, top: int = TOP, reranked: float = RERANKED, least: int = LEAST, prefix: int = PREFIX, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each of ``queries`` (rows of the index' vectors) the nearest found, the smaller id of equals.

    Blocks of queries meet blocks of the index: what a task holds is bounded, and the stated queries are
    ranked against all vectors. Ids that are null come last among equals.
    """
    width, points, norm = index.width, index.pivots, index.norm
    prefix = min(prefix, len(points))
    n = queries.count()
    q_blocks = max(1, -(-n * width * 8 // block_bytes))
    asked = queries.select(F.pmod(F.xxhash64("row"), F.lit(q_blocks)).alias("q_block"), "row", "vec_id", "v")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(index.n_blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    # A block's vectors and lists are one group's rows, told apart by their pivot.
    posted = index.blocks.select("block", "rows", "ids", "copies", "vectors", F.lit(None).cast("int").alias("pivot"), F.lit(None).cast("binary").alias("members"), F.lit(None).cast("binary").alias("places"))
    posted = posted.unionByName(index.lists.select("block", *(F.lit(None).cast("binary").alias(c) for c in ("rows", "ids", "copies", "vectors")), "pivot", "members", "places"))
    posted = posted.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).withColumn("q_block", F.col("q_block").cast("long"))

    def meet(key, left, right):
        held = left.to_pylist()
        head = [r for r in held if r["pivot"] is None]
        empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())], names=["query", "query_id", "vec_id", "score", "row"])
        if not head or not right.num_rows:
            return empty
        rows, ids = (np.frombuffer(head[0][c], dtype="<i8") for c in ("rows", "ids"))
        copies, x = np.frombuffer(head[0]["copies"], dtype="<i4"), np.frombuffer(head[0]["vectors"], dtype="<f8").reshape(-1, width)
        ends = np.cumsum(copies)
        smallest = ids[ends - copies]
        order_by_id = np.argsort(smallest, kind="stable")
        # The place of each pivot in each vector's order; those behind the prefix share the place after it.
        place = np.full((len(points), len(x)), prefix, dtype=np.uint16 if prefix <= 255 else np.int32)  # sums of so many places fit
        for r in held:
            if r["pivot"] is not None:
                place[r["pivot"], np.frombuffer(r["members"], dtype="<i4")] = np.frombuffer(r["places"], dtype="<i4")
        place = np.ascontiguousarray(place[:, order_by_id])
        q, q_rows, q_ids = _matrix(right["v"], width), right["row"].to_numpy(), right["vec_id"].to_pylist()
        near = nearest_pivots(np.column_stack([q, np.zeros(len(q))]), points, prefix)
        many = min(len(x), max(least, int(np.ceil(len(x) * reranked))))
        out, far, larger = [], np.empty(len(x), dtype=place.dtype), np.empty(len(x), dtype=place.dtype)
        for i in range(len(q)):
            # Up to a constant the footrule is twice the sum of the larger of both places, over the query's pivots.
            far[:] = 0
            for s, p in enumerate(near[i].tolist()):
                np.maximum(place[p], s, out=larger)
                np.add(far, larger, out=far)
            order, rough, done, idle = np.argsort(far, kind="stable"), np.empty(len(x)), 0, 0
            best = np.full(top + 1, -np.inf)  # the query's own vector may be among them
            while done < len(x) and idle < IDLE:
                own = order_by_id[order[done : done + many]]
                rough[done : done + len(own)] = x[own] @ q[i]
                idle = 0 if rough[done : done + len(own)].max() > best[0] else idle + 1
                done += len(own)
                best = np.sort(np.concatenate([best, rough[done - len(own) : done]]))[-top - 1 :]
            # What rounding can't lift among the best isn't multiplied out.
            found = order_by_id[order[:done][rough[:done] >= best[0] - ROUNDING * max(1.0, abs(best[-1]))]]
            score = products(np.broadcast_to(q[i], (len(found), width)), x[found])
            best = np.lexsort((smallest[found], -score))[: top + 1]
            rank = []
            for f, own in zip(found[best].tolist(), score[best].tolist(), strict=True):
                at = ends[f] - copies[f]
                rank += [(-own, int(ids[k]), int(rows[k])) for k in range(at, min(ends[f], at + top + 1)) if rows[k] != q_rows[i]]
            rank.sort()
            out += [(int(q_rows[i]), q_ids[i], i_id, -own, row) for own, i_id, row in rank[:top]]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), empty.schema.types, strict=True)], names=empty.schema.names) if out else empty

    met = posted.groupBy("block", "q_block").cogroup(asked.groupBy("block", "q_block")).applyInArrow(meet, "query long, query_id long, vec_id long, score double, row long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row"))
    ranked = met.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")


def neighbours(vectors: DataFrame, every: int, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding", scratch: Scratch | None = None, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest of every row whose id is divisible by ``every``, its own row left out.

    Vectors that are null, empty, zero or hold null or non-finite components take no part. Rows that
    repeat an id are vectors, and queries, of their own; ids that are null are no queries and come back
    as null, last among equals. Vectors of unlike lengths are padded with zeros. An empty table gives an
    empty one. Ids are integers; other columns are not read. ``options``: pivots, prefix, reranked, least, block_bytes.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "permutations")
    shared = {k: v for k, v in options.items() if k in ("prefix", "block_bytes")}
    index = build(vectors, scratch, id_col=id_col, vec_col=vec_col, **shared, **{k: v for k, v in options.items() if k == "pivots"})
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = index.vectors.where(F.col("vec_id") % every == 0)
    return search(index, queries, scratch, top, **shared, **{k: v for k, v in options.items() if k in ("reranked", "least")})


def op11_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 20)
