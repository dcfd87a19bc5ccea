"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks. If two have a squared distance of at most D, then in
at least one block of m it is at most D/m. Each block is range-joined under that budget over cells of
several of its coordinates, and what any block finds is verified on the whole vectors in double precision.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hot_join
from .components import connected_components

THRESHOLD = 0.9
BLOCKS = 4
#: Bytes of a cell's vectors, what one task holds of either side; small tables get several cells still, of this many vectors at least.
CELL_BYTES = 8 << 20
CELLS, LEAST = 4, 1024
#: Vectors of either side whose block distances are worked out at once, and pairs that are verified at once.
ROWS, COLUMNS = 256, 2048
CHUNK = 1 << 15
#: What rounding may add to a block's squared distance, in double precision and in the single precision that finds candidates.
SLACK, COARSE = 1e-9, 1e-5
SEED = 11


def rotation(dim: int, seed: int = SEED):
    """A fixed random rotation, which spreads every direction's energy over the blocks."""
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit_vectors(vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows, reps). rows: vec_id, usable, k1, k2; reps: node, copies, smallest id and vector of each distinct usable one."""
    v = F.col("v")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    usable = F.coalesce(v.isNotNull() & finite, F.lit(False))
    rows = base.select("vec_id", usable.alias("usable"), F.xxhash64("v").alias("k1"), F.xxhash64(F.lit("again"), "v").alias("k2"), "v")
    reps = rows.where("usable").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id"), F.first("v").alias("v"))
    reps = scratch.write(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
    return rows.drop("v"), reps


def reachable(costs: list, budget: float):
    """(which point, cell) of all cells whose squared distance from a point is at most the budget. ``costs``: for each
    coordinate that is cut, by point and interval, the squared distance; cells are numbered with the last coordinate fastest."""
    import numpy as np

    n = len(costs[0]) if costs else 0
    point, cell, spent = np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n)
    for cost in costs:
        q = cost.shape[1]
        to = spent[:, None] + cost[point]
        at, interval = np.nonzero(to <= budget)
        point, cell, spent = point[at], cell[at] * q + interval, to[at, interval]
    return point, cell


def cells(reps: DataFrame, scratch: Scratch, dim: int, blocks: int, budget: float, most: int | None) -> DataFrame:
    """block, pair of cells (s, t), owner, node, copies, vector: each vector in the pairs of its own cell and those that its block's range reaches.

    A block's cells are cut at medians of as many of its coordinates as there must be cells, and at
    further quantiles where it has no more coordinates; the more of them are cut, the fewer cells a
    range reaches.
    """
    import numpy as np

    turn, edges_at = rotation(dim), np.linspace(0, dim, blocks + 1).astype(int)
    n = reps.where(F.size("v") == dim).count()
    parts = -(-n // most) if most else max(-(-n // max(1, CELL_BYTES // (8 * dim))), min(CELLS, -(-n // LEAST)))
    halvings, narrow = max(0, parts - 1).bit_length(), int(np.diff(edges_at).min())
    cut = min(halvings, narrow)  # coordinates of each block that are cut
    intervals = [1 << (halvings // cut + (j < halvings % cut)) for j in range(cut)]
    leads = np.column_stack([turn[:, at : at + cut] for at in edges_at[:-1]]) if cut else np.empty((dim, 0))

    def lead(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(-1, dim)
            most = np.abs(x).max(1, keepdims=True)
            x = x / np.linalg.norm(x / most, axis=1, keepdims=True) / most
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x)), pa.array(list(x @ leads), pa.list_(pa.float64()))], names=["node", "copies", "u", "leads"])

    led = scratch.write(reps.where(F.size("v") == dim).select("node", "v", "copies").mapInArrow(lead, "node long, copies long, u array<double>, leads array<double>"), f"led{dim}")
    names = [f"x{k}" for k in range(cut * blocks)]
    finest = max(intervals, default=1)
    found = led.select(*(F.col("leads")[k].alias(x) for k, x in enumerate(names))).stat.approxQuantile(names, [i / finest for i in range(1, finest)], 0.2 / finest) if cut else []
    cuts = [np.asarray(c)[finest // q - 1 :: finest // q] for c, q in zip(found, intervals * blocks, strict=True)]
    reach = [budget * (edges_at[b + 1] - edges_at[b]) / dim + SLACK for b in range(blocks)]

    def deal(batches):
        for batch in batches:
            x = np.asarray(batch.column(3).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            for b in range(blocks):
                home, costs = np.zeros(batch.num_rows, dtype=np.int64), []
                for k in range(b * cut, b * cut + cut):
                    low, high = np.r_[-np.inf, cuts[k]], np.r_[cuts[k], np.inf]
                    costs.append(np.maximum(0, np.maximum(low[None, :] - x[:, k, None], x[:, k, None] - high[None, :])) ** 2)
                    home = home * len(low) + np.searchsorted(cuts[k], x[:, k], side="right")
                point, cell = reachable(costs, reach[b]) if cut else (np.arange(batch.num_rows), home)
                own = home[point]
                for at in range(0, len(point), 1 << 13):
                    p, c, h = point[at : at + (1 << 13)], cell[at : at + (1 << 13)], own[at : at + (1 << 13)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(p), b, dtype=np.int32)), pa.array(np.minimum(c, h)), pa.array(np.maximum(c, h)), pa.array(h <= c), *(batch.column(k).take(pa.array(p)) for k in (0, 1, 2))], names=["block", "s", "t", "owner", "node", "copies", "u"]
                    )

    return led.mapInArrow(deal, "block int, s long, t long, owner boolean, node long, copies long, u array<double>")


def joined(dealt: DataFrame, dim: int, blocks: int, budget: float, threshold: float) -> DataFrame:
    """node, links (copies of the vectors that it links with here), toward (a linked node of each local group).

    Candidates are found in single precision, with room for its rounding, and judged in double. A pair
    is verified in the first block that finds it, so no pair counts twice and none is written out.
    """
    import numpy as np

    turn, at = rotation(dim), np.linspace(0, dim, blocks + 1).astype(int)
    limits = [budget * (at[b + 1] - at[b]) / dim + SLACK for b in range(blocks)]

    def tile(key, table):
        block, s, t = (k.as_py() for k in key)
        table = table.combine_chunks()
        node, copies, owner = table["node"].to_numpy(), table["copies"].to_numpy(), table["owner"].to_numpy()
        u = np.asarray(table["u"].combine_chunks().flatten()).reshape(-1, dim)
        x = u @ turn
        left = np.flatnonzero(owner)
        right = left if s == t else np.flatnonzero(~owner)
        links = np.zeros(len(node), dtype=np.int64)
        parent = np.arange(len(node))

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        part = [x[:, at[b] : at[b + 1]] for b in range(blocks)]
        half = (part[block] ** 2).sum(1, keepdims=True) / 2
        one = np.ones_like(half)
        # One product is the negative half of the squared distance.
        a = np.hstack([part[block], -half, one])[left].astype(np.float32)
        b = np.ascontiguousarray(np.hstack([part[block], one, -half])[right].astype(np.float32).T)
        least = np.float32(-limits[block] / 2 - COARSE)
        for k in range(0, len(left), ROWS):
            for m in range(k if s == t else 0, len(right), COLUMNS):
                i, j = np.divmod(np.flatnonzero(a[k : k + ROWS] @ b[:, m : m + COLUMNS] >= least), min(COLUMNS, len(right) - m))
                i, j = left[i + k], right[j + m]
                if s == t:
                    once = i < j
                    i, j = i[once], j[once]
                for c in range(0, len(i), CHUNK):
                    p, q = i[c : c + CHUNK], j[c : c + CHUNK]
                    far = [((part[e][p] - part[e][q]) ** 2).sum(1) > limits[e] for e in range(block + 1)]
                    ok = ~far[block]
                    for e in range(block):
                        ok &= far[e]
                    p, q = p[ok], q[ok]
                    ok = np.einsum("ij,ij->i", u[p], u[q]) >= threshold
                    p, q = p[ok], q[ok]
                    np.add.at(links, p, copies[q])
                    np.add.at(links, q, copies[p])
                    for v, w in zip(p.tolist(), q.tolist(), strict=True):
                        v, w = find(v), find(w)
                        if v != w:
                            parent[max(v, w)] = min(v, w)
        hit = np.flatnonzero(links)
        roots = np.array([find(i) for i in hit], dtype=np.int64)
        return pa.table({"node": node[hit], "links": links[hit], "toward": node[roots] if len(hit) else node[hit]})

    return dealt.groupBy("block", "s", "t").applyInArrow(tile, "node long, links long, toward long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, cell: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row, exactly.

    Equal vectors are joined as one and counted as many. Vectors that are null, empty, zero, or hold
    null or non-finite components link with nothing; so do vectors of different lengths. Rows that
    repeat an id are vectors of their own; ids are integers. component_id is the smallest id reachable, the row's own
    if it has no link; ids that are null are never the smallest, and their rows are not kept.
    ``cell``: about how many vectors a cell has. Cells are cut at quantiles, which are approximate and
    affect only how even the tasks are. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "embeddings")
    rows, reps = unit_vectors(vectors, scratch, id_col, vec_col)
    budget = 2 - 2 * threshold + SLACK
    found = None
    for (dim,) in sorted(reps.select(F.size("v")).distinct().collect()):
        m = min(blocks, dim)
        part = joined(cells(reps, scratch, dim, m, budget, cell), dim, m, budget, threshold)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = scratch.write(found, "found")
    component = connected_components(found.select(F.col("node").alias("a"), F.col("toward").alias("b")), scratch)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = reps.select("node", "k1", "k2", "copies", "least_id").join(links, "node", "left").join(component, "node", "left")
    classes = scratch.write(classes.withColumn("component", F.coalesce("component", "node")), "classes")
    least = scratch.write(classes.groupBy("component").agg(F.min("least_id").alias("of"), F.count(F.lit(1)).alias("n")), "least")
    by_vector = hot_join(classes, least, ["component"]).select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "of", F.col("copies").alias("n"))
    out = hot_join(rows.where("usable").drop("usable"), scratch.write(by_vector, "by_vector"), ["k1", "k2"])
    of = F.coalesce("of", "vec_id")
    linked = out.select("vec_id", F.col("links").cast("long").alias("n_links"), of.alias("component_id"), F.coalesce(F.col("vec_id") == of, F.lit(False)).alias("kept"))
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return linked.unionByName(alone)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
