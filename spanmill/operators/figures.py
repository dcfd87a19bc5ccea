"""Tables behind figures: histograms, densities, heat maps. Values are counted before they meet a grid, so a group is as large as its distinct values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import results


#: Beyond so many bandwidths a Gaussian kernel is zero in double precision.
REACH = 39.0
#: Groups whose statistics are sent to all workers, and points that a task holds before it hands them on.
BROADCAST_GROUPS, HELD_POINTS = 100_000, 1 << 22
#: Values among which an order statistic is looked up on the driver, and the share of rows that a narrower interval is off.
GATHERED, NARROW = 10_000, 0.005


def length_histogram(rollouts: DataFrame, cell: list[str], series: list[str], bins: int = 50, length: str = "seq_len") -> DataFrame:
    """bin, low, high, n, density of each series; the edges, from 0 to the cell's longest plus one, are shared within a cell."""
    top = rollouts.groupBy(*cell).agg((F.max(length) + 1).cast("double").alias("top"))
    counts = rollouts.groupBy(*cell, *series, length).agg(F.count(F.lit(1)).alias("k"))
    width = F.col("top") / bins
    placed = counts.join(top, cell).withColumn("bin", F.least(F.floor(F.col(length) / width), F.lit(bins - 1)).cast("int"))
    n = F.sum("k")
    binned = placed.groupBy(*cell, *series, "bin").agg(n.alias("n"), F.first("top").alias("top"))
    total = F.sum("n").over(Window.partitionBy(*cell, *series))
    return binned.select(*cell, *series, "bin", (F.col("bin") * width).alias("low"), ((F.col("bin") + 1) * width).alias("high"), "n", (F.col("n") / (total * width)).alias("density"))


def kernel_density(values: DataFrame, keys: list[str], value: str, points: int = 1000, low: float | None = 0.0, high_from: list[str] | None = None, log_value: bool = False) -> DataFrame:
    """x, density: Gaussian kernels with Scott's bandwidth (deviation * n ** -1/5) at evenly spaced points.

    Points go from ``low`` (None: the smallest value) to the largest value plus one (with None: the
    largest) of the groups that share ``high_from``. With ``log_value`` the density is of the
    natural log, and values that are not positive are left out. Groups without spread have none.
    """
    x = F.ln(value) if log_value else F.col(value).cast("double")
    rows = values.where(F.col(value) > 0) if log_value else values
    rows = rows.where(F.col(value).isNotNull()).select(*keys, x.alias("v"))
    # By running means, not by sums of squares: equal values have no deviation at all.
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("least"), F.max("v").alias("most"))
    share = Window.partitionBy(*(keys if high_from is None else high_from))
    first, last = (F.min("least").over(share), F.max("most").over(share)) if low is None else (F.lit(float(low)), F.max("most").over(share) + 1)
    per = stats.select(*keys, "n", (F.col("sd") * F.pow("n", F.lit(-0.2))).alias("h"), first.alias("first"), last.alias("last")).where("h > 0")
    per = results.cut(per)
    few = per.count() <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(per) if few else per, keys) if keys else rows.join(F.broadcast(per))
    grid = np.arange(points) / max(1, points - 1)
    steps = F.broadcast(rows.sparkSession.range(points).select(F.col("id").alias("i")))  # the points of a figure

    def scattered(batches):
        """For each group the grid's kernel sums over the task's values, from points within the kernel's reach."""
        sums: dict[tuple, np.ndarray] = {}
        names = [*keys, "i", "s"]

        def emitted():
            for key, own in sums.items():
                at = np.flatnonzero(own)
                for k in range(0, len(at), 1 << 16):
                    part = at[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(part), t) for x, t in zip(key, types, strict=True)), pa.array(part.astype(np.int64)), pa.array(own[part])], names=names)
            sums.clear()

        types = []
        for batch in batches:
            types = batch.schema.types[: len(keys)]
            columns = [batch.column(k).to_pylist() for k in range(len(keys))]
            v, _, h, low_x, high_x = (batch.column(len(keys) + k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(5))
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*columns, strict=True) if keys else [()] * batch.num_rows):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                own, times = np.unique(v[at], return_counts=True)
                wide, x = h[at[0]], low_x[at[0]] + (high_x[at[0]] - low_x[at[0]]) * grid
                total = sums.setdefault(key, np.zeros(points))
                for k in range(0, len(own), 1 << 10):
                    part, n = own[k : k + (1 << 10)], times[k : k + (1 << 10)]
                    near = slice(*np.searchsorted(x, [part[0] - REACH * wide, part[-1] + REACH * wide]))
                    total[near] += n @ np.exp(-(((x[near] - part[:, None]) / wide) ** 2) / 2)
            if len(sums) * points > HELD_POINTS:
                yield from emitted()
        yield from emitted()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    found = joined.mapInArrow(scattered, f"{kinds + ', ' if keys else ''}i long, s double").groupBy(*keys, "i").agg(F.sum("s").alias("s"))
    at = per.join(steps).join(found, [*keys, "i"], "left")
    place = F.col("first") + (F.col("last") - F.col("first")) * F.col("i") / max(1, points - 1)
    return at.select(*keys, place.alias("x"), (F.coalesce("s", F.lit(0.0)) / (F.col("n") * F.col("h") * (2 * 3.141592653589793) ** 0.5)).alias("density"))


def heatmap(trajectories: DataFrame, prompt: list[str], values: str, order: str | None = None, max_positions: int | None = None) -> DataFrame:
    """row, pos, value: a line for each rollout, by length within its prompt (``order="global"``: of all, ``"none"``: as
    the rollouts are numbered), padded by absence; ``max_positions``: no more positions than these.

    Lines are numbered within blocks (a prompt, or a length) that start where the counts before them
    end, so no task sorts all lines.
    """
    if order not in (None, "none", "global"):
        raise ValueError('order is None, "none" or "global"')
    block = ["length"] if order == "global" else prompt
    lengths = trajectories.withColumn("length", F.size(values))
    starts = _running_count(lengths, block)
    within = {"global": prompt, "none": [], None: ["length"]}[order]
    place = F.row_number().over(Window.partitionBy(*block).orderBy(*within, "rollout_idx"))
    lined = lengths.join(starts, block).withColumn("row", F.col("end") - F.col("n") + place - 1)
    shown = F.col(values) if max_positions is None else F.slice(values, 1, max_positions)
    return lined.select(*prompt, "rollout_idx", "row", F.posexplode(shown).alias("pos", "value"))


def _running_count(rows: DataFrame, block: list[str]) -> DataFrame:
    """n of each block and where it ends. Blocks are sorted over many tasks; only the tasks' totals, one row each, are summed up in one."""
    n = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    dealt = results.cut(n.repartitionByRange(*block).withColumn("__task", F.spark_partition_id()))
    totals = dealt.groupBy("__task").agg(F.sum("n").alias("__n"))
    before = totals.select("__task", (F.sum("__n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    own = F.sum("n").over(Window.partitionBy("__task").orderBy(*block).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("end", own).join(before, "__task").select(*block, "n", (F.col("end") + F.col("__before")).alias("end"))


def active_counts(trajectories: DataFrame, keys: list[str], values: str) -> DataFrame:
    """For each position how many rollouts have a finite value there."""
    at = trajectories.select(*keys, F.posexplode(values).alias("pos", "value"))
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    return at.groupBy(*keys, "pos").agg(F.count_if(finite).alias("active"))


def prompt_bounds(trajectories: DataFrame, prompt: list[str]) -> DataFrame:
    """Where each prompt's block of lines ends (the line after its last), and the middle of its first and last line."""
    return _running_count(trajectories, prompt).select(*prompt, "n", "end", (F.col("end") - (F.col("n") + 1) / 2).alias("centre"))


def quantile(rows: DataFrame, value: str, q: float, gathered: int = GATHERED) -> float | None:
    """The exact quantile of a column without nulls, between order statistics by linear interpolation; None of no rows.

    An approximate quantile, whose summaries are merged, gives an interval; rows below and within it are
    counted, and those within it narrow it again. Only what is left at last is counted value by value
    on the driver: at most ``gathered`` rows, or one value.
    """
    n = rows.count()
    if not n:
        return None
    rank = q * (n - 1)
    low, below, inside, own = int(rank), 0, n, rows
    high = min(low + 1, n - 1)
    while inside > gathered:
        share, spread = (low - below) / inside, 4 * NARROW
        while True:
            a, b = own.approxQuantile(value, [max(0.0, share - spread), min(1.0, share + spread + 1 / inside)], NARROW)
            under, upto = own.agg(F.count_if(F.col(value) < a), F.count_if(F.col(value) <= b)).first()
            if below + under <= low and high < below + upto:
                break
            spread *= 4  # the interval missed: it is as wide as all rows at last
            if spread > 4:
                a, b = own.agg(F.min(value), F.max(value)).first()
                under, upto = 0, inside
                break
        if a == b:
            return float(a)
        within = own.where(F.col(value).between(a, b))
        if upto - under == inside:
            break  # few values, each many times
        own, below, inside = within, below + under, upto - under
    counts = sorted(map(tuple, own.groupBy(value).count().collect()))
    ends = below + np.cumsum([c for _, c in counts])
    x, y = (float(counts[int(np.searchsorted(ends, k, side="right"))][0]) for k in (low, high))
    return x + (y - x) * (rank - low)


def quantiles(rows: DataFrame, value: str, qs: list[float], gathered: int = GATHERED) -> list[float | None]:
    """Several exact quantiles; few rows are gathered once for all."""
    if rows.limit(gathered + 1).count() > gathered:
        return [quantile(rows, value, q, gathered) for q in qs]
    x = np.array([r[0] for r in rows.select(F.col(value).cast("double")).collect()])
    return [float(np.quantile(x, q)) if len(x) else None for q in qs]


def colour_limits(cells: DataFrame, value: str = "value", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Exact quantiles of the finite values, in one row; the values are written once and never meet in a task."""
    finite = results.cut(cells.where(F.abs(value) < float("inf")).select(F.col(value).cast("double").alias("v")))
    return cells.sparkSession.createDataFrame([tuple(quantiles(finite, "v", [low, high]))], "low double, high double")
