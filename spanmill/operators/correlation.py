"""Correlations within prompts and their means over prompts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from . import PROMPT, RUN


def _tied_pairs(x: np.ndarray) -> int:
    c = np.unique(x, return_counts=True)[1].astype(np.int64)
    return int((c * (c - 1) // 2).sum())


def discordant_pairs(a: np.ndarray, b: np.ndarray) -> int:
    """Pairs that a and b order in opposite ways, by merging sorted halves: n log n steps."""
    order = np.lexsort((b, a))
    y = np.unique(b, return_inverse=True)[1][order].astype(np.int64)
    n, width, found = len(y), 1, 0
    big = n + 1
    while width < n:
        # Blocks of this width are sorted; of two neighbours, count for each of the right how many of the left are larger.
        block = np.arange(n) // (2 * width)
        right = (np.arange(n) // width) % 2 == 1
        key = block * big + y
        left_keys = key[~right]
        after = np.searchsorted(left_keys, (block[right] + 1) * big, side="left")
        found += int((after - np.searchsorted(left_keys, key[right], side="right")).sum())
        y = np.sort(key) - block * big
        width *= 2
    return found


def kendall_tau_b(a: np.ndarray, b: np.ndarray) -> float | None:
    n = len(a)
    pairs = n * (n - 1) // 2
    tied_a, tied_b = _tied_pairs(a), _tied_pairs(b)
    if tied_a == pairs or tied_b == pairs:
        return None
    both = np.unique(np.column_stack([a, b]), axis=0, return_counts=True)[1].astype(np.int64)
    tied = int((both * (both - 1) // 2).sum())
    ordered = pairs - tied_a - tied_b + tied
    return float((ordered - 2 * discordant_pairs(a, b)) / np.sqrt(float(pairs - tied_a) * float(pairs - tied_b)))


def kendall(rows: DataFrame, a: str, b: str, keys: list[str] = PROMPT) -> DataFrame:
    """Kendall's tau-b of each group; null if either side is constant. A group's two columns are held by one task: 16 bytes a row."""
    schema = rows.select(*keys).schema
    pairs = rows.select(*keys, F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b")).where("__a is not null and __b is not null")

    def one(key, table):
        tau = kendall_tau_b(table["__a"].to_numpy(), table["__b"].to_numpy())
        return pa.Table.from_arrays([*(pa.array([k.as_py()], table.schema.field(n).type) for k, n in zip(key, keys, strict=True)), pa.array([tau], pa.float64())], names=[*keys, "kendall"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return pairs.groupBy(*keys).applyInArrow(one, f"{kinds}, kendall double")


def mid_rank(x: str, keys: list[str]):
    """Rank within the group; ties share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2


def correlations(rows: DataFrame, a: str, b: str, keys: list[str] = PROMPT, with_kendall: bool = True) -> DataFrame:
    """n, pearson, spearman, covariance (and kendall) of two columns within each group; undefined ones are null."""
    ranked = rows.withColumns({"__ra": mid_rank(a, keys), "__rb": mid_rank(b, keys)})
    out = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), E.pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias("pearson"), E.pearson("__ra", "__rb").alias("spearman"), F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias("covariance")
    )
    if not with_kendall:
        return out
    names = {k: f"__{k}" for k in keys}
    other = kendall(rows, a, b, keys).withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]
    return out.join(other, same, "left").drop(*names.values())


def pooled_correlations(prompts: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Over prompts: Pearson and Spearman by Fisher's z with weights n - 3, Kendall with n (n - 1) / 2, covariance with n - 1."""
    n = F.col("n")
    return prompts.groupBy(*keys).agg(
        E.fisher_mean(F.col("pearson"), n - 3).alias("pearson"),
        E.fisher_mean(F.col("spearman"), n - 3).alias("spearman"),
        *([E.weighted_mean(F.col("kendall"), n * (n - 1) / 2).alias("kendall")] if "kendall" in prompts.columns else []),
        E.weighted_mean(F.col("covariance"), n - 1).alias("covariance"),
    )
