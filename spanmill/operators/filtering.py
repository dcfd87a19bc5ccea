"""Filtering by reward, and the raw and kept variants of everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import PROMPT

#: A fixed value: the share of rollouts that is kept.
KEEP_FRACTION = 0.7


def keep_mask(keep_fraction: float = KEEP_FRACTION, keys: list[str] = PROMPT, reward: str = "reward", tie: str = "rollout_idx") -> Column:
    """Whether a rollout is among the best ``ceil(keep_fraction * m)`` of its prompt; ties go to the smaller index, null rewards come last."""
    if not 0 < keep_fraction <= 1:
        raise ValueError("keep_fraction must be in (0, 1]")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(reward).desc_nulls_last(), tie))
    return place <= F.ceil(F.lit(float(keep_fraction)) * F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def with_mask(rollouts: DataFrame, keep_fraction: float = KEEP_FRACTION, keys: list[str] = PROMPT, use_filter: bool = True) -> DataFrame:
    return rollouts.withColumn("keep", keep_mask(keep_fraction, keys) if use_filter else F.lit(True))


def kept(rollouts: DataFrame, keep_fraction: float = KEEP_FRACTION, keys: list[str] = PROMPT) -> DataFrame:
    return with_mask(rollouts, keep_fraction, keys).where("keep").drop("keep")


def both_subsets(masked: DataFrame) -> DataFrame:
    """Every rollout as ``raw`` and, if it is kept, once more as ``kept``, so that one aggregation serves both."""
    return masked.withColumn("subset", F.explode(F.when(F.col("keep"), F.array(F.lit("raw"), F.lit("kept"))).otherwise(F.array(F.lit("raw")))))
