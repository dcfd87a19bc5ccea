"""Panels: one row per run and prompt, as the regressions take them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from . import PROMPT


def prompt_uid(task: str = "task", prompt_id: str = "prompt_id"):
    """Names a prompt across models and variants."""
    return F.concat_ws("/", F.col(task), F.col(prompt_id).cast("string"))


def panel(tree: DataFrame, diversity: DataFrame, vendi: DataFrame | None = None, keys: list[str] = PROMPT) -> DataFrame:
    """task, prompt_id, model_name, model_variant, D, log_VS, VS, R_bar, N_bar, M, prompt_uid; rows without D are dropped."""
    joined = tree.select(*keys, "m", "mean_rate", "mean_length").join(diversity.select(*keys, F.col("diversity").alias("D")), keys)
    joined = joined.join(vendi.select(*keys, F.col("vendi_entropy").alias("log_VS")), keys, "left") if vendi is not None else joined.withColumn("log_VS", F.lit(None).cast("double"))
    return joined.where(F.col("D").isNotNull()).select(*keys, "D", "log_VS", F.exp("log_VS").alias("VS"), F.col("mean_rate").alias("R_bar"), F.col("mean_length").alias("N_bar"), F.col("m").alias("M"), prompt_uid().alias("prompt_uid"))


def rse_panel(tree: DataFrame, entropies: DataFrame, keys: list[str] = PROMPT) -> DataFrame:
    """The judged prompts: cluster entropy over the ``judged`` rollouts, rates and lengths over all M."""
    return tree.select(*keys, F.col("m").alias("M"), F.col("mean_rate").alias("R_bar"), F.col("mean_length").alias("N_bar")).join(entropies.withColumnRenamed("m", "judged"), keys).select(*keys, "RSE", "RSE_norm", "n_clusters", "judged", "R_bar", "N_bar", "M", prompt_uid().alias("prompt_uid"))


def saturation(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How often all judged rollouts differ, and means, by group; distinct prompts."""
    return rows.groupBy(*keys).agg(F.avg((F.col("n_clusters") == F.col("judged")).cast("double")).alias("saturated"), F.avg("RSE").alias("RSE"), F.avg("RSE_norm").alias("RSE_norm"), F.avg("n_clusters").alias("n_clusters"), F.count_distinct("prompt_uid").alias("prompts"))


def z_scored(rows: DataFrame) -> DataFrame:
    """Adds R_sc and invN_sc (z scores of R_bar and 1 / N_bar by sample deviation), D01 and VS01 (drawn into the open unit interval)."""
    inverse = E.ratio(F.lit(1.0), "N_bar")
    stats = rows.agg(F.avg("R_bar").alias("r_mean"), F.stddev_samp("R_bar").alias("r_sd"), F.avg(inverse).alias("n_mean"), F.stddev_samp(inverse).alias("n_sd"))
    unit = lambda x: E.clamp(x, 1e-6, 1 - 1e-6)
    return (
        rows.join(F.broadcast(stats))  # one row
        .withColumns({"R_sc": E.ratio(F.col("R_bar") - F.col("r_mean"), "r_sd"), "invN_sc": E.ratio(inverse - F.col("n_mean"), "n_sd"), "D01": unit(F.abs("D")), "VS01": unit(E.ratio(F.col("VS") - 1, F.col("M") - 1))})
        .drop("r_mean", "r_sd", "n_mean", "n_sd")
    )
