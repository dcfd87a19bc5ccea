"""Entropy of the generation tree: rollouts, prompts, runs, and along positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from . import PROMPT, RUN


def rollout_entropies(rollouts: DataFrame, steps: str = "step_entropy") -> DataFrame:
    """Adds h_sum, seq_len and rate from arrays of step entropies; an empty rollout is an error."""
    n = F.size(steps)
    total = F.aggregate(F.col(steps), F.lit(0.0), lambda s, x: s + x.cast("double"))
    checked = F.when(n > 0, total).otherwise(F.raise_error(F.lit("a rollout has no steps")).cast("double"))
    return rollouts.withColumn("h_sum", checked).withColumn("seq_len", n.cast("long")).withColumn("rate", E.entropy_rate("h_sum", "seq_len"))


#: Scores of a step are summed up relative to the nearest multiple of this, so that no exponential over- or underflows.
SPAN = 600.0


def step_entropies(candidates: DataFrame, keys: list[str], score: str) -> DataFrame:
    """keys, h (entropy in nats of the normalised scores) and k (candidates) of each step, from a row for each candidate.

    Scores are logs of any size; -inf, NaN and null are candidates that are out. Candidates are summed
    up before the shuffle by the span that holds them; a step has as many rows then as spans, mostly one.
    """
    x = F.when((F.col(score) > float("-inf")) & (F.col(score) < float("inf")), F.col(score).cast("double"))
    span = F.round(x / SPAN)
    y = x - span * SPAN
    by_span = candidates.groupBy(*keys, span.alias("__span")).agg(F.count(x).alias("k"), F.sum(F.exp(y)).alias("__s"), F.sum(y * F.exp(y)).alias("__w"))
    held = F.collect_list(F.when(F.col("k") > 0, F.struct("__span", "__s", "__w"))).alias("__held")
    per = by_span.groupBy(*keys).agg(F.sum("k").alias("k"), F.max("__span").alias("__top"), held)
    away = lambda p: (p["__span"] - F.col("__top")) * SPAN  # noqa: E731  0 for the highest span, else -600 or less
    total = F.aggregate("__held", F.lit(0.0), lambda t, p: t + p["__s"] * F.exp(away(p)))
    weighted = F.aggregate("__held", F.lit(0.0), lambda t, p: t + (p["__w"] + p["__s"] * away(p)) * F.exp(away(p)))
    return per.select(*keys, F.when(F.col("k") > 1, F.greatest(F.ln(total) - weighted / total, F.lit(0.0))).when(F.col("k") == 1, 0.0).alias("h"), F.col("k").cast("long").alias("k"))


def rollout_sums(steps: DataFrame, keys: list[str], h: str = "h") -> DataFrame:
    """``rollout_entropies`` from a row for each step."""
    return steps.groupBy(*keys).agg(F.sum(h).alias("h_sum"), F.count(F.lit(1)).alias("seq_len")).withColumn("rate", E.entropy_rate("h_sum", "seq_len"))


def tree_aggregates(max_new_tokens: int | None = None) -> list[Column]:
    """Aggregates over a prompt's rollouts."""
    n = F.col("seq_len").cast("double")
    out = [
        F.count(F.lit(1)).alias("m"),
        F.avg("h_sum").alias("ce_star_max"),
        F.avg(n).alias("mean_length"),
        F.avg("rate").alias("mean_rate"),
        E.gen_ppl(F.avg("h_sum"), F.avg(n)).alias("gen_ppl"),
        E.branching_factor(F.avg("rate")).alias("branching_factor"),
        F.covar_samp(n, "rate").alias("covariance"),
        E.pearson(n, F.col("rate")).alias("pearson"),
    ]
    return out if max_new_tokens is None else [*out, F.avg((F.col("seq_len") >= max_new_tokens).cast("double")).alias("truncation_rate")]


def prompt_metrics(rollouts: DataFrame, keys: list[str] = PROMPT, max_new_tokens: int | None = None) -> DataFrame:
    """Tree metrics of each prompt, in one aggregation."""
    return rollouts.groupBy(*keys).agg(*tree_aggregates(max_new_tokens))


def pooled_metrics(prompts: DataFrame, keys: list[str] = RUN, extra: dict[str, Column] | None = None) -> DataFrame:
    """Run metrics from prompts', each prompt with the same weight: means first, exponentials after."""
    return prompts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("prompts"),
        F.avg("ce_star_max").alias("ce_star_max"),
        E.gen_ppl(F.avg("ce_star_max"), F.avg("mean_length")).alias("gen_ppl"),
        E.branching_factor(F.avg("mean_rate")).alias("branching_factor"),
        *([F.avg("truncation_rate").alias("truncation_rate")] if "truncation_rate" in prompts.columns else []),
        E.fisher_mean(F.col("pearson"), F.col("m") - 3).alias("pearson"),
        E.weighted_mean(F.col("covariance"), F.col("m") - 1).alias("covariance"),
        *((c.alias(n) for n, c in (extra or {}).items())),
    )


def running_rates(steps: DataFrame, rollout: list[str], keys: list[str], bin_step: int = 5, t: str = "t", h: str = "h") -> DataFrame:
    """At every bin_step-th position: the sum of the rollouts' entropies per token so far, and how many rollouts get there."""
    so_far = F.sum(h).over(Window.partitionBy(*rollout).orderBy(t).rowsBetween(Window.unboundedPreceding, 0))
    at = steps.withColumn("rate", so_far / F.col(t)).where(F.col(t) % bin_step == 0)
    return at.groupBy(*keys, t).agg(F.sum("rate").alias("rate_sum"), F.count(F.lit(1)).alias("active"))


def trajectories(rates: DataFrame, keys: list[str], bin_step: int, longest: int, t: str = "t") -> DataFrame:
    """Mean rates at all positions up to the longest; positions that no rollout reaches have a mean and a count of 0."""
    grid = rates.select(*keys).distinct().withColumn(t, F.explode(F.sequence(F.lit(bin_step), F.lit(max(bin_step, longest // bin_step * bin_step)), F.lit(bin_step)))).withColumn(t, F.col(t).cast(rates.schema[t].dataType))
    found = grid.join(rates, [*keys, t], "left")
    active = F.coalesce("active", F.lit(0))
    return found.select(*keys, t, (F.coalesce("rate_sum", F.lit(0.0)) / F.greatest(active, F.lit(1))).alias("mean_rate"), active.cast("long").alias("active"))


def trimmed(curves: DataFrame, keys: list[str], panel: list[str], min_active: int = 1, t: str = "t") -> DataFrame:
    """Of each panel's curves the first positions only: as many as the shortest curve has with enough active rollouts."""
    per_curve = curves.groupBy(*keys).agg(F.count_if(F.col("active") >= min_active).alias("n"))
    shortest = per_curve.groupBy(*panel).agg(F.min("n").alias("n_bins"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(t))
    return curves.withColumn("place", place).join(F.broadcast(shortest) if not panel else shortest, panel).where("place <= n_bins").drop("place", "n_bins")


def within_prompt_variance(rollouts: DataFrame, keys: list[str] = PROMPT) -> DataFrame:
    """Sample variances of length and rate of each prompt with two rollouts or more."""
    return rollouts.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.var_samp(F.col("seq_len").cast("double")).alias("length_variance"), F.var_samp("rate").alias("rate_variance")).where("m >= 2")


def decomposition(pooled: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Pooled cumulative entropy split into shares of length and of covariance."""
    return pooled.select(*keys, E.ce_decomposition("ce_star_max", "gen_ppl", "branching_factor").alias("d")).select(*keys, "d.*")
