"""The core computation: from rollouts (with rewards and embeddings where a run has them all) to prompt and pooled metrics, raw and kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Compute, Figures
from ..functions import expr as E
from ..operators import correlation, figures, filtering, semantic, tree
from ..schemas import RUN_KEYS
from ..sources import artifacts, results


def _correlation(rows: DataFrame, a: str, b: str, keys: list[str], name: str) -> DataFrame:
    found = correlation.correlations(rows, a, b, keys)
    return found.select(*keys, F.struct("pearson", "spearman", "kendall", "covariance").alias(name))


def prompt_stats(rollouts: DataFrame, run: list[str], max_new_tokens: int | str, settings: Compute = Compute()) -> DataFrame:
    """One row per run, prompt and subset (raw, kept) with all metrics nested.

    ``rollouts`` has step sums (``tree.rollout_entropies``), ``reward`` if rewards are used and
    ``embedding`` (null where the run has none); ``max_new_tokens`` is a number or a column's name.
    Without embeddings the semantic metrics are null and the buckets empty.
    """
    prompt = [*run, "prompt_id"]
    use = settings.use_reward_filter and "reward" in rollouts.columns
    needed = [*prompt, "rollout_idx", "h_sum", "seq_len", "rate", *(c for c in ("reward", "embedding", max_new_tokens) if c in rollouts.columns)]
    rows = results.cut(filtering.both_subsets(filtering.with_mask(rollouts.select(*needed), settings.keep_fraction, prompt, use)))
    keys = ["subset", *prompt]
    cap = F.col(max_new_tokens) if isinstance(max_new_tokens, str) else F.lit(max_new_tokens)
    out = rows.withColumn("__cap", F.col("seq_len") >= cap).groupBy(*keys).agg(*tree.tree_aggregates(), F.avg(F.col("__cap").cast("double")).alias("truncation_rate")).drop("covariance", "pearson")
    out = out.join(_correlation(rows, "seq_len", "rate", keys, "length_rate"), keys)
    if "embedding" not in rows.columns:
        return out
    inside = rows.where(F.col("embedding").isNotNull())
    diverse = semantic.rollout_diversity(inside, keys)
    out = out.join(semantic.prompt_diversity(diverse, keys).drop("m").withColumnRenamed("diversity", "semantic_diversity"), keys, "left")
    out = out.join(_correlation(diverse.where(F.col("diversity").isNotNull()), "diversity", "seq_len", keys, "diversity_length"), keys, "left")
    out = out.join(semantic.vendi_entropy(inside, keys).drop("m"), keys, "left")
    buckets = semantic.bucket_stats(inside, keys).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("average_similarity", "semantic_diversity", "num_responses", "min_length", "max_length")))).alias("buckets"))
    return out.join(buckets, keys, "left")


def pooled_stats(prompts: DataFrame, run: list[str]) -> DataFrame:
    """One row per run and subset: the nine pooled metrics, nested."""
    keys = ["subset", *run]

    def nested(name: str) -> F.Column:
        r, m = lambda f: F.col(f"{name}.{f}"), F.col("m")
        return F.struct(
            E.fisher_mean(r("pearson"), m - 3).alias("pearson"), E.fisher_mean(r("spearman"), m - 3).alias("spearman"), E.weighted_mean(r("kendall"), m * (m - 1) / 2).alias("kendall"), E.weighted_mean(r("covariance"), m - 1).alias("covariance")
        ).alias(name)

    parts = [
        F.count(F.lit(1)).alias("num_prompts"),
        F.avg("ce_star_max").alias("ce_star_max"),
        E.gen_ppl(F.avg("ce_star_max"), F.avg("mean_length")).alias("gen_ppl"),
        E.branching_factor(F.avg("mean_rate")).alias("branching_factor"),
        F.avg("truncation_rate").alias("truncation_rate"),
        nested("length_rate"),
    ]
    if "buckets" in prompts.columns:
        bucket = lambda b: F.struct(*(F.avg(F.col("buckets")[b][f]).alias(f) for f in ("semantic_diversity",)))
        parts += [F.avg("semantic_diversity").alias("semantic_diversity"), F.exp(F.avg("vendi_entropy")).alias("vendi_score"), nested("diversity_length"), *(bucket(b).alias(b) for b in semantic.BUCKETS)]
    return prompts.groupBy(*keys).agg(*parts)


def flat_summary(pooled: DataFrame, run: list[str]) -> DataFrame:
    """run, name, value: number of prompts and, for each subset, 17 numbers named ``subset.metric[.part]``."""
    long = results.flat_scalars(pooled, ["subset", *run])
    name = F.when(F.col("name") == "num_prompts", F.col("name")).otherwise(F.concat_ws(".", "subset", F.regexp_replace("name", r"^(short|medium|long)\.semantic_diversity$", "bucketed_diversity.$1")))
    return long.where((F.col("name") != "num_prompts") | (F.col("subset") == "raw")).select(*run, name.alias("name"), "value")


def compute_run(store: artifacts.Store, settings: Compute = Compute(), embedding_key: str | None = None, reward_name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(prompt stats, pooled stats) of all runs that a store has in full. Rewards and embeddings count for a run only if they are complete."""
    runs = store.runs().select(*RUN_KEYS, "num_prompts", "max_new_tokens")
    rollouts = tree.rollout_entropies(artifacts.require_complete(runs, store.read("rollouts").select(*RUN_KEYS, "prompt_id", "rollout_idx", "step_entropy")))
    if reward_name is not None:
        rollouts = artifacts.attach(rollouts, store.read("rewards", reward_name=reward_name), "reward", runs)
    if embedding_key is not None:
        rollouts = artifacts.attach(rollouts, store.read("embeddings", embedding_key=embedding_key), "embedding", runs)
    rollouts = rollouts.join(runs.select(*RUN_KEYS, "max_new_tokens"), RUN_KEYS)
    prompts = prompt_stats(rollouts, RUN_KEYS, "max_new_tokens", settings)
    return prompts, pooled_stats(prompts, RUN_KEYS)


def trajectory_table(rollouts: DataFrame, run: list[str], panel: list[str], longest: int, settings: Figures = Figures()) -> DataFrame:
    """The curves of running entropy rates, trimmed within each panel."""
    steps = rollouts.select(*run, "prompt_id", "rollout_idx", F.posexplode("step_entropy").alias("t", "h")).withColumn("t", F.col("t") + 1)
    rates = tree.running_rates(steps, [*run, "prompt_id", "rollout_idx"], run, settings.bin_step)
    return tree.trimmed(tree.trajectories(rates, run, settings.bin_step, longest), run, panel, settings.min_active_rollouts)


def length_figure(rollouts: DataFrame, cell: list[str], series: list[str], mode: str = "kde", settings: Figures = Figures()) -> DataFrame:
    """Densities or histograms of lengths for each series of a cell."""
    if mode == "hist":
        return figures.length_histogram(rollouts, cell, series, settings.bins)
    if mode == "kde":
        return figures.kernel_density(rollouts, [*cell, *series], "seq_len", settings.length_points, 0.0, cell)
    raise ValueError("mode is hist or kde")


def eos_payload(store: artifacts.Store, score: Callable[[], DataFrame], mode: str = "compute_plot") -> DataFrame | None:
    """The EOS trajectories of a store: ``compute_plot`` scores, stores and returns them, ``compute_only`` returns nothing, ``plot_only`` reads what is stored."""
    if mode not in ("compute_plot", "compute_only", "plot_only"):
        raise ValueError("mode is compute_plot, compute_only or plot_only")
    if mode != "plot_only":
        store.reset(score(), "eos", force=True)
    elif not store.exists("eos"):
        raise FileNotFoundError("no EOS trajectories are stored")
    return None if mode == "compute_only" else store.read("eos")
