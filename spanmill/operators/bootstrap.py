"""Paired bootstrap over prompts between two variants of a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E

#: Replicates, seed, level; of metrics that are positive a percentage is reported as well.
N_BOOT, SEED, CI_LEVEL = 2000, 42, 0.95
POSITIVE = ["ce_star_max", "gen_ppl", "branching_factor"]
#: Draws that a task makes at once, and prompts that it holds before it adds them up.
DRAWN, HELD = 1 << 22, 1 << 17

#: For a number of prompts the positions that replicates draw, some replicates at a time and in order: arrays of (replicates, prompts).
Draws = Callable[[int], Iterator[np.ndarray]]


def seeded_draws(n_boot: int = N_BOOT, seed: int = SEED) -> Draws:
    """The generator's draws with replacement, the same for every comparison over as many prompts. Every task that needs them makes the same stream."""

    def draws(n_prompts: int) -> Iterator[np.ndarray]:
        rng, step = np.random.default_rng(seed), max(1, DRAWN // n_prompts)
        for at in range(0, n_boot, step):
            yield rng.integers(0, n_prompts, (min(step, n_boot - at), n_prompts))

    return draws


def paired(prompts: DataFrame, pair: list[str], variant: str = "model_variant", base: str = "base", other: str = "instruct") -> DataFrame:
    """Prompts of both variants with ``pos`` (0-based place in the pair's common order) and ``n_prompts``.

    Pairs that lack a variant are left out; variants over different prompts are an error.
    """
    rows = prompts.where(F.col(variant).isin(base, other))
    per = rows.groupBy(*pair, variant).agg(F.count(F.lit(1)).alias("n_prompts"), F.sum(F.xxhash64("prompt_id").cast("decimal(38,0)")).alias("which"))
    both = per.groupBy(*pair).agg(F.count(F.lit(1)).alias("variants"), F.min("n_prompts").alias("n_prompts"), (F.min("n_prompts") == F.max("n_prompts")).alias("as_many"), (F.min("which") == F.max("which")).alias("same"))
    ok = F.when(F.col("as_many") & F.col("same"), True).otherwise(F.raise_error(F.lit("the variants of a pair have different prompts")).cast("boolean"))
    both = both.where("variants = 2").where(ok).select(*pair, "n_prompts")
    pos = F.row_number().over(Window.partitionBy(*pair, variant).orderBy("prompt_id")) - 1
    return rows.join(both, pair).withColumn("pos", pos.cast("long"))


@dataclass(frozen=True)
class Metric:
    """A metric of sums: what each prompt adds, and the metric from the sums of these (by name)."""

    parts: dict[str, Column]
    of: Callable[[dict[str, Column]], Column]


def _mean(value: str) -> Metric:
    x = F.col(value).cast("double")
    return Metric({"s": F.coalesce(x, F.lit(0.0)), "n": x.isNotNull().cast("double")}, lambda p: F.try_divide(p["s"], p["n"]))


def _weighted(value: Column, weight: Column, of: Callable[[Column], Column] = lambda x: x) -> Metric:
    """``expr.weighted_mean`` of sums."""
    x, ok = value.cast("double"), value.isNotNull() & (weight > 0)
    parts = {"wx": F.when(ok, x * weight).otherwise(0.0), "w": F.when(ok, weight.cast("double")).otherwise(0.0), "x": F.coalesce(x, F.lit(0.0)), "n": x.isNotNull().cast("double")}
    return Metric(parts, lambda p: of(F.coalesce(F.try_divide(p["wx"], p["w"]), F.try_divide(p["x"], p["n"]))))


def _both(a: Metric, b: Metric, of: Callable[[Column, Column], Column]) -> Metric:
    named = lambda k, m: {f"{k}{n}": c for n, c in m.parts.items()}
    own = lambda k, m, p: m.of({n: p[f"{k}{n}"] for n in m.parts})
    return Metric(named("a", a) | named("b", b), lambda p: of(own("a", a, p), own("b", b, p)))


def pooled_metrics() -> dict[str, Metric]:
    n, z = F.col("n"), lambda c: F.atanh(E.clamp(F.col(c), -E.FISHER_LIMIT, E.FISHER_LIMIT))
    rate = _mean("mean_rate")
    out = {"ce_star_max": _mean("ce_star_max"), "gen_ppl": _both(_mean("ce_star_max"), _mean("mean_length"), E.gen_ppl), "branching_factor": Metric(rate.parts, lambda p: E.branching_factor(rate.of(p)))}
    out |= {"pearson": _weighted(z("pearson"), n - 3, F.tanh), "spearman": _weighted(z("spearman"), n - 3, F.tanh)}
    return out | {"kendall": _weighted(F.col("kendall"), n * (n - 1) / 2), "covariance": _weighted(F.col("covariance"), n - 1)}


def replicate_sums(rows: DataFrame, keys: list[str], parts: list[str], draws: Draws) -> DataFrame:
    """keys, b and the sums of the parts over the prompts that replicate b draws, each as often as it is drawn.

    ``rows`` has pos and n_prompts (``paired``). A task keeps a running sum for each replicate of its
    groups: it counts how often each of its prompts is drawn and adds these multiples of their parts. What
    is shuffled is a row for each group and replicate, whatever the number of prompts.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        types = [None] * len(keys)

        def add(held: dict[tuple, list]) -> None:
            by_size: dict[int, list[tuple]] = {}
            for key in held:
                by_size.setdefault(key[-1], []).append(key)
            for n, members in by_size.items():
                own = {key: tuple(np.concatenate(x) for x in zip(*held[key], strict=True)) for key in members}
                b = 0
                for drawn in draws(n):
                    times = np.zeros((len(drawn), n))
                    np.add.at(times, (np.arange(len(drawn))[:, None], drawn), 1)
                    for key in members:
                        pos, x = own[key]
                        if key[:-1] not in sums or len(sums[key[:-1]]) < b + len(drawn):
                            had = sums.get(key[:-1], np.zeros((0, len(parts))))
                            sums[key[:-1]] = np.concatenate([had, np.zeros((b + len(drawn) - len(had), len(parts)))])
                        sums[key[:-1]][b : b + len(drawn)] += times[:, pos] @ x
                    b += len(drawn)
            held.clear()

        held, rows_held = {}, 0
        for batch in batches:
            types = batch.schema.types[: len(keys)]
            pos, n = batch.column(len(keys)).to_numpy(), batch.column(len(keys) + 1).to_pylist()
            x = np.column_stack([batch.column(len(keys) + 2 + k).to_numpy(zero_copy_only=False) for k in range(len(parts))])
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(len(keys))), n, strict=True)):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                held.setdefault(key, []).append((pos[at], x[at]))
            rows_held += batch.num_rows
            if rows_held >= HELD:
                add(held)
                rows_held = 0
        add(held)
        for key, own in sums.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(own), t) for v, t in zip(key, types, strict=True)), pa.array(np.arange(len(own), dtype=np.int32)), *(pa.array(own[:, k]) for k in range(len(parts)))], names=[*keys, "b", *parts])

    found = rows.select(*keys, "pos", F.col("n_prompts").cast("long"), *(F.col(p).cast("double") for p in parts)).mapInArrow(run, f"{kinds}, b int, {', '.join(f'{p} double' for p in parts)}")
    return found.groupBy(*keys, "b").agg(*(F.sum(p).alias(p) for p in parts))


def comparison(prompts: DataFrame, draws: Draws, pair: list[str], ci_level: float = CI_LEVEL, variant: str = "model_variant", base: str = "base", other: str = "instruct", metrics: dict[str, Metric] | None = None, positive: list[str] = POSITIVE) -> DataFrame:
    """pair, metric, contrast (base, instruct, delta, percent_delta), value, se, ci_low, ci_high.

    value is from the prompts as they are, se the replicates' sample deviation, the bounds are their
    quantiles by linear interpolation. One undefined replicate makes the spread undefined.
    """
    metrics = metrics or pooled_metrics()
    rows = paired(prompts, pair, variant, base, other)
    named = {f"{name}__{part}": column for name, m in metrics.items() for part, column in m.parts.items()}
    rows = rows.select(*pair, variant, "pos", "n_prompts", *(c.alias(n) for n, c in named.items()))
    from_sums = [m.of({part: F.col(f"{name}__{part}") for part in m.parts}).alias(name) for name, m in metrics.items()]

    def contrasts(aggregated: DataFrame, keys: list[str]) -> DataFrame:
        long = aggregated.select(*keys, variant, F.stack(F.lit(len(metrics)), *(x for name in metrics for x in (F.lit(name), F.col(name)))).alias("metric", "x"))
        wide = long.groupBy(*keys, "metric").agg(F.max(F.when(F.col(variant) == base, F.col("x"))).alias("x0"), F.max(F.when(F.col(variant) == other, F.col("x"))).alias("x1"))
        delta = F.col("x1") - F.col("x0")
        percent = F.when(F.col("metric").isin(positive), E.ratio(100 * delta, F.abs("x0")))
        return wide.select(*keys, "metric", F.stack(F.lit(4), F.lit("base"), F.col("x0"), F.lit("instruct"), F.col("x1"), F.lit("delta"), delta, F.lit("percent_delta"), percent).alias("contrast", "value")).where((F.col("contrast") != "percent_delta") | F.col("metric").isin(positive))

    whole = rows.groupBy(*pair, variant).agg(*(F.sum(n).alias(n) for n in named))
    value = contrasts(whole.select(*pair, variant, *from_sums), pair)
    sums = replicate_sums(rows, [*pair, variant], list(named), draws)
    replicates = contrasts(sums.select(*pair, variant, "b", *from_sums), [*pair, "b"])
    tail = (1 - ci_level) / 2
    whole = F.count("value") == F.count(F.lit(1))
    spread = replicates.groupBy(*pair, "metric", "contrast").agg(F.when(whole, F.stddev_samp("value")).alias("se"), F.when(whole, F.percentile("value", F.lit(tail))).alias("ci_low"), F.when(whole, F.percentile("value", F.lit(1 - tail))).alias("ci_high"))
    return value.join(spread, [*pair, "metric", "contrast"], "left")
