"""Beta regression with random intercepts for prompts and models, by Laplace's approximation, on executors.

Rows are kept as one record a prompt. Each round sums scores and weights over the records; within a
record its intercept is eliminated (the Hessian is an arrow: prompts meet only the fixed effects and
the few models), so what reaches the driver is a matrix as wide as these, whatever the panel's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import results
from .figures import quantiles
from .regression import Coefficient, levels

#: Rounds at most, and the change of coefficients below which the fit has settled.
ROUNDS, SETTLED = 60, 1e-7
_COLUMNS = ("y", "r", "length", "task", "model", "variant")


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 8, then the asymptotic series."""
    x, out = np.array(x, dtype=float), np.zeros(np.shape(x))
    while (small := x < 8).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def trigamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, dtype=float), np.zeros(np.shape(x))
    while (small := x < 8).any():
        out[small] += 1 / x[small] ** 2
        x[small] += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 8, then the asymptotic series."""
    x, out = np.array(x, dtype=float), np.zeros(np.shape(x))
    while (small := x < 8).any():
        out[small] -= np.log(x[small])
        x[small] += 1
    y = 1 / (x * x)
    return out + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x


def natural_spline(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Natural cubic splines, zero at the first knot (the smallest x); they span what other bases of the kind span, an intercept aside. Knots that coincide leave a straight line."""
    df = len(knots) - 1
    if len(np.unique(knots)) < df + 1:
        return (x - knots[0])[:, None]
    last, scale = knots[-1], knots[-1] - knots[0]
    d = lambda k: (np.clip(x - knots[k], 0, None) ** 3 - np.clip(x - last, 0, None) ** 3) / (last - knots[k])
    return np.column_stack([(x - knots[0]) / scale, *((d(k) - d(df - 1)) / scale**2 for k in range(df - 1))])


@dataclass(frozen=True)
class Design:
    """How a row's values become the fixed effects of the mean (x) and of the precision (z)."""

    x: Callable[[dict[str, np.ndarray]], np.ndarray]
    z: Callable[[dict[str, np.ndarray]], np.ndarray]
    x_names: list[str]
    z_names: list[str]
    models: int


@dataclass
class BetaFit:
    mean_terms: dict[str, Coefficient]
    dispersion_terms: dict[str, float]
    deviations: dict[str, float]
    log_likelihood: float
    rounds: int
    #: uid, u (the prompt's intercept) and its rows as arrays; with these and the coefficients every fitted value.
    records: DataFrame
    design: Design
    beta: np.ndarray
    delta: np.ndarray


def records(rows: DataFrame) -> DataFrame:
    """uid, u, and arrays of ``_COLUMNS``: a record for each prompt, whose rows are its runs."""
    own = F.sort_array(F.collect_list(F.struct("model", "variant", "task", "y", "r", "length")))
    held = rows.groupBy("uid").agg(own.alias("own"))
    return held.select("uid", F.lit(0.0).alias("u"), *(F.col(f"own.{c}").cast("array<double>").alias(c) for c in _COLUMNS))


class _Batch:
    """A batch of records as flat columns, with where each record begins and which record a row is of."""

    def __init__(self, batch: pa.RecordBatch, design: Design):
        lists = batch.column(2)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        self.starts, self.of = offsets[:-1], np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        self.u = batch.column(1).to_numpy().copy()
        self.values = {c: batch.column(2 + k).flatten().to_numpy() for k, c in enumerate(_COLUMNS)}
        self.y = self.values["y"]
        self.f = np.hstack([design.x(self.values), np.equal.outer(self.values["model"], np.arange(design.models)).astype(float)])
        self.z = design.z(self.values)

    def at(self, beta: np.ndarray, delta: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Means, precisions and the log likelihood."""
        mu = np.clip(1 / (1 + np.exp(-(self.f @ beta + u[self.of]))), 1e-9, 1 - 1e-9)
        phi = np.exp(np.clip(self.z @ delta, -20, 20))
        a, c = mu * phi, (1 - mu) * phi
        return mu, phi, float((log_gamma(phi) - log_gamma(a) - log_gamma(c) + (a - 1) * np.log(self.y) + (c - 1) * np.log1p(-self.y)).sum())

    def scores(self, beta: np.ndarray, delta: np.ndarray, prior: float):
        """Rows' scores and weights, records' sums of these (with the intercept's prior) and of weighted effects."""
        mu, phi, value = self.at(beta, delta, self.u)
        a, c, slope = mu * phi, (1 - mu) * phi, mu * (1 - mu)
        score = phi * (np.log(self.y) - np.log1p(-self.y) - digamma(a) + digamma(c)) * slope
        weight = phi**2 * (trigamma(a) + trigamma(c)) * slope**2
        s = np.add.reduceat(score, self.starts) - self.u / prior
        h = np.add.reduceat(weight, self.starts) + 1 / prior + 1e-10
        return score, weight, s, h, np.add.reduceat(self.f * weight[:, None], self.starts, axis=0), value


def _summed(held: DataFrame, design: Design, sums: Callable[[_Batch], list[np.ndarray | float]], shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """Sums over all records: each task adds up its own and hands on one row, as wide as the shapes."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = np.concatenate([np.ravel(x) for x in sums(_Batch(batch, design))]).astype(float)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    found = np.sum([r[0] for r in held.mapInArrow(run, "sums array<double>").collect()], axis=0)
    ends = np.cumsum([math.prod(s) for s in shapes])
    return [found[b - math.prod(s) : b].reshape(s) for s, b in zip(shapes, ends, strict=True)]


def fit_beta(held: DataFrame, design: Design, most: int = ROUNDS) -> BetaFit:
    """Mean by logit of x, precision by log of z, one normal intercept for each prompt and each model.

    Alternates penalised scoring steps for the mean and the intercepts, scoring steps for the precision,
    and updates of the intercepts' variances from their conditional moments. Every step that makes the
    rows less likely is halved.
    """
    held = results.cut(held)
    n, m, q = len(design.x_names), design.models, len(design.z_names)
    p = n + m  # effects that prompts share
    y = F.explode("y").alias("y")
    mean, variance, prompts = (*held.select(y).agg(F.avg("y"), F.var_pop("y")).first(), held.count())
    beta, delta = np.zeros(p), np.zeros(q)
    beta[0] = math.log(mean / (1 - mean))
    delta[0] = math.log(max(1.0, mean * (1 - mean) / max(variance, 1e-9) - 1))
    var = {"prompt": 0.1, "model": 0.1}

    def penalty(b: np.ndarray, squares: float) -> float:
        return float((b[n:] ** 2).sum()) / (2 * var["model"]) + squares / (2 * var["prompt"])

    def arrow(b: np.ndarray, d: np.ndarray):
        """At these coefficients: the reduced Hessian, its right side, what traces and determinants need, the likelihood and the squares of intercepts."""
        prior = var["prompt"]

        def sums(x: _Batch):
            score, weight, s, h, c, value = x.scores(b, d, prior)
            return [x.f.T @ (x.f * weight[:, None]), x.f.T @ score, (c / h[:, None]).T @ c, (c / h[:, None]).T @ s, (c / h[:, None] ** 2).T @ c, (1 / h).sum(), np.log(h).sum(), value, (x.u**2).sum()]

        ff, fs, cc, cs, traces, inverse, logs, value, squares = _summed(held, design, sums, [(p, p), (p,), (p, p), (p,), (p, p), (), (), (), ()])
        ff[np.diag_indices(p)] += 1e-10
        ff[range(n, p), range(n, p)] += 1 / var["model"]
        fs[n:] -= b[n:] / var["model"]
        return ff, cc, ff - cc, fs - cs, traces, float(inverse), float(logs), float(value), float(squares)

    def moved(step: np.ndarray, scale: float) -> DataFrame:
        """The records with their intercepts a step on, which each record works out from its own sums."""
        b, d, prior = beta.copy(), delta.copy(), var["prompt"]

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    x = _Batch(batch, design)
                    _, _, s, h, c, _ = x.scores(b, d, prior)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.u + scale * (s - c @ step) / h), *batch.columns[2:]], names=batch.schema.names)

        return results.cut(held.mapInArrow(run, held.schema))

    def precision(b: np.ndarray, d: np.ndarray, of: DataFrame):
        def sums(x: _Batch):
            mu, phi, value = x.at(b, d, x.u)
            a, c = mu * phi, (1 - mu) * phi
            score = phi * (digamma(phi) + mu * (np.log(x.y) - digamma(a)) + (1 - mu) * (np.log1p(-x.y) - digamma(c)))
            weight = phi**2 * np.clip(mu**2 * trigamma(a) + (1 - mu) ** 2 * trigamma(c) - trigamma(phi), 1e-9, None)
            return [x.z.T @ (x.z * weight[:, None]), x.z.T @ score, value, (x.u**2).sum()]

        return _summed(of, design, sums, [(q, q), (q,), (), ()])

    found = arrow(beta, delta)
    for k in range(most):
        before = beta.copy(), delta.copy()
        _, _, reduced, right, traces, inverse, _, value, squares = found
        step, scale = np.linalg.solve(reduced, right), 1.0
        while True:
            trial, after = beta + scale * step, moved(step, scale)
            zz, zs, own, trial_squares = precision(trial, delta, after)
            if scale <= 1e-4 or own - penalty(trial, float(trial_squares)) >= value - penalty(beta, squares):
                break
            scale /= 2
        inner = np.linalg.inv(reduced)
        beta, held, squares = trial, after, float(trial_squares)
        var["model"] = max(1e-8, float((beta[n:] ** 2).sum() + np.trace(inner[n:, n:])) / m)
        var["prompt"] = max(1e-8, (squares + inverse + float((inner * traces).sum())) / prompts)
        step, scale = np.linalg.solve(zz + 1e-8 * np.eye(q), zs), 1.0
        while True:
            found = arrow(beta, delta + scale * step)
            if scale <= 1e-4 or found[7] >= own:
                break
            scale /= 2
        delta = delta + scale * step
        if max(abs(beta - before[0]).max(), abs(delta - before[1]).max()) < SETTLED:
            break
    ff, cc, reduced, _, _, _, logs, value, squares = found
    errors = np.sqrt(np.diag(np.linalg.inv(reduced)))[:n]
    prior = m * math.log(var["model"]) + prompts * math.log(var["prompt"])
    laplace = value - penalty(beta, squares) - (prior + logs + np.linalg.slogdet((ff - cc)[n:, n:])[1]) / 2
    terms = {t: Coefficient(float(b), float(e)) for t, b, e in zip(design.x_names, beta, errors, strict=False)}
    return BetaFit(terms, dict(zip(design.z_names, delta.tolist(), strict=True)), {"prompt_uid": math.sqrt(var["prompt"]), "model_name": math.sqrt(var["model"])}, laplace, k + 1, held, design, beta, delta)


def beta_interaction(panel: DataFrame, y: str = "D01", mean_df: int = 4, dispersion_df: int = 3, base: str = "base", task: str = "completion", spline_by_variant: bool = False) -> BetaFit:
    """The panel's y (within the unit interval) on rate and length by variant and on task, with intercepts for prompts and models.

    ``panel`` has R_sc and invN_sc (``panel.z_scored``). The reference task is the one whose name starts
    with ``task``; none or several are an error. The precision depends on variant by task, length, rate by
    variant and model; with ``spline_by_variant`` (the form for Vendi scores) its spline of length also
    differs by variant. Rows with a null are left out. A prompt's rows, its runs, are one record.
    """
    needed = [y, "R_sc", "invN_sc", "task", "model_name", "model_variant", "prompt_uid"]
    missing = sorted(set(needed) - set(panel.columns))
    if missing:
        raise ValueError(f"the panel lacks {missing}")
    rows = results.cut(panel.select(*needed).dropna())
    tasks = levels(rows, "task")
    reference = [t for t in tasks if t.startswith(task)]
    if len(reference) != 1:
        raise ValueError(f"one task has to start with {task!r}; there are {tasks}")
    tasks, models, variants = levels(rows, "task", reference[0]), levels(rows, "model_name"), levels(rows, "model_variant", base)
    code = lambda column, found: F.array_position(F.array(*map(F.lit, found)), F.col(column)) - 1
    coded = rows.select(F.col("prompt_uid").alias("uid"), F.col(y).cast("double").alias("y"), F.col("R_sc").alias("r"), F.col("invN_sc").alias("length"), code("task", tasks).alias("task"), code("model_name", models).alias("model"), code("model_variant", variants).alias("variant"))
    at = lambda df: np.array(quantiles(rows, "invN_sc", [k / df for k in range(df + 1)]))
    mean_knots, dispersion_knots = at(mean_df), at(dispersion_df)
    cross = lambda a, b: (a[:, :, None] * b[:, None, :]).reshape(len(a), -1)
    pair = lambda a, b: [f"{i}:{j}" for i in a for j in b]
    spline_names = lambda knots: [f"length{k + 1}" for k in range(natural_spline(knots, knots).shape[1])]
    s_names, d_names = spline_names(mean_knots), spline_names(dispersion_knots)

    def parts(c: dict[str, np.ndarray]):
        one = np.ones((len(c["y"]), 1))
        dummies = lambda name, found: np.equal.outer(c[name], np.arange(1, len(found))).astype(float)
        return one, c["r"][:, None], dummies("variant", variants), dummies("task", tasks), dummies("model", models)

    def x(c: dict[str, np.ndarray]) -> np.ndarray:
        one, r, v, t, _ = parts(c)
        ns = natural_spline(c["length"], mean_knots)
        return np.hstack([one, r, v, cross(r, v), ns, cross(ns, v), t])

    def z(c: dict[str, np.ndarray]) -> np.ndarray:
        one, r, v, t, m = parts(c)
        nd = natural_spline(c["length"], dispersion_knots)
        return np.hstack([one, v, t, cross(v, t), nd, r, cross(r, v), m, *([cross(nd, v)] if spline_by_variant else [])])

    v, t, m = variants[1:], tasks[1:], models[1:]
    x_names = ["Intercept", "R_sc", *v, *pair(["R_sc"], v), *s_names, *pair(s_names, v), *t]
    z_names = ["Intercept", *v, *t, *pair(v, t), *d_names, "R_sc", *pair(["R_sc"], v), *m, *(pair(d_names, v) if spline_by_variant else [])]
    return fit_beta(records(coded), Design(x, z, x_names, z_names, len(models)))


def simulated_residuals(fit: BetaFit, n: int = 1000, seed: int = 1) -> DataFrame:
    """uid, place (where y stands among n draws from the fit, in the unit interval), outside (of all draws), square (of y's
    distance from its mean), squares (of each draw's). A row's draws are of a generator keyed by the seed, its prompt and its place in the record: the same however rows are dealt."""
    design, beta, delta = fit.design, fit.beta, fit.delta

    def run(batches):
        import xxhash

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _Batch(batch, design)
            mu, phi, _ = x.at(beta, delta, x.u)
            uids = batch.column(0).to_pylist()
            for at in range(0, len(x.y), 512):
                own = range(at, min(at + 512, len(x.y)))
                places, outside, squares = [], [], []
                for i in own:
                    k = x.of[i]
                    key = xxhash.xxh3_128_intdigest(f"{uids[k]}\n{i - x.starts[k]}".encode(), seed)
                    rng = np.random.Generator(np.random.Philox(key=key))
                    drawn = rng.beta(mu[i] * phi[i], (1 - mu[i]) * phi[i], n)
                    places.append(((drawn < x.y[i]).sum() + rng.random()) / (n + 1))
                    outside.append(bool(x.y[i] < drawn.min() or x.y[i] > drawn.max()))
                    squares.append(((drawn - mu[i]) ** 2).tolist())
                yield pa.RecordBatch.from_arrays([pa.array([uids[x.of[i]] for i in own]), pa.array(places), pa.array(outside), pa.array((x.y[own] - mu[own]) ** 2), pa.array(squares, pa.list_(pa.float64()))], names=["uid", "place", "outside", "square", "squares"])

    return fit.records.mapInArrow(run, "uid string, place double, outside boolean, square double, squares array<double>")


def _binomial_tail(k: int, n: int, p: float) -> float:
    """Two-sided: twice the smaller tail, one at most."""
    if n == 0 or k == n * p:
        return 1.0
    up = k > n * p
    ks = np.arange(k, n + 1) if up else np.arange(0, k + 1)
    ks = ks[:1_000_000] if up else ks[-1_000_000:]  # the rest is smaller than rounding
    logs = log_gamma(np.array([n + 1.0])) - log_gamma(ks + 1.0) - log_gamma(n - ks + 1.0) + ks * math.log(p) + (n - ks) * math.log1p(-p)
    return min(1.0, 2 * float(np.exp(logs).sum()))


def uniformity(places: DataFrame, column: str = "place") -> tuple[float, float]:
    """Largest distance of the column's distribution from the uniform one, and its p value. Values are sorted over many tasks; only how many each has reaches the driver."""
    dealt = results.cut(places.select(column).repartitionByRange(column).sortWithinPartitions(column).withColumn("__task", F.spark_partition_id()))
    counts = dict(map(tuple, dealt.groupBy("__task").count().collect()))
    n, before, starts = sum(counts.values()), 0, {}
    for task in sorted(counts):
        starts[task] = before
        before += counts[task]

    def run(key, table):
        x = np.sort(table[column].to_numpy())
        upto = starts[key[0].as_py()] + np.arange(1, len(x) + 1)
        far = float(np.maximum(np.abs(upto / n - x), np.abs(x - (upto - 1) / n)).max())
        return pa.table({"far": [far]})

    distance = dealt.groupBy("__task").applyInArrow(run, "far double").agg(F.max("far")).first()[0]
    lam = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * distance
    tail = min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101)))) if lam > 0.2 else 1.0
    return float(distance), tail


def residual_tests(fit: BetaFit, n: int = 1000, seed: int = 1) -> dict[str, float]:
    """Simulated residuals: how far from uniform, how the observed dispersion compares with the draws', how many lie outside all draws; a p value each."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = results.cut(simulated_residuals(fit, n, seed))
    distance, tail = uniformity(rows)
    total = vector_to_array(Summarizer.sum(array_to_vector(F.col("squares"))))
    count, outside, observed, drawn = rows.agg(F.count(F.lit(1)), F.count_if("outside"), F.sum("square"), total).first()
    drawn = np.array(drawn)
    less, more = float((drawn <= observed).mean()), float((drawn >= observed).mean())
    return {
        "uniformity_distance": distance, "uniformity_pvalue": tail, "dispersion_ratio": observed / float(drawn.mean()), "dispersion_pvalue": min(1.0, 2 * min(less, more)),
        "outlier_share": outside / count, "outlier_pvalue": _binomial_tail(outside, count, 2 / (n + 1)),
    }
