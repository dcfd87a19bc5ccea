"""Random-intercept regressions from sufficient statistics.

Workers reduce each group to sums of products; what the fit needs of all groups is their sum by the
group's size, so the driver gets a few small matrices, whatever the panel's size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.results import cut

Z95 = 1.959963984540054


@dataclass(frozen=True)
class Coefficient:
    """Estimate, standard error, two-sided normal p value, 95% interval."""

    estimate: float
    stderr: float

    @property
    def pvalue(self) -> float:
        return math.erfc(abs(self.estimate / self.stderr) / math.sqrt(2)) if self.stderr > 0 else float("nan")

    @property
    def interval(self) -> tuple[float, float]:
        return self.estimate - Z95 * self.stderr, self.estimate + Z95 * self.stderr

    def as_row(self, term: str) -> tuple:
        return term, self.estimate, self.stderr, self.pvalue, *self.interval


@dataclass
class Fit:
    terms: dict[str, Coefficient]
    sigma2: float
    theta: float
    log_likelihood: float
    n_obs: int
    n_groups: int
    extra: dict[str, float] = field(default_factory=dict)

    def rows(self) -> list[tuple]:
        return [c.as_row(t) for t, c in self.terms.items()]


def levels(rows: DataFrame, column: str, reference: str | None = None) -> list[str]:
    """Levels of a factor, the reference (the first in order unless named) first. A factor has few levels; more than a thousand are an error."""
    found = sorted(r[0] for r in rows.select(column).distinct().limit(1001).collect())
    if len(found) > 1000:
        raise ValueError(f"{column} has too many levels for a factor")
    if reference is not None:
        if reference not in found:
            raise ValueError(f"{column} lacks the level {reference}")
        found = [reference, *(x for x in found if x != reference)]
    return found


def dummies(column: str, found: list[str]) -> dict[str, Column]:
    return {f"{column}[{x}]": (F.col(column) == x).cast("double") for x in found[1:]}


def products(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return {f"{x}:{y}": a[x] * b[y] for x in a for y in b}


def statistics(rows: DataFrame, y: str, design: dict[str, Column], group: str) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """By group size n: (n, groups, sum of zz', sum of (sum z)(sum z)') with z = (design, y). As many rows as there are group sizes."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    k = len(design) + 1
    z = rows.select(F.col(group).alias("g"), F.array(*(c.cast("double") for c in design.values()), F.col(y).cast("double")).alias("z")).where(F.forall("z", lambda x: x.isNotNull()))
    outer = lambda a: F.flatten(F.transform(a, lambda p: F.transform(a, lambda q: p * q)))
    total = lambda c: vector_to_array(Summarizer.sum(array_to_vector(c)))
    per = z.groupBy("g").agg(F.count(F.lit(1)).alias("n"), total(F.col("z")).alias("s"), total(outer(F.col("z"))).alias("zz"))
    found = per.groupBy("n").agg(F.count(F.lit(1)).alias("groups"), total(F.col("zz")).alias("zz"), total(outer(F.col("s"))).alias("ss")).collect()
    return [(r["n"], r["groups"], np.array(r["zz"]).reshape(k, k), np.array(r["ss"]).reshape(k, k)) for r in found]


def solve(stats: list[tuple[int, int, np.ndarray, np.ndarray]], names: list[str], reml: bool = True) -> Fit:
    """Linear mixed model with one random intercept: the variance ratio is profiled in one dimension, the rest is generalised least squares."""
    p = len(names)
    n_obs, n_groups = sum(n * g for n, g, _, _ in stats), sum(g for _, g, _, _ in stats)
    free = n_obs - p if reml else n_obs

    def at(theta: float):
        a = sum(zz - theta / (1 + n * theta) * ss for n, _, zz, ss in stats)
        xx, xy, yy = a[:p, :p], a[:p, p], a[p, p]
        beta = np.linalg.solve(xx, xy)
        rss = max(float(yy - xy @ beta), 1e-300)
        log_det = sum(g * math.log1p(n * theta) for n, g, _, _ in stats)
        value = free * math.log(2 * math.pi * rss / free) + free + log_det + (np.linalg.slogdet(xx)[1] if reml else 0.0)
        return -value / 2, beta, rss / free, xx

    golden = (math.sqrt(5) - 1) / 2
    grid = np.linspace(-12, 12, 49)
    best = max(grid, key=lambda t: at(math.exp(t))[0])
    low, high = best - 0.5, best + 0.5
    for _ in range(80):
        a, b = high - golden * (high - low), low + golden * (high - low)
        if at(math.exp(a))[0] < at(math.exp(b))[0]:
            low = a
        else:
            high = b
    theta = math.exp((low + high) / 2)
    if at(0.0)[0] >= at(theta)[0]:
        theta = 0.0
    log_likelihood, beta, sigma2, xx = at(theta)
    errors = np.sqrt(np.diag(np.linalg.inv(xx)) * sigma2)
    return Fit({n: Coefficient(float(b), float(e)) for n, b, e in zip(names, beta, errors, strict=True)}, sigma2, theta, log_likelihood, n_obs, n_groups)


#: Columns that every regression over a panel needs, beside its response.
PANEL = ("N_bar", "R_bar", "model_name", "model_variant", "prompt_uid", "task")


def require_columns(panel: DataFrame, y: str) -> None:
    """All missing columns are named in one error, before any work."""
    missing = sorted({y, *PANEL} - set(panel.columns))
    if missing:
        raise ValueError(f"the panel lacks {missing}")


def fit(rows: DataFrame, y: str, design: dict[str, Column], group: str = "prompt_uid", reml: bool = True) -> Fit:
    missing = {y, group} - set(rows.columns)
    if missing:
        raise ValueError(f"the panel lacks {sorted(missing)}")
    return solve(statistics(rows, y, design, group), list(design), reml)


def normal_equations(rows: DataFrame, y: str, design: dict[str, Column], found: Fit, group: str = "prompt_uid") -> DataFrame:
    """term, residual: what is left of each of the fit's normal equations at its variance ratio, x'(y - xb) by groups, from the rows themselves; a fit leaves nothing."""
    names = list(design)
    e = F.col(y).cast("double") - sum((design[n] * found.terms[n].estimate for n in names), F.lit(0.0))
    z = rows.select(F.col(group).alias("g"), F.array(*(c.cast("double") for c in design.values()), e).alias("z")).where(F.forall("z", lambda x: x.isNotNull()))
    p = len(names)
    own = [F.sum(F.col("z")[j]).alias(f"s{j}") for j in range(p + 1)] + [F.sum(F.col("z")[j] * F.col("z")[p]).alias(f"t{j}") for j in range(p)]
    per = z.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *own)
    w = found.theta / (1 + F.col("n") * found.theta)
    left = per.agg(*(F.sum(F.col(f"t{j}") - w * F.col(f"s{j}") * F.col(f"s{p}")).alias(f"r{j}") for j in range(p)))
    return left.select(F.stack(F.lit(p), *(x for j, n in enumerate(names) for x in (F.lit(n), F.col(f"r{j}")))).alias("term", "residual"))


def main_design(panel: DataFrame) -> dict[str, Column]:
    model, variant = dummies("model_name", levels(panel, "model_name")), dummies("model_variant", levels(panel, "model_variant"))
    return {"Intercept": F.lit(1.0), **dummies("task", levels(panel, "task")), **model, **variant, **products(model, variant), "R_bar": F.col("R_bar"), "N_bar": F.col("N_bar")}


def main_regression(panel: DataFrame, y: str = "D") -> Fit:
    """y on rate, length, task and the product of model and variant, with an intercept for each prompt (REML)."""
    require_columns(panel, y)
    panel = cut(panel)  # read for its levels, then for its sums
    return fit(panel, y, main_design(panel))


def interaction_design(panel: DataFrame, tuned: str = "instruct", base: str = "base") -> dict[str, Column]:
    found = levels(panel, "model_variant", base)
    if tuned not in found:
        raise ValueError(f"model_variant lacks the level {tuned}")
    variant = dummies("model_variant", found)
    return {"Intercept": F.lit(1.0), **dummies("task", levels(panel, "task")), **dummies("model_name", levels(panel, "model_name")), **variant, "R_bar": F.col("R_bar"), **{f"R_bar:{n}": F.col("R_bar") * c for n, c in variant.items()}, "N_bar": F.col("N_bar")}


def interaction_regression(panel: DataFrame, y: str = "D", tuned: str = "instruct", base: str = "base") -> Fit:
    """y on the product of rate and variant, length, task and model (REML). ``extra`` names beta (rate), tau (variant), eta (their product) and gamma (length)."""
    require_columns(panel, y)
    panel = cut(panel)
    out = fit(panel, y, interaction_design(panel, tuned, base))
    v = f"model_variant[{tuned}]"
    out.extra = {"beta": out.terms["R_bar"].estimate, "tau": out.terms[v].estimate, "eta": out.terms[f"R_bar:{v}"].estimate, "gamma": out.terms["N_bar"].estimate}
    return out


def quadratic_designs(panel: DataFrame, tuned: str = "instruct", base: str = "base") -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """The panel with its rate centred, the linear design and the squares that the quadratic one adds."""
    (mean,) = panel.agg(F.avg("R_bar")).first()
    centred = panel.withColumn("R_bar", F.col("R_bar") - F.lit(mean))
    square = {"R_bar^2": F.col("R_bar") ** 2, f"R_bar^2:model_variant[{tuned}]": F.col("R_bar") ** 2 * (F.col("model_variant") == tuned).cast("double")}
    return centred, interaction_design(centred, tuned, base), square


def quadratic_robustness(panel: DataFrame, y: str = "D", tuned: str = "instruct", base: str = "base") -> dict[str, float]:
    """Does a quadratic rate change the picture? Both models by maximum likelihood over the centred rate; the ratio test has two degrees of freedom, whose tail is exp(-x / 2).

    beta (rate), eta (rate by variant) of both models, q and k (their squares) of the quadratic one, each with its error, p value and interval; deltas of beta and eta; the centre; counts.
    """
    require_columns(panel, y)
    panel = cut(panel)
    (mean,) = panel.agg(F.avg("R_bar")).first()
    centred, design, square = quadratic_designs(panel, tuned, base)
    v = f"model_variant[{tuned}]"
    line, curve = fit(centred, y, design, reml=False), fit(centred, y, design | square, reml=False)
    statistic = 2 * (curve.log_likelihood - line.log_likelihood)
    out = {"lrt": statistic, "lrt_df": 2.0, "pvalue": math.exp(-max(0.0, statistic) / 2), "log_likelihood_linear": line.log_likelihood, "log_likelihood_quadratic": curve.log_likelihood}
    out |= {"r_bar_mean": mean, "n_obs": float(line.n_obs), "n_prompts": float(line.n_groups)}
    terms = [("linear", line, "beta", "R_bar"), ("linear", line, "eta", f"R_bar:{v}"), ("quadratic", curve, "beta", "R_bar"), ("quadratic", curve, "eta", f"R_bar:{v}"), ("quadratic", curve, "q", "R_bar^2"), ("quadratic", curve, "k", f"R_bar^2:{v}")]
    for model, found, name, term in terms:
        c = found.terms[term]
        out |= {f"{name}_{model}": c.estimate, f"{name}_{model}_stderr": c.stderr, f"{name}_{model}_pvalue": c.pvalue, f"{name}_{model}_ci_low": c.interval[0], f"{name}_{model}_ci_high": c.interval[1]}
    for name in ("beta", "eta"):
        delta = out[f"{name}_quadratic"] - out[f"{name}_linear"]
        out |= {f"delta_{name}": delta, f"{name}_within_one_se": float(abs(delta) <= out[f"{name}_linear_stderr"])}
    return out
