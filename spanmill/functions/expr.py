"""Column expressions. What is undefined is null, never NaN: divisions are guarded and NaN is taken out at the boundary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Correlations are drawn in so far before Fisher's transformation.
FISHER_LIMIT = 0.999999


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def defined(x: Column | str) -> Column:
    """NaN becomes null."""
    x = col(x)
    return F.when(~F.isnan(x), x)


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_normalized(a: Column) -> Column:
    """The array divided by its norm, which counts as 1e-12 at least."""
    return let(a, lambda v: let(F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)), lambda norm: F.transform(v, lambda x: x.cast("double") / norm)))


# Aggregates


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of the defined values by their positive weights; the plain mean of the values if no weight is positive."""
    ok = value.isNotNull() & (weight > 0)
    return F.coalesce(F.try_divide(F.sum(F.when(ok, value * weight)), F.sum(F.when(ok, weight))), F.avg(value))


def fisher_mean(r: Column, weight: Column) -> Column:
    """Weighted mean of correlations by way of their z values."""
    return F.tanh(weighted_mean(F.atanh(clamp(r, -FISHER_LIMIT, FISHER_LIMIT)), weight))


def pearson(a: Column | str, b: Column | str) -> Column:
    """Sample correlation; null if either is constant or there are fewer than two rows (``corr`` would raise)."""
    return clamp(F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)), -1.0, 1.0)


def let(x: Column, body) -> Column:
    """``body`` of x, with x worked out once however often the body uses it."""
    return F.transform(F.array(x), body)[0]


# Scores of candidates, as arrays; -inf marks a candidate that is out.


def _finite(a: Column) -> Column:
    return F.filter(a, lambda x: x > float("-inf"))


def log_sum_exp(a: Column) -> Column:
    return let(F.array_max(a), lambda top: top + F.ln(F.aggregate(_finite(a), F.lit(0.0), lambda s, x: s + F.exp(x - top))))


def normalize_scores(a: Column) -> Column:
    """Log probabilities of the scores; -inf stays."""
    return let(a, lambda v: let(log_sum_exp(v), lambda z: F.transform(v, lambda x: F.when(x > float("-inf"), x - z).otherwise(float("-inf")))))


def with_temperature(a: Column, temperature: float) -> Column:
    return a if temperature == 1.0 else F.transform(a, lambda x: x / F.lit(float(temperature)))


def top_k(a: Column, k: int) -> Column:
    """Scores below the k-th largest go out; ties with it stay. No limit for k <= 0 or k >= size."""
    if k <= 0:
        return a
    bound = lambda v: F.element_at(F.sort_array(v, False), F.least(F.lit(k), F.size(v)))
    return let(a, lambda v: let(bound(v), lambda least: F.transform(v, lambda x: F.when(x >= least, x).otherwise(float("-inf")))))


def top_p(a: Column, p: float, shares: Column | None = None) -> Column:
    """Scores go out once the probability of those before them, largest first, exceeds p; the first stays. Ties go by position.

    ``shares`` are the probabilities themselves, where they are known by other means than the scores, their logarithms: by way
    of ln and exp they are off in the last digits, which decide where a sum comes to p itself. Those of scores that are out count as 0.
    """
    if p >= 1:
        return a
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("n"))

    def places(order: Column) -> Column:
        kept = F.aggregate(order, start, lambda s, x: F.struct((s["mass"] + x["share"]).alias("mass"), (s["n"] + F.when((s["mass"] <= p) | (s["n"] == 0), 1).otherwise(0)).alias("n")))["n"]
        return F.transform(F.slice(order, 1, kept), lambda x: x["i"])

    def ordered(v: Column) -> Column:
        if shares is None:
            return F.array_sort(F.transform(normalize_scores(v), lambda x, i: F.struct((-x).alias("neg"), i.alias("i"), F.exp(x).alias("share"))))
        own = F.zip_with(v, shares, lambda x, q: F.when((x > float("-inf")) & q.isNotNull(), q.cast("double")).otherwise(0.0))
        return F.array_sort(F.transform(own, lambda q, i: F.struct((-q).alias("neg"), i.alias("i"), q.alias("share"))))

    return let(a, lambda v: let(let(ordered(v), places), lambda own: F.transform(v, lambda x, i: F.when(F.array_contains(own, i), x).otherwise(float("-inf")))))


def packed_scores(a: Column) -> Column:
    """Without the candidates that are out; arrays need no padding."""
    return _finite(a)


def valid_scores(a: Column, p: float = 1.0, k: int = 100, temperature: float = 1.0) -> Column:
    """Temperature, top k, top p, renormalisation, packing."""
    return packed_scores(normalize_scores(top_p(top_k(with_temperature(a, temperature), k), p)))


def truncated_log_probs(a: Column, k: int) -> Column:
    """Log probabilities of the k largest scores, among themselves."""
    return normalize_scores(F.slice(F.sort_array(normalize_scores(a), False), 1, k))


def step_entropy(log_p: Column) -> Column:
    """Entropy in nats of the finite candidates of one step; they are taken as normalised."""
    return F.aggregate(_finite(log_p), F.lit(0.0), lambda s, x: s - F.exp(x) * x)


def sequence_length(ids: Column, eos: list[int]) -> Column:
    """Tokens up to and with the first end token, all if there is none."""
    first = F.array_min(F.filter(F.array(*(F.array_position(ids, e).cast("long") for e in eos)), lambda x: x > 0))
    return F.coalesce(first, F.size(ids).cast("long"))


def eos_log_prob(ids: Column, log_p: Column, eos: list[int]) -> Column:
    """Log of the joint probability of the end tokens among a step's candidates; null if none is there."""
    ends = F.array(*map(F.lit, eos))
    own = F.transform(F.filter(F.arrays_zip(ids.alias("id"), log_p.alias("lp")), lambda x: F.array_contains(ends, x["id"])), lambda x: x["lp"])
    return F.when(F.size(own) > 0, log_sum_exp(own))


def eos_in_top_k(ids: Column, log_p: Column, eos: list[int], k: int) -> Column:
    """Whether an end token is among the k likeliest candidates."""
    order = F.array_sort(F.zip_with(ids, log_p, lambda i, x: F.struct((-x).alias("neg"), i.alias("id"))))
    return F.arrays_overlap(F.transform(F.slice(order, 1, k), lambda x: x["id"]), F.array(*map(F.lit, eos)))


# Rates of a rollout or a prompt


def entropy_rate(h_sum: Column | str, n: Column | str) -> Column:
    return col(h_sum) / F.greatest(col(n).cast("double"), F.lit(1.0))


def branching_factor(rate: Column | str) -> Column:
    return F.exp(col(rate))


def gen_ppl(entropy: Column | str, mean_length: Column | str) -> Column:
    """exp of entropy per token; null for a mean length of 0."""
    return F.exp(ratio(entropy, mean_length))


def ce_decomposition(ce: Column | str, ppl: Column | str, bf: Column | str) -> Column:
    """Cumulative entropy as what length alone gives and its covariance with the rate, with both as shares."""
    length = ratio(ce, F.ln(col(ppl)))
    driven = length * F.ln(col(bf))
    rest = col(ce) - driven
    return F.struct(col(ce).alias("ce_star_max"), driven.alias("length_driven"), rest.alias("length_entropy_rate_covariance"), ratio(driven, ce).alias("length_driven_share"), ratio(rest, ce).alias("covariance_share"))


# Texts

#: How a verdict is worded, and the names of what can become of a judgment.
SIMILAR, DIFFERENT = "response: similar", "response: different"
OK, PARSE_FAILED, TRUNCATED, REQUEST_FAILED = "ok", "parse_failed", "truncated", "request_failed"


def _last(text: Column, marker: str) -> Column:
    """0-based place of the last occurrence, -1 without one."""
    at = F.instr(F.reverse(text), marker[::-1])
    return F.when(at > 0, F.length(text) - at - len(marker) + 1).otherwise(-1)


def verdict(text: Column | str, finish_reason: Column | None = None, failed: Column | None = None) -> Column:
    """Struct of is_similar and status: the later of the two wordings counts, whatever its case. Failures are not similar."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    yes, no = _last(low, SIMILAR), _last(low, DIFFERENT)
    neither = (yes < 0) & (no < 0)
    lost = F.when(F.coalesce(finish_reason == "length", F.lit(False)), TRUNCATED).otherwise(PARSE_FAILED) if finish_reason is not None else F.lit(PARSE_FAILED)
    status = F.when(neither, lost).otherwise(OK)
    similar = ~neither & (yes > no)
    if failed is not None:
        gone = F.coalesce(failed, F.lit(False))
        status, similar = F.when(gone, REQUEST_FAILED).otherwise(status), ~gone & similar
    return F.struct(similar.alias("is_similar"), status.alias("status"))


def filled(template: str, values: dict[str, Column]) -> Column:
    """The template with its placeholders ``{name}`` replaced in one pass: what a value holds is not replaced again."""
    import re

    parts = re.split("(" + "|".join(re.escape("{" + n + "}") for n in values) + ")", template)
    missing = [n for n in values if "{" + n + "}" not in parts]
    if missing:
        raise ValueError(f"the template lacks {missing}")
    return F.concat(*(values[p[1:-1]] if p.startswith("{") and p[1:-1] in values else F.lit(p) for p in parts))


def text_hash(text: Column | str) -> Column:
    """The first 16 hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(col(text), 256), 1, 16)


#: All white space characters, those beyond ASCII too.
WHITE_SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def clean_prompt(text: Column | str) -> Column:
    """Without white space at the end, then without one closing fence of three backticks, then without white space again."""
    bare = F.regexp_replace(col(text), rf"[{WHITE_SPACE}]+\z", "")
    return F.regexp_replace(F.regexp_replace(bare, r"```\z", ""), rf"[{WHITE_SPACE}]+\z", "")


def task_stem(path: Column | str) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_extract(col(path), r"([^/]+?)(\.[^./]*)?$", 1)


def run_title(model: Column, variant: Column, task: Column, prefix: Column | None = None) -> Column:
    return F.concat_ws("_", *([prefix] if prefix is not None else []), model, variant, task)
