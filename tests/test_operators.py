"""Edge cases and brute force for what SQL does not cover."""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.functions import expr as E
from spanmill.operators import beta, bootstrap, correlation, figures, filtering, judge, panel, regression, semantic, tree
from spanmill.sources import artifacts, external, prompts, results
from spanmill.schemas import ROLLOUTS
from spanmill.streaming.prompt_stats import compact, current, stream_prompt_stats

INF = float("inf")


def one(spark, column, **values):
    names, row = list(values), tuple(values.values())
    kinds = {str: "string", int: "long", float: "double", bool: "boolean"}
    kind = lambda v: f"array<{kinds[type(v[0])]}>" if isinstance(v, list) else kinds[type(v)]
    frame = spark.createDataFrame([row], ", ".join(f"{n} {kind(v)}" for n, v in zip(names, row, strict=True)))
    return frame.select(column.alias("x")).first().x


def test_step_entropy(spark):
    assert one(spark, E.step_entropy(F.col("a")), a=[0.0]) == 0
    assert one(spark, E.step_entropy(F.col("a")), a=[math.log(0.5), math.log(0.5), -INF]) == pytest.approx(math.log(2))


def test_candidates(spark):
    assert one(spark, E.normalize_scores(F.col("a")), a=[0.0, 0.0, -INF]) == pytest.approx([-math.log(2)] * 2 + [-INF])
    assert [x for x in one(spark, E.top_k(F.col("a"), 2), a=[3.0, 2.0, 2.0, 1.0]) if x > -INF] == [3, 2, 2]
    for k in (0, 4, 9):
        assert one(spark, E.top_k(F.col("a"), k), a=[3.0, 2.0, 2.0, 1.0]) == [3, 2, 2, 1]
    logs = [math.log(p) for p in (0.3, 0.5, 0.2)]
    assert one(spark, E.top_p(F.col("a"), 0.6), a=logs) == pytest.approx([logs[0], logs[1], -INF])
    assert one(spark, E.top_p(F.col("a"), 0.0), a=logs) == pytest.approx([-INF, logs[1], -INF])
    assert one(spark, E.top_p(F.col("a"), 1.0), a=logs) == pytest.approx(logs)
    assert one(spark, E.valid_scores(F.col("a"), 0.7, 2, 1.0), a=logs) == pytest.approx([math.log(0.375), math.log(0.625)])


@pytest.mark.parametrize("seed", range(10))
def test_top_p_against_a_loop(spark, seed):
    x = np.random.default_rng(seed).normal(size=12)
    p = np.exp(x) / np.exp(x).sum()
    mass, keep = 0.0, set()
    for i in np.argsort(-p, kind="stable"):
        if mass > 0.7 and keep:
            break
        keep.add(int(i))
        mass += p[i]
    got = one(spark, E.top_p(F.col("a"), 0.7), a=x.tolist())
    assert {i for i, v in enumerate(got) if v > -INF} == keep


@pytest.mark.parametrize(("ids", "want"), [([5, 6, 8], 3), ([1, 2], 1), ([5, 2, 1], 2), ([9, 9, 1, 2], 3)])
def test_sequence_length(spark, ids, want):
    assert one(spark, E.sequence_length(F.col("a"), [1, 2]), a=ids) == want


@pytest.mark.parametrize(("text", "want"), [("Response: similar", (True, "ok")), ("RESPONSE: DIFFERENT", (False, "ok")), ("response: similar, no: Response: different", (False, "ok")), ("response: different? Response: Similar", (True, "ok")), ("maybe", (False, "parse_failed")), ("", (False, "parse_failed"))])
def test_verdict(spark, text, want):
    assert tuple(one(spark, E.verdict("t"), t=text)) == want
    failed = one(spark, E.verdict("t", F.lit("length"), F.lit(True)), t=text)
    assert tuple(failed) == (False, "request_failed")
    assert one(spark, E.verdict("t", F.lit("length")), t="maybe").status == "truncated"


@pytest.mark.parametrize(("text", "want"), [("x```\n", "x"), ("x``````", "x```"), ("x \t\n", "x"), ("x```y", "x```y"), ("```", ""), ("a\u00a0", "a"), ("a\u3000", "a"), ("a\u2028```\u205f\x85\x1c", "a"), ("a\u200b", "a\u200b"), ("a```\u2009b", "a```\u2009b")])
def test_clean_prompt(spark, text, want):
    assert one(spark, E.clean_prompt("t"), t=text) == want


def test_template(spark):
    assert one(spark, E.filled("{a}-{b}", {"a": F.col("t"), "b": F.lit("{a}")}), t="{b}") == "{b}-{a}"
    with pytest.raises(ValueError):
        E.filled("{a}", {"a": F.lit(1), "b": F.lit(2)})


def test_weighted_mean_falls_back(spark):
    rows = spark.createDataFrame([(1.0, 0), (3.0, 0), (None, 9)], "v double, w int")
    assert rows.agg(E.weighted_mean(F.col("v"), F.col("w"))).first()[0] == 2
    assert rows.union(spark.createDataFrame([(7.0, 2)])).agg(E.weighted_mean(F.col("v"), F.col("w"))).first()[0] == 7


def test_small_prompts(spark):
    rows = spark.createDataFrame([("a", 1, 5, 1.0), ("b", 1, 5, 1.0), ("b", 2, 5, 2.0), ("c", 1, 4, 1.0), ("c", 2, 5, 1.0)], "prompt_id string, rollout_idx int, seq_len long, h_sum double").withColumn("rate", E.entropy_rate("h_sum", "seq_len"))
    got = {r.prompt_id: r for r in tree.prompt_metrics(rows, ["prompt_id"], 5).collect()}
    assert got["a"].covariance is None and got["a"].pearson is None and got["b"].pearson is None and got["b"].covariance == 0
    taus = {r.prompt_id: r.kendall for r in correlation.kendall(rows, "seq_len", "rate", ["prompt_id"]).collect()}
    assert taus == {"a": None, "b": None, "c": -1.0}


def test_identity_of_cumulative_entropy(spark):
    """CE* = E[N] E[R] + (M - 1) / M cov(N, R)."""
    r = np.random.default_rng(3)
    rows = spark.createDataFrame([(p, i, int(r.integers(1, 40)), float(r.random() * 30)) for p in range(4) for i in range(9)], "prompt_id int, rollout_idx int, seq_len long, h_sum double").withColumn("rate", E.entropy_rate("h_sum", "seq_len"))
    for m in tree.prompt_metrics(rows, ["prompt_id"]).collect():
        assert m.ce_star_max == pytest.approx(m.mean_length * m.mean_rate + 8 / 9 * m.covariance)


@pytest.mark.parametrize("seed", range(8))
def test_kendall_against_pairs(seed):
    r = np.random.default_rng(seed)
    a, b = r.integers(0, 6, 40).astype(float), r.integers(0, 9, 40).astype(float)
    s = [(np.sign(a[i] - a[j]), np.sign(b[i] - b[j])) for i, j in itertools.combinations(range(40), 2)]
    want = sum(x * y for x, y in s) / math.sqrt(sum(x * x for x, _ in s) * sum(y * y for _, y in s))
    assert correlation.kendall_tau_b(a, b) == pytest.approx(want)


@pytest.mark.parametrize(("m", "fraction"), [(100, 0.55), (7, 0.7), (1, 0.1), (5, 1.0)])
def test_keep_mask(spark, m, fraction):
    rows = spark.createDataFrame([(0, i, float(i // 3)) for i in range(m)], "prompt_id int, rollout_idx int, reward double")
    kept = {r.rollout_idx for r in filtering.kept(rows, fraction, ["prompt_id"]).collect()}
    assert kept == set(sorted(range(m), key=lambda i: (-(i // 3), i))[: math.ceil(fraction * m)])


def vectors(spark, x, label=0):
    return spark.createDataFrame([(label, i, [float(v) for v in row], i + 1) for i, row in enumerate(x)], "prompt_id int, rollout_idx int, embedding array<double>, seq_len long")


def test_diversity(spark):
    same, axes = vectors(spark, np.tile([0.6, 0.8], (3, 1))), vectors(spark, np.eye(4))
    for rows, diversity, vendi in ((same, 0, 1), (axes, 1, 4), (vectors(spark, np.eye(2)[:1]), None, 1)):
        got = semantic.prompt_diversity(semantic.rollout_diversity(rows, ["prompt_id"]), ["prompt_id"]).first().diversity
        assert got == (None if diversity is None else pytest.approx(diversity))
        assert math.exp(semantic.vendi_entropy(rows, ["prompt_id"]).first().vendi_entropy) == pytest.approx(vendi)


def test_vendi_against_the_kernel(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(17, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    values = np.linalg.eigvalsh(x @ x.T / 17)
    values = values[values > 1e-12]
    rows = vectors(spark, x).repartition(5)
    vendi = semantic.vendi_entropy(rows, ["prompt_id"]).first().vendi_entropy
    assert vendi == pytest.approx(-(values * np.log(values)).sum())
    assert semantic.renyi2_entropy(rows, ["prompt_id"]).first().renyi2_entropy <= vendi <= math.log(17)


@pytest.mark.parametrize("m", [1, 2, 3, 10])
def test_buckets(spark, m):
    rows = semantic.bucket_stats(vectors(spark, np.eye(12)[:m]), ["prompt_id"]).collect()
    assert [r.bucket for r in sorted(rows, key=lambda r: ["short", "medium", "long"].index(r.bucket))] == semantic.BUCKETS
    n = [r.num_responses for r in rows]
    assert sum(n) == m and max(n) - min(n) <= 1
    assert all((r.average_similarity is None) == (r.num_responses < 2) and (r.min_length is None) == (r.num_responses == 0) for r in rows)


def test_clusters(spark):
    nodes = spark.createDataFrame([(0, p) for p in range(1, 7)] + [(1, 1)], "prompt_id int, pos int")
    yes = [(0, 1, 2), (0, 2, 1), (0, 2, 3), (0, 3, 2), (0, 4, 5)]  # a chain, and one direction only
    judged = spark.createDataFrame([(*x, True) for x in yes] + [(0, 5, 4, False)], "prompt_id int, r int, c int, is_similar boolean")
    labels = judge.clusters(nodes, judge.reciprocal_edges(judged, ["prompt_id"]), ["prompt_id"])
    assert {(r.prompt_id, r.pos): r.cluster for r in labels.collect()} == {(0, 1): 1, (0, 2): 1, (0, 3): 1, (0, 4): 4, (0, 5): 5, (0, 6): 6, (1, 1): 1}
    got = {r.prompt_id: r for r in judge.cluster_entropy(labels, ["prompt_id"]).collect()}
    assert got[1].RSE == 0 and got[1].RSE_norm is None and got[0].n_clusters == 4 and 0 < got[0].RSE_norm < 1


def test_subsample(spark):
    rows = spark.createDataFrame([(p, i) for p in range(3) for i in range(40 if p else 5)], "prompt_id int, rollout_idx int")
    got = judge.subsample(rows, 10, keys=["prompt_id"]).collect()
    assert sorted(np.bincount([r.prompt_id for r in got])) == [5, 10, 10]
    by = {}
    for r in got:
        by.setdefault(r.prompt_id, []).append((r.pos, r.rollout_idx))
    for p, own in by.items():
        assert [k for k, _ in sorted(own)] == list(range(1, len(own) + 1)) and [i for _, i in sorted(own)] == judge.drawn(40 if p else 5, 10, 42 + p)


def test_draws_of_the_mersenne_generator():
    """The generator is the published one (its outputs for the seed 5489), and a draw is the head of the swapped permutation."""
    raw = np.random.RandomState(5489)._bit_generator.random_raw(10_000)
    assert raw[0] == 3499211612 and raw[-1] == 4123659995
    for n, size, seed in ((100, 24, 42), (30, 24, 7), (25, 24, 0), (10, 24, 3), (1000, 5, 2**32 + 9)):
        order, outputs = list(range(n)), np.random.RandomState(seed % 2**32)._bit_generator.random_raw(n).tolist()
        for i in range(n - 1):
            j = i + outputs[i] % (n - i)
            order[i], order[j] = order[j], order[i]
        assert judge.drawn(n, size, seed) == (sorted(order[:size]) if n > size else list(range(n)))


def test_templates_need_their_places(spark):
    nodes = spark.createDataFrame([(0, 1, "a"), (0, 2, "b")], "prompt_id int, pos int, text string")
    with pytest.raises(ValueError, match="template lacks"):
        external.judgment_matrix(nodes, "{response_a} {response_b}", None, ["prompt_id"])
    with pytest.raises(ValueError, match="nodes lack task_prompt"):
        external.judgment_matrix(nodes, "{task_prompt} {response_a} {response_b}", None, ["prompt_id"])


def test_failures_stop_the_write(spark):
    judged = spark.createDataFrame([(0, "ok"), (0, "parse_failed"), (1, "ok")], "prompt_id int, status string")
    assert {r.prompt_id: r.failure_rate for r in judge.failure_rates(judged, ["prompt_id"]).collect()} == {0: 0.5, 1: 0.0}
    assert judge.require_few_failures(judged, ["prompt_id"], 0.5).count() == 3
    with pytest.raises(Exception, match="too many"):
        judge.require_few_failures(judged, ["prompt_id"], 0.1).collect()


def test_bootstrap_against_numpy(spark):
    r = np.random.default_rng(7)
    rows = [("m", v, p, float(r.random()), float(10 + p), 0.5, 0.1, None, 0.2, 0.3, 8) for v in ("base", "instruct") for p in range(6)]
    schema = "model_name string, model_variant string, prompt_id int, ce_star_max double, mean_length double, mean_rate double, pearson double, spearman double, kendall double, covariance double, n int"
    frame = spark.createDataFrame(rows, schema)
    got = {(x.metric, x.contrast): x for x in bootstrap.comparison(frame, bootstrap.seeded_draws(50), ["model_name"]).collect()}
    drawn = np.random.default_rng(42).integers(0, 6, (50, 6))
    base, other = np.array([x[3] for x in rows[:6]]), np.array([x[3] for x in rows[6:]])
    delta = other[drawn].mean(1) - base[drawn].mean(1)
    at = got["ce_star_max", "delta"]
    assert (at.value, at.se, at.ci_low, at.ci_high) == pytest.approx((other.mean() - base.mean(), delta.std(ddof=1), *np.quantile(delta, [0.025, 0.975])))
    assert got["spearman", "base"].value is None and got["spearman", "base"].se is None
    assert ("pearson", "percent_delta") not in got and ("gen_ppl", "percent_delta") in got
    with pytest.raises(Exception, match="different prompts"):
        bootstrap.paired(frame.where("not (model_variant = 'base' and prompt_id = 0)"), ["model_name"]).collect()


def dense_fit(y, x, g, reml=True):
    """Brute force: the likelihood over a grid of variance ratios with full covariance matrices."""
    z = (g[:, None] == np.unique(g)[None, :]).astype(float)
    best = None
    for theta in np.r_[0, np.exp(np.linspace(-6, 6, 2001))]:
        v = np.eye(len(y)) + theta * z @ z.T
        w = np.linalg.inv(v)
        xx = x.T @ w @ x
        b = np.linalg.solve(xx, x.T @ w @ y)
        e = y - x @ b
        free = len(y) - (x.shape[1] if reml else 0)
        s2 = e @ w @ e / free
        value = -(free * math.log(2 * math.pi * s2) + free + np.linalg.slogdet(v)[1] + (np.linalg.slogdet(xx)[1] if reml else 0)) / 2
        if best is None or value > best[0]:
            best = value, b, np.sqrt(np.diag(np.linalg.inv(xx)) * s2)
    return best


@pytest.mark.parametrize("reml", [True, False])
def test_mixed_model_against_dense_algebra(spark, reml):
    r = np.random.default_rng(5)
    g = np.repeat(np.arange(15), r.integers(1, 6, 15))
    x = r.normal(size=len(g))
    y = 1 + 2 * x + r.normal(size=15)[g] + 0.5 * r.normal(size=len(g))
    frame = spark.createDataFrame([(float(a), float(b), str(c)) for a, b, c in zip(y, x, g, strict=True)], "y double, x double, g string")
    got = regression.fit(frame, "y", {"Intercept": F.lit(1.0), "x": F.col("x")}, "g", reml)
    value, b, e = dense_fit(y, np.column_stack([np.ones(len(x)), x]), g, reml)
    assert got.log_likelihood == pytest.approx(value, abs=1e-3)
    assert [c.estimate for c in got.terms.values()] == pytest.approx(b, abs=1e-3) and [c.stderr for c in got.terms.values()] == pytest.approx(e, rel=1e-2)
    assert regression.Coefficient(1.959963984540054, 1.0).pvalue == pytest.approx(0.05)


def beta_rows(spark, seed, prompts, runs, models, beta_true=(0.3, 0.8), deviation=0.4, phi=30.0):
    """A panel with known effects: uid, y, r (the covariate), length (0), task (0 or 1, a dispersion effect), model, variant."""
    r = np.random.default_rng(seed)
    u, w, rows = deviation * r.normal(size=prompts), 0.2 * r.normal(size=models), []
    for g in range(prompts):
        for k in range(runs):
            x, m, t = float(r.normal()), k % models, g % 2
            mu = 1 / (1 + math.exp(-(beta_true[0] + beta_true[1] * x + u[g] + w[m])))
            p = phi * math.exp(0.5 * t)
            rows.append((f"p{g}", float(np.clip(r.beta(mu * p, (1 - mu) * p), 1e-6, 1 - 1e-6)), x, 0.0, t, m, k))
    return rows, spark.createDataFrame(rows, "uid string, y double, r double, length double, task int, model int, variant int")


def beta_design(models):
    return beta.Design(lambda c: np.column_stack([np.ones(len(c["y"])), c["r"]]), lambda c: np.column_stack([np.ones(len(c["y"])), c["task"]]), ["Intercept", "r"], ["Intercept", "task"], models)


def test_beta_regression_recovers_what_it_was_given(spark):
    rows, frame = beta_rows(spark, 2, 120, 20, 4)
    got = beta.fit_beta(beta.records(frame.repartition(5)), beta_design(4))
    assert got.rounds < beta.ROUNDS and got.mean_terms["r"].estimate == pytest.approx(0.8, abs=0.03)
    assert math.exp(got.dispersion_terms["Intercept"]) == pytest.approx(30, rel=0.15) and got.dispersion_terms["task"] == pytest.approx(0.5, abs=0.15) and got.deviations["prompt_uid"] == pytest.approx(0.4, rel=0.3)
    tests = beta.residual_tests(got, 200)
    assert min(tests[f"{k}_pvalue"] for k in ("uniformity", "dispersion", "outlier")) > 0.001 and tests["dispersion_ratio"] == pytest.approx(1, abs=0.15) and tests["outlier_share"] < 0.05
    # The draws are a row's own, however rows are dealt; a fit with a wrong precision is found out.
    again = beta.residual_tests(beta.BetaFit(**{**got.__dict__, "records": got.records.repartition(3)}), 200)
    assert again == pytest.approx(tests)
    wrong = beta.residual_tests(beta.BetaFit(**{**got.__dict__, "delta": got.delta + [2.0, 0.0]}), 200)
    assert wrong["dispersion_ratio"] > 3 and max(wrong[f"{k}_pvalue"] for k in ("uniformity", "dispersion", "outlier")) < 0.02


def test_beta_fit_against_dense_equations(spark):
    """At the fit nothing is left of the score equations of all effects, by differences of a likelihood written out here; its
    errors are those of the whole information matrix, and the variances are those that its inverse gives."""
    rows, frame = beta_rows(spark, 5, 15, 8, 2)
    got = beta.fit_beta(beta.records(frame), beta_design(2), 2000)
    intercept = {r.uid: r.u for r in got.records.collect()}
    uids = sorted(intercept)
    x = np.array([[1.0, r[2], *(r[5] == m for m in range(2)), *(r[0] == u for u in uids)] for r in rows], dtype=float)
    z, y = np.array([[1.0, r[4]] for r in rows]), np.array([r[1] for r in rows])
    b = np.r_[got.beta, [intercept[u] for u in uids]]
    variances = np.r_[np.inf, np.inf, [got.deviations["model_name"] ** 2] * 2, [got.deviations["prompt_uid"] ** 2] * 15]

    def likelihood(b, d):
        own = sum(beta_log_density(v, 1 / (1 + math.exp(-float(p @ b))), math.exp(float(q @ d))) for v, p, q in zip(y, x, z))
        return own - float((b**2 / (2 * variances)).sum())

    for k in range(len(b)):
        e = np.eye(len(b))[k] * 1e-5
        assert abs(likelihood(b + e, got.delta) - likelihood(b - e, got.delta)) / 2e-5 < 2e-3
    for k in range(2):
        e = np.eye(2)[k] * 1e-5
        assert abs(likelihood(b, got.delta + e) - likelihood(b, got.delta - e)) / 2e-5 < 2e-3
    mu, phi = 1 / (1 + np.exp(-x @ b)), np.exp(z @ got.delta)
    weight = phi**2 * (beta.trigamma(mu * phi) + beta.trigamma((1 - mu) * phi)) * (mu * (1 - mu)) ** 2
    inverse = np.linalg.inv(x.T @ (x * weight[:, None]) + np.diag(1 / variances))
    assert [c.stderr for c in got.mean_terms.values()] == pytest.approx(np.sqrt(np.diag(inverse)[:2]), rel=1e-3)
    assert variances[-1] == pytest.approx(((b[4:] ** 2).sum() + np.trace(inverse[4:, 4:])) / 15, rel=1e-2)


def test_uniformity(spark):
    x = np.random.default_rng(3).random(3000)
    for own in (x, x**1.2):
        frame = spark.createDataFrame([(float(v),) for v in own], "place double").repartition(7)
        s = np.sort(own)
        want = max(np.abs(np.arange(1, 3001) / 3000 - s).max(), np.abs(s - np.arange(3000) / 3000).max())
        distance, tail = beta.uniformity(frame)
        assert distance == pytest.approx(float(want)) and (tail > 0.01) == (own is x)
    assert beta._binomial_tail(5, 10, 0.5) == 1.0 and beta._binomial_tail(0, 10, 0.5) == pytest.approx(2 / 1024) and beta._binomial_tail(9, 10, 0.5) == pytest.approx(22 / 1024)


def test_beta_needs_its_reference_task(spark):
    names = ["D01", "R_sc", "invN_sc", "task", "model_name", "model_variant", "prompt_uid"]
    rows = spark.createDataFrame([(0.5, 0.1, 0.2, t, "m", v, f"{t}/0") for t in ("completion_a", "completion_b", "math") for v in ("base", "instruct")], ", ".join(f"{n} {'double' if k < 3 else 'string'}" for k, n in enumerate(names)))
    with pytest.raises(ValueError, match="one task has to start"):
        beta.beta_interaction(rows)
    with pytest.raises(ValueError, match=r"lacks \['R_sc'\]"):
        beta.beta_interaction(rows.drop("R_sc"))


def test_special_functions():
    assert beta.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329)
    assert beta.trigamma(np.array([1.0]))[0] == pytest.approx(math.pi**2 / 6)
    x = np.linspace(0, 3, 50)
    assert np.linalg.matrix_rank(np.column_stack([np.ones(50), beta.natural_spline(x, np.quantile(x, np.linspace(0, 1, 5)))])) == 5
    assert beta.log_gamma(np.array([0.3, 1.0, 7.5, 1e4])).tolist() == pytest.approx([math.lgamma(v) for v in (0.3, 1.0, 7.5, 1e4)])
    assert abs(beta.natural_spline(x, np.quantile(x, np.linspace(0, 1, 5)))[0]).max() == 0


def test_z_scores(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 0.0, 1.0, 1), (3.0, 4.0, -2.0, 5.0, 9)], "R_bar double, N_bar double, D double, VS double, M int")
    got = panel.z_scored(rows).orderBy("R_bar").collect()
    assert got[0].R_sc == pytest.approx(-math.sqrt(0.5)) and got[0].D01 == 1e-6 and got[1].D01 == 1 - 1e-6 and got[0].VS01 is None and got[1].VS01 == 0.5


def test_equal_values_have_no_density(spark):
    rows = spark.createDataFrame([("a", 1021.0210339319474)] * 33 + [("b", 1.0), ("b", 2.0), ("c", 7.0)], "k string, v double").repartition(7)
    assert {r.k for r in figures.kernel_density(rows, ["k"], "v", 5, high_from=["k"]).collect()} == {"b"}


def test_density_against_all_pairs(spark):
    """Kernels scattered over the grid within their reach, by parts in several tasks, are the sums over all values."""
    r = np.random.default_rng(2)
    x = {"a": np.round(r.normal(20, 3, 900), 1), "b": np.r_[r.normal(5, 1, 50), 400.0]}
    frame = spark.createDataFrame([(k, float(v)) for k, own in x.items() for v in own], "k string, v double").repartition(6)
    got = {}
    for row in figures.kernel_density(frame, ["k"], "v", 60, 0.0, []).orderBy("x").collect():
        got.setdefault(row.k, []).append((row.x, row.density))
    grid = np.linspace(0, 401.0, 60)
    for k, own in x.items():
        h = own.std(ddof=1) * len(own) ** -0.2
        want = np.exp(-(((grid[:, None] - own) / h) ** 2) / 2).sum(1) / (len(own) * h * math.sqrt(2 * math.pi))
        assert np.array(got[k]) == pytest.approx(np.column_stack([grid, want]), abs=1e-12)


def test_density_integrates_to_one(spark):
    rows = spark.createDataFrame([(float(v),) for v in np.random.default_rng(0).normal(50, 5, 200)], "v double")
    got = figures.kernel_density(rows, [], "v", 400).orderBy("x").collect()
    x, d = np.array([r.x for r in got]), np.array([r.density for r in got])
    assert len(got) == 400 and float(((d[1:] + d[:-1]) / 2 * np.diff(x)).sum()) == pytest.approx(1, abs=0.02)


def test_prompt_files(spark, tmp_path):
    (tmp_path / "math.x.jsonl").write_text("\n".join([json.dumps({"prompt": "a```\n"}), "  ", json.dumps({"prompt": "b", "other": 1}), json.dumps({"prompt": "c"})]) + "\n")
    path = str(tmp_path / "math.x.jsonl")
    assert [tuple(r) for r in prompts.load_prompts(spark, path, 2).orderBy("prompt_id").collect()] == [("math.x", 0, "a"), ("math.x", 1, "b")]
    assert prompts.load_prompts(spark, path).count() == 3
    (tmp_path / "bad.jsonl").write_text('{"p": 1}\n')
    with pytest.raises(Exception, match="no prompt"):
        prompts.load_prompts(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "math.txt").write_text("T {a}\n")
    assert prompts.load_template(spark, str(tmp_path), "math") == "T {a}\n"


RUN = {"model_name": "m", "task": "t", "model_variant": "base", "run_name": "1", "prompt_file": "p", "num_prompts": 3, "n_samples": 2, "max_new_tokens": 9, "temperature": 1.0, "top_k": 5, "top_p": 1.0, "seed": 1, "logprobs": 5, "enable_thinking": False}
KEYS = ("m", "t", "base", "1")


def rollout_rows(spark, ids):
    from spanmill.schemas import ROLLOUTS

    return spark.createDataFrame([(*KEYS, p, i, f"text {p} {i}", [1, 2], 2, [0.5, 1.0], None) for p in ids for i in range(2)], ROLLOUTS)


def test_large_prompt_files_are_numbered_in_order(spark, tmp_path):
    lines = [json.dumps({"prompt": f"p{k} " + "x" * (k % 90)}) if k % 5 else " \u3000" for k in range(4000)]
    (tmp_path / "big.jsonl").write_text("\n".join(lines) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        found = prompts.load_prompts(spark, str(tmp_path / "big.jsonl"))
        assert spark.read.text(str(tmp_path / "big.jsonl")).rdd.getNumPartitions() > 10
        got = {r.prompt_id: r.prompt for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == {i: json.loads(x)["prompt"].rstrip() for i, x in enumerate(x for x in lines if x.strip())}


def test_prompt_files_in_parts(spark, tmp_path):
    """What Spark writes in parts is one file: numbered through, under the folder's name."""
    path, values = str(tmp_path / "math.jsonl"), [json.dumps({"prompt": f"p{k}"}) + "\n  \n" * (k % 3 == 0) for k in range(200)]
    spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, value string").repartitionByRange(7, "k").sortWithinPartitions("k").select("value").write.text(path)
    assert len(list((tmp_path / "math.jsonl").glob("part-*"))) > 3
    got = prompts.load_prompts(spark, path).collect()
    assert sorted((r.task, r.prompt_id, r.prompt) for r in got) == sorted(("math", k, f"p{k}") for k in range(200))


def test_large_prompt_tables_are_written_in_parts(spark, sf_dir, monkeypatch):
    from spanmill.plans import artifact_queries

    seen, load = [], prompts.load_prompts
    monkeypatch.setattr(artifact_queries, "_PART_BYTES", 1 << 15)
    monkeypatch.setattr(artifact_queries.prompts, "load_prompts", lambda spark, path, n: seen.append(path) or load(spark, path, n))
    want = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").orderBy("doc_id").select("text").collect()]
    assert artifact_queries.loaded_prompts(spark, sf_dir).count() == min(150, len(want))
    assert spark.read.text(seen[0]).select("_metadata.file_path").distinct().count() > 5
    assert load(spark, seen[0]).count() == len(want)


def test_runs_are_appended(spark, tmp_path):
    store = artifacts.Store(spark, str(tmp_path))
    other = RUN | {"task": "u"}
    for run in (RUN, other, RUN | {"num_prompts": 8}):
        store.save_run(run)
    assert {r.task: r.num_prompts for r in store.runs().collect()} == {"t": 8, "u": 3}
    assert spark.read.json(str(tmp_path / "runs")).count() == 3  # what was saved before is still there
    store.save_runs(spark.createDataFrame([tuple((RUN | {"seed": 9}).values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double'}" for k, v in RUN.items())))
    assert {r.task: r.seed for r in store.runs().collect()} == {"t": 9, "u": 1}


def test_shared_folder_is_asked_for():
    from types import SimpleNamespace

    session = lambda master, named: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=SimpleNamespace(master=master))
    assert results.shared_dir(session("spark://x", "hdfs://y/z/")) == "hdfs://y/z" and results.shared_dir(session("local[4]", None)) == results.shared_dir(session("local", None))
    for master in ("spark://x", "yarn", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="checkpoint"):
            results.shared_dir(session(master, None))


def test_store(spark, tmp_path):
    store = artifacts.Store(spark, str(tmp_path))
    assert store.resume(RUN) == 0
    store.append(rollout_rows(spark, [0, 1]), "rollouts")
    assert store.resume(RUN | {"num_prompts": 4}) == 2
    with pytest.raises(ValueError, match="seed"):
        store.resume(RUN | {"seed": 2})
    with pytest.raises(ValueError, match="replaced"):
        store.reset(rollout_rows(spark, [5]), "rollouts")
    runs = store.runs()
    with pytest.raises(ValueError, match="incomplete"):
        artifacts.require_complete(runs, store.read("rollouts"))
    store.append(rollout_rows(spark, [2, 3, 4]), "rollouts")
    whole = artifacts.require_complete(runs, store.read("rollouts"))
    assert {r.prompt_id for r in whole.collect()} == {0, 1, 2, 3}
    rewards = whole.select(*artifacts.RUN_KEYS, "prompt_id", "rollout_idx", F.lit(1.0).alias("reward"))
    assert artifacts.attach(whole, rewards, "reward", runs).where("reward is null").count() == 0
    assert artifacts.attach(whole, rewards.where("prompt_id < 2"), "reward", runs).where("reward is not null").count() == 0
    assert {r.prompt_id for r in artifacts.pending(whole, rewards.where("prompt_id < 3")).collect()} == {3}
    assert store.texts(model_name="m").columns[-1] == "text" and store.texts(model_name="n").count() == 0
    store.reset(rollout_rows(spark, [7]), "rollouts", force=True)
    assert store.count_prompts("rollouts").first().prompts == 1
    assert store.resume_judgments(RUN, {"judge_name": "j"}, None) == 0


def test_compute(spark, tmp_path):
    from spanmill.plans import compute

    store = artifacts.Store(spark, str(tmp_path))
    store.save_run(RUN)
    rows = rollout_rows(spark, range(4))
    store.append(rows, "rollouts")
    rewards = rows.select(*artifacts.RUN_KEYS, F.lit("r").alias("reward_name"), "prompt_id", "rollout_idx", F.col("rollout_idx").cast("float").alias("reward"))
    vectors = rows.select(*artifacts.RUN_KEYS, F.lit("e").alias("embedding_key"), "prompt_id", "rollout_idx", F.when(F.col("rollout_idx") == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>").alias("embedding"))
    store.append(rewards, "rewards")
    store.append(vectors, "embeddings")
    prompts, pooled = compute.compute_run(store, compute.Compute(0.5, True), "e", "r")
    got = {r.subset: r for r in pooled.collect()}
    assert got["raw"].num_prompts == got["kept"].num_prompts == 3
    assert got["raw"].semantic_diversity == pytest.approx(1) and got["raw"].vendi_score == pytest.approx(2) and got["kept"].vendi_score == pytest.approx(1) and got["kept"].semantic_diversity is None
    assert got["raw"].ce_star_max == 1.5 and got["raw"].truncation_rate == 0
    flat = compute.flat_summary(pooled, artifacts.RUN_KEYS)
    assert flat.count() == 35 and {r.m for r in prompts.where("subset = 'kept'").collect()} == {1}
    _, bare = compute.compute_run(store, embedding_key="none")
    assert bare.where("subset = 'raw'").first().vendi_score is None
    curves = compute.trajectory_table(rows, artifacts.RUN_KEYS, ["task"], 10, compute.Figures(bin_step=1))
    assert [(r.t, r.mean_rate, r.active) for r in curves.orderBy("t").collect()] == [(1, 0.5, 8), (2, 0.75, 8)]
    lengths = tree.rollout_entropies(rows)
    assert compute.length_figure(lengths, ["task"], ["model_name"], "hist").agg(F.sum("n")).first()[0] == 8


def test_heatmap_orders(spark):
    rows = spark.createDataFrame([("p", 1, [1.0, 2.0]), ("p", 2, [1.0]), ("q", 3, [5.0])], "prompt_id string, rollout_idx int, v array<double>")
    lines = lambda order: {r.rollout_idx: r.row for r in figures.heatmap(rows, ["prompt_id"], "v", order).collect()}
    assert lines(None) == {2: 0, 1: 1, 3: 2} and lines("global") == {2: 0, 3: 1, 1: 2}


def test_results(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5, (2.0, None), [1.0])], "k string, x double, s struct<p: double, q: double>, list array<double>")
    assert sorted((r.name, r.value) for r in results.flat_scalars(rows, ["k"]).collect() if r.value) == [("s.p", 2.0), ("x", 1.5)]
    assert '"q":null' in results.as_json(rows, ["k"]).first().json
    results.write_json(rows, str(tmp_path / "j"))
    results.write_csv(rows.select("k", "x"), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.csv(str(tmp_path / "c"), header=True).count() == 1


def test_stream(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    flat = lambda ids: rollout_rows(spark, ids).coalesce(1).write.mode("append").parquet(source)
    flat([0, 1])
    stream_prompt_stats(spark, source, out, state).awaitTermination()
    assert current(spark, out).count() == 2
    flat([1, 2])
    stream_prompt_stats(spark, source, out, state).awaitTermination()
    compact(spark, out, str(tmp_path / "compact"))
    got = {r.prompt_id: r for r in spark.read.parquet(str(tmp_path / "compact")).collect()}
    assert set(got) == {0, 1, 2} and got[1].m == 2 and got[1].ce_star_max == 1.5


def test_stream_of_split_prompts(spark, tmp_path):
    """A prompt whose rollouts come in two batches ends with the metrics of them all; one that comes again replaces its own."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = rollout_rows(spark, [0, 1])
    for part in (rows.where("rollout_idx = 0"), rows.where("rollout_idx = 1 and prompt_id = 0").withColumn("step_entropy", F.array(F.lit(3.0)).cast("array<float>")), rows.where("rollout_idx = 0 and prompt_id = 1").withColumn("step_entropy", F.array(F.lit(5.0)).cast("array<float>"))):
        part.coalesce(1).write.mode("append").parquet(source)
        stream_prompt_stats(spark, source, out, state).awaitTermination()
    got = {r.prompt_id: (r.m, r.ce_star_max) for r in current(spark, out).collect()}
    assert got == {0: (2, 2.25), 1: (1, 5.0)}


def test_stream_works_on_what_comes(spark, tmp_path):
    """Over many batches, each reads and updates no more than it has; the metrics are those of the last rollouts in one batch."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    r, last = np.random.default_rng(4), {}
    for k in range(12):
        for p, i in {(int(r.integers(3)), int(r.integers(6))) for _ in range(4)}:
            last[p, i] = (k, [float(x) for x in r.random(int(r.integers(1, 8)))])
        own = [(p, i, steps) for (p, i), (at, steps) in last.items() if at == k]
        frame = spark.createDataFrame(own, "prompt_id int, rollout_idx int, step_entropy array<float>").withColumns({**{c: F.lit("x") for c in ("model_name", "task", "model_variant", "run_name", "text")}, "token_ids": F.array(F.lit(1).cast("long")), "seq_len": F.size("step_entropy").cast("long"), "step_logprobs": F.lit(None).cast("array<array<float>>")})
        frame.select(*(c.split()[0] for c in ROLLOUTS.split(", "))).coalesce(1).write.mode("append").parquet(source)
    query = stream_prompt_stats(spark, source, out, state, max_new_tokens=5, max_files=1)
    query.awaitTermination()
    progress = [x for x in query.recentProgress if x["numInputRows"]]
    assert len(progress) == 12 and all(x["numInputRows"] <= 4 and x["stateOperators"][0]["numRowsUpdated"] <= 8 for x in progress)
    rows = spark.createDataFrame([(p, i, steps) for (p, i), (_, steps) in last.items()], "prompt_id int, rollout_idx int, step_entropy array<float>")
    want = {x.prompt_id: x for x in tree.prompt_metrics(tree.rollout_entropies(rows), ["prompt_id"], 5).collect()}
    got = {x.prompt_id: x for x in current(spark, out).collect()}
    assert set(got) == set(want)
    for p, x in want.items():
        assert all(got[p][c] == pytest.approx(x[c], rel=1e-6) for c in x.asDict())


@pytest.mark.parametrize(("n", "n_boot"), [(1, 3), (7, 40_000), (70_000, 99)])
def test_draws_are_those_of_one_call(n, n_boot):
    blocks = list(bootstrap.seeded_draws(n_boot)(n))
    assert len(blocks) == -(-n_boot // max(1, bootstrap.DRAWN // n))
    assert (np.concatenate(blocks) == np.random.default_rng(42).integers(0, n, (n_boot, n))).all()


@pytest.mark.parametrize("held", [1, 1 << 17])
def test_replicate_sums_in_parts(spark, monkeypatch, held):
    """Running sums over parts of a group's prompts, in several tasks, are the sums over all that is drawn."""
    r = np.random.default_rng(3)
    x = {(g, p): r.random() for g, n in (("a", 40), ("b", 7)) for p in range(n)}
    frame = spark.createDataFrame([(g, p, 40 if g == "a" else 7, v) for (g, p), v in x.items()], "g string, pos long, n_prompts long, v double").repartition(5)
    monkeypatch.setattr(bootstrap, "HELD", held)
    got = {(s.g, s.b): s.v for s in bootstrap.replicate_sums(frame, ["g"], ["v"], bootstrap.seeded_draws(60)).collect()}
    for g, n in (("a", 40), ("b", 7)):
        drawn = np.random.default_rng(42).integers(0, n, (60, n))
        assert [got[g, b] for b in range(60)] == pytest.approx([sum(x[g, p] for p in row) for row in drawn.tolist()])


@pytest.mark.parametrize("gathered", [10, 10_000])
@pytest.mark.parametrize("kind", ["distinct", "few", "skewed", "one", "two"])
def test_quantiles(spark, kind, gathered):
    r = np.random.default_rng(5)
    x = {"distinct": r.normal(size=30_000), "few": r.integers(0, 4, 5_000), "skewed": np.r_[np.zeros(20_000), r.exponential(size=3_000)], "one": np.full(3_000, 2.5), "two": np.array([1.0, 4.0])}[kind].astype(float)
    frame = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(5).cache()
    for q in (0.0, 0.02, 0.31, 0.98, 1.0):
        assert figures.quantile(frame, "v", q, gathered) == pytest.approx(float(np.quantile(x, q)), abs=1e-12)
    assert figures.quantile(frame.limit(0), "v", 0.5) is None
    frame.unpersist()


def test_entropies_of_rows_and_arrays_agree(spark):
    r = np.random.default_rng(9)
    rows = [(g, float(x)) for g in range(20) for x in np.r_[r.normal(-3, 4, g % 5 + 1), [-INF] * (g % 3)]]
    frame = spark.createDataFrame(rows, "g int, x double")
    long = {x.g: (x.h, x.k) for x in tree.step_entropies(frame, ["g"], "x").collect()}
    listed = frame.groupBy("g").agg(F.collect_list("x").alias("a")).select("g", E.step_entropy(E.normalize_scores(F.col("a"))).alias("h"))
    assert {x.g: x.h for x in listed.collect()} == pytest.approx({g: h for g, (h, _) in long.items()}, abs=1e-12)
    assert {g: k for g, (_, k) in long.items()} == {g: g % 5 + 1 for g in range(20)}


def test_entropies_of_scores_of_any_size(spark):
    """Rows agree with arrays from -1e5 to 1e5, across the borders of spans too; a step without candidates has no entropy."""
    r = np.random.default_rng(10)
    at = [-1e5, -1500.0, -801.0, -300.0, -299.0, 0.0, 300.0, 301.0, 799.0, 900.0, 1e5]
    rows = [(g, float(x)) for g in range(200) for x in at[g % len(at)] + r.choice([0.0, 1.0, 3.0, -250.0], 4) * r.random(4)]
    rows += [(300, -800.0), (300, -801.0), (301, 800.0), (301, 799.0), (302, 1e5), (302, -1e5), (303, -INF), (304, None), (305, 300.5), (305, 299.5), (305, -INF)]
    frame = spark.createDataFrame(rows, "g int, x double")
    long = {x.g: (x.h, x.k) for x in tree.step_entropies(frame, ["g"], "x").collect()}
    listed = frame.where("g < 303 or g = 305").groupBy("g").agg(F.collect_list("x").alias("a")).select("g", E.step_entropy(E.normalize_scores(F.col("a"))).alias("h"))
    assert {x.g: x.h for x in listed.collect()} == pytest.approx({g: h for g, (h, _) in long.items() if g not in (303, 304)}, abs=1e-9)
    assert long[300][0] == pytest.approx(0.5822, abs=1e-4) and long[301] == pytest.approx(long[300]) and long[303] == long[304] == (None, 0)


def test_spectra_of_small_and_large_groups(spark):
    r = np.random.default_rng(6)
    x = {g: r.normal(size=(n, 6)) for g, n in enumerate((1, 5, 6, 7, 90))}
    x = {g: v / np.linalg.norm(v, axis=1, keepdims=True) for g, v in x.items()}
    rows = vectors(spark, x[0], 0)
    for g in list(x)[1:]:
        rows = rows.union(vectors(spark, x[g], g))
    got = {v.prompt_id: v for v in semantic.vendi_entropy(rows.repartition(4), ["prompt_id"]).collect()}
    two = {v.prompt_id: v.renyi2_entropy for v in semantic.renyi2_entropy(rows, ["prompt_id"]).collect()}
    for g, v in x.items():
        kernel = v @ v.T / len(v)
        values = np.linalg.eigvalsh(kernel)
        values = values[values > 1e-12]
        assert (got[g].m, got[g].vendi_entropy) == (len(v), pytest.approx(-(values * np.log(values)).sum()))
        assert two[g] == pytest.approx(-math.log((kernel**2).sum()))


def test_judge_client(spark):
    """Requests are repeated, the last error is kept, and no pair is asked twice once it is written."""

    class Client:
        def __init__(self):
            self.asked = {}

        def __call__(self, prompt):
            self.asked[prompt] = self.asked.get(prompt, 0) + 1
            if self.asked[prompt] < 3:
                raise TimeoutError("busy")
            return ("Response: similar", "stop") if "b" not in prompt else ("", "length")

    rows = spark.createDataFrame([(0, 1, "a1"), (0, 2, "a2"), (0, 3, "b3")], "prompt_id int, pos int, text string").withColumn("task_prompt", F.lit("t"))
    found = external.judgment_matrix(rows, "{task_prompt}: {response_a}|{response_b}", Client, ["prompt_id"], retries=2, wait=0.0)
    assert {(x.r, x.c): (x.is_similar, x.status) for x in found.collect()} == {(1, 2): (True, "ok"), (2, 1): (True, "ok"), (1, 3): (False, "truncated"), (2, 3): (False, "truncated")}
    short = external.judgment_matrix(rows, "{task_prompt}: {response_a}|{response_b}", Client, ["prompt_id"], retries=1, wait=0.0).collect()
    assert {x.status for x in short} == {"request_failed"} and all("busy" in x.text for x in short)
    with pytest.raises(TimeoutError):
        external.require_ready(Client)
    with pytest.raises(ValueError, match="response_b"):
        external.judgment_matrix(rows, "{task_prompt} {response_a}", Client, ["prompt_id"])


@pytest.mark.parametrize("tokens", [1, 50, 10_000])
def test_batches_of_like_length(spark, tokens):
    """One row out for each in; a batch holds as many rows as fit when padded, whatever Arrow batches they came in."""
    r = np.random.default_rng(6)
    sizes = [0, *(int(x) for x in r.integers(1, 30, 300)), *[7] * 200]
    rows = spark.createDataFrame([(i, "x" * n if n else None) for i, n in enumerate(sizes)], "id long, text string").repartition(7)

    def hook(batches):
        for k, batch in enumerate(batches):
            n = batch["text"].fillna("").str.len()
            yield batch[["id"]].assign(rows=len(batch), longest=n.max(), own=n)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = external.by_length(rows, hook, "id long, rows long, longest long, own long", F.length("text"), tokens).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(x.id for x in got) == list(range(len(sizes))) and all(x.own == sizes[x.id] for x in got)
    assert all(x.rows == 1 or x.rows * x.longest <= tokens for x in got)
    if tokens == 50:
        assert sum(x.longest - x.own for x in got) < 0.2 * sum(sizes) and max(x.rows for x in got) > 5


def test_eos_modes(spark, tmp_path):
    from spanmill.plans import compute

    store = artifacts.Store(spark, str(tmp_path))
    rows = rollout_rows(spark, [0]).withColumn("prefix_ids", F.array(F.lit(7).cast("long")))
    score = lambda: external.eos_scored(rows, lambda prefix, ids: [np.log(np.tile([0.5, 0.25, 0.25], (len(x), 1))) + 4 for x in ids], [1, 2], top_k=1)
    with pytest.raises(FileNotFoundError):
        compute.eos_payload(store, score, "plot_only")
    with pytest.raises(ValueError):
        compute.eos_payload(store, score, "plot")
    assert compute.eos_payload(store, score, "compute_only") is None
    for mode in ("plot_only", "compute_plot"):
        assert [(r.eos_logprob, r.eos_in_top_k) for r in compute.eos_payload(store, score, mode).collect()] == [(pytest.approx([math.log(0.5)] * 2, abs=1e-6), [False, False])] * 2


def beta_log_density(y, mu, phi):
    return math.lgamma(phi) - math.lgamma(mu * phi) - math.lgamma((1 - mu) * phi) + (mu * phi - 1) * math.log(y) + ((1 - mu) * phi - 1) * math.log1p(-y)


def test_random_intercepts_against_quadrature(spark):
    """Laplace's approximation is near the integral over each prompt's intercept, once that of the one model is taken out."""
    rows, frame = beta_rows(spark, 13, 12, 15, 1, (0.3, 0.0), 0.6)
    design = beta.Design(lambda c: np.ones((len(c["y"]), 1)), lambda c: np.ones((len(c["y"]), 1)), ["1"], ["1"], 1)
    got = beta.fit_beta(beta.records(frame), design, 500)
    b, phi, sd = float(got.beta.sum()), math.exp(got.dispersion_terms["1"]), got.deviations["prompt_uid"]
    at = np.linspace(-6, 6, 241)
    total = 0.0
    for k in range(12):
        logs = np.array([-t * t / 2 - math.log(2 * math.pi) / 2 + sum(beta_log_density(r[1], 1 / (1 + math.exp(-(b + sd * t))), phi) for r in rows if r[0] == f"p{k}") for t in at])
        total += logs.max() + math.log(np.exp(logs - logs.max()).sum() * (at[1] - at[0]))
    assert got.log_likelihood == pytest.approx(total, abs=1.0)  # with the cost of the one model that has an intercept as well


def test_missing_cells(spark):
    cells = artifacts.matrix(spark, a=["x", "y"], b=["1", "2"])
    have = spark.createDataFrame([("x", "1")], "a string, b string")
    assert artifacts.missing_of(cells, have, ["a", "b"]).count() == 3 and artifacts.existing_of(cells, have, ["a", "b"]).count() == 1
