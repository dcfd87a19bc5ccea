"""One query per operator over the derived tables, with the SQL that gives the same rows. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import PROMPT, RUN, beta, bootstrap, correlation, figures, filtering, judge, panel, regression, semantic, tree
from ..sources import artifacts, results
from . import compute
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(body: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if body is not None:
            SQL[f.__name__] = fx.sql(body)
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


R = "round({0}, 6) + 0.0::double as {1}".format
P = "task, model_name, model_variant, prompt_id"
V = "task, model_name, model_variant"
FISHER = "round(tanh(coalesce(sum(case when {0} is not null and {1} > 3 then ({1} - 3) * atanh(greatest(-0.999999, least(0.999999, {0}))) end) / nullif(sum(case when {0} is not null and {1} > 3 then {1} - 3 end), 0), avg(case when {0} is not null then atanh(greatest(-0.999999, least(0.999999, {0}))) end))), 6) + 0.0::double as {2}".format
WEIGHTED = "round(coalesce(sum(case when {0} is not null and {1} > 0 then {1} * {0} end) / nullif(sum(case when {0} is not null and {1} > 0 then {1} end), 0), avg({0})), 6) + 0.0::double as {2}".format


# Candidates and steps


@query(f"select orderkey, t::int as t, k, {R('h', 'h')} from fx_steps")
def step_entropy(spark, d):
    return rounded(fx.steps(spark, d).select("orderkey", "t", "k", "h"))


@query(f"select rollout_idx, seq_len, {R('h_sum', 'h_sum')}, {R('rate', 'rate')} from fx_rollouts")
def rollout_entropy(spark, d):
    return rounded(fx.rollouts_with_steps(spark, d).select("rollout_idx", "seq_len", "h_sum", "rate"))


@query(f"select l_orderkey as orderkey, l_linenumber as line, {R('ln(p)', 'lp')} from fx_lines")
def normalize_logprobs(spark, d):
    found = fx.candidates(spark, d).select("orderkey", F.arrays_zip("numbers", E.normalize_scores(F.col("scores")).alias("lp")).alias("z"))
    return rounded(found.select("orderkey", F.explode("z").alias("z")).select("orderkey", F.col("z.numbers").alias("line"), F.col("z.lp").alias("lp")))


@query("select orderkey, count(*) as survivors, sum(line)::bigint as lines from (select l_orderkey as orderkey, l_linenumber as line, rank() over (partition by l_orderkey order by l_quantity desc) as r from fx_lines) where r <= 2 group by orderkey")
def top_k_mask(spark, d):
    found = fx.candidates(spark, d, F.col("l_quantity")).withColumn("kept", E.top_k(F.col("scores"), 2))
    return _survivors(found)


def _survivors(found: DataFrame) -> DataFrame:
    long = found.select("orderkey", F.explode(F.arrays_zip("numbers", "kept")).alias("z")).where(F.col("z.kept") > float("-inf"))
    return long.groupBy("orderkey").agg(F.count(F.lit(1)).alias("survivors"), F.sum(F.col("z.numbers")).cast("long").alias("lines"))


@query("""select orderkey, count(*) as survivors, sum(line)::bigint as lines from (select l_orderkey as orderkey, l_linenumber as line, row_number() over w as r, coalesce(sum(p) over (partition by l_orderkey order by p desc, l_linenumber rows between unbounded preceding and 1 preceding), 0) as before
 from fx_lines window w as (partition by l_orderkey order by p desc, l_linenumber)) where r = 1 or before <= 0.6::double group by orderkey""")
def top_p_mask(spark, d):
    """The mass is summed from shares as they are, as the SQL does."""
    return _survivors(fx.shared_candidates(spark, d).withColumn("kept", E.top_p(F.col("scores"), 0.6, F.col("shares"))))


@query(f"select orderkey, {R('-sum(q * ln(q))', 'h')} from (select l_orderkey as orderkey, pow(p, 1 / 0.7::double) / sum(pow(p, 1 / 0.7::double)) over (partition by l_orderkey) as q from fx_lines) group by orderkey")
def temperature_entropy(spark, d):
    return rounded(fx.candidates(spark, d).select("orderkey", E.step_entropy(E.normalize_scores(E.with_temperature(F.col("scores"), 0.7))).alias("h")))


@query(f"""select orderkey, count(*) as n, {R('-sum(z * ln(z))', 'h')} from (select orderkey, q / sum(q) over (partition by orderkey) as z from (select orderkey, line, q, row_number() over w as r, coalesce(sum(q) over (partition by orderkey order by q desc, line rows between unbounded preceding and 1 preceding), 0) as before
 from (select orderkey, line, q / sum(q) over (partition by orderkey) as q from (select l_orderkey as orderkey, l_linenumber as line, pow(p, 1 / 0.8::double) as q, rank() over (partition by l_orderkey order by p desc) as k from fx_lines) where k <= 4)
 window w as (partition by orderkey order by q desc, line)) where r = 1 or before <= 0.9::double) group by orderkey""")
def valid_scores(spark, d):
    kept = E.valid_scores(F.col("scores"), p=0.9, k=4, temperature=0.8)
    return rounded(fx.candidates(spark, d).withColumn("kept", kept).select("orderkey", F.size("kept").cast("long").alias("n"), E.step_entropy(F.col("kept")).alias("h")))


@query(f"select orderkey, {R('-sum(q * ln(q))', 'h')} from (select orderkey, p / sum(p) over (partition by orderkey) as q from (select l_orderkey as orderkey, p, row_number() over (partition by l_orderkey order by p desc) as r from fx_lines) where r <= 3) group by orderkey")
def truncated_entropy(spark, d):
    return rounded(fx.candidates(spark, d).select("orderkey", E.step_entropy(E.truncated_log_probs(F.col("scores"), 3)).alias("h")))


@query(f"""select orderkey, max(lp) as eos_logprob, bool_or(r <= 2 and line in (2, 4)) as in_top_k from (select l_orderkey as orderkey, l_linenumber as line, row_number() over (partition by l_orderkey order by p desc, l_linenumber) as r,
 round(ln(sum(case when l_linenumber in (2, 4) then p end) over (partition by l_orderkey)), 6) + 0.0::double as lp from fx_lines) group by orderkey""")
def eos_probability(spark, d):
    ids, lp = F.col("numbers"), E.normalize_scores(F.col("scores"))
    return rounded(fx.candidates(spark, d).withColumn("lp", lp).select("orderkey", E.eos_log_prob(ids, F.col("lp"), [2, 4]).alias("eos_logprob"), E.eos_in_top_k(ids, F.col("lp"), [2, 4], 2).alias("in_top_k")))


@query("select user_id, coalesce(min(i) filter (id in (7, 13)), max(i))::bigint as seq_len from (select user_id, event_id % 50 as id, row_number() over (partition by user_id order by event_id) as i from events) group by user_id")
def eos_length(spark, d):
    ids = F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x % 50)
    return fx.table(spark, d, "events").groupBy("user_id").agg(ids.alias("ids")).select("user_id", E.sequence_length(F.col("ids"), [7, 13]).alias("seq_len"))


# Tree metrics


@query(f"select {P}, m, {R('ce', 'ce_star_max')}, {R('nbar', 'mean_length')}, {R('rbar', 'mean_rate')}, {R('gen_ppl', 'gen_ppl')}, {R('bf', 'branching_factor')}, {R('cov', 'covariance')}, {R('pearson', 'pearson')}, {R('trunc', 'truncation_rate')} from fx_prompt")
def prompt_tree_metrics(spark, d):
    return rounded(tree.prompt_metrics(fx.rollouts(spark, d), PROMPT, fx.MAX_NEW_TOKENS))


@query(f"select {V}, count(*) as prompts, {R('avg(ce)', 'ce_star_max')}, {R('exp(avg(ce) / avg(nbar))', 'gen_ppl')}, {R('exp(avg(rbar))', 'branching_factor')}, {R('avg(trunc)', 'truncation_rate')}, {FISHER('pearson', 'm', 'pearson')}, {WEIGHTED('cov', '(m - 1)', 'covariance')} from fx_prompt group by {V}")
def pooled_tree_metrics(spark, d):
    return rounded(tree.pooled_metrics(tree.prompt_metrics(fx.rollouts(spark, d), PROMPT, fx.MAX_NEW_TOKENS)))


@query(f"select {P}, {R('trunc', 'truncation_rate')} from fx_prompt")
def truncation_rate(spark, d):
    return rounded(tree.prompt_metrics(fx.rollouts(spark, d), PROMPT, fx.MAX_NEW_TOKENS).select(*PROMPT, "truncation_rate"))


@query(f"select {V}, {R('ce', 'ce_star_max')}, {R('n * r', 'length_driven')}, {R('ce - n * r', 'length_entropy_rate_covariance')}, {R('n * r / ce', 'length_driven_share')}, {R('(ce - n * r) / ce', 'covariance_share')} from (select {V}, avg(ce) as ce, avg(nbar) as n, avg(rbar) as r from fx_prompt group by {V})")
def ce_decomposition(spark, d):
    return rounded(tree.decomposition(tree.pooled_metrics(tree.prompt_metrics(fx.rollouts(spark, d)))))


@query(f"select r.task, r.model_name, r.model_variant, s.t::int as t, round(sum(s.cs / s.t), 6) + 0.0::double as rate_sum, count(*) as active from (select custkey, t, sum(h) over (partition by custkey order by t rows between unbounded preceding and current row) as cs from fx_steps) s join fx_rollouts r on r.rollout_idx = s.custkey where s.t % 5 = 0 group by all")
def running_entropy_rate(spark, d):
    return rounded(tree.running_rates(fx.run_steps(spark, d), ["rollout_idx"], RUN))


_CURVES = f"""(select r.task, r.model_name, r.model_variant, s.t, sum(s.cs / s.t) as rs, count(*) as active from (select custkey, t, sum(h) over (partition by custkey order by t rows between unbounded preceding and current row) as cs from fx_steps) s
 join fx_rollouts r on r.rollout_idx = s.custkey where s.t % 5 = 0 group by all)"""
_GRID = f"""(select g.task, g.model_name, g.model_variant, g.t, coalesce(c.rs, 0) / greatest(coalesce(c.active, 0), 1) as mean_rate, coalesce(c.active, 0) as active from (select distinct {V}, t.t from {_CURVES} k cross join (select unnest(range(5, 21, 5)) as t) t) g left join {_CURVES} c using ({V}, t))"""


@query(f"select {V}, t::int as t, {R('mean_rate', 'mean_rate')}, active::bigint as active from {_GRID}")
def entropy_trajectory(spark, d):
    return rounded(tree.trajectories(tree.running_rates(fx.run_steps(spark, d), ["rollout_idx"], RUN), RUN, 5, 20))


@query(f"""select {V}, t::int as t, {R('mean_rate', 'mean_rate')}, active::bigint as active from (select g.*, row_number() over (partition by {V} order by t) as place, n.n from {_GRID} g join (select task, min(n) as n from (select {V}, count(*) filter (active >= 1) as n from {_GRID} group by {V}) group by task) n using (task)) where place <= n""")
def trimmed_trajectory(spark, d):
    curves = tree.trajectories(tree.running_rates(fx.run_steps(spark, d), ["rollout_idx"], RUN), RUN, 5, 20)
    return rounded(tree.trimmed(curves, RUN, ["task"]).select(*RUN, "t", "mean_rate", "active"))


@query(f"select {P}, count(*) as m, {R('var_samp(seq_len)', 'length_variance')}, {R('var_samp(rate)', 'rate_variance')} from fx_rollouts group by {P} having count(*) >= 2")
def within_prompt_variance(spark, d):
    return rounded(tree.within_prompt_variance(fx.rollouts(spark, d)))


# Correlations


@query(f"select {P}, {R('cov', 'covariance')}, {R('pearson', 'pearson')} from fx_prompt")
def prompt_cov_pearson(spark, d):
    return rounded(tree.prompt_metrics(fx.rollouts(spark, d)).select(*PROMPT, "covariance", "pearson"))


@query(f"select {P}, n, {R('spearman', 'spearman')} from fx_spearman")
def prompt_spearman(spark, d):
    return rounded(correlation.correlations(fx.rollouts(spark, d), "seq_len", "rate", with_kendall=False).select(*PROMPT, "n", "spearman"))


@query(f"select {P}, {R('k.kendall', 'kendall')} from fx_prompt left join fx_kendall k using ({P})")
def prompt_kendall(spark, d):
    return rounded(correlation.kendall(fx.rollouts(spark, d), "seq_len", "rate"))


@query(f"select {V}, {FISHER('pearson', 'm', 'pearson')}, {FISHER('spearman', 'm', 'spearman')}, {WEIGHTED('kendall', '(m * (m - 1) / 2)', 'kendall')}, {WEIGHTED('cov', '(m - 1)', 'covariance')} from fx_prompt join fx_spearman using ({P}) left join fx_kendall using ({P}) group by {V}")
def pooled_correlation(spark, d):
    return rounded(correlation.pooled_correlations(correlation.correlations(fx.rollouts(spark, d), "seq_len", "rate")))


# Reward filter


@query(f"select {P}, rollout_idx, keep from fx_masked")
def reward_filter_mask(spark, d):
    return filtering.with_mask(fx.rollouts(spark, d)).select(*PROMPT, "rollout_idx", "keep")


@query(f"select subset, {V}, count(*) as prompts, sum(m)::bigint as rollouts, {R('avg(ce)', 'ce_star_max')}, {R('exp(avg(ce) / avg(nbar))', 'gen_ppl')}, {R('exp(avg(rbar))', 'branching_factor')} from fx_subset_prompt group by subset, {V}")
def kept_tree_metrics(spark, d):
    prompts = tree.prompt_metrics(filtering.both_subsets(filtering.with_mask(fx.rollouts(spark, d))), ["subset", *PROMPT])
    return rounded(tree.pooled_metrics(prompts, ["subset", *RUN], {"rollouts": F.sum("m")}).select("subset", *RUN, "prompts", "rollouts", "ce_star_max", "gen_ppl", "branching_factor"))



# Embeddings


@query(f"select {P}, rollout_idx, {R('diversity', 'diversity')} from fx_diversity")
def rollout_diversity(spark, d):
    return rounded(fx.diversity(spark, d).select(*PROMPT, "rollout_idx", "diversity"))


@query(f"select {P}, count(*) as m, {R('avg(diversity)', 'diversity')} from fx_diversity group by {P}")
def prompt_diversity(spark, d):
    return rounded(semantic.prompt_diversity(fx.diversity(spark, d)))


@query(f"select {P}, count(*) as n, {R('case when count(*) > 1 then covar_samp(diversity, seq_len) end', 'covariance')}, {R('case when count(*) > 1 and stddev_samp(diversity) * stddev_samp(seq_len) > 0 then greatest(-1.0, least(1.0, covar_samp(diversity, seq_len) / (stddev_samp(diversity) * stddev_samp(seq_len)))) end', 'pearson')} from fx_diversity group by {P}")
def diversity_vs_length(spark, d):
    return rounded(correlation.correlations(fx.diversity(spark, d), "diversity", "seq_len", with_kendall=False).select(*PROMPT, "n", "covariance", "pearson"))


@query(f"select {P}, bucket, {R('average_similarity', 'average_similarity')}, {R('semantic_diversity', 'semantic_diversity')}, num_responses, min_length, max_length from fx_bucket_stats")
def bucket_stats(spark, d):
    return rounded(semantic.bucket_stats(fx.embedded(spark, d)))


@query(f"select {V}, bucket, {R('avg(average_similarity)', 'average_similarity')}, {R('avg(semantic_diversity)', 'semantic_diversity')}, {R('avg(num_responses)', 'num_responses')}, {R('avg(min_length)', 'min_length')}, {R('avg(max_length)', 'max_length')} from fx_bucket_stats group by {V}, bucket")
def pooled_buckets(spark, d):
    return rounded(semantic.pooled_buckets(semantic.bucket_stats(fx.embedded(spark, d))))


@query(f"select prompt_id, m, {R('h', 'vendi_entropy')} from fx_axes")
def vendi_entropy(spark, d):
    return rounded(semantic.vendi_entropy(fx.axes(spark, d), ["prompt_id"]))


@query(f"select prompt_id, {R('exp(h)', 'vendi_score')}, {R('case when m > 1 then greatest(1e-6, least(1 - 1e-6, (exp(h) - 1) / (m - 1))) end', 'vs01')} from fx_axes")
def vendi_unit(spark, d):
    found = semantic.vendi_entropy(fx.axes(spark, d), ["prompt_id"])
    rows = found.select("prompt_id", F.exp("vendi_entropy").alias("VS"), F.col("m").alias("M"), F.lit(0.5).alias("D"), F.col("m").cast("double").alias("R_bar"), F.col("prompt_id").cast("double").alias("N_bar"))
    return rounded(panel.z_scored(rows).select("prompt_id", F.col("VS").alias("vendi_score"), F.col("VS01").alias("vs01")))


@query(f"""select prompt_id, max(m) as m, {R('-ln(sum(g * g) / (max(m) * max(m)))', 'renyi2_entropy')} from (select a.prompt_id, a.i, b.i as j, sum(a.x * b.x) as g, count(*) as m
 from (select label as prompt_id, vec_id, unnest(embedding::double[]) as x, unnest(range(len(embedding))) as i from embeddings) a join (select label as prompt_id, vec_id, unnest(embedding::double[]) as x, unnest(range(len(embedding))) as i from embeddings) b using (prompt_id, vec_id) group by all) group by prompt_id""")
def vendi_renyi2(spark, d):
    return rounded(semantic.renyi2_entropy(fx.labelled(spark, d), ["prompt_id"]))


_MOMENTS = """(with x as (select label as prompt_id, vec_id, unnest(embedding::double[]) as x, unnest(range(len(embedding))) as i from embeddings),
 g as (select a.prompt_id, a.i, b.i as j, sum(a.x * b.x) / max(n.n) as g, max(n.n) as m from x a join x b using (prompt_id, vec_id) join (select label as prompt_id, count(*) as n from embeddings group by label) n using (prompt_id) group by all),
 g2 as (select a.prompt_id, a.i, b.j, sum(a.g * b.g) as g from g a join g b on a.prompt_id = b.prompt_id and a.j = b.i group by all)
 select prompt_id, max(g.m) as m, sum(g.g * g.g) as p2, sum(g2.g * g.g) as p3, sum(g2.g * g2.g) as p4 from g join g2 using (prompt_id, i, j) group by prompt_id)"""


@query(f"select prompt_id, m, {R('p2', 'p2')}, {R('p3', 'p3')}, {R('p4', 'p4')} from {_MOMENTS}")
def vendi_moments(spark, d):
    """The spectra of kernels of real embeddings, held by the traces of the kernels' powers."""
    rows = fx.labelled(spark, d)
    found = [semantic.spectral_moment(rows, p, ["prompt_id"]).withColumnRenamed("moment", f"p{p}") for p in (2, 3, 4)]
    return rounded(found[0].join(found[1].drop("m"), "prompt_id").join(found[2].drop("m"), "prompt_id"))


@query(f"select label as prompt_id, vec_id as rollout_idx, {R('sqrt(list_sum(list_transform(e, lambda x: x * x)))', 'norm')}, {R('e[1] / greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-12)', 'first')} from (select label, vec_id, list_transform(embedding::double[], lambda x: 3 * x) as e from embeddings)")
def l2_normalize(spark, d):
    tripled = F.transform("embedding", lambda x: 3 * x.cast("double"))
    rows = fx.labelled(spark, d).select("prompt_id", "rollout_idx", tripled.alias("e"))
    return rounded(rows.select("prompt_id", "rollout_idx", F.sqrt(E.dot(F.col("e"), F.col("e"))).alias("norm"), E.l2_normalized(F.col("e"))[0].alias("first")))


# Figures


@query(f"""select task, model_name, model_variant, bin::int as bin, {R('bin * w', 'low')}, {R('(bin + 1) * w', 'high')}, n, {R('n / (t * w)', 'density')} from (select *, sum(n) over (partition by {V})::double as t from (select task, model_name, model_variant, w, least(floor(seq_len / w), 49) as bin, count(*) as n
 from fx_rollouts join (select task, model_name, (max(seq_len) + 1) / 50.0::double as w from fx_rollouts group by task, model_name) using (task, model_name) group by all))""")
def length_histogram(spark, d):
    return rounded(figures.length_histogram(fx.rollouts(spark, d), ["task", "model_name"], ["model_variant"]))


@query(f"""select {V}, {R('x', 'x')}, {R('sum(exp(-pow((x - v) / h, 2) / 2)) / (max(n) * max(h) * sqrt(2 * pi()))', 'density')} from (select f.task, f.model_name, f.model_variant, f.seq_len::double as v, s.n, s.h, g.x from fx_rollouts f join (select {V}, count(*) as n, stddev_samp(seq_len) * pow(count(*), -0.2::double) as h from fx_rollouts group by {V}) s using ({V})
 join (select task, i * (max(seq_len) + 1) / 99.0::double as x from fx_rollouts cross join range(100) t(i) group by task, i) g using (task) where s.h > 0) group by {V}, x""")
def length_kde(spark, d):
    return rounded(figures.kernel_density(fx.rollouts(spark, d), RUN, "seq_len", 100, 0.0, ["task"]))


@query(f"""select * from (with v as (select {V}, ln(lv) as v from (select {P}, var_samp(seq_len) as lv from fx_rollouts group by {P} having count(*) >= 2) where lv > 0),
 e as (select min(v) as lo, max(v) as hi from v), s as (select {V}, count(*) as n, stddev_samp(v) * pow(count(*), -0.2::double) as h from v group by {V} having count(*) > 1)
 select {V}, {R('x', 'x')}, {R('sum(exp(-pow((x - v) / h, 2) / 2)) / (max(n) * max(h) * sqrt(2 * pi()))', 'density')} from (select v.*, s.n, s.h, e.lo + (e.hi - e.lo) * i / 39.0::double as x from v join s using ({V}) cross join e cross join range(40) t(i) where s.h > 0) group by {V}, x)""")
def variance_kde(spark, d):
    return rounded(figures.kernel_density(tree.within_prompt_variance(fx.rollouts(spark, d)), RUN, "length_variance", 40, None, [], log_value=True))


@query(f"select task, (t - 1)::int as pos, count(*) filter (h > 0) as active from fx_steps s join fx_rollouts r on r.rollout_idx = s.custkey group by task, t")
def active_counts(spark, d):
    logs = F.transform("step_entropy", lambda h: F.when(h > 0, F.ln(h)).otherwise(float("-inf")))
    return figures.active_counts(fx.rollouts_with_steps(spark, d).withColumn("logs", logs), ["task"], "logs")


@query(f"select task, prompt_id, count(*) as n, (sum(count(*)) over (order by task, prompt_id))::bigint as end_line, round(sum(count(*)) over (order by task, prompt_id) - (count(*) + 1) / 2.0::double, 6) as centre from fx_rollouts group by task, prompt_id")
def heatmap_blocks(spark, d):
    return rounded(figures.prompt_bounds(fx.rollouts(spark, d), ["task", "prompt_id"]).withColumnRenamed("end", "end_line"))


@query(f"select l.line::bigint as line, (s.t - 1)::int as pos, {R('s.h', 'value')} from (select rollout_idx, row_number() over (order by task, prompt_id, seq_len, rollout_idx) - 1 as line from fx_rollouts) l join fx_steps s on s.custkey = l.rollout_idx")
def heatmap_cells(spark, d):
    return rounded(figures.heatmap(fx.rollouts_with_steps(spark, d), ["task", "prompt_id"], "step_entropy").select(F.col("row").alias("line"), "pos", "value"))


@query(f"select l.line::bigint as line, (s.t - 1)::int as pos, {R('s.h', 'value')} from (select rollout_idx, row_number() over (order by task, prompt_id, rollout_idx) - 1 as line from fx_rollouts) l join fx_steps s on s.custkey = l.rollout_idx where s.t <= 5")
def heatmap_unsorted(spark, d):
    """Lines as the rollouts are numbered, the first five positions of each."""
    found = figures.heatmap(fx.rollouts_with_steps(spark, d), ["task", "prompt_id"], "step_entropy", "none", 5)
    return rounded(found.select(F.col("row").alias("line"), "pos", "value"))


@query(f"select {R('quantile_cont(h, 0.02)', 'low')}, {R('quantile_cont(h, 0.98)', 'high')} from fx_steps")
def colour_limits(spark, d):
    return rounded(figures.colour_limits(fx.steps(spark, d), "h"))


# Judgments


@query("select prompt_id, r::int as r, c::int as c, vr, vc from fx_pairs where r < c")
def judge_pairs(spark, d):
    return judge.forward_pairs(fx.nodes(spark, d), ["prompt_id"]).select("prompt_id", "r", "c", F.col("rollout_idx_r").alias("vr"), F.col("rollout_idx_c").alias("vc"))


@query("select prompt_id, c::int as r, r::int as c from fx_judgments where r < c and is_similar")
def reverse_pairs(spark, d):
    return judge.reverse_pairs(fx.judgments(spark, d).where("r < c"), ["prompt_id"])


@query("select prompt_id, r::int as r, c::int as c from fx_edges")
def reciprocal_edges(spark, d):
    return judge.reciprocal_edges(fx.judgments(spark, d), ["prompt_id"])


@query("select prompt_id, pos::int as pos, cluster::int as cluster from fx_clusters")
def clusters(spark, d):
    return judge.clusters(fx.nodes(spark, d), judge.reciprocal_edges(fx.judgments(spark, d), ["prompt_id"]), ["prompt_id"])


@query(f"select prompt_id, m, n_clusters, {R('rse', chr(34) + 'RSE' + chr(34))}, {R('rse / nullif(ln(m), 0)', chr(34) + 'RSE_norm' + chr(34))} from fx_rse")
def rse(spark, d):
    return rounded(judge.cluster_entropy(clusters(spark, d), ["prompt_id"]))


@query("select prompt_id, r::int as r, c::int as c, is_similar, status from fx_verdicts")
def verdict_parse(spark, d):
    return judge.judgments(fx.replies(spark, d)).select("prompt_id", "r", "c", "is_similar", "status")


@query(f"select prompt_id, count(*) as n, count(*) filter (status <> 'ok') as failures, {R('avg(case when status <> chr(111) || chr(107) then 1.0::double else 0.0::double end)', 'failure_rate')} from fx_verdicts group by prompt_id")
def failure_rate(spark, d):
    return rounded(judge.failure_rates(judge.judgments(fx.replies(spark, d)), ["prompt_id"]))


_RSE_PANEL = """(select p.task, p.model_name, p.model_variant, p.prompt_id, r.rse as "RSE", r.rse / nullif(ln(r.m), 0) as "RSE_norm", r.n_clusters, r.m as judged, p.rbar as "R_bar", p.nbar as "N_bar", p.m as "M", concat(p.task, '/', p.prompt_id) as prompt_uid from fx_prompt p join fx_rse r using (prompt_id))"""


def _rse_panel(spark: SparkSession, d: str) -> DataFrame:
    t = tree.prompt_metrics(fx.rollouts(spark, d))
    return panel.rse_panel(t, t.select(*PROMPT).join(rse(spark, d), "prompt_id"))


@query(f"""select {P}, {R('"RSE"', '"RSE"')}, {R('"RSE_norm"', '"RSE_norm"')}, n_clusters, judged, {R('"R_bar"', '"R_bar"')}, {R('"N_bar"', '"N_bar"')}, "M", prompt_uid from {_RSE_PANEL}""")
def rse_panel(spark, d):
    return rounded(_rse_panel(spark, d))


@query(f"""select model_variant, {R('avg((n_clusters = judged)::int::double)', 'saturated')}, {R('avg("RSE")', '"RSE"')}, {R('avg("RSE_norm")', '"RSE_norm"')}, {R('avg(n_clusters)', 'n_clusters')}, count(distinct prompt_uid) as prompts from {_RSE_PANEL} group by model_variant""")
def rse_saturation(spark, d):
    return rounded(panel.saturation(_rse_panel(spark, d), ["model_variant"]))


# Texts


_STRIPPED = rf"regexp_replace(regexp_replace(regexp_replace({{0}}, '[{E.WHITE_SPACE}]+\z', ''), '```\z', ''), '[{E.WHITE_SPACE}]+\z', '')".replace(r"\x{85}\x{A0}", r"\x{0085}\x{00A0}")


@query("select doc_id, sha256(" + _STRIPPED.replace("{0}", "text || chr(160) || '``````' || chr(10) || ' ' || chr(12288) || chr(8195)") + ") as cleaned from documents")
def prompt_clean(spark, d):
    fenced = F.concat("text", F.lit("\u00a0``````\n \u3000\u2003"))
    return fx.table(spark, d, "documents").select("doc_id", F.sha2(E.clean_prompt(fenced), 256).alias("cleaned"))


@query("select doc_id, substr(sha256(text), 1, 16) as hash from documents")
def prompt_hash(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", E.text_hash("text").alias("hash"))


@query("select page_id, regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1) as stem from pages")
def task_stem(spark, d):
    return fx.table(spark, d, "pages").select("page_id", E.task_stem("url").alias("stem"))


@query("select conv_id, turn, sha256('Task: ' || role || chr(10) || 'A: ' || text || chr(10) || 'B: {a}') as filled from conversations")
def template_fill(spark, d):
    text = E.filled("Task: {task}\nA: {a}\nB: {b}", {"task": F.col("role"), "a": F.col("text"), "b": F.lit("{a}")})
    return fx.table(spark, d, "conversations").select("conv_id", "turn", F.sha2(text, 256).alias("filled"))


# Panels and inference


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return panel.panel(tree.prompt_metrics(fx.rollouts(spark, d)), semantic.prompt_diversity(fx.diversity(spark, d)), semantic.vendi_entropy(fx.embedded(spark, d)))


@query(f"""select {P}, {R('"D"', '"D"')}, {R('"R_bar"', '"R_bar"')}, {R('"N_bar"', '"N_bar"')}, "M", prompt_uid from fx_panel""")
def prompt_panel(spark, d):
    return rounded(_panel(spark, d).drop("log_VS", "VS"))


@query(f"""select {P}, {R('("R_bar" - avg("R_bar") over ()) / stddev_samp("R_bar") over ()', '"R_sc"')}, {R('(1 / "N_bar" - avg(1 / "N_bar") over ()) / stddev_samp(1 / "N_bar") over ()', '"invN_sc"')}, {R('greatest(1e-6, least(1 - 1e-6, abs("D")))', '"D01"')} from fx_panel""")
def panel_zscored(spark, d):
    return rounded(panel.z_scored(_panel(spark, d)).select(*PROMPT, "R_sc", "invN_sc", "D01"))


def _components(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.rollouts(spark, d)
    return tree.prompt_metrics(rows).select(*PROMPT, "ce_star_max", "mean_length", "mean_rate", "pearson", "covariance", F.col("m").alias("n"))


_PAIRED = f"""(select task, model_name, prompt_id, b.ce - a.ce as delta from fx_prompt b join fx_prompt a using (task, model_name, prompt_id) where a.model_variant = 'base' and b.model_variant = 'instruct')"""


@query(f"select task, model_name, prompt_id, {R('delta', 'delta')} from {_PAIRED} where (task, model_name) in (select (task, model_name) from (select task, model_name, model_variant, count(*) as n from fx_prompt group by all) group by task, model_name having count(*) = 2 and min(n) = max(n))")
def paired_delta(spark, d):
    rows = bootstrap.paired(_components(spark, d), ["task", "model_name"])
    base, other = (rows.where(F.col("model_variant") == v).select("task", "model_name", "prompt_id", F.col("ce_star_max").alias(v)) for v in ("base", "instruct"))
    return rounded(base.join(other, ["task", "model_name", "prompt_id"]).select("task", "model_name", "prompt_id", (F.col("instruct") - F.col("base")).alias("delta")))


_POSITIVE = "('ce_star_max', 'gen_ppl', 'branching_factor')"
_POOL = ", ".join((R("avg(ce)", "ce_star_max"), R("exp(avg(ce) / avg(nbar))", "gen_ppl"), R("exp(avg(rbar))", "branching_factor"), FISHER("pearson", "m", "pearson"), FISHER("spearman", "m", "spearman"), WEIGHTED("kendall", "(m * (m - 1) / 2)", "kendall"), WEIGHTED("cov", "(m - 1)", "covariance"))).replace(", 6) + 0.0::double", ", 15)")
_LONG = "unnest(['ce_star_max', 'gen_ppl', 'branching_factor', 'pearson', 'spearman', 'kendall', 'covariance']) as metric, unnest([ce_star_max, gen_ppl, branching_factor, pearson, spearman, kendall, covariance]) as x"
_CONTRASTS = "unnest(['base', 'instruct', 'delta', 'percent_delta']) as contrast, unnest([x0, x1, x1 - x0, 100 * (x1 - x0) / nullif(abs(x0), 0)])"
_VARIANTS = "max(case when model_variant = 'base' then x end) as x0, max(case when model_variant = 'instruct' then x end) as x1"


def _bootstrap_sql(draws: str) -> str:
    """All seven metrics over replicates; ``draws`` selects np (number of prompts), b, s and pos."""
    whole = "case when count(x) = count(*) then {0} end".format
    return f"""select task, model_name, metric, contrast, {R('v.value', 'value')}, {R('se', 'se')}, {R('lo', 'ci_low')}, {R('hi', 'ci_high')} from
 (select * from (with f as (select * from fx_prompt join fx_spearman using ({P}) left join fx_kendall using ({P})),
 p as (select *, row_number() over (partition by {V} order by prompt_id) - 1 as pos, count(*) over (partition by {V}) as np from f),
 i as ({draws}), z as (select {V}, b, {_POOL} from p join i using (np, pos) group by {V}, b), l as (select {V}, b, {_LONG} from z),
 w as (select task, model_name, b, metric, {_VARIANTS} from l group by all), c as (select task, model_name, metric, {_CONTRASTS} as x from w)
 select task, model_name, metric, contrast, {whole('stddev_samp(x)')} as se, {whole('quantile_cont(x, 0.025)')} as lo, {whole('quantile_cont(x, 0.975)')} as hi from c group by task, model_name, metric, contrast)) q
 join (with f as (select * from fx_prompt join fx_spearman using ({P}) left join fx_kendall using ({P})), z as (select {V}, {_POOL} from f group by {V}), l as (select {V}, {_LONG} from z), w as (select task, model_name, metric, {_VARIANTS} from l group by all)
 select task, model_name, metric, {_CONTRASTS} as value from w) v using (task, model_name, metric, contrast)
 where contrast <> 'percent_delta' or metric in {_POSITIVE}"""


def _correlated_components(spark: SparkSession, d: str) -> DataFrame:
    found = correlation.correlations(fx.rollouts(spark, d), "seq_len", "rate").drop("n")
    return _components(spark, d).drop("pearson", "covariance").join(found, PROMPT)


def _hashed_draws(n_prompts: int):
    """Draws by a formula that SQL has as well."""
    b, slot = np.indices((bootstrap.N_BOOT, n_prompts))
    yield ((b * 7919 + slot * 104729 + b * slot * 31) % 1000003) % n_prompts


@query(_bootstrap_sql("select np, b, s, ((b * 7919 + s * 104729 + b * s * 31) % 1000003) % np as pos from (select distinct np from p) cross join range(2000) b(b) cross join lateral (select unnest(range(np)) as s)"))
def bootstrap_ci(spark, d):
    prompts = _correlated_components(spark, d)
    return rounded(bootstrap.comparison(prompts, _hashed_draws, ["task", "model_name"]))


def _drawn(most: int = 5) -> str:
    """The seeded generator's draws for up to so many prompts, a digit each: an input table of the SQL."""
    digits = {n: "".join(map(str, np.random.default_rng(bootstrap.SEED).integers(0, n, (bootstrap.N_BOOT, n)).ravel())) for n in range(1, most + 1)}
    rows = ", ".join(f"({n}, '{x}')" for n, x in digits.items())
    return f"select n::bigint as np, (k - 1) // n as b, (k - 1) % n as s, substr(digits, k::int, 1)::bigint as pos from (values {rows}) t(n, digits) cross join lateral (select unnest(range(1, len(digits) + 1)) as k)"


@query(_bootstrap_sql(_drawn()))
def bootstrap_seeded(spark, d):
    prompts = _correlated_components(spark, d)
    return rounded(bootstrap.comparison(prompts, bootstrap.seeded_draws(), ["task", "model_name"]))


def _plain_panel(spark: SparkSession, d: str) -> DataFrame:
    return results.cut(panel.panel(tree.prompt_metrics(fx.rollouts(spark, d)), semantic.prompt_diversity(fx.diversity(spark, d))))


_LEVELS = "select 'task[' || task || ']' as term from (select distinct task from fx_panel) where task > (select min(task) from fx_panel) union all select 'model_name[' || model_name || ']' from (select distinct model_name from fx_panel) where model_name > (select min(model_name) from fx_panel)"
_NAMED = "select unnest(['Intercept', 'model_variant[instruct]', 'R_bar', 'N_bar']) as term"
_ZERO = "select {0}term, 0.0::double as residual, true as sound from ({1})".format


def _equations(rows: DataFrame, design, found: regression.Fit) -> DataFrame:
    """What the normal equations leave of each term, and whether its error, p value and interval are such."""
    sound = {n: bool(c.stderr > 0 and 0 <= c.pvalue <= 1 and c.interval[0] < c.estimate < c.interval[1] and abs((c.interval[1] - c.interval[0]) / c.stderr - 2 * regression.Z95) < 1e-9) for n, c in found.terms.items()}
    left = regression.normal_equations(rows, "D", design, found)
    return left.select("term", (F.round("residual", 6) + F.lit(0.0)).alias("residual"), F.element_at(F.create_map(*(F.lit(x) for kv in sound.items() for x in kv)), F.col("term")).alias("sound"))


@query(_ZERO("", f"{_LEVELS} union all {_NAMED} union all select 'model_name[' || model_name || ']:model_variant[instruct]' from (select distinct model_name from fx_panel) where model_name > (select min(model_name) from fx_panel)"))
def lmm_main(spark, d):
    rows = _plain_panel(spark, d)
    return _equations(rows, regression.main_design(rows), regression.main_regression(rows))


@query(_ZERO("", f"{_LEVELS} union all {_NAMED} union all select 'R_bar:model_variant[instruct]'"))
def lmm_interaction(spark, d):
    rows = _plain_panel(spark, d)
    return _equations(rows, regression.interaction_design(rows), regression.interaction_regression(rows))


@query(_ZERO("model, ", f"select m.model, t.term from (select unnest(['line', 'curve']) as model) m cross join ({_LEVELS} union all {_NAMED} union all select 'R_bar:model_variant[instruct]' union all select unnest(['R_bar^2', 'R_bar^2:model_variant[instruct]'])) t where m.model = 'curve' or t.term not like 'R_bar^2%'"))
def lmm_quadratic(spark, d):
    rows, design, square = regression.quadratic_designs(_plain_panel(spark, d))
    line, curve = _equations(rows, design, regression.fit(rows, "D", design, reml=False)), _equations(rows, design | square, regression.fit(rows, "D", design | square, reml=False))
    return line.withColumn("model", F.lit("line")).unionByName(curve.withColumn("model", F.lit("curve")))


@query()
def lmm_robustness(spark, d):
    return spark.createDataFrame(sorted(regression.quadratic_robustness(_plain_panel(spark, d)).items()), "name string, value double")


def _beta_terms(spark: SparkSession, found: beta.BetaFit) -> DataFrame:
    return spark.createDataFrame([c.as_row(t) for t, c in found.mean_terms.items()], "term string, estimate double, stderr double, pvalue double, ci_low double, ci_high double")


@query()
def beta_interaction(spark, d):
    return _beta_terms(spark, beta.beta_interaction(panel.z_scored(_panel(spark, d)), task="AFRICA"))


@query()
def beta_vendi(spark, d):
    return _beta_terms(spark, beta.beta_interaction(panel.z_scored(_panel(spark, d)), "VS01", dispersion_df=4, task="AFRICA", spline_by_variant=True))


@query()
def beta_residuals(spark, d):
    """Simulated residuals of the beta model over the panel."""
    rows = results.cut(panel.z_scored(_plain_panel(spark, d)))
    found = beta.beta_interaction(rows, task="AFRICA")
    return spark.createDataFrame(sorted(beta.residual_tests(found).items()), "name string, value double")


# Artifacts and results


@query(f"""select {V}, name, {R('value', 'value')} from (select {V}, unnest(['prompts', 'ce_star_max', 'gen_ppl', 'branching_factor', 'correlation.pearson', 'correlation.covariance']) as name, unnest([prompts::double, ce_star_max, gen_ppl, branching_factor, pearson, covariance]) as value
 from (select {V}, count(*) as prompts, {R('avg(ce)', 'ce_star_max')}, {R('exp(avg(ce) / avg(nbar))', 'gen_ppl')}, {R('exp(avg(rbar))', 'branching_factor')}, {FISHER('pearson', 'm', 'pearson')}, {WEIGHTED('cov', '(m - 1)', 'covariance')} from fx_prompt group by {V}))""")
def flat_summary(spark, d):
    pooled = tree.pooled_metrics(tree.prompt_metrics(fx.rollouts(spark, d)))
    nested = pooled.select(*RUN, "prompts", "ce_star_max", "gen_ppl", "branching_factor", F.struct("pearson", "covariance").alias("correlation"))
    return rounded(results.flat_scalars(nested, RUN))


def _expected(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*RUN).agg(F.max("prompt_id").alias("num_prompts"))


@query(f"select {V}, max(prompt_id) as num_prompts, count(distinct prompt_id) filter (reward > 0) as found, count(distinct prompt_id) filter (reward > 0) >= max(prompt_id) as complete from fx_rollouts group by {V}")
def completeness_gate(spark, d):
    rows = fx.rollouts(spark, d)
    return artifacts.completeness(_expected(rows), rows.where("reward > 0"), RUN)


@query(f"select {P}, rollout_idx from fx_rollouts f where not exists (select 1 from fx_rollouts g where g.task = f.task and g.model_name = f.model_name and g.model_variant = f.model_variant and g.prompt_id = f.prompt_id and g.reward > 8500)")
def pending_prompts(spark, d):
    rows = fx.rollouts(spark, d)
    return artifacts.pending(rows, rows.where("reward > 8500"), RUN).select(*PROMPT, "rollout_idx")


@query("select t.task, m.model_name, v.model_variant from (select distinct r_name as task from region) t cross join (values ('fam0'), ('fam1'), ('fam2'), ('fam3')) m(model_name) cross join (values ('base'), ('instruct')) v(model_variant) where (t.task, m.model_name, v.model_variant) not in (select (task, model_name, model_variant) from fx_rollouts)")
def matrix_missing(spark, d):
    tasks = [r[0] for r in fx.table(spark, d, "region").select("r_name").distinct().collect()]
    cells = artifacts.matrix(spark, task=tasks, model_name=["fam0", "fam1", "fam2", "fam3"], model_variant=["base", "instruct"])
    return artifacts.missing_of(cells, fx.rollouts(spark, d).select(*RUN).distinct(), RUN)


@query("select distinct concat_ws('_', 'x', model_name, model_variant, task) as title from fx_rollouts")
def run_titles(spark, d):
    return fx.rollouts(spark, d).select(*RUN).distinct().select(E.run_title(F.col("model_name"), F.col("model_variant"), F.col("task"), F.lit("x")).alias("title"))
