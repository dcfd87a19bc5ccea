"""Rollout-shaped tables derived from the star schema: lines of an order are a step's candidates, an
order is a step, a customer a rollout, a nation a prompt, a region a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import judge, semantic, tree

MAX_NEW_TOKENS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str, score=None) -> DataFrame:
    """orderkey and its lines' scores (log prices unless given), in line order."""
    lines = table(spark, sf_dir, "lineitem")
    score = F.ln("l_extendedprice") if score is None else score
    listed = lines.groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", score.cast("double").alias("x")))).alias("lines"))
    return listed.select("orderkey", F.transform("lines", lambda s: s["l_linenumber"]).alias("numbers"), F.transform("lines", lambda s: s["x"]).alias("scores"))


def shared_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with each line's share of its order's price: divided, not by way of logarithms, and summed in the order of the table's rows."""
    lines = table(spark, sf_dir, "lineitem")
    own = F.struct("l_linenumber", F.col("l_extendedprice").alias("x"), F.col("_metadata.row_index").alias("row"))
    listed = lines.groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.array_sort(F.collect_list(own)).alias("lines"))
    in_rows = F.array_sort(F.transform("lines", lambda s: F.struct(s["row"].alias("row"), s["l_linenumber"].alias("line"), s["x"].alias("x"))))
    total = F.aggregate(in_rows, F.lit(0.0), lambda t, s: t + F.coalesce(s["x"], F.lit(0.0)))
    shares = E.let(total, lambda t: F.transform("lines", lambda s: E.ratio(s["x"], t)))
    return listed.select("orderkey", F.transform("lines", lambda s: s["l_linenumber"]).alias("numbers"), F.transform("lines", lambda s: F.ln(s["x"])).alias("scores"), shares.alias("shares"))


def _placed(orders: DataFrame, entropy: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("custkey").orderBy("o_orderdate", "orderkey"))
    return orders.join(entropy, "orderkey").select("custkey", "orderkey", place.alias("t"), "h", "k")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), "o_orderdate")


def long_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orderkey, h, k from the lines as they are, a row for each candidate."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.ln("l_extendedprice").alias("score"))
    return tree.step_entropies(lines, ["orderkey"], "score")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """custkey, orderkey, t, h, k; the candidates of a step as an array."""
    entropy = candidates(spark, sf_dir).select("orderkey", E.step_entropy(E.normalize_scores(F.col("scores"))).alias("h"), F.size("scores").cast("long").alias("k"))
    return _placed(_orders(spark, sf_dir), entropy)


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task, model_name, model_variant, prompt_id, rollout_idx, reward of each customer."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return customer.select(
        F.col("r_name").alias("task"),
        F.concat(F.lit("fam"), (F.floor(F.col("c_custkey") / 2) % 3).cast("string")).alias("model_name"),
        F.when(F.col("c_custkey") % 2 == 0, "base").otherwise("instruct").alias("model_variant"),
        F.col("c_nationkey").alias("prompt_id"),
        F.col("c_custkey").alias("rollout_idx"),
        F.col("c_acctbal").alias("reward"),
    )


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task, model_name, model_variant, prompt_id, rollout_idx, reward, h_sum, seq_len, rate: sums over rows, no array is built."""
    sums = tree.rollout_sums(_orders(spark, sf_dir).join(long_entropies(spark, sf_dir), "orderkey"), ["custkey"])
    return named(spark, sf_dir).join(sums, F.col("rollout_idx") == F.col("custkey")).drop("custkey")


def rollouts_with_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from arrays of step entropies, as artifacts hold them, with ``step_entropy``."""
    arrays = steps(spark, sf_dir).groupBy("custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "h"))), lambda s: s["h"]).alias("step_entropy"))
    return tree.rollout_entropies(named(spark, sf_dir).join(arrays, F.col("rollout_idx") == F.col("custkey")).drop("custkey"))


def run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with the names of their runs."""
    placed = _placed(_orders(spark, sf_dir), long_entropies(spark, sf_dir))
    return placed.join(named(spark, sf_dir), F.col("custkey") == F.col("rollout_idx")).select("task", "model_name", "model_variant", "prompt_id", "rollout_idx", "t", "h")


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts with an embedding each."""
    vectors = table(spark, sf_dir, "embeddings")
    total = vectors.agg(F.count(F.lit(1)).alias("total"))  # one row
    return rollouts(spark, sf_dir).join(F.broadcast(total)).withColumn("vec_id", F.col("rollout_idx") % F.col("total")).drop("total").join(vectors.select("vec_id", "embedding"), "vec_id", "left")


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prompt_id, rollout_idx, embedding: groups of many and of five vectors, each vector one of eight orthogonal ones, so a kernel's spectrum is how often each occurs."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rollout_idx"), "label")
    which = (F.col("rollout_idx") * 7 + F.floor(F.col("rollout_idx") / 5)) % 8
    turned = F.array(*(F.when(F.bit_count(which.bitwiseAND(F.lit(i))) % 2 == 0, 1.0).otherwise(-1.0) / F.sqrt(F.lit(8.0)) for i in range(8)))
    many = vectors.select(F.col("label").cast("long").alias("prompt_id"), "rollout_idx", turned.alias("embedding"))
    few = vectors.select((F.floor(F.col("rollout_idx") / 5) + 10_000).alias("prompt_id"), "rollout_idx", turned.alias("embedding"))
    return many.unionByName(few)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings alone: label as prompt, vector as rollout."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("prompt_id"), F.col("vec_id").alias("rollout_idx"), "embedding")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("rollout_idx")
    return judge.subsample(labelled(spark, sf_dir), keys=["prompt_id"], order=(v * 7919) % 10007)


def directed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prompt_id, r, c, vr, vc, sim for both orders."""
    half = judge.forward_pairs(nodes(spark, sf_dir), ["prompt_id"])
    sim = F.round(E.dot(F.col("embedding_r"), F.col("embedding_c")), 6)
    one = half.select("prompt_id", "r", "c", F.col("rollout_idx_r").alias("vr"), F.col("rollout_idx_c").alias("vc"), sim.alias("sim"))
    return one.unionByName(one.select("prompt_id", F.col("c").alias("r"), F.col("r").alias("c"), F.col("vc").alias("vr"), F.col("vr").alias("vc"), "sim"))


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge whose threshold depends on the first item, so that verdicts can differ by order."""
    return directed_pairs(spark, sf_dir).select("prompt_id", "r", "c", (F.col("sim") > 0.17 + F.lit(0.03) * (F.col("vr") % 3)).alias("is_similar"))


#: What a judge may reply.
REPLIES = ["Both agree. Response: similar", "They diverge. RESPONSE: DIFFERENT", "Could be Response: similar at first. Response: different", 'Not "response: different". Response: Similar', "no verdict", ""]


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = (F.col("r") * 5 + F.col("c")) % 6
    return directed_pairs(spark, sf_dir).select("prompt_id", "r", "c", F.element_at(F.array(*map(F.lit, REPLIES)), (which + 1).cast("int")).alias("text"), F.when(which == 4, "length").otherwise("stop").alias("finish_reason"))


def diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.rollout_diversity(embedded(spark, sf_dir))


#: The same tables for DuckDB.
VIEWS = """
fx_lines as (select l_orderkey, l_linenumber, l_quantity, l_extendedprice / sum(l_extendedprice) over (partition by l_orderkey) as p from lineitem),
fx_steps as (select o.o_custkey as custkey, o.o_orderkey as orderkey, row_number() over (partition by o.o_custkey order by o.o_orderdate, o.o_orderkey) as t, s.h as h, s.k as k
  from orders o join (select l_orderkey, count(*) as k, -sum(p * ln(p)) as h from fx_lines group by l_orderkey) s on s.l_orderkey = o.o_orderkey),
fx_rollouts as (select r.r_name as task, c.c_nationkey as prompt_id, concat('fam', cast(cast(floor(c.c_custkey / 2) as bigint) % 3 as varchar)) as model_name,
  case when c.c_custkey % 2 = 0 then 'base' else 'instruct' end as model_variant, c.c_custkey as rollout_idx, x.n as seq_len, x.hs as h_sum, x.hs / greatest(x.n, 1) as rate, c.c_acctbal as reward
  from customer c join nation n on n.n_nationkey = c.c_nationkey join region r on r.r_regionkey = n.n_regionkey
  join (select custkey, count(*) as n, sum(h) as hs from fx_steps group by custkey) x on x.custkey = c.c_custkey),
fx_masked as (select f.*, row_number() over (partition by task, model_name, model_variant, prompt_id order by reward desc, rollout_idx) <= ceil(cast(0.7 as double) * count(*) over (partition by task, model_name, model_variant, prompt_id)) as keep from fx_rollouts f),
fx_subsets as (select 'raw' as subset, * from fx_masked union all select 'kept' as subset, * from fx_masked where keep),
fx_prompt as (select task, model_name, model_variant, prompt_id, count(*) as m, avg(h_sum) as ce, avg(seq_len) as nbar, avg(rate) as rbar, exp(avg(h_sum) / nullif(avg(seq_len), 0)) as gen_ppl, exp(avg(rate)) as bf,
  avg(case when seq_len >= 12 then 1.0::double else 0.0::double end) as trunc, case when count(*) > 1 then covar_samp(seq_len, rate) end as cov,
  case when count(*) > 1 and stddev_samp(seq_len) * stddev_samp(rate) > 0 then greatest(-1.0, least(1.0, covar_samp(seq_len, rate) / (stddev_samp(seq_len) * stddev_samp(rate)))) end as pearson
  from fx_rollouts group by all),
fx_subset_prompt as (select subset, task, model_name, model_variant, prompt_id, count(*) as m, avg(h_sum) as ce, avg(seq_len) as nbar, avg(rate) as rbar from fx_subsets group by all),
fx_ranked as (select f.*, rank() over (partition by task, model_name, model_variant, prompt_id order by seq_len) + (count(*) over (partition by task, model_name, model_variant, prompt_id, seq_len) - 1) / 2.0::double as ra,
  rank() over (partition by task, model_name, model_variant, prompt_id order by rate) + (count(*) over (partition by task, model_name, model_variant, prompt_id, rate) - 1) / 2.0::double as rb from fx_rollouts f),
fx_spearman as (select task, model_name, model_variant, prompt_id, count(*) as n, case when count(*) > 1 and stddev_samp(ra) * stddev_samp(rb) > 0 then greatest(-1.0, least(1.0, covar_samp(ra, rb) / (stddev_samp(ra) * stddev_samp(rb)))) end as spearman from fx_ranked group by all),
fx_kendall as (select a.task, a.model_name, a.model_variant, a.prompt_id, case when sum(abs(sign(a.seq_len - b.seq_len))) > 0 and sum(abs(sign(a.rate - b.rate))) > 0 then
    sum(sign(a.seq_len - b.seq_len) * sign(a.rate - b.rate)) / sqrt(sum(abs(sign(a.seq_len - b.seq_len)))::double * sum(abs(sign(a.rate - b.rate)))::double) end as kendall
  from fx_rollouts a join fx_rollouts b on a.task = b.task and a.model_name = b.model_name and a.model_variant = b.model_variant and a.prompt_id = b.prompt_id and a.rollout_idx < b.rollout_idx group by all),
fx_axes as (select prompt_id, sum(c)::bigint as m, -sum(c / s * ln(c / s)) as h from (select prompt_id, w, count(*)::double as c, sum(count(*)) over (partition by prompt_id)::double as s from
  (select g.prompt_id, (vec_id * 7 + vec_id // 5) % 8 as w from embeddings cross join lateral (select unnest([label::bigint, vec_id // 5 + 10000]) as prompt_id) g) group by prompt_id, w) group by prompt_id),
fx_n as (select count(*) as n from embeddings),
fx_embedded as (select f.*, e.embedding::double[] as e from fx_rollouts f cross join fx_n join embeddings e on e.vec_id = f.rollout_idx % fx_n.n),
fx_cells as (select f.task, f.model_name, f.model_variant, f.prompt_id, f.rollout_idx, f.seq_len, unnest(e) as x, unnest(range(len(e))) as d from fx_embedded f),
fx_sums as (select task, model_name, model_variant, prompt_id, d, sum(x) as s, count(*) as m from fx_cells group by all),
fx_diversity as (select c.task, c.model_name, c.model_variant, c.prompt_id, c.rollout_idx, c.seq_len, 1 - (sum(c.x * s.s) - 1) / nullif(s.m - 1, 0) as diversity
  from fx_cells c join fx_sums s using (task, model_name, model_variant, prompt_id, d) group by c.task, c.model_name, c.model_variant, c.prompt_id, c.rollout_idx, c.seq_len, s.m),
fx_bucketed as (select f.*, ntile(3) over (partition by task, model_name, model_variant, prompt_id order by seq_len, rollout_idx) - 1 as bucket_id from fx_embedded f),
fx_bucket_sums as (select task, model_name, model_variant, prompt_id, bucket_id, d, sum(x) as s, count(*) as n from (select task, model_name, model_variant, prompt_id, bucket_id, unnest(e) as x, unnest(range(len(e))) as d from fx_bucketed) group by all),
fx_pairsims as (select task, model_name, model_variant, prompt_id, bucket_id, (sum(s * s) - max(n)) / 2 / (max(n) * (max(n) - 1) / 2.0::double) as sim from fx_bucket_sums group by all having max(n) > 1),
fx_bucket_stats as (select p.task, p.model_name, p.model_variant, p.prompt_id, g.bucket, s.sim as average_similarity, 1 - s.sim as semantic_diversity, coalesce(b.n, 0)::bigint as num_responses, b.lo as min_length, b.hi as max_length
  from (select distinct task, model_name, model_variant, prompt_id from fx_bucketed) p cross join (values (0, 'short'), (1, 'medium'), (2, 'long')) g(bucket_id, bucket)
  left join (select task, model_name, model_variant, prompt_id, bucket_id, count(*) as n, min(seq_len) as lo, max(seq_len) as hi from fx_bucketed group by all) b on b.task = p.task and b.model_name = p.model_name and b.model_variant = p.model_variant and b.prompt_id = p.prompt_id and b.bucket_id = g.bucket_id
  left join fx_pairsims s on s.task = p.task and s.model_name = p.model_name and s.model_variant = p.model_variant and s.prompt_id = p.prompt_id and s.bucket_id = g.bucket_id),
fx_nodes as (select label as prompt_id, vec_id, pos from (select label, vec_id, row_number() over (partition by label order by (vec_id * 7919) % 10007, vec_id) as pos from embeddings) q where pos <= 24),
fx_pairs as (select a.prompt_id as prompt_id, a.pos as r, b.pos as c, a.vec_id as vr, b.vec_id as vc, round(list_inner_product(cast(ea.embedding as double[]), cast(eb.embedding as double[])), 6) as sim
  from fx_nodes a join fx_nodes b on a.prompt_id = b.prompt_id and a.pos <> b.pos join embeddings ea on ea.vec_id = a.vec_id join embeddings eb on eb.vec_id = b.vec_id),
fx_judgments as (select prompt_id, r, c, sim > 0.17 + 0.03 * (vr % 3) as is_similar from fx_pairs),
fx_edges as (select x.prompt_id as prompt_id, x.r as r, x.c as c from fx_judgments x join fx_judgments y on x.prompt_id = y.prompt_id and x.r = y.c and x.c = y.r where x.is_similar and y.is_similar),
fx_reach as (select prompt_id, pos, pos as root from fx_nodes union select e.prompt_id, e.c as pos, w.root from fx_reach w join fx_edges e on e.prompt_id = w.prompt_id and e.r = w.pos),
fx_clusters as (select prompt_id, pos, min(root) as cluster from fx_reach group by all),
fx_rse as (select prompt_id, sum(s)::bigint as m, count(*) as n_clusters, greatest(-sum(s / m * ln(s / m)), 0) as rse from (select prompt_id, cluster, count(*)::double as s, sum(count(*)) over (partition by prompt_id)::double as m from fx_clusters group by prompt_id, cluster) q group by prompt_id),
fx_replies as (select prompt_id, r, c, case when (r * 5 + c) % 6 = 4 then 'length' else 'stop' end as finish_reason, case (r * 5 + c) % 6 when 0 then 'Both agree. Response: similar' when 1 then 'They diverge. RESPONSE: DIFFERENT'
  when 2 then 'Could be Response: similar at first. Response: different' when 3 then 'Not "response: different". Response: Similar' when 4 then 'no verdict' else '' end as text from fx_pairs),
fx_last as (select *, length(lower(text)) - instr(reverse(lower(text)), reverse('response: similar')) as ys, instr(lower(text), 'response: similar') > 0 as y, length(lower(text)) - instr(reverse(lower(text)), reverse('response: different')) as ns, instr(lower(text), 'response: different') > 0 as n from fx_replies),
fx_verdicts as (select prompt_id, r, c, y and (not n or ys - 17 > ns - 19) as is_similar, case when y or n then 'ok' when finish_reason = 'length' then 'truncated' else 'parse_failed' end as status from fx_last),
fx_panel as (select p.task, p.model_name, p.model_variant, p.prompt_id, d.d as "D", p.rbar as "R_bar", p.nbar as "N_bar", p.m as "M", concat(p.task, '/', p.prompt_id) as prompt_uid from fx_prompt p
  join (select task, model_name, model_variant, prompt_id, avg(diversity) as d from fx_diversity group by all) d using (task, model_name, model_variant, prompt_id) where d.d is not null)
"""


def sql(body: str) -> str:
    return f"with recursive {VIEWS}\n{body}"
