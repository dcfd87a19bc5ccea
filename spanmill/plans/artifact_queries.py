"""Queries over stores, sinks, hooks and gates: each writes and reads back through the library, with the SQL that gives the same rows from the tables themselves."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import PROMPT, RUN, correlation, filtering, judge, panel, regression, semantic, tree
from ..schemas import ROLLOUTS, RUN_KEYS, names
from ..sources import artifacts, external, prompts, results, shards
from . import compute
from . import fixtures as fx
from .queries import FISHER, P, R, V, WEIGHTED, query, rounded

#: Step entropies as artifacts store them, and each prompt's place in its task, for DuckDB.
_STORED = f"(select f.*, s.hs, dense_rank() over (partition by f.task order by f.prompt_id) - 1 as spot from fx_rollouts f join (select custkey, sum(h::float::double) as hs from fx_steps group by custkey) s on s.custkey = f.rollout_idx)"


def _store(spark: SparkSession) -> artifacts.Store:
    return artifacts.Store(spark, results.temporary(spark, "store"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Rollouts in the shape of artifacts; prompts are numbered within their task."""
    rows = fx.rollouts_with_steps(spark, d)
    at = rows.select("task", "prompt_id").distinct().groupBy("task").agg(F.array_sort(F.collect_list("prompt_id")).alias("ids"))  # the prompts of a task: a file's
    place = (F.array_position("ids", F.col("prompt_id")) - 1).cast("int")
    texts = F.concat(F.lit("text "), F.col("rollout_idx").cast("string"))
    columns = {"run_name": F.lit("r"), "prompt_id": place, "text": texts, "token_ids": F.sequence(F.lit(1).cast("long"), "seq_len"), "step_logprobs": F.lit(None).cast("array<array<float>>"), "step_entropy": F.col("step_entropy").cast("array<float>"), "rollout_idx": F.col("rollout_idx").cast("int")}
    return rows.join(at, "task").withColumns(columns).select(*names(ROLLOUTS), "reward")


def _filled(spark: SparkSession, d: str) -> artifacts.Store:
    store = _store(spark)
    store.append(_stored(spark, d), "rollouts")
    return store


@query(f"select {V}, spot::int as prompt_id, rollout_idx::int as rollout_idx, text, seq_len, {R('hs', 'h_sum')} from (select *, 'text ' || rollout_idx as text from {_STORED})")
def artifact_rollouts(spark, d):
    rows = tree.rollout_entropies(_filled(spark, d).read("rollouts").select(*RUN, "prompt_id", "rollout_idx", "text", "step_entropy"))
    return rounded(rows.select(*RUN, "prompt_id", "rollout_idx", "text", "seq_len", "h_sum"))


@query(f"select task, model_variant, spot::int as prompt_id, rollout_idx::int as rollout_idx, 'text ' || rollout_idx as text from {_STORED} where model_name = 'fam1' and model_variant = 'base'")
def artifact_texts(spark, d):
    return _filled(spark, d).texts(model_name="fam1", model_variant="base").select("task", "model_variant", "prompt_id", "rollout_idx", "text")


_SHARD = f"(select s.*, row_number() over (partition by {V}, spot order by rollout_idx) - 1 as place from {_STORED} s)"


def _in_shards(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """A folder of shards of all runs; rollouts are numbered within their prompts, as shards have them."""
    place = (F.row_number().over(Window.partitionBy(*RUN_KEYS, "prompt_id").orderBy("rollout_idx")) - 1).cast("int")
    rows, root = _stored(spark, d).withColumn("rollout_idx", place), results.temporary(spark, "shards")
    shards.write_shards(rows.withColumn("prompt", F.concat_ws(" ", "task", "prompt_id")), root)
    return root, rows


@query(f"select {V}, spot::int as prompt_id, place::int as rollout_idx, concat_ws(' ', task, spot) as prompt, text, seq_len, {R('hs', 'h_sum')} from (select *, 'text ' || rollout_idx as text from {_SHARD})")
def shard_rollouts(spark, d):
    """All rollouts written as shards, a file each prompt; entropies and texts read back from their byte ranges."""
    found = shards.read_shards(spark, _in_shards(spark, d)[0], columns=[*RUN, "prompt_id", "rollout_idx", "prompt", "text", "step_entropy"])
    return rounded(tree.rollout_entropies(found).select(*RUN, "prompt_id", "rollout_idx", "prompt", "text", "seq_len", "h_sum"))


@query(f"select task, model_variant, spot::int as prompt_id, place::int as rollout_idx, 'text ' || rollout_idx as text, round(reward::float::double, 6) + 0.0::double as reward from {_SHARD} where model_name = 'fam1' and task in ('ASIA', 'EUROPE')")
def shard_run(spark, d):
    """Texts and rewards of some runs, whose folders alone are listed and whose headers alone are read for the texts."""
    root, rows = _in_shards(spark, d)
    shards.write_shards(rows.withColumn("reward_name", F.lit("w")), root, "rewards")
    of = lambda df: df.where(F.col("model_name") == "fam1").where(F.col("task").isin("ASIA", "EUROPE"))
    texts = of(shards.read_shards(spark, root, columns=[*RUN, "prompt_id", "rollout_idx", "text"]))
    rewards = of(shards.read_shards(spark, root, "rewards", columns=[*RUN, "prompt_id", "rollout_idx", "reward"]))
    return rounded(texts.join(rewards, [*RUN, "prompt_id", "rollout_idx"]).select("task", "model_variant", "prompt_id", "rollout_idx", "text", F.col("reward").cast("double").alias("reward")))


@query("select prompt_id::int as prompt_id, r::int as r, c::int as c, vr::int as rollout_idx_r, vc::int as rollout_idx_c, sim > 0.17 + 0.03 * (vr % 3) as is_similar, case when sim > 0.17 + 0.03 * (vr % 3) then 'ok' else 'parse_failed' end as status from fx_pairs")
def shard_judgments(spark, d):
    """Verdicts written as a matrix and a list for each prompt, and read back."""
    similar = F.col("sim") > 0.17 + F.lit(0.03) * (F.col("vr") % 3)
    rows = fx.directed_pairs(spark, d).select("prompt_id", "r", "c", F.col("vr").alias("rollout_idx_r"), F.col("vc").alias("rollout_idx_c"), similar.alias("is_similar"), F.when(similar, "ok").otherwise("parse_failed").alias("status"))
    root = results.temporary(spark, "shards")
    shards.write_shards(rows.withColumns({**{k: F.lit(v) for k, v in _CELL.items()}, "judge_name": F.lit("j"), "text": F.lit("said")}), root, "judgments")
    return shards.read_shards(spark, root, "judgments").where("judge_name = 'j' and text = 'said'").select("prompt_id", "r", "c", "rollout_idx_r", "rollout_idx_c", "is_similar", "status")


@query(f"select {V}, count(distinct spot) as prompts from {_STORED} group by {V}")
def artifact_counts(spark, d):
    return _filled(spark, d).count_prompts("rollouts").select(*RUN, "prompts")


@query(f"select {V}, count(*) as rollouts, true as refused from {_STORED} where model_name <> 'fam2' or rollout_idx % 2 = 0 group by {V}")
def artifact_reset(spark, d):
    store, refused = _filled(spark, d), False
    half = _stored(spark, d).where("model_name = 'fam2' and rollout_idx % 2 = 0")
    try:
        store.reset(half, "rollouts")
    except ValueError:
        refused = True
    store.reset(half, "rollouts", force=True)
    # A run without an even rollout is not in the new rows and so keeps its old ones.
    return store.read("rollouts").where("model_name <> 'fam2' or rollout_idx % 2 = 0").groupBy(*RUN).agg(F.count(F.lit(1)).alias("rollouts")).withColumn("refused", F.lit(refused))


def _runs(rows: DataFrame) -> DataFrame:
    """Settings of the runs that rollouts have."""
    fixed = {"prompt_file": F.lit("p"), "n_samples": F.lit(100), "max_new_tokens": F.lit(fx.MAX_NEW_TOKENS), "temperature": F.lit(1.0), "top_k": F.lit(100), "top_p": F.lit(1.0), "seed": F.lit(42), "logprobs": F.lit(100), "enable_thinking": F.lit(False)}
    counted = rows.groupBy(*RUN_KEYS).agg(F.count_distinct("prompt_id").cast("int").alias("num_prompts"))
    return counted.withColumns(fixed)


@query(f"select {V}, (n + 7)::int as num_prompts, n::bigint as held, true as refused from (select {V}, count(distinct spot) as n from {_STORED} group by {V}) order by task, model_name, model_variant limit 2")
def run_metadata(spark, d):
    store = _filled(spark, d)
    store.save_runs(_runs(store.read("rollouts")))
    out = []
    for row in store.runs().orderBy(*RUN).limit(2).collect():
        run = row.asDict()
        held = store.resume(run | {"num_prompts": run["num_prompts"] + 7})
        try:
            store.resume(run | {"seed": 1})
            refused = False
        except ValueError:
            refused = True
        out.append((*(run[k] for k in RUN), held, refused))
    held = spark.createDataFrame(out, ", ".join(f"{k} string" for k in RUN) + ", held long, refused boolean")
    return store.runs().select(*RUN, "num_prompts").join(held, RUN).select(*RUN, "num_prompts", "held", "refused")


@query("select prompt_id::int as prompt_id, r::int as r, c::int as c, is_similar, case when is_similar then 'ok' else 'parse_failed' end as status from fx_judgments")
def artifact_judgments(spark, d):
    return _judged_store(spark, d).read("judgments", judge_name="j").select("prompt_id", "r", "c", "is_similar", "status")


_CELL = {"model_name": "m", "task": "t", "model_variant": "base", "run_name": "r"}


def _judged_store(spark: SparkSession, d: str) -> artifacts.Store:
    store = _store(spark)
    rows = fx.judgments(spark, d).withColumns({**{k: F.lit(v) for k, v in _CELL.items()}, "judge_name": F.lit("j"), "prompt_id": F.col("prompt_id").cast("int"), "r": F.col("r").cast("int"), "c": F.col("c").cast("int"), "status": F.when(F.col("is_similar"), "ok").otherwise("parse_failed"), "text": F.lit("")})
    store.append(rows, "judgments")
    return store


@query("select count(distinct prompt_id) as held, 0::bigint as of_another, true as refused from fx_judgments")
def resume_judgments(spark, d):
    store, settings = _judged_store(spark, d), {"judge_name": "j", "seed": 42}
    held, other = store.resume_judgments(_CELL, settings, settings), store.resume_judgments(_CELL, {"judge_name": "k"}, None)
    try:
        store.resume_judgments(_CELL, settings, settings | {"seed": 1})
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(held, other, refused)], "held long, of_another long, refused boolean")


@query(f"select {V}, spot::int as prompt_id, rollout_idx::int as rollout_idx, case when model_name <> 'fam1' or not bool_or(spot = 0) over (partition by {V}) then reward::float::double end as reward from {_STORED}")
def attached_rewards(spark, d):
    """Rewards of a run count only if no prompt lacks them."""
    rows = _stored(spark, d)
    found = rows.select(*RUN_KEYS, "prompt_id", "rollout_idx", F.col("reward").cast("float").alias("reward")).where("model_name <> 'fam1' or prompt_id > 0")
    out = artifacts.attach(rows.drop("reward"), found, "reward", _runs(rows))
    return out.select(*RUN, "prompt_id", "rollout_idx", F.col("reward").cast("double").alias("reward"))


_SUBSETS = f"(select 'raw' as subset, s.*, true as kept from {_STORED} s union all select 'kept', * from (select s.*, row_number() over (partition by {V}, spot order by reward::float desc, rollout_idx) <= ceil(0.7::double * count(*) over (partition by {V}, spot)) as kept from {_STORED} s) where kept)"


@query(f"select subset, {V}, count(*) as num_prompts, {R('avg(ce)', 'ce_star_max')}, {R('exp(avg(ce) / avg(n))', 'gen_ppl')}, {R('avg(trunc)', 'truncation_rate')} from (select subset, {V}, spot, avg(hs) as ce, avg(seq_len) as n, avg(case when seq_len >= 12 then 1.0::double else 0.0::double end) as trunc from {_SUBSETS} join (select {V}, count(distinct spot) as n_spots from {_STORED} group by {V}) using ({V}) where spot < n_spots group by all) group by subset, {V}")
def computed_runs(spark, d):
    """A store's runs from metadata, rollouts and rewards to pooled metrics."""
    store, rows = _filled(spark, d), _stored(spark, d)
    store.save_runs(_runs(rows))
    store.append(rows.withColumn("reward_name", F.lit("w")), "rewards")
    _, pooled = compute.compute_run(store, compute.Compute(use_reward_filter=True), reward_name="w")
    return rounded(pooled.select("subset", *RUN, "num_prompts", "ce_star_max", "gen_ppl", "truncation_rate"))


@query(f"select {P}, count(*) as m, {R('avg(h_sum)', 'ce_star_max')}, null::double as semantic_diversity, null::double as vendi_entropy, 0::bigint as short from fx_rollouts group by {P}")
def prompt_stats_sink(spark, d):
    """Statistics without embeddings, written and read back: semantic fields are null, buckets empty."""
    rows = fx.rollouts(spark, d).withColumn("embedding", F.lit(None).cast("array<float>"))
    path = results.temporary(spark, "stats") + "/prompts"
    results.write_stats(compute.prompt_stats(rows, RUN, fx.MAX_NEW_TOKENS), path)
    found = results.read_stats(spark, path).where("subset = 'raw'")
    return rounded(found.select(*PROMPT, "m", "ce_star_max", "semantic_diversity", "vendi_entropy", F.coalesce(F.col("buckets")["short"]["num_responses"], F.lit(0)).cast("long").alias("short")))


_POOLED = f"select {V}, count(*) as prompts, {R('avg(ce)', 'ce_star_max')}, {FISHER('pearson', 'm', 'pearson')} from fx_prompt group by {V}"


def _pooled(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tree.pooled_metrics(tree.prompt_metrics(fx.rollouts(spark, d))).select(*RUN, "prompts", "ce_star_max", "pearson"))


@query(_POOLED)
def json_sink(spark, d):
    path = results.temporary(spark, "json") + "/pooled"
    results.write_json(_pooled(spark, d).select(*RUN, F.struct("prompts", "ce_star_max", "pearson").alias("metrics")), path)
    return spark.read.schema(", ".join(f"{k} string" for k in RUN) + ", metrics struct<prompts: bigint, ce_star_max: double, pearson: double>").json(path).select(*RUN, "metrics.*")


@query(_POOLED)
def json_text(spark, d):
    found = results.as_json(_pooled(spark, d), RUN)
    return found.select(*RUN, F.from_json("json", "prompts bigint, ce_star_max double, pearson double").alias("x")).select(*RUN, "x.*")


@query(_POOLED)
def csv_sink(spark, d):
    path = results.temporary(spark, "csv") + "/pooled"
    results.write_csv(_pooled(spark, d), path)
    return spark.read.schema(_pooled(spark, d).schema).csv(path, header=True)


def _eos_scorer(prefix: list[int], ids: list[list[int]]) -> list[np.ndarray]:
    """Stands for a language model over eight tokens: the likelihood falls with the distance from the last token."""
    return [-abs(np.arange(8)[None, :] - np.array(own)[:, None] % 8) * 0.5 for own in ids]


@query(f"""select {V}, spot::int as prompt_id, rollout_idx::int as rollout_idx, t::int as t, {R('ln((exp(-abs(2 - t % 8) * 0.5) + exp(-abs(5 - t % 8) * 0.5)) / z)', 'eos_logprob')}, greatest(exp(-abs(2 - t % 8) * 0.5), exp(-abs(5 - t % 8) * 0.5)) >= 1 as in_top
 from (select *, list_sum(list_transform(range(8), lambda v: exp(-abs(v - t % 8) * 0.5))) as z from (select s.*, unnest(range(1, seq_len + 1)) as t from {_STORED} s where model_name = 'fam0'))""")
def eos_payload(spark, d):
    """Rescored, stored and read again, as compute_only and plot_only do one after the other."""
    store, rows = _filled(spark, d), _stored(spark, d).where("model_name = 'fam0'").withColumn("prefix_ids", F.array(F.lit(1).cast("long")))
    score = lambda: external.eos_scored(rows, _eos_scorer, [2, 5], top_k=1)
    compute.eos_payload(store, score, "compute_only")
    found = compute.eos_payload(store, score, "plot_only")
    long = found.select(*RUN, "prompt_id", "rollout_idx", F.posexplode(F.arrays_zip("eos_logprob", "eos_in_top_k")).alias("t", "z"))
    # Stored as floats; the model's values are rounded as doubles here, six digits of either agree.
    return long.select(*RUN, "prompt_id", "rollout_idx", (F.col("t") + 1).alias("t"), (F.round(F.col("z.eos_logprob").cast("double"), 6) + F.lit(0.0)).alias("eos_logprob"), F.col("z.eos_in_top_k").alias("in_top"))


@query("select prompt_id, count(*) as n, 'refused' as strict from fx_verdicts group by prompt_id")
def failure_gate(spark, d):
    judged = judge.judgments(fx.replies(spark, d))
    try:
        judge.require_few_failures(judged, ["prompt_id"]).count()
        strict = "passed"
    except Exception as error:  # Spark wraps what raise_error says
        strict = "refused" if "too many judgments failed" in str(error) else str(error)
    return judge.require_few_failures(judged, ["prompt_id"], 1.0).groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n")).withColumn("strict", F.lit(strict))


def _outputs(prompts: int = 10, size: int = judge.JUDGED, seed: int = 42) -> str:
    """The Mersenne generator's first outputs for each prompt's seed: an input table of the SQL."""
    rows = ", ".join(f"({k}, {i}, {x})" for k in range(prompts) for i, x in enumerate(np.random.RandomState(seed + k)._bit_generator.random_raw(size).tolist()))
    return f"select * from (values {rows}) t(prompt_id, i, x)"


@query(f"""select * from (with recursive raw as ({_outputs()}), own as (select label as prompt_id, vec_id, row_number() over (partition by label order by vec_id) - 1 as place, count(*) over (partition by label) as n from embeddings),
 p as (select prompt_id, max(n) as n, 0 as i, range(max(n)) as r from own group by prompt_id union all
  select p.prompt_id, p.n, p.i + 1, list_transform(p.r, lambda v, k: case when k - 1 = p.i then p.r[p.i + 1 + raw.x % (p.n - p.i)] when k - 1 = p.i + raw.x % (p.n - p.i) then p.r[p.i + 1] else v end) from p join raw using (prompt_id, i) where p.n > {judge.JUDGED})
 select own.prompt_id, own.vec_id as rollout_idx, row_number() over (partition by own.prompt_id order by own.vec_id)::int as pos from own join p on p.prompt_id = own.prompt_id
  and (p.n <= {judge.JUDGED} and p.i = 0 or p.i = {judge.JUDGED} and list_contains(p.r[1:{judge.JUDGED}], own.place)))""")
def judge_subsample(spark, d):
    """Which rollouts are drawn."""
    return judge.subsample(fx.labelled(spark, d), keys=["prompt_id"]).select("prompt_id", "rollout_idx", "pos")


_CLEAN = rf"regexp_replace(regexp_replace(regexp_replace(text, '[{E.WHITE_SPACE}]+\z', ''), '```\z', ''), '[{E.WHITE_SPACE}]+\z', '')".replace(r"\x{85}\x{A0}", r"\x{0085}\x{00A0}")


#: Bytes of text in a part of a prompt file, about.
_PART_BYTES = 32 << 20


@query(f"select (row_number() over (order by doc_id) - 1)::int as prompt_id, sha256({_CLEAN}) as prompt from documents where text is not null qualify prompt_id < 150")
def loaded_prompts(spark, d):
    """A prompt file in parts, with blank lines between; the first 150 prompts of it."""
    path = results.temporary(spark, "prompts") + "/math.jsonl"
    texts, place = fx.table(spark, d, "documents").where("text is not null"), F.col("doc_id").asc_nulls_last()
    parts = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // _PART_BYTES + 3
    texts = texts.repartitionByRange(parts, place).sortWithinPartitions(place)
    texts.select(F.concat(F.to_json(F.struct(F.col("text").alias("prompt"))), F.when(F.col("doc_id") % 7 == 0, "\n  \n").otherwise("")).alias("value")).write.text(path)
    return prompts.load_prompts(spark, path, 150).select("prompt_id", F.sha2("prompt", 256).alias("prompt"))


@query("select r_name as task, 'Compare ' || r_name || ': {response_a} {response_b}' || chr(10) as template from region")
def loaded_templates(spark, d):
    folder, tasks = results.temporary(spark, "templates"), [r[0] for r in fx.table(spark, d, "region").select("r_name").collect()]
    for task in tasks:
        results.write_text(spark, f"{folder}/{task}.txt", f"Compare {task}: {{response_a}} {{response_b}}\n")
    return spark.createDataFrame([(t, prompts.load_template(spark, folder, t)) for t in tasks], "task string, template string")


@query("select 'the panel lacks [' || string_agg(chr(39) || name || chr(39), ', ' order by name) || ']' as message, max(n) as rows from (select unnest(['D', 'N_bar', 'task']) as name, n from (select count(*) as n from fx_prompt))")
def required_columns(spark, d):
    """A panel of all prompts that lacks three columns, named in the error."""
    rows = tree.prompt_metrics(fx.rollouts(spark, d)).select("model_name", "model_variant", F.col("mean_rate").alias("R_bar"), panel.prompt_uid().alias("prompt_uid"))
    try:
        regression.main_regression(rows)
        message = ""
    except ValueError as error:
        message = str(error)
    return rows.agg(F.lit(message).alias("message"), F.count(F.lit(1)).alias("rows"))


@query("select n_nationkey::int as prompt_id, i::int as rollout_idx, n_name || '-' || i as text, length(n_name || '-' || i)::double as size, i = 1 as ends, (length(n_name) % 3)::double as reward from nation cross join range(3) t(i)")
def model_hooks(spark, d):
    """Rollouts, embeddings and rewards by callables that stand for models."""

    def generate(batches):
        for batch in batches:
            out = batch.loc[batch.index.repeat(3)].reset_index(drop=True)
            out["rollout_idx"] = np.tile(np.arange(3, dtype="int32"), len(batch))
            out["text"] = out["prompt"] + "-" + out["rollout_idx"].astype(str)
            yield out[["prompt_id", "rollout_idx", "prompt", "text"]]

    def embed(batches):
        for batch in batches:
            yield batch.assign(embedding=[[float(len(t)), float(t.endswith("1"))] for t in batch["text"]])

    def reward(batches):
        for batch in batches:
            yield batch.assign(reward=batch["prompt"].str.len().astype(float) % 3)

    found = external.generated(fx.table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("prompt_id"), F.col("n_name").alias("prompt")), generate, "prompt_id int, rollout_idx int, prompt string, text string")
    found = external.embedded(found, embed, "prompt_id int, rollout_idx int, prompt string, text string, embedding array<double>")
    found = external.rewarded(found, reward, "prompt_id int, rollout_idx int, prompt string, text string, embedding array<double>, reward double")
    return found.select("prompt_id", "rollout_idx", "text", F.col("embedding")[0].alias("size"), (F.col("embedding")[1] == 1).alias("ends"), "reward")


@query("select doc_id, length(text)::bigint as seen, true as fits from documents")
def length_batches(spark, d):
    """Every document through a hook in batches of like length; a batch and its padding stay within the budget, and all padding within a tenth of the tokens."""
    tokens = 1 << 13

    def score(batches):
        for batch in batches:
            n = batch["text"].str.len()
            yield pd.DataFrame({"doc_id": batch["doc_id"], "seen": n, "padded": n.max(), "fits": len(batch) == 1 or len(batch) * n.max() <= tokens})

    found = results.cut(external.rewarded(fx.table(spark, d, "documents").select("doc_id", "text"), score, "doc_id long, seen long, padded long, fits boolean", F.length("text"), tokens))
    little = found.agg((F.sum("padded") - F.sum("seen") <= 0.1 * F.sum("padded")).alias("little"))  # one row
    return found.join(F.broadcast(little)).select("doc_id", "seen", (F.col("fits") & F.col("little")).alias("fits"))


class _Judge:
    """Stands for a judge: alike if both responses end in the same digit; every fifth request fails at first, some for good."""

    def __init__(self):
        self.asked: dict[str, int] = {}

    def __call__(self, prompt: str) -> tuple[str, str]:
        a, b = prompt.split()[-2:]
        self.asked[prompt] = self.asked.get(prompt, 0) + 1
        if (int(a) + int(b)) % 5 == 0 and self.asked[prompt] == 1:
            raise TimeoutError("busy")
        if int(a) % 11 == 0 and int(b) % 11 == 0:
            raise TimeoutError("gone")
        return f"So: Response: {'similar' if a[-1] == b[-1] else 'different'}", "stop"


@query("""select * from (with w as (select prompt_id, r, c, vr, vc, not (vr % 11 = 0 and vc % 11 = 0) as heard, vr % 10 = vc % 10 as alike from fx_pairs)
 select prompt_id, r::int as r, c::int as c, heard and alike as is_similar, case when heard then 'ok' else 'request_failed' end as status from w where r < c or (heard and alike))""")
def judgment_matrix(spark, d):
    """All pairs once, and those found similar the other way round, by a judge that fails now and then."""
    nodes = fx.nodes(spark, d).select("prompt_id", "pos", F.col("rollout_idx").cast("string").alias("text"), F.concat(F.lit("Name "), F.col("prompt_id").cast("string")).alias("task_prompt"))
    found = external.judgment_matrix(nodes, "For {task_prompt} compare {response_a} {response_b}", _Judge, ["prompt_id"], retries=2, wait=0.0)
    return found.select("prompt_id", "r", "c", "is_similar", "status")


def _correlated(rows: str, a: str, b: str, keys: str) -> str:
    """Correlations of two columns by group in SQL, with ranks and pairs spelled out."""
    return f"""(select g.*, s.spearman, k.kendall from (select {keys}, count(*) as m, case when count(*) > 1 then covar_samp({a}, {b}) end as cov, case when count(*) > 1 and stddev_samp({a}) * stddev_samp({b}) > 0 then greatest(-1.0, least(1.0, covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})))) end as pearson from {rows} group by {keys}) g
 join (select {keys}, case when count(*) > 1 and stddev_samp(ra) * stddev_samp(rb) > 0 then greatest(-1.0, least(1.0, covar_samp(ra, rb) / (stddev_samp(ra) * stddev_samp(rb)))) end as spearman from (select *, rank() over (partition by {keys} order by {a}) + (count(*) over (partition by {keys}, {a}) - 1) / 2.0::double as ra, rank() over (partition by {keys} order by {b}) + (count(*) over (partition by {keys}, {b}) - 1) / 2.0::double as rb from {rows}) group by {keys}) s using ({keys})
 left join (select {", ".join("x." + k.strip() for k in keys.split(","))}, case when sum(abs(sign(x.{a} - y.{a}))) > 0 and sum(abs(sign(x.{b} - y.{b}))) > 0 then sum(sign(x.{a} - y.{a}) * sign(x.{b} - y.{b})) / sqrt(sum(abs(sign(x.{a} - y.{a})))::double * sum(abs(sign(x.{b} - y.{b})))::double) end as kendall
 from {rows} x join {rows} y on {" and ".join(f"x.{k.strip()} = y.{k.strip()}" for k in keys.split(","))} and x.rollout_idx < y.rollout_idx group by all) k using ({keys}))"""


_KEYS = f"subset, {P}"
_DIVERSE = f"(select c.subset, c.task, c.model_name, c.model_variant, c.prompt_id, c.rollout_idx, c.seq_len, round(1 - (sum(c.x * s.s) - 1) / nullif(s.m - 1, 0), 12) as diversity from fx_subset_cells c join (select {_KEYS}, d, sum(x) as s, count(*) as m from fx_subset_cells group by all) s using ({_KEYS}, d) group by c.subset, c.task, c.model_name, c.model_variant, c.prompt_id, c.rollout_idx, c.seq_len, s.m)"
_SUBSET_CELLS = f"fx_subset_cells as (select subset, task, model_name, model_variant, prompt_id, rollout_idx, seq_len, unnest(e) as x, unnest(range(len(e))) as d from fx_subsets f cross join fx_n join (select vec_id, embedding::double[] as e from embeddings) e on e.vec_id = f.rollout_idx % fx_n.n)"
_BUCKET = f"(select {_KEYS}, b, 1 - (sum(s * s) - max(n)) / 2 / (max(n) * (max(n) - 1) / 2.0::double) as div from (select {_KEYS}, b, d, sum(x) as s, count(*) as n from (select c.*, r.b from fx_subset_cells c join (select {_KEYS}, rollout_idx, ntile(3) over (partition by {_KEYS} order by seq_len, rollout_idx) - 1 as b from fx_subsets) r using ({_KEYS}, rollout_idx)) group by all) group by all having max(n) > 1)"
_SK = f"subset, {V}"


@query(f"""select * from (with {_SUBSET_CELLS}, v as (select * from {_DIVERSE}), w as (select * from v where diversity is not null),
 t as (select {_KEYS}, avg(h_sum) as ce, avg(seq_len) as n, avg(rate) as r, avg(case when seq_len >= 12 then 1.0::double else 0.0::double end) as trunc from fx_subsets group by all),
 l as (select {_SK}, {FISHER('pearson', 'm', 'lp')}, {FISHER('spearman', 'm', 'ls')}, {WEIGHTED('kendall', '(m * (m - 1) / 2)', 'lk')}, {WEIGHTED('cov', '(m - 1)', 'lc')} from {_correlated('fx_subsets', 'seq_len', 'rate', _KEYS)} group by {_SK}),
 mm as (select {_KEYS}, count(*) as m from fx_subsets group by all),
 q as (select {_SK}, {FISHER('pearson', 'mm.m', 'dp')}, {FISHER('spearman', 'mm.m', 'ds')}, {WEIGHTED('kendall', '(mm.m * (mm.m - 1) / 2)', 'dk')}, {WEIGHTED('cov', '(mm.m - 1)', 'dc')} from {_correlated('w', 'diversity', 'seq_len', _KEYS)} c right join mm using ({_KEYS}) group by {_SK}),
 z as (select {_SK}, count(*)::double as prompts, {R('avg(ce)', 'ce')}, {R('exp(avg(ce) / avg(n))', 'ppl')}, {R('exp(avg(r))', 'bf')}, {R('avg(trunc)', 'tr')} from t group by all),
 y as (select {_SK}, {R('avg(d)', 'sd')} from (select {_KEYS}, avg(diversity) as d from v group by all) group by {_SK}),
 b as (select {_SK}, {R('avg(div) filter (b = 0)', 'b0')}, {R('avg(div) filter (b = 1)', 'b1')}, {R('avg(div) filter (b = 2)', 'b2')} from {_BUCKET} group by {_SK})
 select {V}, case when name = 'num_prompts' then name else subset || '.' || name end as name, value from (select {_SK},
 unnest(['num_prompts', 'ce_star_max', 'gen_ppl', 'branching_factor', 'truncation_rate', 'length_rate.pearson', 'length_rate.spearman', 'length_rate.kendall', 'length_rate.covariance', 'semantic_diversity', 'diversity_length.pearson', 'diversity_length.spearman', 'diversity_length.kendall', 'diversity_length.covariance', 'bucketed_diversity.short', 'bucketed_diversity.medium', 'bucketed_diversity.long']) as name,
 unnest([prompts, ce, ppl, bf, tr, lp, ls, lk, lc, sd, dp, ds, dk, dc, b0, b1, b2]) as value from z join l using ({_SK}) join q using ({_SK}) join y using ({_SK}) left join b using ({_SK})) where name <> 'num_prompts' or subset = 'raw')""")
def pooled_stats(spark, d):
    """The flat summary: the number of prompts and 16 numbers of each subset; the Vendi score, which needs a spectrum, has a query of its own."""
    found = compute.prompt_stats(fx.embedded(spark, d), RUN, fx.MAX_NEW_TOKENS, compute.Compute(use_reward_filter=True))
    return rounded(compute.flat_summary(compute.pooled_stats(found, RUN), RUN).where("name not like '%vendi_score'"))


@query()
def pooled_vendi(spark, d):
    found = compute.prompt_stats(fx.embedded(spark, d), RUN, fx.MAX_NEW_TOKENS, compute.Compute(use_reward_filter=True))
    return rounded(compute.flat_summary(compute.pooled_stats(found, RUN), RUN).where("name like '%vendi_score'"))
