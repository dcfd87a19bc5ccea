"""Pairwise similarity verdicts: pairs to ask for, parsing, reciprocal edges, clusters and their entropy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from . import PROMPT

#: Rollouts that are judged of each prompt, and the share of failed requests that is borne.
JUDGED = 24
MAX_FAILURE_RATE = 0.05


def drawn(n: int, size: int, seed: int) -> list[int]:
    """The first ``size`` places of a permutation of n by the 32-bit Mersenne generator seeded with an integer, sorted: the
    place i is swapped with one of those from i on, the next output modulo how many these are. All of n if they are no more."""
    if n <= size:
        return list(range(n))
    raw = np.random.RandomState(seed % (1 << 32))._bit_generator.random_raw(size)
    moved: dict[int, int] = {}  # what stands in a place that has been swapped
    out = []
    for i, x in enumerate(raw.tolist()):
        j = i + x % (n - i)
        out.append(moved.get(j, j))
        moved[j] = moved.get(i, i)
    return sorted(out)


def subsample(rollouts: DataFrame, size: int = JUDGED, seed: int = 42, keys: list[str] = PROMPT, order: Column | None = None, prompt: str = "prompt_id") -> DataFrame:
    """The rollouts of each prompt that are judged, with ``pos`` from 1 on in the order of rollout_idx. All if there are no more than ``size``.

    A prompt's draw (``drawn``) is seeded by ``seed`` plus its number, ``prompt``; one without a number draws as 0. With ``order``
    the first rollouts in that order are taken, and numbered in it.
    """
    if order is not None:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "rollout_idx"))
        return rollouts.withColumn("pos", place).where(F.col("pos") <= size)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rollouts.select(*keys).schema)

    def run(batches):
        for batch in batches:
            places = [drawn(n, size, seed + (number or 0)) for n, number in zip(batch.column(batch.num_columns - 1).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(places, pa.list_(pa.int32()))], names=[*batch.schema.names[:-2], "places"])

    # A prompt is one of its keys' rows, however many rollouts it has: prompts are counted before they draw.
    counts = rollouts.groupBy(*keys).agg(F.first(F.col(prompt).cast("long")).alias("__number"), F.count(F.lit(1)).alias("__n"))
    chosen = counts.mapInArrow(run, f"{kinds}, places array<int>").select(*keys, F.posexplode("places").alias("pos", "__place"))
    place = (F.row_number().over(Window.partitionBy(*keys).orderBy("rollout_idx")) - 1).alias("__place")
    return rollouts.select("*", place).join(chosen, [*keys, "__place"]).select(*rollouts.columns, (F.col("pos") + 1).cast("int").alias("pos"))


def forward_pairs(nodes: DataFrame, keys: list[str] = PROMPT) -> DataFrame:
    """Ordered pairs r < c of the judged rollouts of a prompt; at most size * (size - 1) / 2 a prompt."""
    carried = [c for c in nodes.columns if c not in keys and c != "pos"]
    a = nodes.select(*keys, F.col("pos").alias("r"), *(F.col(c).alias(f"{c}_r") for c in carried))
    b = nodes.select(*keys, F.col("pos").alias("c"), *(F.col(c).alias(f"{c}_c") for c in carried))
    return a.join(b, keys).where("r < c")


def reverse_pairs(judged: DataFrame, keys: list[str] = PROMPT) -> DataFrame:
    """The pairs to ask for the other way round: those found similar."""
    return judged.where(F.col("is_similar")).select(*keys, F.col("c").alias("r"), F.col("r").alias("c"))


def judgments(replies: DataFrame, text: str = "text") -> DataFrame:
    """Adds is_similar and status to raw replies; finish_reason and failed are used if they are there."""
    finish = F.col("finish_reason") if "finish_reason" in replies.columns else None
    failed = F.col("failed") if "failed" in replies.columns else None
    return replies.withColumn("v", E.verdict(text, finish, failed)).select(*replies.columns, "v.*")


def failure_rates(judged: DataFrame, keys: list[str] = PROMPT) -> DataFrame:
    """Requests, failures and their share by group."""
    bad = F.col("status") != E.OK
    return judged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("failures"), F.coalesce(F.avg(bad.cast("double")), F.lit(0.0)).alias("failure_rate"))


def require_few_failures(judged: DataFrame, keys: list[str] = PROMPT, most: float = MAX_FAILURE_RATE) -> DataFrame:
    """The judgments, or an error where a group's failures exceed the bound: nothing of it is to be written."""
    rate = F.avg((F.col("status") != E.OK).cast("double")).over(Window.partitionBy(*keys))
    return judged.withColumn("__ok", F.when(rate <= most, True).otherwise(F.raise_error(F.lit("too many judgments failed")).cast("boolean"))).where("__ok").drop("__ok")


def reciprocal_edges(judged: DataFrame, keys: list[str] = PROMPT) -> DataFrame:
    """Pairs found similar both ways, in both directions."""
    yes = judged.where(F.col("is_similar")).select(*keys, "r", "c")
    return yes.join(yes.select(*keys, F.col("c").alias("r"), F.col("r").alias("c")), [*keys, "r", "c"], "left_semi")


def clusters(nodes: DataFrame, edges: DataFrame, keys: list[str] = PROMPT) -> DataFrame:
    """keys, pos, cluster (its smallest pos). Nodes without an edge are clusters of their own.

    A group holds the judged nodes of one prompt, a fixed number, so one task takes it whole.
    """
    linked = edges.groupBy(*keys, F.col("r").alias("pos")).agg(F.collect_list("c").alias("next"))
    rows = nodes.select(*keys, "pos").join(linked, [*keys, "pos"], "left")
    schema = rows.select(*keys, "pos").schema

    def one(table):
        pos, following = table["pos"].to_pylist(), table["next"].to_pylist()
        near = {p: set(f or ()) for p, f in zip(pos, following, strict=True)}
        for p, f in list(near.items()):
            for q in f:
                near.setdefault(q, set()).add(p)
        label: dict[int, int] = {}
        for p in sorted(near):
            if p not in label:
                stack = [p]
                while stack:
                    q = stack.pop()
                    if q not in label:
                        label[q] = p
                        stack.extend(near[q])
        return table.drop_columns(["next"]).append_column("cluster", pa.array([label[p] for p in pos], table.schema.field("pos").type))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return rows.groupBy(*keys).applyInArrow(one, f"{kinds}, cluster {schema['pos'].dataType.simpleString()}")


def cluster_entropy(labelled: DataFrame, keys: list[str] = PROMPT) -> DataFrame:
    """m, n_clusters, RSE (entropy of cluster sizes in nats) and RSE_norm (over ln m, null for one node)."""
    sizes = labelled.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("size"))
    m = F.sum("size")
    entropy = F.ln(m) - F.sum(F.col("size") * F.ln("size")) / m
    return sizes.groupBy(*keys).agg(m.alias("m"), F.count(F.lit(1)).alias("n_clusters"), F.greatest(entropy, F.lit(0.0)).alias("RSE")).withColumn("RSE_norm", E.ratio("RSE", F.ln("m")))
