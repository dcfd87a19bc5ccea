"""Diversity of embeddings: pairwise similarity by vector sums, length buckets, Vendi score."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import expr as E
from . import PROMPT, RUN

#: The names of the length buckets, shortest first.
BUCKETS = ["short", "medium", "long"]


def vector_sum(embedding: str) -> Column:
    """Sum of the group's vectors; partial sums are merged, so a group of any size is a vector per task."""
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(embedding).cast("array<double>"))))


def rollout_diversity(rows: DataFrame, keys: list[str] = PROMPT, embedding: str = "embedding") -> DataFrame:
    """Adds ``diversity``: one minus the mean similarity with the prompt's other rollouts; null for a single one. Vectors have unit length."""
    sums = rows.where(F.col(embedding).isNotNull()).groupBy(*keys).agg(vector_sum(embedding).alias("__sum"), F.count(F.lit(1)).alias("__m"))
    joined = rows.join(sums, keys, "left")
    others = E.ratio(E.dot(F.col(embedding), F.col("__sum")) - 1, F.col("__m") - 1)
    return joined.withColumn("diversity", 1 - others).drop("__sum", "__m")


def prompt_diversity(rows: DataFrame, keys: list[str] = PROMPT) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.avg("diversity").alias("diversity"))


def mean_pair_similarity(total: Column, n: Column) -> Column:
    """Mean over unordered pairs of unit vectors, from the norm of their sum."""
    return E.ratio((E.dot(total, total) - n) / 2, n * (n - 1) / 2)


def with_buckets(rows: DataFrame, keys: list[str] = PROMPT, length: str = "seq_len", tie: str = "rollout_idx", buckets: int = 3) -> DataFrame:
    """Adds bucket_id: thirds by rank of length, ties by index; floor(rank * buckets / m)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(length, tie)) - 1
    return rows.withColumn("bucket_id", F.floor(place * buckets / F.count(F.lit(1)).over(Window.partitionBy(*keys))).cast("int"))


def bucket_stats(rows: DataFrame, keys: list[str] = PROMPT, embedding: str = "embedding", length: str = "seq_len") -> DataFrame:
    """Three rows a group: similarity, diversity, members and range of lengths of each bucket; what needs two members is null with fewer."""
    inside = with_buckets(rows, keys, length)
    found = inside.groupBy(*keys, "bucket_id").agg(F.count(F.lit(1)).alias("n"), vector_sum(embedding).alias("total"), F.min(length).alias("min_length"), F.max(length).alias("max_length"))
    grid = inside.select(*keys).distinct().withColumn("bucket_id", F.explode(F.array(*map(F.lit, range(3)))))
    n = F.coalesce("n", F.lit(0))
    similarity = F.when(n >= 2, mean_pair_similarity(F.col("total"), n))
    return grid.join(found, [*keys, "bucket_id"], "left").select(
        *keys, F.element_at(F.array(*map(F.lit, BUCKETS)), F.col("bucket_id") + 1).alias("bucket"), similarity.alias("average_similarity"), (1 - similarity).alias("semantic_diversity"), n.cast("long").alias("num_responses"), "min_length", "max_length"
    )


def pooled_buckets(stats: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Means over prompts where they are defined."""
    return stats.groupBy(*keys, "bucket").agg(*(F.avg(c).alias(c) for c in ("average_similarity", "semantic_diversity", "num_responses", "min_length", "max_length")))


def spectrum_entropy(gram: np.ndarray, n: int) -> float:
    """Entropy of the spectrum of a Gram matrix over n vectors; its non-zero part is the kernel's."""
    values = np.clip(np.linalg.eigvalsh(gram / n), 0, None)
    values = values[values > 0]
    return float(-(values * np.log(values)).sum())


def collision_entropy(gram: np.ndarray, n: int) -> float:
    """Minus the log of the squared Frobenius norm, which kernel and Gram matrix share."""
    return float(-np.log((gram * gram).sum() / (n * n)))


#: Rows of one task's part of a large group, in multiples of the dimension.
PART = 4
#: Large groups that are sent to all workers; more are joined by a shuffle.
SENT_GROUPS = 100_000


def _spectral(rows: DataFrame, keys: list[str], embedding: str, name: str, statistic: Callable[[np.ndarray, int], float]) -> DataFrame:
    """keys, m and a statistic of each group's kernel, by the smaller of two matrices.

    A group of no more vectors than they have dimensions goes to one task, whose matrix is of the
    vectors; a larger one is dealt in parts of ``PART`` times the dimension, each of which sends on a
    dimension-square sum, a fraction of its vectors.
    """
    rows = rows.select(*keys, F.col(embedding).cast("array<double>").alias("__v")).where(F.col("__v").isNotNull())
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    matrix = lambda table: np.asarray(table["__v"].combine_chunks().flatten()).reshape(table.num_rows, -1)

    def whole(key, table):
        x = matrix(table)
        return pa.table({**{k: [v.as_py()] for k, v in zip(keys, key, strict=True)}, "m": [len(x)], name: [statistic(x @ x.T, len(x))]})

    def part(key, table):
        x = matrix(table)
        return pa.table({**{k: [v.as_py()] for k, v in zip(keys, key, strict=False)}, "m": [len(x)], "gram": [(x.T @ x).ravel()]})

    def final(batches):
        for batch in batches:
            n, grams = batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1)
            found = [statistic(np.asarray(grams[i].values).reshape(int(len(grams[i]) ** 0.5), -1), k) for i, k in enumerate(n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys) + 1)), pa.array(found, pa.float64())], names=[*keys, "m", name])

    typed = lambda f, schema: lambda key, table: f(key, table).cast(schema)
    arrow = to_arrow_schema(rows.select(*keys, F.lit(0).cast("long").alias("m"), F.lit(0.0).alias(name)).schema)
    arrow_part = to_arrow_schema(rows.select(*keys, F.lit(0).cast("long").alias("m"), F.col("__v").alias("gram")).schema)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"), F.max(F.size("__v")).alias("__d"))
    large = counts.where("__m > __d").select(*keys, F.ceil(F.col("__m") / (PART * F.col("__d"))).alias("__parts"))
    n = large.count()
    sent = (lambda df: F.broadcast(df)) if n <= SENT_GROUPS else (lambda df: df)
    small = rows.join(sent(large.select(*keys)), keys, "left_anti") if n else rows
    own = small.groupBy(*keys).applyInArrow(typed(whole, arrow), f"{kinds}, m long, {name} double")
    if not n:
        return own
    dealt = rows.join(sent(large), keys).withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.col("__parts")))
    grams = dealt.select(*keys, "__part", "__v").groupBy(*keys, "__part").applyInArrow(typed(part, arrow_part), f"{kinds}, m long, gram array<double>")
    summed = grams.groupBy(*keys).agg(F.sum("m").alias("m"), vector_sum("gram").alias("gram"))
    return own.unionByName(summed.mapInArrow(final, f"{kinds}, m long, {name} double"))


def vendi_entropy(rows: DataFrame, keys: list[str] = PROMPT, embedding: str = "embedding") -> DataFrame:
    """m and vendi_entropy of each group: the entropy of its kernel's spectrum. The Vendi score is its exponential."""
    return _spectral(rows, keys, embedding, "vendi_entropy", spectrum_entropy)


def renyi2_entropy(rows: DataFrame, keys: list[str] = PROMPT, embedding: str = "embedding") -> DataFrame:
    """m and renyi2_entropy: minus the log of the kernel's squared Frobenius norm, a lower bound of the Vendi entropy."""
    return _spectral(rows, keys, embedding, "renyi2_entropy", collision_entropy)


def spectral_moment(rows: DataFrame, power: int, keys: list[str] = PROMPT, embedding: str = "embedding") -> DataFrame:
    """m and moment of each group: the sum of the power of its kernel's eigenvalues, the trace of the kernel's power."""
    return _spectral(rows, keys, embedding, "moment", lambda gram, n: float((np.linalg.eigvalsh(gram / n) ** power).sum()))
