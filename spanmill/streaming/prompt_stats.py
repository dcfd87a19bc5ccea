"""Prompt metrics kept up to date as rollouts arrive, whatever batches a prompt's rollouts come in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import tree
from ..schemas import ROLLOUTS, RUN_KEYS

#: What the state store needs to hold state by key and part of a key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Share of a sum of squares below which a sum of squared deviations is rounding.
EQUAL = 1e-12
_SUMS = ("m", "h", "n", "rate", "hit", "nn", "rr", "nr")
_KEYS = [*RUN_KEYS, "prompt_id"]
CHANGED = f"{', '.join(f'{k} string' for k in RUN_KEYS)}, prompt_id int, {', '.join(f'{s} double' for s in _SUMS)}"


def _terms(h: float, n: float, rate: float, cap: int) -> np.ndarray:
    """What a rollout adds to its prompt's sums."""
    return np.array([1.0, h, n, rate, float(n >= cap), n * n, rate * rate, n * rate])


class PromptSums(StatefulProcessor):
    """State of a prompt: its sums, and for each rollout what it counted for last, so one that comes again replaces itself.
    A batch reads and writes the prompts and rollouts that it has, no others."""

    def __init__(self, max_new_tokens: int):
        self.cap = max_new_tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", ", ".join(f"{s} double" for s in _SUMS))
        self.last = handle.getMapState("last", "rollout_idx int", "h double, n double, rate double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        total = np.array(self.sums.get(), dtype=float) if self.sums.exists() else np.zeros(len(_SUMS))
        for batch in rows:
            for i, h, n, rate in zip(batch["rollout_idx"], batch["h_sum"], batch["seq_len"], batch["rate"], strict=True):
                own, at = (float(h), float(n), float(rate)), (int(i),)
                if self.last.containsKey(at):
                    total -= _terms(*self.last.getValue(at), self.cap)
                total += _terms(*own, self.cap)
                self.last.updateValue(at, own)
        self.sums.update(tuple(total.tolist()))
        yield pd.DataFrame([[*key, *total.tolist()]], columns=[*_KEYS, *_SUMS])

    def close(self) -> None:
        pass


def from_sums(sums: DataFrame) -> DataFrame:
    """``tree.prompt_metrics`` of prompts from their sums."""
    from ..functions import expr as E

    m, mean = F.col("m"), lambda c: F.col(c) / F.col("m")
    left = lambda ab, a, b: F.when(m > 1, (F.col(ab) - F.col(a) * F.col(b) / m) / (m - 1))  # noqa: E731  sample covariance
    # What rounding of the sums leaves of equal values is no spread.
    deviation = lambda aa, a: F.when(left(aa, a, a) * (m - 1) > EQUAL * F.col(aa), F.sqrt(left(aa, a, a)))
    covariance, spread = left("nr", "n", "rate"), deviation("nn", "n") * deviation("rr", "rate")
    return sums.select(
        *_KEYS, m.cast("long").alias("m"), mean("h").alias("ce_star_max"), mean("n").alias("mean_length"), mean("rate").alias("mean_rate"),
        E.gen_ppl(mean("h"), mean("n")).alias("gen_ppl"), E.branching_factor(mean("rate")).alias("branching_factor"),
        covariance.alias("covariance"), E.clamp(covariance / spread, -1.0, 1.0).alias("pearson"), mean("hit").alias("truncation_rate"),
    )


def stream_prompt_stats(spark: SparkSession, rollouts_path: str, out_path: str, checkpoint: str, max_new_tokens: int = 4000, available_now: bool = True, max_files: int | None = None) -> StreamingQuery:
    """Follow a folder of rollouts and write the metrics of prompts whose rollouts came, a folder for each batch.

    Sums of prompts and the last values of rollouts are the stream's state, so a batch's work goes by what it
    has, not by what came before. A rollout that comes again counts as it came last; a batch that is
    replayed replaces its own folder. ``current`` reads each prompt as it stands. ``max_files``: files of a batch at most.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    root = out_path.rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        from_sums(batch).write.mode("overwrite").parquet(f"{root}/batch={number}")

    reader = spark.readStream.schema(ROLLOUTS)
    reader = reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)
    source = reader.parquet(rollouts_path).where(F.size("step_entropy") > 0)
    own = tree.rollout_entropies(source).select(*_KEYS, "rollout_idx", "h_sum", F.col("seq_len").cast("double").alias("seq_len"), "rate")
    changed = own.groupBy(*_KEYS).transformWithStateInPandas(PromptSums(max_new_tokens), CHANGED, "update", "none")
    writer = changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, out_path: str) -> DataFrame:
    """Each prompt's metrics as its last batch wrote them."""
    rows = spark.read.parquet(out_path)
    values = [c for c in rows.columns if c not in (*_KEYS, "batch")]
    return rows.groupBy(*_KEYS).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*_KEYS, "last.*")


def compact(spark: SparkSession, out_path: str, into: str) -> None:
    """The metrics as they stand, in few files by run; the batches' folders can go once no reader needs them."""
    current(spark, out_path).write.mode("overwrite").partitionBy(*RUN_KEYS).parquet(into)
