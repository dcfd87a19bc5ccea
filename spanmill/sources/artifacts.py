"""Artifact tables of runs: Parquet, partitioned by the run's keys, so a run or an artifact is read and replaced alone."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import ARTIFACTS, RUN_KEYS, RUNS, names


class Store:
    """The artifact tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, artifact: str) -> str:
        return f"{self.root}/{artifact}"

    def exists(self, artifact: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(artifact))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def partitions(self, artifact: str) -> list[str]:
        sub = ARTIFACTS[artifact][1]
        return [*RUN_KEYS, *([sub] if sub else [])]

    def read(self, artifact: str, **where: str) -> DataFrame:
        """Rows of an artifact; ``where`` names partitions. What is selected later is all that is read: schema and partitions are pruned."""
        schema = ARTIFACTS[artifact][0]
        if not self.exists(artifact):
            return self.spark.createDataFrame([], schema)
        out = self.spark.read.schema(schema).parquet(self.path(artifact))
        for key, value in where.items():
            out = out.where(F.col(key) == value)
        return out

    def texts(self, **where: str) -> DataFrame:
        return self.read("rollouts", **where).select(*RUN_KEYS, "prompt_id", "rollout_idx", "text")

    def _shaped(self, df: DataFrame, artifact: str) -> DataFrame:
        """The artifact's columns in its types, dealt so that a run is few files and a large one several tasks."""
        shaped = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ARTIFACTS[artifact][0])))
        return shaped.hint("rebalance", *self.partitions(artifact))

    def append(self, df: DataFrame, artifact: str) -> None:
        self._shaped(df, artifact).write.mode("append").partitionBy(*self.partitions(artifact)).parquet(self.path(artifact))

    def reset(self, df: DataFrame, artifact: str, force: bool = False) -> None:
        """Replace the partitions that ``df`` has; without ``force``, only such as hold nothing yet."""
        keys = self.partitions(artifact)
        if not force and self.exists(artifact):
            held = self.count_prompts(artifact).join(df.select(*keys).distinct(), keys, "left_semi").agg(F.sum("prompts")).first()[0]
            if held:
                raise ValueError(f"{held} prompts of {artifact} would be replaced; pass force=True to do so")
        self._shaped(df, artifact).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(self.path(artifact))

    def count_prompts(self, artifact: str) -> DataFrame:
        """Prompts by run (and key) that an artifact holds."""
        return self.read(artifact).groupBy(*self.partitions(artifact)).agg(F.count_distinct("prompt_id").alias("prompts"))

    def runs(self) -> DataFrame:
        """The settings of each run as they were saved last."""
        if not self.exists("runs"):
            return self.spark.createDataFrame([], RUNS)
        saved = self.spark.read.schema(f"{RUNS}, saved_at bigint").json(self.path("runs"))
        last = saved.groupBy(*RUN_KEYS).agg(F.max_by(F.struct(*names(RUNS)), "saved_at").alias("run"))
        return last.select("run.*")

    def save_runs(self, runs: DataFrame) -> None:
        """The settings of many runs at once."""
        rows = runs.select(*names(RUNS), F.lit(time.time_ns()).alias("saved_at"))
        rows.write.mode("append").option("ignoreNullFields", "false").json(self.path("runs"))

    def save_run(self, run: dict) -> None:
        """One JSON line in a file of its own; all fields are needed, unknown ones are ignored. Nothing that was saved before is touched, so a crash or another writer loses no run."""
        missing = [f for f in names(RUNS) if f not in run]
        if missing:
            raise KeyError(f"the run lacks {missing}")
        row = (*(run[f] for f in names(RUNS)), time.time_ns())
        self.spark.createDataFrame([row], f"{RUNS}, saved_at bigint").coalesce(1).write.mode("append").option("ignoreNullFields", "false").json(self.path("runs"))

    def resume(self, run: dict) -> int:
        """Where a run goes on: how many prompts it has. Its settings may differ from the stored ones in ``num_prompts`` only; they are stored anew."""
        stored = self.runs().where(same_run(run)).collect()
        if not stored:
            self.save_run(run)
            return 0
        changed = [f for f in names(RUNS) if f != "num_prompts" and stored[0][f] != run[f]]
        if changed:
            raise ValueError(f"the stored run differs in {changed}")
        self.save_run(run)
        row = self.count_prompts("rollouts").where(same_run(run)).first()
        return row["prompts"] if row else 0

    def resume_judgments(self, run: dict, judge: dict, stored: dict | None) -> int:
        """Like ``resume`` for one judge: if there are judgments, any difference of settings is an error."""
        row = self.count_prompts("judgments").where(same_run(run) & (F.col("judge_name") == judge["judge_name"])).first()
        if row is None:
            return 0
        changed = sorted(k for k in {*judge, *(stored or {})} if judge.get(k) != (stored or {}).get(k))
        if changed:
            raise ValueError(f"the stored judge differs in {changed}")
        return row["prompts"]


def same_run(run: dict) -> Column:
    out = F.lit(True)
    for key in RUN_KEYS:
        out = out & (F.col(key) == run[key])
    return out


def completeness(expected: DataFrame, found: DataFrame, keys: list[str] = RUN_KEYS, num: str = "num_prompts") -> DataFrame:
    """Adds ``complete`` to the runs: whether an artifact has at least the run's prompts."""
    counts = found.groupBy(*keys).agg(F.count_distinct("prompt_id").alias("found"))
    return expected.join(counts, keys, "left").withColumn("found", F.coalesce("found", F.lit(0))).withColumn("complete", F.col("found") >= F.col(num))


def require_complete(expected: DataFrame, found: DataFrame, keys: list[str] = RUN_KEYS, num: str = "num_prompts") -> DataFrame:
    """The artifact's rows of the runs' first prompts; a run that lacks some is an error, prompts beyond them are ignored."""
    short = completeness(expected, found, keys, num).where("not complete").select(*keys, "found", num).take(5)
    if short:
        raise ValueError(f"incomplete: {[r.asDict() for r in short]}")
    return found.join(expected.select(*keys, num), keys).where(F.col("prompt_id") < F.col(num)).drop(num)


def attach(rollouts: DataFrame, artifact: DataFrame, value: str, expected: DataFrame, keys: list[str] = RUN_KEYS, num: str = "num_prompts") -> DataFrame:
    """Rollouts with an artifact's value. A run whose artifact is not complete gets null everywhere: all or nothing."""
    whole = completeness(expected, artifact, keys, num).where("complete").select(*keys)
    usable = artifact.join(whole, keys, "left_semi").select(*keys, "prompt_id", "rollout_idx", value)
    return rollouts.join(usable, [*keys, "prompt_id", "rollout_idx"], "left")


def pending(rollouts: DataFrame, artifact: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """Rollouts of the prompts that an artifact lacks, whichever they are."""
    return rollouts.join(artifact.select(*keys, "prompt_id").distinct(), [*keys, "prompt_id"], "left_anti")


def existing_of(matrix: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    return matrix.join(runs, keys, "left_semi")


def missing_of(matrix: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    return matrix.join(runs, keys, "left_anti")


def matrix(spark: SparkSession, **levels: list[str]) -> DataFrame:
    """All combinations of the named levels: a design of a few dozen rows."""
    import itertools

    return spark.createDataFrame(list(itertools.product(*levels.values())), ", ".join(f"{k} string" for k in levels))
