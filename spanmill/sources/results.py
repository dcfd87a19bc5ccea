"""Results as tables and files."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and driver and executors are one process (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; without a name a cluster gets an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def temporary(spark: SparkSession, label: str) -> str:
    """A folder of its own within the shared one, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def at_exit() -> None:
        with contextlib.suppress(Exception):  # the session may be gone by then
            drop(spark, path)

    atexit.register(at_exit)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder: what reads them several times plans from there, and survives lost executors."""
    path = temporary(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """Nested statistics as they are; ``read_stats`` gives them back."""
    stats.write.mode("overwrite").parquet(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, wherever Spark's paths lead."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def flat_scalars(nested: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, value: the numbers of a row, those of structs as ``parent.child``; arrays and texts are skipped."""
    from pyspark.sql.types import NumericType, StructType

    pairs = []
    for f in nested.schema:
        if f.name in keys:
            continue
        if isinstance(f.dataType, StructType):
            pairs += [(f"{f.name}.{g.name}", F.col(f"{f.name}.{g.name}")) for g in f.dataType if isinstance(g.dataType, NumericType)]
        elif isinstance(f.dataType, NumericType):
            pairs.append((f.name, F.col(f.name)))
    return nested.select(*keys, F.stack(F.lit(len(pairs)), *(x for name, c in pairs for x in (F.lit(name), c.cast("double")))).alias("name", "value"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in which what is undefined is an explicit null."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def as_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and one JSON text of all other columns."""
    return df.select(*keys, F.to_json(F.struct(*(c for c in df.columns if c not in keys)), {"ignoreNullFields": "false"}).alias("json"))
