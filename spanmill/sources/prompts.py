"""Prompt files and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as E


#: How Spark names the parts of what it writes.
_PART = r"/part-(\d{5,})-[0-9a-f-]{36}-c\d+[^/]*$"


def load_prompts(spark: SparkSession, path: str, num_prompts: int = 0) -> DataFrame:
    """task, prompt_id, prompt of a JSON-lines file: blank lines are skipped, prompt_id is the place among the others.

    The first ``num_prompts`` come back, all for 0 or less. A line without a prompt is an error. A
    folder of parts, as Spark writes it, is one file: the parts follow each other, the folder's name is the
    file's. A large file is read and numbered where it is read, split by split; only the splits' counts meet.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("value").alias("json"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"))
    # A split's lines follow each other in one task, so their places there do too, in either scan.
    filled = lines.where(F.regexp_replace("json", f"[{E.WHITE_SPACE}]", "") != "").withColumn("at", F.monotonically_increasing_id())
    counts = filled.groupBy("file", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).withColumn("name", F.regexp_replace("file", _PART, ""))
    in_order = Window.partitionBy("name").orderBy(F.length(F.regexp_extract("file", _PART, 1)), "file", "part")
    before = F.coalesce(F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = filled.join(F.broadcast(counts.select("file", "part", "name", "first", before.alias("before"))), ["file", "part"]).withColumn("prompt_id", (F.col("before") + F.col("at") - F.col("first")).cast("int"))
    text = F.from_json("json", "prompt string")["prompt"]
    prompt = F.when(text.isNotNull(), E.clean_prompt(text)).otherwise(F.raise_error(F.lit("a line has no prompt")).cast("string"))
    out = numbered.select(E.task_stem("name").alias("task"), "prompt_id", prompt.alias("prompt"))
    return out.where(F.col("prompt_id") < num_prompts) if num_prompts > 0 else out


def load_template(spark: SparkSession, folder: str, task: str) -> str:
    """The judge's template of a task; an absent file is an error."""
    return spark.read.text(f"{folder.rstrip('/')}/{task}.txt", wholetext=True).first()[0]
