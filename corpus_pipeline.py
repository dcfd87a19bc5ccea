"""The corpus pipeline: quality rules, line deduplication, near-duplicate removal, substring deduplication, packing.

Each stage works on all that its predecessor kept. All but the last return the columns of documents,
whichever these are; an empty table goes through as one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm import jaccard, lines, packing, quality, substrings
from spanmill.llm.common import Scratch

#: Called with (spark, docs, sf_dir) and, by a caller that knows when scratch tables can go, with these.
Stage = Callable[..., DataFrame]


def _columns_of(docs: DataFrame, cleaned: DataFrame) -> DataFrame:
    """The documents' own columns, with n_chars brought up to date where there is one."""
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Removes the lines that fail the line-first rules, and drops the documents that the rules reject.

    Null and empty texts have no words and go. Rows are judged each by itself, whatever their ids.
    """
    return _columns_of(docs, quality.filter_documents(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Removes chunks of lines that an earlier document has. A document that is left empty stays, empty; a null text stays null.

    Earlier goes by id; rows that share one, or lack one and come last, are documents of their own.
    """
    return _columns_of(docs, lines.deduplicate(docs, scratch=scratch))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that with the smallest id.

    Texts without words (null, empty, white space) are in no group and stay, and so do rows without
    an id. Rows that share an id go or stay each by its own text.
    """
    return jaccard.keep_first(docs, scratch=scratch)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Removes passages that an earlier document has; a null text stays null. Earlier is what ``line_dedup`` takes it to be."""
    return _columns_of(docs, substrings.deduplicate(docs, scratch=scratch))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Token sequences of power-of-two lengths, none of which crosses documents. A null or empty text is the end token alone; rows that repeat are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packed),
]

#: None: SQL can express neither the walk of the near-duplicate join nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each result written to the shared folder and read again; what earlier stages needed goes as soon as theirs is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        kept = Scratch(spark, "pipeline")
        with Scratch(spark, name) as scratch:
            docs = kept.write(stage(spark, docs, sf_dir, scratch), name)
        if before:
            before.drop()
        before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
