"""The training-data queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_NAMES = {"op6_embedding_near_dedup": "embeddings", "op7_ngram_jaccard": "jaccard", "op1_warc": "warc", "op2_substring_dedup": "substrings", "op3_line_dedup": "lines", "op4_lattice_score": "lattice", "op5_quality_rules": "quality", "op8_quality_classifier": "classifier", "op9_sentencepieces": "sentencepieces", "op10_packing": "packing", "op11_permutation_index": "permutations", "op12_vector_codes": "codes", "op13_alignment": "alignment"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _NAMES.items()}


def oracle_sql() -> dict[str, str]:
    from .codes import OP12_SQL
    from .quality import OP5_SQL
    from .warc import OP1_SQL

    return {"op1_warc": OP1_SQL, "op5_quality_rules": OP5_SQL, "op12_vector_codes": OP12_SQL}
