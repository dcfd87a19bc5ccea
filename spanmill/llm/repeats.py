"""What the two chunk deduplicators share: digests that several rows hold, and rows with their lists of them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, hot_join, sliced


def light(keyed: DataFrame, text: str, digests: Callable[[bytes], list[bytes]]) -> DataFrame:
    """k1, k2, row: each row's distinct 16-byte digests."""

    def run(batches):
        for batch in sliced(batches, 1):
            found, counts = [], []
            for own in as_bytes(batch.column(1)):
                own = dict.fromkeys(digests(own))
                found.append(b"".join(own))
                counts.append(len(own))
            k = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            row = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
            for at in range(0, len(k), 1 << 16):
                own = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(k[own, 0])), pa.array(np.ascontiguousarray(k[own, 1])), pa.array(row[own])], names=["k1", "k2", "row"])

    return keyed.select("row", F.col(text).alias("text")).mapInArrow(run, "k1 long, k2 long, row long")


def shared(found: DataFrame, scratch: Scratch) -> DataFrame:
    """k1, k2, first, n: digests of at least two rows, the first of these, and how many there are. Rows are merged before the shuffle, so a digest of a third of all rows costs no task more."""
    return scratch.write(found.groupBy("k1", "k2").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")


def lists(found: DataFrame, firsts: DataFrame) -> DataFrame:
    """row and its list of shared digests (k1, k2, later: another row is the first). A list is no longer than its row has digests."""
    both = hot_join(found, firsts, ["k1", "k2"])
    return both.select("row", F.struct("k1", "k2", (F.col("row") != F.col("first")).alias("later")).alias("x")).groupBy("row").agg(F.collect_list("x").alias("list"))


def list_of(column: pa.Array, i: int) -> dict[bytes, bool]:
    """Row i's digests, each with whether another row is the first."""
    if not column[i].is_valid:
        return {}
    x = column[i].values
    k = np.column_stack([x.field("k1").to_numpy(zero_copy_only=False), x.field("k2").to_numpy(zero_copy_only=False)]).astype("<i8").tobytes()
    return {k[16 * j : 16 * j + 16]: later for j, later in enumerate(x.field("later").to_pylist())}
