"""Substring deduplication: content-defined chunks by a gear rolling hash, deduplicated by digest.

A boundary depends on the 32 bytes before it only, so an insertion changes the chunks that it
touches and no others.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import repeats
from .common import Scratch, as_bytes, documents, free_names, keyed, place, sliced

#: A gear hash of 16 bits has seen exactly the last 16 bytes; its four highest bits decide.
WINDOW = 16
CUT_SHIFT = 12
#: A cut stands if no other cut is due in the bytes before it: no chunk is shorter.
MIN_CHUNK = 16
#: Neighbouring repeated chunks are removed if together they have as many bytes: some eight words.
MIN_RUN = 48
GEAR = np.random.default_rng(97).integers(0, 1 << 16, 256).astype(np.uint16)


def boundaries(text: bytes) -> list[int]:
    """Offsets where chunks begin and end, 0 and the length included, never within a character."""
    n = len(text)
    if n <= WINDOW:
        return [0, n] if n else [0]
    x = np.frombuffer(text, dtype=np.uint8)
    h = GEAR[x]
    for step in (1, 2, 4, 8):  # the sums over 2, 4, 8 and 16 bytes, each from two of half the width
        shifted = h[:-step] << np.uint16(step)
        h = h.copy()
        h[step:] += shifted
    due = np.flatnonzero(h[WINDOW - 1 : -1] >> np.uint16(CUT_SHIFT) == 0) + WINDOW
    if len(due):
        alone = np.empty(len(due), dtype=bool)
        alone[0] = True
        np.greater_equal(np.diff(due), MIN_CHUNK, out=alone[1:])
        due = due[alone]
        if not text.isascii():
            for _ in range(3):
                inside = due < n
                inside[inside] = (x[due[inside]] & 0xC0) == 0x80
                due = due + inside
            due = due[due < n]
    return [0, *due.tolist(), n]


def chunk_digests(text: bytes) -> list[bytes]:
    """128-bit digests of the chunks that are long enough to count."""
    at, whole, digest = boundaries(text), memoryview(text), xxhash.xxh3_128_digest
    return [digest(whole[a:b]) for a, b in zip(at, at[1:]) if b - a >= MIN_CHUNK]


def _runs(marks: list[bool], at: list[int]) -> list[tuple[int, int]]:
    """First and past-the-last chunk of each run of marked chunks that is long enough."""
    out, start = [], None
    for k, mark in enumerate([*marks, False]):
        if mark and start is None:
            start = k
        elif not mark and start is not None:
            if at[k] - at[start] >= MIN_RUN:
                out.append((start, k))
            start = None
    return out


def cleaned(text: bytes, shared: dict[bytes, bool]) -> tuple[bytes, int, int, int, int]:
    """The text without removed runs, and how many chunks there are, lie in repeated runs (the first occurrence included), went, and bytes went."""
    at, whole, digest = boundaries(text), memoryview(text), xxhash.xxh3_128_digest
    own = [digest(whole[a:b]) if b - a >= MIN_CHUNK else b"" for a, b in zip(at, at[1:])]
    times = Counter(own)
    seen: set[bytes] = {b""}
    later, repeated = [], []
    for d in own:
        again = d in seen and d != b""
        seen.add(d)
        later.append(again or shared.get(d, False))
        repeated.append(d in shared or d != b"" and times[d] > 1)
    kept, kept_to, gone = [], 0, _runs(later, at)
    for a, b in gone:
        kept.append(whole[kept_to : at[a]])
        kept_to = at[b]
    kept.append(whole[kept_to:])
    return b"".join(kept), len(own), sum(b - a for a, b in _runs(repeated, at)), sum(b - a for a, b in gone), sum(at[b] - at[a] for a, b in gone)


_STATS = ("n_chunks", "n_repeated_chunks", "n_removed_chunks", "n_removed_bytes")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The documents with repeated passages removed from the text, and four counts (``_STATS``).

    A chunk stays where it occurs first: in the row with the smallest id, at its first place. Later
    occurrences go if they and their repeated neighbours reach ``MIN_RUN`` bytes. Chunks are the same
    if their 128-bit digests (XXH3, not a cryptographic hash) are; their bytes are not compared. Every row is
    a document: of rows that share an id the order goes by their texts' hashes, and rows without an
    id come last. Ids are integers. A null text stays null, with counts of 0. Other columns pass
    through; a count whose name one of them has gets an underscore after it. An empty table gives an empty one.
    """
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    names = docs.columns
    stats = free_names(names, _STATS)
    at, text = names.index(text_col), place(docs, text_col)
    rows = keyed(docs, id_col, text_col, scratch)
    found = scratch.write(repeats.light(rows, text, chunk_digests), "light")
    together = rows.join(repeats.lists(found, repeats.shared(found, scratch)), "row", "left").drop("row")
    schema = StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in stats)])

    def run(batches):
        for batch in sliced(batches, at):
            listed = batch.column(batch.num_columns - 1)
            found = [cleaned(own, repeats.list_of(listed, i)) for i, own in enumerate(as_bytes(batch.column(at)))]
            texts = pa.array([r[0].decode("utf-8", "replace") if ok else None for r, ok in zip(found, batch.column(at).is_valid().to_pylist(), strict=True)], pa.string())
            columns = [texts if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[1 + k] for r in found], pa.int64()) for k in range(4))], names=[*names, *stats])

    return together.mapInArrow(run, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir)).select("doc_id", "text", *_STATS, F.length("text").cast("long").alias("n_chars"))
