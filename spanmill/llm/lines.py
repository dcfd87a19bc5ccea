"""Line deduplication by content-defined chunks of lines: hashes of the lines around a place choose
whether a chunk ends there, so a chunk's bounds depend on its own text and its neighbours', not on
where it stands. Chunks of several lines that repeat across the corpus go, once their bytes have been
compared; a chunk of one line counts together with the chunk beside it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import repeats
from .common import Scratch, as_bytes, documents, free_names, keyed, own_cache, place, sliced, table_batches

#: A line's hash holds its end back from being a boundary in one of so many lines, and so its start; two lines
#: stay in one chunk if both the first's end and the second's start are held back. The more lines are, the fewer
#: short runs lie between two boundaries of their own, and the fewer chunks there are.
HELD = 8
_STATS = ("n_lines", "n_removed_lines", "n_removed_chunks")


def line_chunks(lines: list[bytes], held: int = HELD) -> list[tuple[int, int]]:
    """First and past-the-last line of each chunk. The rolling hash of a place is made of the hashes of the line before it and the line after it."""
    out, start, ends_held = [], 0, False
    for i, line in enumerate(lines):
        h = xxhash.xxh3_64_intdigest(line)
        if i and not (ends_held and h % held == 0):
            out.append((start, i))
            start = i
        ends_held = (h >> 32) % held == 0
    return [*out, (start, len(lines))]


def multi_line(lines: list[bytes], held: int = HELD) -> list[tuple[int, int, bytes]]:
    """What is compared: each chunk of several lines, and each chunk of one line with its neighbour, if they hold a word; places and bytes."""
    chunks, found = line_chunks(lines, held), []
    for k, (a, b) in enumerate(chunks):
        if b - a > 1:
            found.append((a, b))
        if k + 1 < len(chunks):
            c, d = chunks[k + 1]
            if b - a == 1 or d - c == 1:
                found.append((a, d))
    return [(a, b, text) for a, b in found if not (text := b"\n".join(lines[a:b])).isspace() and text]


def chunk_digests(text: bytes, digest: Callable[[bytes], bytes] = xxhash.xxh3_128_digest, held: int = HELD) -> list[bytes]:
    return [digest(own) for _, _, own in multi_line(text.split(b"\n"), held)]


def cleaned(text: bytes, shared: dict[bytes, bool], digest: Callable[[bytes], bytes] = xxhash.xxh3_128_digest, held: int = HELD) -> tuple[bytes, int, int, int]:
    """The text without the lines that go; how many lines it had; lines that went and chunks that went whole."""
    lines = text.split(b"\n")
    first: dict[bytes, int] = {}
    goes = bytearray(len(lines))
    for a, b, own in multi_line(lines, held):
        # What overlaps its own first place is no second copy of it.
        if a >= first.setdefault(own, a) + b - a or shared and shared.get(digest(own), False):
            goes[a:b] = b"\1" * (b - a)
    gone = sum(goes)
    if not gone:
        return text, len(lines), 0, 0
    chunks = sum(all(goes[a:b]) for a, b in line_chunks(lines, held))
    return b"\n".join(line for line, go in zip(lines, goes, strict=True) if not go), len(lines), gone, chunks


def differing(listed: DataFrame, text: str, digest: Callable[[bytes], bytes] = xxhash.xxh3_128_digest, held: int = HELD) -> DataFrame:
    """k1, k2: shared digests whose chunks are not the same bytes in all rows.

    ``listed`` has texts and their lists of shared digests; only chunks with such a digest travel, and
    copies are merged before the shuffle.
    """
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        own_cache("lines", dict)

        def rows():
            for batch in sliced(batches, 0):
                for i, own in enumerate(as_bytes(batch.column(0))):
                    shared = repeats.list_of(batch.column(1), i)
                    for chunk in {chunk for _, _, chunk in multi_line(own.split(b"\n"), held)} if shared else ():
                        key = digest(chunk)
                        if key in shared:
                            yield int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), chunk

        yield from table_batches(rows(), schema)

    pairs = listed.where(F.col("list").isNotNull()).select(text, "list").mapInArrow(run, "k1 long, k2 long, bytes binary")
    return pairs.distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1").select("k1", "k2")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, digest: Callable[[bytes], bytes] = xxhash.xxh3_128_digest, held: int = HELD) -> DataFrame:
    """The documents without repeated chunks of lines, and three counts (``_STATS``).

    A chunk of several lines (or of one with its neighbour, ``multi_line``) that holds a word stays in
    the row with the smallest id, at its first place; later copies go. A line that repeats alone stays.
    A repeated run of lines is found from its first boundary to its last; what the README states is how much that is. Every row is a document: of rows that share an id the order goes by
    their texts' hashes, and rows without an id come last. Ids are integers. A null text stays null and counts
    as one empty line. Other columns pass through; a count whose name one of them has gets an
    underscore after it. An empty table gives an empty one. ``digest`` gives 16 bytes; chunks
    that share one and differ are kept.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    names = docs.columns
    stats = free_names(names, _STATS)
    at, text = names.index(text_col), place(docs, text_col)
    rows = keyed(docs, id_col, text_col, scratch)
    found = scratch.write(repeats.light(rows, text, lambda own: chunk_digests(own, digest, held)), "light")
    firsts = repeats.shared(found, scratch)
    together = scratch.write(rows.join(repeats.lists(found, firsts), "row", "left").drop("row"), "together")
    unlike = scratch.write(differing(together, text, digest, held), "unlike")
    if not unlike.isEmpty():  # nothing is removed on the word of a digest that two different pairs have
        firsts = scratch.write(firsts.join(unlike, ["k1", "k2"], "left_anti"), "alike")
        together = rows.join(repeats.lists(found, firsts), "row", "left").drop("row")
    schema = StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in stats)])

    def run(batches):
        own_cache("lines", dict)
        for batch in sliced(batches, at):
            listed = batch.column(batch.num_columns - 1)
            found = [cleaned(own, repeats.list_of(listed, i), digest, held) for i, own in enumerate(as_bytes(batch.column(at)))]
            texts = pa.array([r[0].decode("utf-8", "replace") if ok else None for r, ok in zip(found, batch.column(at).is_valid().to_pylist(), strict=True)], pa.string())
            columns = [texts if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[1 + k] for r in found], pa.int64()) for k in range(3))], names=[*names, *stats])

    return together.mapInArrow(run, schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir)).select("doc_id", "text", *_STATS)
