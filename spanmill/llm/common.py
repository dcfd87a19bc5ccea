"""What the training-data operators share: scratch tables, keys of rows, joins with hot keys, document input."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and driver and executors are one process (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

#: Longest slice of a column that is turned into Python objects at once.
SLICE_BYTES = 8 << 20

#: Longest word that a worker's cache remembers, so that a bound on entries bounds bytes too.
CACHED_BYTES = 64

#: Stands for a null id, and so comes last.
NO_ID = (1 << 63) - 1

#: A key is hot if it has so many rows, and so large a share of all rows that no more than HOT_KEYS keys can be hot.
HOT_ROWS, HOT_KEYS = 1000, 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; without a name a cluster gets an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = LOCAL_CHECKPOINTS
    return named.rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cut the lineage and survive lost executors.

    Results may still read them, so whoever opened a scratch says when it goes: by ``drop`` or a with
    statement. What nobody drops goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._at_exit)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back; later plans start from the files."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self) -> None:
        atexit.unregister(self._at_exit)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _at_exit(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone by then
            self.drop()

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def placed(docs: DataFrame) -> DataFrame:
    """The columns by place (c0, c1, ...), so that no name can clash."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def place(docs: DataFrame, column: str) -> str:
    """What ``placed`` calls a column."""
    return f"c{docs.columns.index(column)}"


def keyed(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """``placed`` columns and ``row``, a long of each row's own that orders rows by id, those without one last.

    Where ids are whole and unique, they are the keys. Else the rows are written once, in the order of
    their ids and, among rows of one id, of their texts' hashes, and of their places in the scan, and
    numbered in it: however many rows share an id, and a text, they are dealt over many tasks and keep
    keys of their own.
    """
    own = placed(docs)
    key = F.coalesce(F.col(place(docs, id_col)).cast("long"), F.lit(NO_ID))
    if own.select(key.alias("row")).groupBy("row").count().where((F.col("count") > 1) | (F.col("row") == NO_ID)).isEmpty():
        return own.withColumn("row", key)
    tie = F.xxhash64(place(docs, text_col))
    order = ["row", "tie", "spread"]
    ordered = own.withColumns({"row": key, "tie": tie, "spread": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.write(ordered.drop("tie", "spread").withColumn("row", F.monotonically_increasing_id()), "keyed")


def hot_join(many: DataFrame, few: DataFrame, on: list[str], n: str = "n", most: int = HOT_KEYS, least: int | None = None) -> DataFrame:
    """``many`` joined with ``few``, which has one row a key and in ``n`` how many rows of ``many`` the key has (n is dropped).

    Keys with a large share of the rows, ``most`` at most and of ``least`` rows (HOT_ROWS) at least, are sent to all
    workers, so their rows stay where they are; only the other rows are shuffled to meet their keys. Both
    tables are read more than once and are best written before.
    """
    total = few.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) >= max(HOT_ROWS if least is None else least, -(-total // most))
    if few.where(hot).isEmpty():
        return many.join(few.drop(n), on)
    own = F.broadcast(few.where(hot).drop(n))
    rest = many.join(F.broadcast(few.where(hot).select(*on)), on, "left_anti")
    return many.join(own, on).unionByName(rest.join(few.where(~hot).drop(n), on))


def free_names(taken: list[str], wanted: tuple[str, ...]) -> list[str]:
    """The wanted names; one that is taken already gets underscores after it."""
    held, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


#: What empties the caches that this worker process holds, by operator.
_CACHES: dict[str, Callable[[], None]] = {}


def own_cache(name: str, clear: Callable[[], None]) -> None:
    """Called where a task begins to use an operator's cache: the caches of other operators, which an earlier task left in this worker, are emptied."""
    if name not in _CACHES:
        for empty in _CACHES.values():
            empty()
        _CACHES.clear()
        _CACHES[name] = clear
        pa.default_memory_pool().release_unused()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; a null id counts as the empty text."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def as_bytes(column: pa.Array) -> Iterator[bytes]:
    """The column's values as UTF-8 bytes, null as empty, a bounded slice at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(kind)
    step = max(1, min(len(column), int(SLICE_BYTES * max(1, len(column)) / max(1, column.nbytes))))
    for at in range(0, len(column), step):
        for value in column.slice(at, step).to_pylist():
            yield value or b""


def sliced(batches: Iterable[pa.RecordBatch], text: int, most: int = 1024, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows and bytes of the text column (by place) at most; a longer text is a slice alone."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(at + most, max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def one_row_texts(batches: Iterable[pa.RecordBatch], text: str, keys: list[str]) -> Iterator[tuple[tuple, bytes]]:
    """(keys, text) for each row of the batches."""
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        for row in zip(zip(*columns, strict=True) if keys else ((),) * batch.num_rows, as_bytes(batch.column(text)), strict=True):
            yield row


def table_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 4096, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded length and size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes | str))
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
