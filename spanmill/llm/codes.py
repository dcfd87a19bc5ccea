"""Vector codes by product quantisation with delta-maintained Lloyd rounds.

Vectors become integers and are cut into parts with a codebook each. Every round writes the vectors
with their codes and those before, and the running sums and counts of each codebook entry; only parts
whose entry changed add to and take from these sums, summed up in each task before the shuffle.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hot_join

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors whose distances to a codebook are worked out at once.
ROWS = 1 << 12
#: Whole numbers up to here are exact in double precision, in which distances are worked out.
EXACT = 1 << 53


@dataclass
class Codes:
    """rows: vec_id, label, x (padded integers), code (a byte for each part), error; books: the final entries by part, entry, position."""

    rows: DataFrame
    books: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def decoded(self, scale: int = SCALE) -> DataFrame:
        """vec_id, embedding: the entries that each code names."""
        books = self.books

        def run(batches):
            for batch in batches:
                code = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, len(books))
                x = np.concatenate([books[p][code[:, p]] for p in range(len(books))], axis=1) / scale
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["vec_id", "embedding"])

        return self.rows.select("vec_id", "code").mapInArrow(run, "vec_id long, embedding array<double>")


def integers(vectors: DataFrame, scratch: Scratch, parts: int, scale: int, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, int]:
    """(row, vec_id, label, x of every vector without null or non-finite components, the width of x). Shorter vectors are padded with zeros, all to a multiple of the parts."""
    v = F.col("v")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    kept = base.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    longest, most = kept.agg(F.max(F.size("v")), F.max(F.array_max(F.transform(v, F.abs)))).first()
    width = -(-max(longest or 0, parts) // parts) * parts
    limit = int((EXACT / (4 * (width // parts))) ** 0.5)
    if (most or 0) * scale >= limit - 1:
        raise ValueError(f"components must be less than {limit // scale} for exact distances of {width // parts} components")
    x = F.concat(F.transform(v, lambda c: F.floor(c * scale).cast("int")), F.array_repeat(F.lit(0), F.lit(width) - F.size("v")))
    return scratch.write(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", x.alias("x")), "integers"), width


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest entry, the first of equals, and its squared distance. Whole numbers, exactly."""
    half = (book.astype(np.float64) ** 2).sum(1)
    entry, far = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
    for at in range(0, len(x), ROWS):
        own = x[at : at + ROWS].astype(np.float64)
        to = half - 2 * (own @ book.T.astype(np.float64))
        e = to.argmin(1)
        entry[at : at + ROWS] = e
        far[at : at + ROWS] = (to[np.arange(len(own)), e] + (own**2).sum(1)).astype(np.int64)
    return entry, far


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """The rows with ``code`` by these books, ``before`` (the code they had) and ``error`` (squared distances, summed)."""
    parts, width = books.shape[0], books.shape[0] * books.shape[2]
    own = [c for c in rows.columns if c not in ("code", "before", "error")]

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(own.index("x")), width).reshape(-1, parts, width // parts)
            found = [nearest(x[:, p], books[p]) for p in range(parts)]
            code = np.column_stack([e for e, _ in found]).astype(np.uint8)
            error = sum(d for _, d in found)
            had = batch.column(len(own))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(own))), pa.array([c.tobytes() for c in code], pa.binary()), had, pa.array(error)], names=[*own, "code", "before", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema)
    had = F.col("code") if "code" in rows.columns else F.lit(None).cast("binary").alias("code")
    return rows.select(*own, had).mapInArrow(run, f"{kinds}, code binary, before binary, error long")


def changes(rows: DataFrame, parts: int, entries: int, width: int) -> DataFrame:
    """part, entry, at (-1: how many parts, else the component), value: what parts whose entry changed add to their
    entry's sums and take from those of the entry before. Each task sums up before anything is shuffled."""
    size = width // parts

    def run(batches):
        total = np.zeros((parts, entries, size + 1), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), width).reshape(-1, parts, size).astype(np.int64)
            x = np.concatenate([np.ones((len(x), parts, 1), dtype=np.int64), x], axis=2)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, parts)
            known = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            before = np.frombuffer(b"".join(b if b else bytes(parts) for b in batch.column(2).to_pylist()), dtype=np.uint8).reshape(-1, parts)
            for p in range(parts):
                moved = ~known | (code[:, p] != before[:, p])
                np.add.at(total[p], code[moved, p], x[moved, p])
                moved &= known
                np.subtract.at(total[p], before[moved, p], x[moved, p])
        p, e, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(k.astype(np.int32) - 1), pa.array(total[p, e, k])], names=["part", "entry", "at", "value"])

    moved = rows.where(F.col("before").isNull() | (F.col("before") != F.col("code"))).select("x", "code", "before")
    return moved.mapInArrow(run, "part int, entry int, at int, value long").groupBy("part", "entry", "at").agg(F.sum("value").alias("value"))


def moved_to(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Each entry that has parts replaced by the floor of their mean. The sums are as many as the books' numbers."""
    parts, entries, size = books.shape
    total = np.zeros((parts, entries, size + 1), dtype=np.int64)
    for part, entry, at, value in sums.select("part", "entry", "at", "value").collect():
        total[part, entry, at + 1] = value
    n = total[:, :, :1]
    return np.where(n > 0, total[:, :, 1:] // np.maximum(n, 1), books)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scratch: Scratch | None = None) -> Codes | None:
    """Codes of all vectors without null or non-finite components; None if there are none.

    A component x counts as floor(scale * x). Each part's codebook starts as that part of the vectors
    with the smallest ids (those without an id last, rows of one id by their components), of which there
    may be fewer than ``entries`` (256 at most). An entry that no part is nearest to stays. Rows that
    repeat are vectors of their own; vectors of unlike lengths are padded with zeros. Components too
    large for exact distances raise an error. Ids are integers; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "codes")
    rows, width = integers(vectors, scratch, parts, scale, id_col, vec_col, label_col)
    first = rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(min(entries, 256)).collect()
    if not first:
        return None
    books = np.array([r.x for r in first], dtype=np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    sums, held = None, None
    for _ in range(rounds):
        own = Scratch(spark, "codes")
        rows = own.write(assigned(rows, books), "assigned")
        delta = changes(rows, parts, len(first), width)
        sums = own.write((sums.unionByName(delta) if sums else delta).groupBy("part", "entry", "at").agg(F.sum("value").alias("value")), "sums")
        books = moved_to(books, sums)
        if held:
            held.drop()
        held = own
    return Codes(scratch.write(assigned(rows, books), "coded"), books)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (summed over equal labels, nulls together), codebooks_sha256."""
    coded = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    if coded is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    # Joins pass over nulls, so that a null label has a key that says so.
    rows = coded.rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("of"))
    by_label = rows.groupBy("none", "of").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    both = hot_join(rows, Scratch(spark, "codes").write(by_label, "labels"), ["none", "of"])
    return both.select("vec_id", "code", "error", "label_error", F.lit(coded.sha256()).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    """The rounds one after another: distances of all parts to all entries, the nearest, and the floors of the means."""
    out = []
    for r in range(ROUNDS + 1):
        out.append(f"far{r} AS MATERIALIZED (SELECT row, p, e, sum((x - c) * (x - c)) AS d FROM comps JOIN book{r} USING (p, j) GROUP BY row, p, e)")
        out.append(f"near{r} AS MATERIALIZED (SELECT row, p, e, d FROM far{r} QUALIFY row_number() OVER (PARTITION BY row, p ORDER BY d, e) = 1)")
        if r < ROUNDS:
            mean = "CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT)"
            out.append(f"mean{r} AS MATERIALIZED (SELECT p, e, j, {mean} AS c FROM comps JOIN near{r} USING (row, p) GROUP BY p, e, j)")
            out.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (p, e, j))")
    return ",\n".join(out)


#: The embeddings' width is read off the first kept row; all are of one width.
OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = (SELECT count(*) FROM (SELECT unnest(embedding) AS x) u WHERE x IS NOT NULL AND isfinite(x))),
wide AS (SELECT max(len(embedding)) // {PARTS} AS size FROM kept),
comps AS MATERIALIZED (
  SELECT row, k // size AS p, k % size AS j, CAST(floor({SCALE} * CAST(embedding[k + 1] AS DOUBLE)) AS BIGINT) AS x
  FROM kept, wide, (SELECT unnest(range({PARTS} * 4096)) AS k) WHERE k < {PARTS} * size),
book0 AS MATERIALIZED (SELECT p, row - 1 AS e, j, x AS c FROM comps WHERE row <= {ENTRIES}),
{_rounds_sql()},
coded AS MATERIALIZED (SELECT row, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY row),
books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), books
"""
