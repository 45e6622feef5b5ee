"""Product codes of vectors: codebooks by rounds of exact integer means, one small number for each part of a vector.

Vectors are kept as columnar blocks (part, dimension, rows). A round is one RDD treeAggregate over the blocks: in a
task, distances to all entries of a part's codebook accumulate dimension by dimension, and np.add.at adds the parts to
int64 tensors of sums and counts; the tensors merge through a reduction tree. A round moves the codebooks and the
tensors, whose size depends on parts, entries and dimensions only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, staged
from .whole import LONG, Entries, Totals, integers, joined, longs, tables, whole_vectors

#: Rows of a columnar block.
ROWS = 1024
#: Sums by label that may be broadcast; more are joined by shuffling.
BROADCAST_LABELS = 100_000


def blocks_of(rows: DataFrame, dims: int, parts: int) -> DataFrame:
    """n, narrow and data: the blocks' bytes, laid out by part, dimension and row (int64, or doubles of wide vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, narrow in tables(batches, "v", dims, ROWS):
            data = np.ascontiguousarray(values.T)
            yield pa.record_batch([pa.array([len(values)]), pa.array([narrow]), pa.array([data.tobytes()], pa.binary())], names=["n", "narrow", "data"])

    return rows.select("v").mapInArrow(run, "n long, narrow boolean, data binary")


def _columns(data: bytes, n: int, narrow: bool, parts: int) -> np.ndarray:
    values = np.frombuffer(bytes(data), np.int64 if narrow else np.float64)
    return (values if narrow else integers(values)).reshape(parts, -1, n)


def _added(totals: list[Totals], books: list[Entries], columns: np.ndarray) -> list[Totals]:
    for total, book, part in zip(totals, books, columns, strict=True):
        total.add(book.nearest(part)[0], part.T)
    return totals


def codebooks(rows: DataFrame, dims: int = 64, parts: int = 4, entries: int = 256, rounds: int = 4, key: str = "vec_id") -> np.ndarray:
    """The codebooks (part, entry, position) of rows (key, v) after so many rounds, as Python's integers.

    They start as the parts of the rows of the smallest keys; repeated keys count by their vectors' order.
    """
    spark = rows.sparkSession
    width = dims // parts
    first = rows.select(key, "v").orderBy(key, "v").limit(entries).collect()
    books = integers(np.array([r["v"] for r in first], float).reshape(len(first), parts, width).transpose(1, 0, 2))
    if not len(first):
        return books
    blocks = staged(blocks_of(rows, dims, parts), "blocks").rdd
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast([Entries(b) for b in books])
        zero = [Totals(len(first), width) for _ in range(parts)]
        found = blocks.treeAggregate(
            zero,
            lambda totals, block, sent=sent: _added(totals, sent.value, _columns(block.data, block.n, block.narrow, parts)),
            lambda a, b: [x.merge(y) for x, y in zip(a, b, strict=True)],
        )
        sent.unpersist()
        books = np.stack([t.means(b) for t, b in zip(found, books, strict=True)])
    return books


def encoded(rows: DataFrame, books: np.ndarray, key: str, *others: str) -> DataFrame:
    """key, the other columns, code (an entry's number for each part, in hex digits) and error of every row (key, v)."""
    parts, entries, width = books.shape
    digits = max(2, len(f"{max(0, entries - 1):x}"))
    sent = rows.sparkSession.sparkContext.broadcast([Entries(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, values, narrow in tables(batches, "v", parts * width, ROWS):
            columns = (values if narrow else integers(values)).T.reshape(parts, width, -1)
            found = [book.nearest(part) for book, part in zip(sent.value, columns, strict=True)]
            code = ["".join(f"{x:0{digits}x}" for x in row) for row in np.stack([f[0] for f in found], 1).tolist()]
            total = sum((integers(f[1]) if f[1].dtype == object else f[1] for f in found[1:]), found[0][1])
            names = [key, *others]
            kept = [table.column(c).combine_chunks() for c in names]
            yield pa.record_batch([*kept, pa.array(code, pa.string()), longs(total)], names=[*names, "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (key, *others)) + ", code string, error long")


def compressed(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", dims: int = 64, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """key, code, error, label_error and codebooks_sha256 of every row that takes part, repeated rows included.

    Components become floor(scale * x). Rows with a null key, a vector of another length than `dims`, or one with a null
    or non-finite component take no part; other columns are ignored. With fewer rows than `entries` the codebooks are that
    short. Equal distances go to the entry of the lower number. label_error sums `error` over rows of one label, null being
    one; errors and sums beyond a long are the greatest long. An empty table gives an empty result.
    """
    if dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    spark = vectors.sparkSession
    lean(spark)
    whole = whole_vectors(vectors.select(F.col(key).alias("id"), F.col(column).alias("x"), F.col(label).alias("label")), "id", "x", dims, scale, "label")
    rows = staged(whole, "vectors")
    books = codebooks(rows, dims, parts, entries, rounds, "id")
    if not books.shape[1]:
        found = rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        found = staged(encoded(rows, books, "id", "label"), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    sums = staged(found.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "sums")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    digest = hashlib.sha256(joined(books).encode()).hexdigest()
    out = found.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
