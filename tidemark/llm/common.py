"""Helpers shared by the corpus operators: tables, checkpoints, samples, batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_path, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, name)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    return written(df, name)


def lean(spark: SparkSession) -> None:
    """Hand whole texts to Python a thousand rows at a time at most; the default of 10,000 takes memory in both processes.

    All operators on texts call it; it lowers the session's setting, which Spark reads when a plan runs, and never raises it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= 1_000:
        spark.conf.set(name, "1000")


def crc32_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; the fold rule of the classifiers."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings; null becomes the empty string."""
    return ["" if x is None else x for x in column.to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that `column` (string or binary) holds at most about `limit` bytes in each, one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size, dtype=np.int64) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal first columns, across batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)
