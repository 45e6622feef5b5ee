"""Vectors of whole numbers: exact distances, and sums that merge, whatever the size of a component.

Almost all vectors are narrow: their squared distances fit 63 bits. The others are wide, and are reckoned in Python's
integers. So are nearest entries only where it matters: an entry beyond `reach` is farther from a narrow vector than
any narrow entry, so that narrow vectors pass it over.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, key: str, column: str, dims: int, scale: int, *others: str) -> DataFrame:
    """key, the other columns and v: floor(scale * x) of each component, as a double, which holds it exactly.

    Rows with a null key, without a vector of `dims` components, or with a component that is null or isn't finite (also
    once scaled) take no part.
    """
    x = F.col(column)
    scaled = lambda e: e.cast("double") * F.lit(float(scale))
    usable = F.col(key).isNotNull() & (F.size(x) == dims) & ~F.exists(x, lambda e: e.isNull() | F.isnan(scaled(e)) | (F.abs(scaled(e)) == F.lit(float("inf"))))
    # Doubles from 2^52 on are whole numbers.
    v = F.transform(x, lambda e: F.when(F.abs(scaled(e)) < float(1 << 52), F.floor(scaled(e)).cast("double")).otherwise(scaled(e)))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long").alias(key), *others, v.alias("v"))


def limits(dims: int) -> tuple[int, int]:
    """The greatest component of a narrow vector, and the reach: the greatest of an entry that can be nearest to one.

    Squared distances of narrow vectors from entries within reach fit 62 bits; from an entry beyond it they are more
    than 4 * narrow^2 * dims, which two narrow vectors never are apart.
    """
    root = isqrt(max(1, dims) - 1) + 1
    narrow = (1 << 31) // (root * (2 * root + 4))
    return narrow, narrow * (2 * root + 3)


def integers(values: np.ndarray) -> np.ndarray:
    """Whole doubles (or integers) as Python's integers."""
    out = np.empty(values.shape, object)
    out.ravel()[:] = [int(x) for x in values.ravel().tolist()]
    return out


class Entries:
    """Numbered vectors, of which the nearest is asked for; ties go to the smaller number."""

    def __init__(self, values: np.ndarray):
        self.values = values
        narrow, reach = limits(values.shape[1])
        size = np.array([max((abs(int(x)) for x in row), default=0) for row in values.tolist()], object)
        #: numbers of the entries that narrow vectors look at, or None where they need Python's integers too
        self.near = np.flatnonzero(size <= reach) if (size <= narrow).any() else None
        self.small = values[self.near].astype(np.int64) if self.near is not None else None

    def nearest(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest entry for vectors laid out by dimension (dims, rows).

        Distances to all entries accumulate dimension by dimension. columns: int64 of narrow vectors, or Python's integers.
        """
        fits = columns.dtype != object and self.near is not None
        entries = self.small if fits else integers(self.values)
        columns = columns if fits else integers(columns)
        distance = np.zeros((columns.shape[1], len(entries)), columns.dtype)
        for d in range(len(columns)):
            step = columns[d][:, None] - entries[None, :, d]
            step *= step
            distance += step
        best = distance.argmin(1)
        return (self.near[best] if fits else best), distance[np.arange(len(best)), best]


class Totals:
    """Sums and counts of the vectors dealt to each of k entries: int64 tensors, and Python's integers for wide vectors."""

    def __init__(self, k: int, dims: int):
        self.sums = np.zeros((k, dims), np.int64)
        self.counts = np.zeros(k, np.int64)
        self.wide: dict[int, np.ndarray] = {}

    def add(self, entry: np.ndarray, vectors: np.ndarray, counts: np.ndarray | int = 1) -> Totals:
        """Add vectors (rows, dims), each the sum of so many, to their entries."""
        np.add.at(self.counts, entry, counts)
        if vectors.dtype != object:
            np.add.at(self.sums, entry, vectors)
        else:
            for k, v in zip(entry.tolist(), vectors, strict=True):
                self.wide[k] = self.wide[k] + v if k in self.wide else v
        return self

    def merge(self, other: Totals) -> Totals:
        self.sums += other.sums
        self.counts += other.counts
        for k, v in other.wide.items():
            self.wide[k] = self.wide[k] + v if k in self.wide else v
        return self

    def means(self, before: np.ndarray) -> np.ndarray:
        """floor(sum / count) of every entry by components, as Python's integers; unused entries stay as before."""
        out = before.copy()
        for k in np.flatnonzero(self.counts):
            total = integers(self.sums[k]) + self.wide.get(int(k), 0)
            out[k] = total // int(self.counts[k])
        return out


def tables(batches: Iterator[pa.RecordBatch], column: str, dims: int, rows: int) -> Iterator[tuple[pa.Table, np.ndarray, bool]]:
    """Tables of `rows` rows at most with their vectors (rows, dims): int64 and True for narrow ones, doubles and False for wide ones."""
    narrow, _ = limits(dims)
    held: dict[bool, list[pa.RecordBatch]] = {True: [], False: []}

    def cut(fits: bool, least: int) -> Iterator[tuple[pa.Table, np.ndarray, bool]]:
        while held[fits] and (n := sum(b.num_rows for b in held[fits])) >= least:
            whole = pa.Table.from_batches(held[fits])
            part, rest = whole.slice(0, rows), whole.slice(rows)
            values = np.asarray(part.column(column).combine_chunks().flatten()).reshape(part.num_rows, dims)
            yield part, values.astype(np.int64) if fits else values, fits
            held[fits] = rest.to_batches() if n > rows else []

    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.asarray(batch.column(batch.schema.get_field_index(column)).flatten()).reshape(batch.num_rows, dims)
        fit = (np.abs(values) <= narrow).all(1)
        for fits in (True, False):
            if (fit == fits).any():
                held[fits].append(batch.filter(pa.array(fit == fits)))
                yield from cut(fits, rows)
    for fits in (True, False):
        yield from cut(fits, 1)


def longs(values: Sequence[int] | np.ndarray) -> pa.Array:
    """Distances as longs; one that a long can't hold is the greatest long."""
    return pa.array(values if getattr(values, "dtype", object) != object else [min(LONG, int(x)) for x in values], pa.int64())


def joined(values: np.ndarray) -> str:
    """All components in order, as decimal integers joined by commas."""
    return ",".join(str(int(x)) for x in values.ravel().tolist())
