"""Exact top-k inner products over a bit-sliced index.

A block of vectors is kept as bitmaps: for each attribute (component) and each bit of its quantised value, one bit a row.
A query's scores are sums of those slices at the weights of the query's own bits; they are added for all rows at once
with bitwise full adders (three bitmaps of one weight become one of that weight and one of the next). The k-th highest
sum is read from the most significant slice downward. The lowest bits of an attribute are left out of the sums, which
bounds every row's score from both sides; rows within the bound of the k-th one are the boundary, and get exact scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import groups, lean, staged

SCALE = 1024
#: Slices of an attribute that are added up; lower ones only count in the exact scores of boundary rows.
SLICES = 6
#: Rows of a block and their bytes at most, and queries that are read at once.
ROW_BLOCK, BLOCK_BYTES, QUERY_BLOCK = 16_384, 32 << 20, 1_024
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, key: str, column: str, scale: int = SCALE) -> DataFrame:
    """key and v, floor(scale * x) of each component as a double, which holds it exactly; without the vectors that take no part."""
    x = F.col(column)
    scaled = lambda e: e.cast("double") * F.lit(float(scale))
    usable = F.col(key).isNotNull() & x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(scaled(e)) | (F.abs(scaled(e)) == F.lit(float("inf"))))
    # Doubles from 2^52 on are whole numbers.
    v = F.transform(x, lambda e: F.when(F.abs(scaled(e)) < float(1 << 52), F.floor(scaled(e)).cast("double")).otherwise(scaled(e)))
    return vectors.filter(usable).select(F.col(key).cast("long").alias(key), v.alias("v"))


class BitSlices:
    """The bit-sliced index of one block of rows."""

    def __init__(self, values: np.ndarray, slices: int = SLICES):
        n, self.dims = values.shape
        self.values = values
        self.low = int(values.min(initial=0))
        shifted = (values - self.low).astype(np.uint64)
        width = max(1, int(shifted.max(initial=0)).bit_length())
        self.cut = max(0, width - slices)
        self.width = width - self.cut
        self.words = (n + 63) // 64
        self.n = n
        padded = np.zeros((self.dims, self.words * 64), np.uint64)
        padded[:, :n] = (shifted >> np.uint64(self.cut)).T
        #: slice of attribute d and bit i, as 64-bit words
        self.slices = np.stack([np.packbits((padded >> np.uint64(i)).astype(np.uint8) & 1, axis=1, bitorder="little").view(np.uint64) for i in range(self.width)], axis=1)
        self.rows = np.packbits(np.arange(self.words * 64) < n, bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of sum(|q| * a), least first, and the greatest difference that the cut bits make.

        a is the attribute where q is positive and its complement where q is negative, so that all terms add up.
        """
        size = np.abs(query).astype(np.uint64)
        flip = np.where(query < 0, ~np.uint64(0), np.uint64(0))
        attributes = self.slices ^ flip[:, None, None]
        bits = int(size.max(initial=0)).bit_length()
        at: dict[int, list[np.ndarray]] = {}
        for j in range(bits):
            d = np.flatnonzero((size >> np.uint64(j)) & np.uint64(1))
            if len(d):
                for i in range(self.width):
                    at.setdefault(i + j, []).append(attributes[d, i])
        out: list[np.ndarray] = []
        w = 0
        while any(k >= w for k in at):
            parts = at.pop(w, [])
            x = np.concatenate(parts) if parts else np.zeros((0, self.words), np.uint64)
            while len(x) > 2:
                third = len(x) // 3
                a, b, c = x[:third], x[third : 2 * third], x[2 * third : 3 * third]
                half = a ^ b
                at.setdefault(w + 1, []).append((a & b) | (half & c))
                x = np.concatenate((half ^ c, x[3 * third :]))
            if len(x) == 2:
                at.setdefault(w + 1, []).append(x[:1] & x[1:])
                x = x[:1] ^ x[1:]
            out.append(x[0] if len(x) else np.zeros(self.words, np.uint64))
            w += 1
        return out, int(size.sum()) * ((1 << self.cut) - 1)

    def top(self, query: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
        """Rows that hold the k highest scores with all ties of the k-th; own: rows (bitmap) that take no part."""
        slices, slack = self.sums(query)
        live = self.rows if own is None else self.rows & ~own
        if int(np.bitwise_count(live).sum()) <= k or not slices:
            return np.flatnonzero(np.unpackbits(live.view(np.uint8), bitorder="little"))
        rest, need, kth = live, k, 0
        for i in range(len(slices) - 1, -1, -1):
            high = rest & slices[i]
            c = int(np.bitwise_count(high).sum())
            if c >= need:
                rest, kth = high, kth | (1 << i)
            else:
                need, rest = need - c, rest & ~slices[i]
        least = max(0, kth - -(-slack // (1 << self.cut)))
        above, same = np.zeros_like(live), live
        for i in range(len(slices) - 1, -1, -1):
            if least >> i & 1:
                same = same & slices[i]
            else:
                above, same = above | (same & slices[i]), same & ~slices[i]
        return np.flatnonzero(np.unpackbits((above | same).view(np.uint8), bitorder="little"))


class Block:
    """Rows (ids, whole numbers as doubles): an index of those whose inner products fit 63 bits, and the others by themselves."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids = ids
        #: Components up to this magnitude are small.
        self.bound = isqrt((1 << 62) // max(1, values.shape[1]))
        small = (np.abs(values) <= self.bound).all(1)
        self.small, self.large = np.flatnonzero(small), np.flatnonzero(~small)
        self.index = BitSlices(values[small].astype(np.int64))
        self.wide = _wide(values[self.large])

    def best(self, query: int, v: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but the query's own, by falling score, then id; scores are exact, of any size."""
        small, large = self.small, self.large
        mine = self.ids[small] == query
        if (np.abs(v) <= self.bound).all():
            q = v.astype(np.int64)
            own = None
            if mine.any():
                padded = np.zeros(self.index.words * 64, bool)
                padded[: len(small)] = mine
                own = np.packbits(padded, bitorder="little").view(np.uint64)
            rows = self.index.top(q, k, own)
            scores, ids = self.index.values[rows] @ q, self.ids[small[rows]]
            order = np.lexsort((ids, -scores))[:k]
            found = list(zip(scores[order].tolist(), ids[order].tolist(), strict=True))
        else:
            scores = _wide(self.index.values[~mine]) @ _wide(v[None])[0] if len(v) else np.zeros(int((~mine).sum()), object)
            found = list(zip(scores.tolist(), self.ids[small[~mine]].tolist(), strict=True))
        if len(large):
            others = self.ids[large] != query
            found += zip((self.wide[others] @ _wide(v[None])[0]).tolist(), self.ids[large[others]].tolist(), strict=True)
        return sorted(found, key=lambda f: (-f[0], f[1]))[:k] if len(found) > k or len(large) else found


def _wide(values: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python's, which have any size."""
    out = np.empty(values.shape, object)
    out[:] = [[int(x) for x in row] for row in values.tolist()] if values.size else 0
    return out


def _beyond(score: int) -> bytes | None:
    """For a score that a long can't hold (or the last that it can), bytes that sort as the score."""
    return (score + (1 << 2160)).to_bytes(272, "big") if abs(score) >= _LONG else None


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k highest integer inner products, ties to smaller ids.

    Both inputs have `key` and `column` (an array of numbers); other columns are ignored. A row with a null key, a null
    vector, or one that holds a null or a component that isn't finite (once scaled, in a double) takes no part. Rows with
    the query's own key are no candidates, nor are vectors of another length; empty vectors score 0 among themselves.
    Repeated rows are candidates, and queries, each on their own. Ranks follow exact scores of any size; a score that a
    long can't hold is given as the nearest long. Empty tables give an empty result.

    Rows are dealt to bounded blocks, each indexed once in one task; queries are sent to every block and read in parts of
    bounded size. A block gives k rows a query; the best k of those are kept.
    """
    spark = vectors.sparkSession
    lean(spark)
    rows = staged(quantised(vectors, key, column, scale), "vectors")
    asked = staged(quantised(queries, key, column, scale), "queries")
    n, longest = rows.select(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n // max(64, min(ROW_BLOCK, BLOCK_BYTES // (8 * max(1, longest or 0))))))
    parts = max(1, -(-asked.count() // QUERY_BLOCK))

    own = F.pmod(F.monotonically_increasing_id(), F.lit(blocks))
    left = rows.select(own.alias("block"), F.lit(-1).cast("long").alias("part"), F.col(key).alias("id"), "v")
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64(key, "v"), F.lit(parts)).alias("part"), F.col(key).alias("id"), "v")
    dealt = left.union(right).select("block", F.size("v").cast("long").alias("dims"), "part", "id", "v").repartition(max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, None
        for (b, dims, part), group in groups(batches, 3):
            ids = group["id"].to_numpy()
            values = np.asarray(group["v"].combine_chunks().flatten()).reshape(len(ids), int(dims))
            if part < 0:
                held, block = (b, dims), Block(ids, values)
            elif held == (b, dims):
                found = [(q, i, s) for q, v in zip(ids.tolist(), values, strict=True) for s, i in block.best(q, v, k)]
                scores = [max(-_LONG - 1, min(_LONG, f[2])) for f in found]
                yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array(scores, pa.int64()), pa.array([_beyond(f[2]) for f in found], pa.binary())], names=["query_id", "vec_id", "score", "beyond"])

    best = dealt.sortWithinPartitions("block", "dims", "part").mapInArrow(run, "query_id long, vec_id long, score long, beyond binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
