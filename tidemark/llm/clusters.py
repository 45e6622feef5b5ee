"""Lloyd's centroids by two trees: a cover tree over each block of vectors, and one over the centroids of each round.

Vectors are dealt to bounded blocks. A block's cover tree is built once and kept with the vectors in the order of its
leaves, so that a node is a stretch of rows. In a round, pairs (node, node of the centroids' tree) are walked level by
level from the roots. A pair goes when even the nearest of its points are farther apart than the vectors' node surely is
from another centroid; a node left with one centroid is dealt to it whole, by its sum; pairs of leaves are compared
exactly. All distances that decide are integers. A round moves the centroids and their sums only.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, staged
from .whole import LONG, Entries, Totals, integers, joined, longs, tables, whole_vectors

#: Vectors of a block, and of a leaf at most (unless they are all equal).
ROWS, LEAF = 1024, 8
#: Pairs whose distances are reckoned at once.
PAIRS = 1 << 14


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a from all rows of b in floating point; narrow vectors' squares are exact to 2^53."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.stack([np.sqrt(((b - row) ** 2).sum(1)) for row in a]) if len(a) else np.zeros((0, len(b)))


class CoverTree:
    """A cover tree over the rows of a table, by levels of radius 2^i.

    A node holds all rows within 2^i of its centre. Its children have radius 2^(i-1): the first has the same centre, the
    centre of every further one is farther than that from those before it. Levels at which nothing is split are left out.
    Nodes are in order of breadth, children one after the other; `order` lays rows out by leaves. Of equal rows of one
    leaf, the centre is the first.
    """

    def __init__(self, values: np.ndarray, leaf: int = LEAF):
        n = len(values)
        exact = values.astype(float)
        self.order = np.zeros(n, np.int32)
        nodes: list[tuple[int, int, int, float]] = []
        children: list[tuple[int, int]] = []
        waiting = deque([(0, 0, np.arange(n), _apart(exact[:1], exact)[0])] if n else [])
        made = len(waiting)
        while waiting:
            first, centre, members, apart = waiting.popleft()
            radius = float(apart.max())
            nodes.append((first, first + len(members), centre, radius * (1 + 1e-12)))
            if len(members) <= leaf or not radius > 0 or not np.isfinite(radius):
                self.order[first : first + len(members)] = members
                children.append((0, 0))
                continue
            half = 2.0 ** (np.ceil(np.log2(radius)) - 1)
            parts = [(centre, members[apart <= half], apart[apart <= half])]
            rest = members[apart > half]
            left = exact[rest]
            while len(rest):
                away = np.sqrt(((left - left[0]) ** 2).sum(1))
                near = away <= half
                parts.append((int(rest[0]), rest[near], away[near]))
                rest, left = rest[~near], left[~near]
            children.append((made, made + len(parts)))
            made += len(parts)
            for part in parts:
                waiting.append((first, *part))
                first += len(part[1])
        self.first, self.last, centres = (np.array([x[i] for x in nodes], np.int32) for i in range(3))
        self.radius = np.array([x[3] for x in nodes])
        self.children = np.array(children, np.int32).reshape(-1, 2)
        place = np.zeros(n, np.int32)
        place[self.order] = np.arange(n)
        #: a node's centre, as a row in the order of leaves
        self.centre = place[centres]


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ranges its place, and its numbers one after the other."""
    n = last - first
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + first[at]


class Centroids:
    """The centroids of a round, with their tree where narrow vectors can use one."""

    def __init__(self, values: np.ndarray):
        self.entries = Entries(values)
        if self.entries.near is not None:
            self.tree = CoverTree(self.entries.small, 1)
            self.rows = self.entries.small[self.tree.order]
            self.number = self.entries.near[self.tree.order]

    def deal(self, tree: CoverTree, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches (first, last) of a block's rows in the order of its leaves, with the number of their nearest centroid."""
        if self.entries.near is None:
            return np.arange(len(rows)), np.arange(len(rows)) + 1, self.entries.nearest(rows.T)[0]
        own = self.tree
        v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
        dealt: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(v):
            apart = np.sqrt(_squared(rows[tree.centre[v]], self.rows[own.centre[c]]))
            start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            size = np.diff(np.append(start, len(v)))
            # Some centroid is no farther than this from any vector of the node.
            surely = np.repeat(np.minimum.reduceat(apart + tree.radius[v], start), size)
            keep = ~(apart - tree.radius[v] - own.radius[c] > surely * (1 + 1e-9) + 1e-6)
            v, c = v[keep], c[keep]
            start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            size = np.diff(np.append(start, len(v)))
            leaf_v, leaf_c = tree.children[v, 1] == 0, own.children[c, 1] == 0
            alone = np.repeat(size == 1, size) & leaf_c
            dealt.append((tree.first[v[alone]], tree.last[v[alone]], self.number[own.centre[c[alone]]]))
            ready = ~alone & leaf_v & np.repeat(np.logical_and.reduceat(leaf_c, start), size)
            dealt.append(self._compared(tree, rows, v[ready], c[ready]))
            v, c = (x[~alone & ~ready] for x in (v, c))
            at, kids = _spread(*_kids(tree, v))
            v, c = kids, c[at]
            at, kids = _spread(*_kids(own, c))
            v, c = v[at], kids
            order = np.argsort(v, kind="stable")
            v, c = v[order], c[order]
        return tuple(np.concatenate(x) for x in zip(*dealt, strict=True))

    def _compared(self, tree: CoverTree, rows: np.ndarray, v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every row of the leaves v with the exactly nearest of the centroids that are left to its leaf; ties to the smaller number."""
        at, row = _spread(tree.first[v], tree.last[v])
        entry = self.tree.centre[c[at]]
        distance = _squared(rows[row], self.rows[entry]) if len(row) else np.zeros(0, np.int64)
        number = self.number[entry]
        order = np.lexsort((number, distance, row))
        best = order[np.concatenate(([True], row[order][1:] != row[order][:-1]))] if len(row) else order
        return row[best], row[best] + 1, number[best]


def _kids(tree: CoverTree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of the nodes' children; a leaf's is itself."""
    leaf = tree.children[nodes, 1] == 0
    return np.where(leaf, nodes, tree.children[nodes, 0]), np.where(leaf, nodes + 1, tree.children[nodes, 1])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of a from the same rows of b."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), PAIRS):
        step = a[i : i + PAIRS] - b[i : i + PAIRS]
        out[i : i + PAIRS] = np.einsum("ij,ij->i", step, step)
    return out


def grown(rows: DataFrame, dims: int) -> DataFrame:
    """The blocks of rows (id, v): ids and data in the order of the block's leaves, and its tree (null for wide vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, values, narrow in tables(batches, "v", dims, ROWS):
            ids = table.column("id").to_numpy()
            tree = None
            if narrow:
                tree = CoverTree(values)
                ids, values = ids[tree.order], values[tree.order]
                kind = next(k for k in (np.int16, np.int32, np.int64) if np.abs(values).max(initial=0) <= np.iinfo(k).max)
                values = values.astype(kind)
            yield pa.record_batch([pa.array([ids], pa.list_(pa.int64())), pa.array([values.dtype.str]), pa.array([values.tobytes()], pa.binary()), pa.array([tree and pickle.dumps(tree)], pa.binary())], names=["ids", "kind", "data", "tree"])

    return rows.mapInArrow(run, "ids array<long>, kind string, data binary, tree binary")


def _dealt(centroids: Centroids, kind: str, data: bytes, tree: bytes | None, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a block, and stretches of them with their centroids' numbers."""
    rows = np.frombuffer(bytes(data), kind).reshape(-1, dims)
    if tree is None:
        rows = integers(rows)
        return rows, np.arange(len(rows)), np.arange(len(rows)) + 1, centroids.entries.nearest(rows.T)[0]
    rows = rows.astype(np.int64)
    return rows, *centroids.deal(pickle.loads(bytes(tree)), rows)


def _added(totals: Totals, centroids: Centroids, block, dims: int) -> Totals:
    rows, first, last, number = _dealt(centroids, block.kind, block.data, block.tree, dims)
    if rows.dtype == object:
        return totals.add(number, rows)
    before = np.concatenate((np.zeros((1, dims), np.int64), np.cumsum(rows, 0)))
    return totals.add(number, before[last] - before[first], last - first)


def lloyd(blocks: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids (Python's integers) after so many rounds over the blocks; empty ones stay where they are."""
    spark = blocks.sparkSession
    k, dims = centroids.shape
    over = blocks.select("kind", "data", "tree").rdd
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(Centroids(centroids))
        totals = over.treeAggregate(Totals(k, dims), lambda t, block, sent=sent: _added(t, sent.value, block, dims), lambda a, b: a.merge(b))
        sent.unpersist()
        centroids = totals.means(centroids)
    return centroids


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster and squared distance of every vector of the blocks."""
    dims = centroids.shape[1]
    sent = blocks.sparkSession.sparkContext.broadcast(Centroids(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, kind, data, tree in zip(*(batch.column(i) for i in range(4)), strict=True):
                rows, first, last, number = _dealt(sent.value, kind.as_py(), data.as_py(), tree.as_py(), dims)
                order = np.argsort(first)
                cluster = np.repeat(number[order], (last - first)[order])
                entries = sent.value.entries
                if rows.dtype == object or entries.near is None:
                    step = integers(rows) - integers(entries.values)[cluster]
                    distance = (step * step).sum(1)
                else:
                    place = np.zeros(len(entries.values), np.int64)
                    place[entries.near] = np.arange(len(entries.near))
                    distance = _squared(rows, entries.small[place[cluster]])
                yield pa.record_batch([ids.values, pa.array(cluster.astype(np.int32)), longs(distance)], names=["id", "cluster", "distance"])

    return blocks.select("ids", "kind", "data", "tree").mapInArrow(run, "id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", key: str = "vec_id", column: str = "embedding", dims: int = 64, scale: int = 1024) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every row that takes part.

    Components become floor(scale * x). Rows with a null key, a vector of another length than `dims`, or one with a null
    or non-finite component take no part; other columns are ignored. The first centroids are the rows of the k smallest
    sha256 of `seed:key` (repeated keys by their vectors' order; fewer rows give fewer centroids). Equal distances go to
    the smaller number; a centroid without vectors stays. Repeated rows count, and are returned, each. Distances and sums
    beyond a long are the greatest long. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    lean(spark)
    rows = staged(whole_vectors(vectors.select(F.col(key).alias("id"), F.col(column).alias("x")), "id", "x", dims, scale), "vectors")
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "v").limit(k).collect()
    names = ("cluster_inertia", "inertia", "centroid_sha256")
    if not first:
        return rows.select(F.col("id").alias(key), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", *names[:2])], F.lit("").alias(names[2]))
    blocks = staged(grown(rows, dims), "blocks")
    centroids = lloyd(blocks, integers(np.array([r["v"] for r in first], float)), rounds)
    found = staged(assigned(blocks, centroids), "assigned")
    sums = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    inertia = min(LONG, sum(sums.values()))
    told = [(c, min(LONG, total), inertia, hashlib.sha256(joined(centroids[c]).encode()).hexdigest()) for c, total in sums.items()]
    of = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select(F.col("id").alias(key), "cluster", "distance", *names)
