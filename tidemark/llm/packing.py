"""Variable-capacity best-fit packing of token sequences into several permitted lengths.

A document longer than the greatest capacity is cut into pieces of that capacity and a rest. Pieces are packed longest
first: each goes to the open bin with the least room that holds it; if none does, a bin is opened. For each permitted
size that holds the piece, the bin is filled in thought with the longest waiting pieces that fit; the size whose contents
would cost least a token is opened. Packings that open one least size throughout are tried as well. Bins are downsized to
the smallest capacity that holds their contents, and the cheapest packing is kept.

Groups are stretches of a Spark partition, so packing needs no shuffle, no key can be hot, and memory is bounded.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, pieces, strings
from .tokens import default_path, encoder

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces that are packed together at most.
GROUP = 50_000


def default_cost(capacity: int) -> float:
    """Of one sequence: its tokens, their attention, and a fixed part."""
    return capacity * (1 + capacity / 16_384) + 32


class _Waiting:
    """The multiset of lengths that aren't packed yet."""

    def __init__(self, lengths: np.ndarray):
        distinct, count = np.unique(lengths, return_counts=True)
        self._lengths: list[int] = distinct.tolist()
        self._count = dict(zip(self._lengths, count.tolist(), strict=True))

    def remove(self, n: int) -> None:
        self._count[n] -= 1
        if not self._count[n]:
            del self._count[n], self._lengths[bisect_left(self._lengths, n)]

    def filled(self, room: int) -> int:
        """The tokens that the longest waiting pieces, each taken if it fits, would put into the room."""
        lengths, count, left = self._lengths, self._count, room
        k = bisect_right(lengths, left)
        while k:
            n = lengths[k - 1]
            left -= n * min(count[n], left // n)
            k = bisect_right(lengths, left, 0, k - 1)
        return room - left


def best_fit(lengths: np.ndarray, capacities: Sequence[int], least: int | None = None, cost=default_cost) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece and each bin's contents.

    Bins open at capacities[least] or the smallest that holds the piece; without `least`, at the size whose contents, filled
    up with waiting pieces and downsized, would cost least a token (of equal ones the smaller).
    """
    sizes = sorted(capacities)
    price = [cost(c) for c in sizes]
    bins = np.zeros(len(lengths), np.int64)
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    open_: dict[int, list[int]] = {}
    held: list[int] = []
    waiting = _Waiting(lengths) if least is None else None

    def opened(n: int) -> int:
        best = None
        for c in sizes[bisect_left(sizes, n) :]:
            content = n + waiting.filled(c - n)
            each = price[bisect_left(sizes, content)] / content
            if best is None or each < best[0]:
                best = each, c
        return best[1]

    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if waiting:
            waiting.remove(n)
        k = bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            b = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[k]
        else:
            room = opened(n) if waiting else sizes[max(least, bisect_left(sizes, n))]
            b = len(held)
            held.append(0)
        bins[i] = b
        held[b] += n
        room -= n
        if room:
            if room in open_:
                open_[room].append(b)
            else:
                open_[room] = [b]
                insort(rooms, room)
    return bins, np.array(held, np.int64)


def pack(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES, cost=default_cost) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece and each bin's capacity, for positive lengths up to the greatest capacity."""
    sizes = np.array(sorted(capacities))
    price = np.array([cost(int(c)) for c in sizes])
    best = None
    for least in (None, *range(len(sizes))):
        bins, held = best_fit(lengths, capacities, least, cost)
        fitted = np.searchsorted(sizes, held)
        total = float(price[fitted].sum())
        if best is None or total < best[0]:
            best = total, bins, sizes[fitted]
    return best[1], best[2]


def packed(docs: DataFrame, tokenizer: str | None = None, capacities: Sequence[int] = CAPACITIES, end: int = 1, group: int = GROUP, cost=default_cost) -> DataFrame:
    """A row for each piece of each document of docs (doc_id, text): doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_capacity.

    A document's tokens are those of its whole text (null: none) and `end`, so that every document has one piece at
    least. `start` is the piece's place in its document, `bin_offset` its place in the bin; bin_id is unique. Repeated
    rows are packed each on its own; other columns are ignored; an empty table gives no rows.
    """
    lean(docs.sparkSession)
    tokenizer = tokenizer or default_path()
    greatest = max(capacities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 36
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first
            if not held:
                return
            ids, place, start, size = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            bins, capacity = pack(size, capacities, cost)
            order = np.argsort(bins, kind="stable")
            ran = np.cumsum(size[order]) - size[order]
            begins = np.concatenate(([True], np.diff(bins[order]) != 0))
            ran -= np.repeat(ran[begins], np.diff(np.append(np.flatnonzero(begins), len(ran))))
            columns = [ids[order], place[order], start[order], size[order], first + bins[order], ran, capacity[bins[order]]]
            first += len(capacity)
            for i in range(0, len(order), 10_000):
                yield pa.record_batch([pa.array(c[i : i + 10_000], from_pandas=True) for c in columns[:1]] + [pa.array(c[i : i + 10_000]) for c in columns[1:]], schema=schema)

        count = 0
        for x in pieces(batches, "text", 1 << 20):
            n = np.array([len(e) + 1 for e in encoder(tokenizer)(strings(x.column(1)))], np.int64)
            parts = -(-n // greatest)
            ids = np.array([i for i in x.column(0).to_pylist()], object)
            place = np.concatenate([np.arange(p) for p in parts])
            start = place * greatest
            size = np.minimum(np.repeat(n, parts) - start, greatest)
            for i in range(0, len(place), group):
                held.append((np.repeat(ids, parts)[i : i + group], place[i : i + group], start[i : i + group], size[i : i + group]))
                count += len(held[-1][0])
                if count >= group:
                    yield from flush()
                    count = 0
        yield from flush()

    names = ("doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_capacity")
    schema = pa.schema([(n, pa.int64()) for n in names])
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))
