"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted verification.

A benchmark item and a window of a document are bags of 5-word shingles. Items are sorted into classes of like size, and
for each class every document is covered by windows of that size, a few words apart. A window's and an item's 64-bit
SimHash are compared through four blocks of 16 bits: fingerprints within RADIUS differ by at most RADIUS // 4 bits in
one block at least, so looking up each block with that many bits changed finds all of them. What is found is verified
by the exact weighted Jaccard similarity of the two bags, over all alignments of the item near the window.

Tasks shingle the benchmark. It is searched in blocks of bounded size: a few are sent to the tasks for a pass over the
documents, whose finds are written before these blocks are released and the next ones made, so the driver never holds
more than PASS + 1 of them. A worker keeps the index of a block for its next tasks. Documents are never shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import lean, pieces, staged, strings

BITS, BLOCKS, RADIUS = 64, 4, 15
SIMILARITY = 0.75
#: Items of one index, and their shingles, at most (one item at least); indexes that are searched in one pass.
ITEMS, SHINGLES, PASS = 4_096, 1 << 20, 4
#: Ratio of the sizes within a class, and windows of a class that begin within one window's length.
SPREAD, STEPS = 1.25, 8
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def fingerprints(totals: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash from the number of set bits of each of the 64 places and the number of shingles."""
    return np.packbits(totals > (counts // 2).astype(totals.dtype)[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _summed(x: np.ndarray, width: int) -> np.ndarray:
    """The sums of each `width` rows that follow one another, by doubling."""
    out, power, span, done = None, x, 1, 0
    while True:
        if width & span:
            part = power[done:]
            out = part.copy() if out is None else out[: len(part)] + part[: len(out)]
            done += span
        span *= 2
        if span > width:
            return out
        power = power[: len(power) - span // 2] + power[span // 2 :]


def bits_of(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


@dataclass
class _Class:
    size: int
    step: int
    items: np.ndarray
    prints: np.ndarray
    starts: list[np.ndarray] = field(default_factory=list)  # for each block, 65,537 places in `lists`
    lists: list[np.ndarray] = field(default_factory=list)


class Index:
    """The multi-index of one block of items: (id, shingle hashes in order)."""

    def __init__(self, items: list[tuple[int, np.ndarray]], radius: int = RADIUS):
        self.ids = [i for i, _ in items]
        self.shingles = [s for _, s in items]
        self.bags = [Counter(s.tolist()) for _, s in items]
        self.radius = radius
        self.classes: list[_Class] = []
        masks = [sum(1 << b for b in c) for n in range(radius // BLOCKS + 1) for c in combinations(range(16), n)]
        variants = np.array(masks, np.uint16)
        order = sorted(range(len(items)), key=lambda i: len(items[i][1]))
        while order:
            least = len(self.shingles[order[0]])
            own = [i for i in order if len(self.shingles[i]) <= max(least, int(least * SPREAD))]
            order = order[len(own) :]
            size = (least + len(self.shingles[own[-1]]) + 1) // 2
            prints = np.concatenate([fingerprints(bits_of(self.shingles[i]).sum(0, keepdims=True, dtype=np.int64), np.array([len(self.shingles[i])])) for i in own])
            c = _Class(size, max(1, size // STEPS), np.array(own), prints)
            for b in range(BLOCKS):
                keys = (((prints >> np.uint64(16 * b)).astype(np.uint16))[:, None] ^ variants).ravel()
                at = np.argsort(keys, kind="stable")
                c.starts.append(np.concatenate(([0], np.cumsum(np.bincount(keys, minlength=1 << 16)))))
                c.lists.append((at // len(variants)).astype(np.int32))
            self.classes.append(c)

    def near(self, c: _Class, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (place in prints, place in the class's items) whose fingerprints are within the radius."""
        rows, items = [], []
        for b in range(BLOCKS):
            key = (prints >> np.uint64(16 * b)).astype(np.uint16).astype(np.int64)
            n = c.starts[b][key + 1] - c.starts[b][key]
            row = np.repeat(np.arange(len(prints)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(c.starts[b][key], n)
            item = c.lists[b][at]
            close = np.bitwise_count(prints[row] ^ c.prints[item]) <= self.radius
            rows.append(row[close])
            items.append(item[close])
        found = np.unique(np.concatenate(rows) * len(c.items) + np.concatenate(items))
        return found // len(c.items), found % len(c.items)

    def matches(self, shingles: np.ndarray, offsets: np.ndarray, similarity: float) -> list[tuple[int, int, int, float]]:
        """(text, item, start shingle, similarity), the best alignment of each item that reaches the similarity in each text."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        if not len(shingles):
            return []
        bits = bits_of(shingles)
        for step in sorted({c.step for c in self.classes}):
            # Sums over runs of `step` shingles, then over the runs of each window.
            n = np.diff(offsets)
            runs = -(-n // step)
            first = np.concatenate(([0], np.cumsum(runs)))
            begins = np.repeat(offsets[:-1] - first[:-1] * step, runs) + np.arange(first[-1]) * step
            ends = np.repeat(offsets[1:], runs)
            widest = max(c.size for c in self.classes if c.step == step) + step
            kind = np.uint8 if widest < 256 else np.uint16 if widest < 1 << 16 else np.uint32
            sums = bits[begins].astype(kind)
            for k in range(1, step):
                inside = begins + k < ends
                sums[inside] += bits[(begins + k)[inside]]
            text = np.repeat(np.arange(len(n)), runs)
            for c in (c for c in self.classes if c.step == step):
                width = max(1, round(c.size / step))
                k = np.arange(max(0, len(begins) - width + 1))
                k = k[k + width <= first[text[k] + 1]]
                count = np.minimum(begins[k] + width * step, ends[k]) - begins[k]
                # A text with fewer runs than a window is one window, if it is long enough.
                short = np.flatnonzero((runs > 0) & (runs < width) & (n >= similarity * min(len(self.shingles[i]) for i in c.items)))
                totals = _summed(sums, width)[k] if len(k) else np.zeros((0, BITS), kind)
                if len(short):
                    totals = np.concatenate((totals, np.stack([bits[offsets[t] : offsets[t + 1]].sum(0, dtype=kind) for t in short])))
                    k, count = np.concatenate((k, first[short])), np.concatenate((count, n[short]))
                if not len(k):
                    continue
                prints = fingerprints(totals, count)
                rows, items = self.near(c, prints)
                for r, i in zip(k[rows].tolist(), c.items[items].tolist(), strict=True):
                    t = int(text[r])
                    score, at = self._aligned(shingles[offsets[t] : offsets[t + 1]], int(begins[r] - offsets[t]), i, 2 * step, similarity)
                    if score >= similarity and (score, -at) > best.get((t, i), (0.0, 0)):
                        best[t, i] = score, -at
        return [(t, i, -at, score) for (t, i), (score, at) in sorted(best.items())]

    def _aligned(self, own: np.ndarray, at: int, item: int, margin: int, similarity: float) -> tuple[float, int]:
        """The greatest weighted Jaccard similarity of the item and a window of its size that begins near `at`."""
        bag, size = self.bags[item], len(self.shingles[item])
        low, high = max(0, at - margin), min(max(0, len(own) - size), at + margin)
        near = own[low : max(high, low) + size].tolist()
        # Bags of n and m shingles are that similar only if they share s / (1 + s) of n + m.
        if sum(1 for h in near if h in bag) < (size + min(size, len(near))) * similarity / (1 + similarity) - 1e-9:
            return 0.0, 0
        best = 0.0, 0
        for k in range(max(high, low) - low + 1):
            window = Counter(near[k : k + size])
            both = sum(min(v, bag[h]) for h, v in window.items() if h in bag)
            best = max(best, (both / (size + sum(window.values()) - both), -(low + k)))
        return best[0], -best[1]


def _items(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Blocks of at most `block` items and SHINGLES shingles, of 5 words or more; equal texts are one item, of the smallest id."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches, "text"):
            found, at = S.shingle_hashes(*_enough(*S.word_hashes(strings(x.column(1)))))
            lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(found.view(np.int64)))
            rows = pa.table([x.column(0), lists.cast(pa.list_(pa.int64()))], names=["item_id", "shingles"])
            yield from rows.filter(pa.array(np.diff(at) > 0)).combine_chunks().to_batches()

    texts = benchmark.filter("text is not null and item_id is not null").groupBy("text").agg(F.min("item_id").cast("long").alias("item_id"))
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for r in texts.select("item_id", "text").mapInArrow(shingled, "item_id long, shingles array<long>").toLocalIterator():
        if held and (len(held) == block or size + len(r.shingles) > SHINGLES):
            yield sorted(held, key=lambda x: x[0])
            held, size = [], 0
        held.append((r.item_id, np.array(r.shingles, np.int64).view(np.uint64)))
        size += len(r.shingles)
    if held:
        yield sorted(held, key=lambda x: x[0])


#: The indexes that this worker built last, by radius and items.
_built: dict[tuple, Index] = {}


def _index(sent, radius: int) -> Index:
    items = sent.value
    key = radius, hash(tuple((i, s.tobytes()) for i, s in items))
    if key not in _built:
        while len(_built) >= PASS:
            del _built[next(iter(_built))]
        _built[key] = Index(items, radius)
    return _built[key]


FOUND = "doc_id long, item_id long, start_word long, n_words long, similarity double"


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, block: int = ITEMS) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: each benchmark item found in a document, at its best place.

    docs has doc_id and text, benchmark item_id and text; other columns are ignored. A null text matches nothing, nor does
    a document or an item of fewer than five words. Repeated rows of docs give repeated rows. Items with equal texts are
    one, the one of the smallest id. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    lean(spark)
    blocks = _items(benchmark, block)
    out, ahead = None, next(blocks, None)
    while ahead is not None:
        sent = [spark.sparkContext.broadcast(items) for items in (ahead, *islice(blocks, PASS - 1))]
        ahead = next(blocks, None)
        part = _searched(docs, sent, similarity, radius)
        if out is None and ahead is None:
            return part
        # What is found is written, so that no later task needs these blocks.
        part = staged(part, "leaks")
        for one in sent:
            one.destroy()
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], FOUND) if out is None else out


def _searched(docs: DataFrame, sent: list, similarity: float, radius: int) -> DataFrame:
    """One pass over the documents for the blocks of items that are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [_index(s, radius) for s in sent]
        for x in pieces(batches, "text", 1 << 20):
            found, at = S.shingle_hashes(*_enough(*S.word_hashes(strings(x.column(1)))))
            ids = x.column(0).to_pylist()
            for own in indexes:
                hits = own.matches(found, at, similarity)
                yield pa.record_batch(
                    [
                        pa.array([ids[t] for t, *_ in hits], pa.int64()),
                        pa.array([own.ids[i] for _, i, *_ in hits], pa.int64()),
                        pa.array([s for _, _, s, _ in hits], pa.int64()),
                        pa.array([len(own.shingles[i]) + S.WIDTH - 1 for _, i, *_ in hits], pa.int64()),
                        pa.array([v for *_, v in hits], pa.float64()),
                    ],
                    names=["doc_id", "item_id", "start_word", "n_words", "similarity"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def _enough(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words without those of texts that have fewer than five."""
    n = np.diff(offsets)
    keep = np.repeat(n >= S.WIDTH, n)
    return words[keep], np.concatenate(([0], np.cumsum(np.where(n >= S.WIDTH, n, 0))))


def decontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the documents in which a benchmark item is found; a null doc_id stays."""
    hit = contaminated(docs, benchmark, similarity).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
