"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A part's features are the hashed 4- to 8-grams of its lower-cased bytes: that one is there, there twice, there three times.
Each feature is scaled by the log ratio of its smoothed frequencies among the parts of the two classes, and a logistic
regression is trained on the scaled features. A text is as toxic as its worst part.

The counts and the features of the labelled texts are made in tasks; the driver gets the features that tell something,
whose number the hash bounds, and of each text in the sample a bounded number of parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, lean, pieces, staged, strings

GRAMS, BITS, LEVELS = (4, 5, 6, 7, 8), 20, 3
#: Labelled rows that are used in training, about: toxic ones and others.
TOXIC_SAMPLE, OTHER_SAMPLE = 5_000, 10_000
#: Parts of a text that are kept in training, those of the highest sums of ratios.
PARTS = 8
#: Features whose log-count ratio is nearer to 0, or that are in fewer parts, tell nothing and are left out.
LEAST_RATIO, LEAST_COUNT = 2.0, 4
#: Added to each count, and what a toxic text counts in training, against 1 of another.
SMOOTH, WEIGHT = 1.0, 16.0
#: Bytes of a part, about.
STRETCH = 1_024


def _hashed(raw: np.ndarray) -> np.ndarray:
    """The hashed n-grams of some bytes, with repetitions."""
    out = []
    b = raw.astype(np.uint32) + np.uint32(1)
    h = b * np.uint32(0x9E3779B1)
    for n in range(2, GRAMS[-1] + 1):
        if len(raw) < n:
            break
        h = (h[: len(raw) - n + 1] ^ (h[: len(raw) - n + 1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + b[n - 1 :] * np.uint32(0xC2B2AE3D)
        if n in GRAMS:
            out.append(((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class Present:
    """The distinct features of the parts of whole texts; with `known` (a mark for each feature), only those that it marks."""

    def __init__(self, known: np.ndarray | None = None) -> None:
        self._known = known
        self._any = None if known is None else known.reshape(LEVELS, -1).any(0)
        self._last = np.zeros(1 << BITS, np.int32)

    def __call__(self, text: str) -> list[np.ndarray]:
        """An array for each part of equal length, about STRETCH bytes; one for an empty text."""
        raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
        size = -(-len(raw) // max(1, round(len(raw) / STRETCH))) if len(raw) else 1
        found = []
        for i in range(0, max(1, len(raw)), size):
            h = _hashed(raw[i : i + size + GRAMS[-1] - 1])
            if self._any is not None:
                h = h[self._any[h]]
            levels = []
            for k in range(LEVELS):
                at = np.arange(len(h), dtype=np.int32)
                self._last[h] = at
                last = self._last[h] == at
                levels.append(h[last].astype(np.int32) + np.int32(k << BITS))
                h = h[~last]
            own = np.concatenate(levels)
            found.append(own if self._known is None else own[self._known[own]])
        return found


@dataclass
class Toxicity:
    features: np.ndarray
    weights: np.ndarray  # of each feature: its log-count ratio times its coefficient
    offset: float
    _dense: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_dense": None}

    def score(self, text: str) -> float:
        if self._dense is None:
            weights = np.zeros(LEVELS << BITS, np.float32)
            weights[self.features] = self.weights
            self._dense = weights, Present(weights != 0)
        weights, present = self._dense
        worst = max(float(weights[p].sum(dtype=np.float64)) for p in present(text))
        return float(1 / (1 + np.exp(-np.clip(worst + self.offset, -40, 40))))


def train(features: np.ndarray, ratio: np.ndarray, texts: list[list[np.ndarray]], labels: np.ndarray, epochs: int = 30, decay: float = 1e-3, batch: int = 8, seed: int = 5) -> Toxicity:
    """Logistic regression on the scaled features (ascending, with their ratios) of each text's parts, by AdaGrad."""
    y = np.asarray(labels, np.float64)
    n = [max(1.0, float((y == k).sum())) for k in (0, 1)]
    offset = float(np.log(n[1] / n[0])) if len(y) else 0.0
    coefficient, squares, square = np.zeros(len(features)), np.full(len(features), 1e-3), 1.0
    rows = [[np.searchsorted(features, p) for p in parts] for parts in texts]
    rng = np.random.default_rng(seed)
    for _ in range(epochs if 0 < y.sum() < len(y) else 0):
        order = rng.permutation(len(y))
        for begin in range(0, len(y), batch):
            chosen = order[begin : begin + batch]
            # The worst part stands for the text, as in scoring.
            scaled = ratio * coefficient
            parts = [max(rows[i], key=lambda p: scaled[p].sum()) if len(rows[i]) > 1 else rows[i][0] for i in chosen]
            at = np.concatenate(parts)
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            z = np.bincount(owner, scaled[at], len(parts)) + offset
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[chosen]) * np.where(y[chosen] > 0, WEIGHT, 1.0)
            own, of = np.unique(at, return_inverse=True)
            step = np.bincount(of, g[owner] * ratio[at], len(own)) + decay * np.bincount(of, minlength=len(own)) * coefficient[own]
            squares[own] += step * step
            coefficient[own] -= 0.02 * step / np.sqrt(squares[own])
            square += float(g.sum()) ** 2
            offset -= 0.05 * float(g.sum()) / np.sqrt(square)
    return Toxicity(features, (ratio * coefficient).astype(np.float32), offset)


def _examples(docs: DataFrame, labels: DataFrame, toxic: int, others: int) -> DataFrame:
    """text, y of about `toxic` and `others` rows of either label, chosen by a hash of the id; equal texts count once.

    An id with several labels counts as toxic if one says so; of several texts for an id the least counts.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("y"))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, bound / max(1, n.get(y, 0))) for y, bound in ((True, toxic), (False, others))}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003))
    chosen = known.filter(drawn < F.when(F.col("y"), F.lit(int(1_000_003 * share[True]))).otherwise(F.lit(int(1_000_003 * share[False]))))
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return staged(texts.groupBy("text").agg(F.max("y").alias("y")).select("text", "y", F.xxhash64("text").alias("place")), "examples")


def _counted(examples: DataFrame) -> DataFrame:
    """feature, n0, n1: the parts of either label that have each feature; under feature -1 all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = Present()
        counts, total = np.zeros((2, LEVELS << BITS), np.int32), [0, 0]
        for x in pieces(batches, "text"):
            for text, y in zip(strings(x.column(0)), x.column(1).to_pylist(), strict=True):
                for part in present(text):
                    counts[int(y), part] += 1
                    total[int(y)] += 1
        at = np.flatnonzero(counts.any(0))
        for i in range(0, len(at), 100_000):
            own = at[i : i + 100_000]
            yield pa.record_batch([pa.array(own.astype(np.int64)), *(pa.array(counts[k, own].astype(np.int64)) for k in (0, 1))], names=["feature", "n0", "n1"])
        yield pa.record_batch([pa.array([-1], pa.int64()), *(pa.array([t], pa.int64()) for t in total)], names=["feature", "n0", "n1"])

    return examples.select("text", "y").mapInArrow(run, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_SAMPLE, others: int = OTHER_SAMPLE) -> Toxicity:
    """Train on about `toxic` and `others` rows of labels (doc_id, toxic) and the whole texts of docs (doc_id, text).

    Rows without label or text are left out. Without rows of both labels, all texts score alike.
    """
    lean(docs.sparkSession)
    examples = _examples(docs, labels, toxic, others)
    counts = staged(_counted(examples), "counts")
    total = counts.filter("feature = -1").first()
    n = [total[k] if total else 0 for k in ("n0", "n1")]
    ratio = F.log((F.col("n1") + SMOOTH) / (max(1, n[1]) + 2 * SMOOTH)) - F.log((F.col("n0") + SMOOTH) / (max(1, n[0]) + 2 * SMOOTH))
    known = counts.filter((F.col("feature") >= 0) & (F.col("n0") + F.col("n1") >= LEAST_COUNT)).select("feature", ratio.alias("ratio")).filter(F.abs("ratio") >= LEAST_RATIO).toPandas().sort_values("feature")
    features, ratios = known.feature.to_numpy(np.int64), known.ratio.to_numpy(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.zeros(LEVELS << BITS, np.float32)
        scale[features] = ratios
        present = Present(scale != 0)
        for x in pieces(batches, "text"):
            rows = [sorted(present(t), key=lambda p: -float(scale[p].sum()))[:PARTS] for t in strings(x.column(1))]
            yield pa.record_batch([x.column(0), pa.array([[p.tolist() for p in r] for r in rows], pa.list_(pa.list_(pa.int32()))), x.column(2)], names=["place", "parts", "y"])

    rows = examples.select("place", "text", "y").mapInArrow(run, "place long, parts array<array<int>>, y boolean").collect()
    rows = sorted(rows, key=lambda r: (r.place, r.y))
    return train(features, ratios, [[np.array(p, np.int64) for p in r.parts] for r in rows], np.array([r.y for r in rows], bool))


def score(docs: DataFrame, model: Toxicity, key: str = "doc_id") -> DataFrame:
    """key, score (0 to 1) for every row of docs (key, text); a null text scores as an empty one. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches, "text"):
            yield pa.record_batch([x.column(0), pa.array([model.score(t) for t in strings(x.column(1))], pa.float64())], names=[key, "score"])

    lean(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, score double")


def toxicity_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learned only where crc32(doc_id) mod 3 isn't 1.

    A null text scores as an empty one; a null doc_id is never held out; repeated rows give a row each; other columns of
    either table are ignored; an empty docs gives an empty result, and without labels of both kinds all texts score alike.
    """
    model = fit(docs, labels.filter(crc32_mod("doc_id", 3) != 1))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
