"""Quality: regularised quadratic discriminant analysis over transformed document statistics.

Counts, means and second moments of each class are Spark aggregates over all labelled rows. Each class gets a
covariance shrunk towards the pooled one and that towards a multiple of the identity; its Cholesky factor is kept, and a
document's score comes from the difference of the two Mahalanobis log-densities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, lean, pieces, staged, strings
from .shingles import _SPACE, hashes_of, word_spans

STATISTICS = ("words", "word_bytes", "upper", "symbols", "digits", "punctuation", "distinct", "top_word", "same_next", "distinct_pairs", "line_words", "distinct_lines", "ended")
TO_POOLED, TO_IDENTITY = 0.1, 0.02

_kind = np.zeros((4, 256), bool)
_kind[0, 65:91] = True
_kind[1, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_kind[2, 48:58] = True
_kind[3, [ord(c) for c in "!\"'(),-.:;?"]] = True


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of a whole text, one for each of STATISTICS; an empty text has fixed ones."""
    raw = text.encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    share = np.bincount(data, minlength=256) if len(data) else np.zeros(256)
    starts, ends = word_spans(data)
    n = len(starts)
    if not n:
        return np.zeros(len(STATISTICS))
    marks = max(1, len(data) - int(share[_SPACE].sum()))
    upper, symbols, digits, punctuation = (float(share[k].sum()) / marks for k in _kind)
    words = hashes_of([raw])[0]
    ordered = np.sort(words)
    fresh = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    distinct, top = len(fresh), int(np.diff(np.append(fresh, n)).max())
    same = int((words[1:] == words[:-1]).sum()) / max(1, n - 1)
    pairs = len(np.unique(words[1:] * np.uint64(0x9E3779B97F4A7C15) ^ words[:-1])) / (n - 1) if n > 1 else 1.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    last = data[ends - 1]
    root = np.sqrt
    return np.array(
        [
            np.log(n),
            np.log(float((ends - starts).mean())),
            root(upper),
            root(symbols),
            root(digits),
            root(punctuation),
            np.log((distinct + 1) / (n + 1)),
            root(top / n),
            root(same),
            np.log(pairs + 0.02),
            np.log(n / len(lines)),
            np.log(len(set(lines)) / len(lines)),
            root(float(np.isin(last, [33, 46, 63]).mean())),
        ]
    )


def described(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and x, the statistics of each whole text of docs (key, text); a null text counts as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches, "text"):
            yield pa.record_batch([x.column(0), pa.array([statistics(t) for t in strings(x.column(1))], pa.list_(pa.float64()))], names=[key, "x"])

    lean(docs.sparkSession)
    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, x array<double>")


@dataclass
class Discriminant:
    means: list[np.ndarray]
    inverses: list[np.ndarray]  # of the Cholesky factors
    constants: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        logs = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for m, w, c in zip(self.means, self.inverses, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -40, 40)))


def train(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """From each class's count (2), sums (2, d) and sums of products (2, d, d). A class without rows gets the pooled figures."""
    d = sums.shape[1]
    total = max(1.0, counts.sum())
    centre = sums.sum(0) / total
    spreads = [products[k] / counts[k] - np.outer(sums[k], sums[k]) / counts[k] ** 2 if counts[k] else np.zeros((d, d)) for k in (0, 1)]
    pooled = sum(c * s for c, s in zip(counts, spreads, strict=True)) / total
    means, inverses, constants = [], [], []
    for k in (0, 1):
        own = spreads[k] if counts[k] > 1 else pooled
        s = (1 - to_pooled) * own + to_pooled * pooled
        s = (1 - to_identity) * s + to_identity * np.diag(np.diag(pooled) + 1e-6)
        factor = np.linalg.cholesky(s + 1e-9 * np.eye(d))
        means.append(sums[k] / counts[k] if counts[k] else centre)
        inverses.append(np.linalg.inv(factor))
        constants.append(float(np.log((counts[k] + 1) / (total + 2)) - np.log(np.diag(factor)).sum()))
    return Discriminant(means, inverses, constants)


def fit(rows: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Discriminant:
    """From all labelled rows: `rows` has key and x, `labels` key and label (null: left out; several: the least counts)."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg((F.min(label) > 0).cast("int").alias("y"))
    d = len(STATISTICS)
    x = [F.col("x")[i] for i in range(d)]
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    found = rows.join(known, key).groupBy("y").agg(F.count("*").alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in upper]).alias("p")).collect()
    counts, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in found:
        counts[r.y], sums[r.y] = r.n, r.s
        for (i, j), v in zip(upper, r.p, strict=True):
            products[r.y, i, j] = products[r.y, j, i] = v
    return train(counts, sums, products)


def score(rows: DataFrame, model: Discriminant, key: str = "doc_id") -> DataFrame:
    """key, score (0 to 1) for every row of `rows` (key, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([b.column(0), pa.array(model.scores(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)))], names=[key, "score"])

    return rows.select(key, "x").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, score double")


def quality_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learned only where crc32(doc_id) mod 5 isn't 0.

    A null text scores as an empty one; a null doc_id is never held out; repeated rows give a row each; other columns of
    either table are ignored; an empty docs gives an empty result. A class without labels gets the other's figures.
    """
    rows = staged(described(docs), "statistics")
    model = fit(rows, labels.filter(crc32_mod("doc_id", 5) != 0))
    return score(rows, model).select("doc_id", F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
