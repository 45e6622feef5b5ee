"""Language identification with a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows of the lower-cased text; each filter's maximum over
a window goes through a softmax layer. The network is trained in numpy on a bounded sample of labelled rows and applied
to every window of every text; a document's probabilities are the mean over its windows, weighted by their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, lean, pieces, staged, strings

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 16, 256
#: Labelled rows of each language that are used in training, about.
SAMPLE = 1_500
EPOCHS, SHARE = 8, 64
#: Languages whose counts may be broadcast; more are joined by shuffling.
LANGUAGES = 4_096
_WORD = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter: numerals such as a half, superscripts or Roman ones are none."""
    return text is not None and any(m.group().isalpha() for m in _WORD.finditer(text))


def windows(text: str, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Every window of a text's bytes, the last one filled with zeros, and the number of bytes in each."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    n = -(-len(raw) // length)
    out = np.zeros(n * length, np.uint8)
    out[: len(raw)] = raw
    size = np.full(n, length)
    if n:
        size[-1] = len(raw) - (n - 1) * length
    return out.reshape(n, length), size


@dataclass
class ByteNetwork:
    languages: list[str]
    filters: list[np.ndarray]  # for each width, (width, 256, filters)
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray
    _pairs: list | None = None

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def probabilities(self, batch: np.ndarray) -> np.ndarray:
        """(windows, languages). Two neighbouring bytes are looked up at once."""
        if self._pairs is None:
            self._pairs = [[(w[i][:, None] + w[i + 1][None]).reshape(65536, -1) if i + 1 < len(w) else w[i] for i in range(0, len(w), 2)] for w in self.filters]
        both = (batch[:, :-1].astype(np.int64) << 8) | batch[:, 1:]
        n, length = batch.shape
        tops = []
        for tables, bias, w in zip(self._pairs, self.biases, self.filters, strict=True):
            width = len(w)
            count = length - width + 1
            x = None
            for k, t in enumerate(tables):
                i = 2 * k
                at = both[:, i : i + count] if len(t) == 65536 else batch[:, i : i + count]
                y = t.take(at.ravel(), axis=0)
                x = y if x is None else np.add(x, y, out=x)
            tops.append(np.maximum(x.reshape(n, count, -1).max(axis=1) + bias, 0))
        return _softmax(np.concatenate(tops, axis=1) @ self.dense + self.offset)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and its probability for each text; ('und', 0.0) without any letter."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        held = [(i, *windows(t)) for i, t in enumerate(texts) if has_letter(t)]
        if not held or not self.languages:
            return out
        every, sizes = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        p = np.concatenate([self.probabilities(every[i : i + SHARE]) for i in range(0, len(every), SHARE)]) * sizes[:, None]
        at = np.cumsum([0, *(len(h[1]) for h in held)])
        total = np.add.reduceat(p, at[:-1], axis=0)
        for (i, *_), row in zip(held, total / total.sum(1, keepdims=True), strict=True):
            k = int(row.argmax())
            out[i] = self.languages[k], min(1.0, float(row[k]))
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(batch: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = 3) -> ByteNetwork:
    """Fit the network by Adam on (rows, WINDOW) bytes and their languages."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], np.int64)
    filters = [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in filters:
        w[:, 0] = 0
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    dense = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, max(1, len(languages)))).astype(np.float32)
    offset = np.zeros(max(1, len(languages)), np.float32)
    weights = [*filters, *biases, dense, offset]
    one, two = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs if len(languages) > 1 else 0):
        order = rng.permutation(len(y))
        for begin in range(0, len(y), SHARE):
            x, target = batch[order[begin : begin + SHARE]], y[order[begin : begin + SHARE]]
            n, length = x.shape
            tops, where = [], []
            for w, b in zip(filters, biases, strict=True):
                count = length - len(w) + 1
                v = sum(w[i][x[:, i : i + count]] for i in range(len(w)))
                at = v.argmax(axis=1)
                tops.append(np.take_along_axis(v, at[:, None], axis=1)[:, 0] + b)
                where.append(at)
            hidden = np.maximum(np.concatenate(tops, axis=1), 0)
            d = _softmax(hidden @ dense + offset)
            d[np.arange(n), target] -= 1
            d /= n
            back = (d @ dense.T) * (hidden > 0)
            grads: list[np.ndarray] = []
            for k, (w, at) in enumerate(zip(filters, where, strict=True)):
                g, own = np.zeros_like(w), back[:, k * FILTERS : (k + 1) * FILTERS]
                for i in range(len(w)):
                    np.add.at(g[i], (x[np.arange(n)[:, None], at + i], np.arange(FILTERS)[None]), own)
                g[:, 0] = 0
                grads.append(g)
            grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))] + [hidden.T @ d, d.sum(0)]
            step += 1
            for w, g, m, s in zip(weights, grads, one, two, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return ByteNetwork(languages, filters, biases, dense, offset)


def fit(docs: DataFrame, bound: int = SAMPLE, seed: int = 23) -> ByteNetwork:
    """Train on about `bound` rows of each language of docs (doc_id, text, lang), chosen by a hash.

    Of each chosen text one window is learned, at a place that a hash of the id chooses among all of the text. Texts that
    are null, blank or without language are left out. The counts of the languages are joined as a broadcast, so no text
    is shuffled and no language's rows meet in one task; only if there are more than LANGUAGES are windows shuffled.
    """
    known = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = staged(known.groupBy("lang").count(), "languages").select("lang", F.least(F.lit(1.0), F.lit(float(bound)) / F.col("count")).alias("share"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_003))
    begin = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.greatest(F.lit(1), F.length("text") - WINDOW + 1)).cast("int")
    window = F.substring("text", begin + 1, F.lit(WINDOW)).alias("text")
    if counts.count() <= LANGUAGES:
        rows = known.join(F.broadcast(counts), "lang").filter(drawn < F.col("share") * 1_000_003).select("lang", window)
    else:
        rows = known.select("lang", drawn.alias("drawn"), window).join(counts, "lang").filter(F.col("drawn") < F.col("share") * 1_000_003).select("lang", "text")
    rows = rows.filter(F.length(F.trim("text")) > 0)
    rows = sorted(rows.toPandas()[["lang", "text"]].itertuples(index=False, name=None))
    batch = np.zeros((len(rows), WINDOW), np.uint8)
    for i, (_, t) in enumerate(rows):
        raw = t.lower().encode("utf-8", "replace")[:WINDOW]
        batch[i, : len(raw)] = np.frombuffer(raw, np.uint8)
    return train(batch, [x for x, _ in rows])


def identify(docs: DataFrame, network: ByteNetwork, key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score for every row of docs (key, text): whole texts, every window.

    A null text, or one without any letter, is `und` with score 0. Extra columns are ignored; repeated rows give a row each.
    Without labelled rows to learn from, the network has no languages and all texts are `und`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches, "text", 1 << 20):
            found = network.predict_all(strings(x.column(1)))
            yield pa.record_batch([x.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[key, "lang_pred", "score"])

    lean(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, lang_pred string, score double")


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents whose crc32(doc_id) mod 4 isn't 2.

    A text that is null, empty or without a letter is `und` with score 0. A null doc_id is never held out; repeated rows
    give a row each; other columns are ignored; an empty table gives an empty result.
    """
    network = fit(docs.filter(crc32_mod("doc_id", 4) != 2))
    return identify(docs, network).select("doc_id", F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, network: ByteNetwork, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language the network knows: not `und`, and scored `least` or more.

    Rows with a null, empty or letterless text go; a null id or language changes nothing; repeated rows are each judged
    alike. An empty table, or a network without languages, gives an empty result.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches, "text", 1 << 20):
            found = network.predict_all(strings(x.column(at)))
            yield x.filter(pa.array([name != "und" and score >= least for name, score in found]))

    lean(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
