"""MinHash near-duplicate detection with sequential Bayesian verification.

Texts with the same words collapse first. Every remaining text gets 128 min-hashes of its 5-word shingles in 32 bands
of four; texts that share a band are candidates. A candidate's signatures are compared batch by batch, and it is
dropped as soon as the posterior probability that its similarity reaches the threshold falls under the chosen miss
probability. What is left is verified on the full shingle sets.

A band shared by many texts never gives all of its pairs: each text is first compared with one pivot of the band and
links are closed to components, a few times with other pivots for the texts of other components. Only texts of a band
that are still in different components are compared further, in blocks of bounded size. No band, partner or candidate
is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import groups, lean, pieces, staged, strings
from .components import components

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
BATCH = 32
MISS = 1e-5
#: Texts in a block of the verification, about, and rounds of pivots.
BLOCK = 4_096
ROUNDS = 2
#: Texts of a band in a block, where components meet.
SPAN = 1024
#: Ids that may be broadcast to thin the texts before they are shuffled; more are joined by shuffling.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(11)
_MULTIPLY = (_rng.integers(0, 2**31, HASHES) * 2 + 1).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, HASHES).astype(np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of min-hashes for each non-empty set."""
    h = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(h * _MULTIPLY[k] + _ADD[k], at)
    return out


@lru_cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For 32, 64, ... compared hashes, the fewest equal ones with P(similarity >= threshold | equal ones) >= miss, under a uniform prior."""
    grid = np.linspace(0.0005, 0.9995, 1000)
    found = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        logs = m * np.log(grid) + (n - m) * np.log(1 - grid)
        p = np.exp(logs - logs.max(1, keepdims=True))
        above = p[:, grid >= threshold].sum(1) / p.sum(1)
        found.append(int(np.argmax(above >= miss)))
    return tuple(found)


def likely(one: np.ndarray, two: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Indexes of the rows of two signature tables that no batch rules out."""
    alive, equal = np.arange(len(one)), np.zeros(len(one), np.int64)
    for i, least in enumerate(least_matches(threshold, miss)):
        part = slice(i * BATCH, (i + 1) * BATCH)
        equal = equal + (one[alive, part] == two[alive, part]).sum(1)
        keep = equal >= least
        alive, equal = alive[keep], equal[keep]
    return alive


def described(docs: DataFrame) -> DataFrame:
    """doc_id, number of distinct shingles, two hashes of the word sequence, the signature and its bands (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            words, offsets = S.word_hashes(strings(batch.column(1)))
            one, two = S.sequence_hashes(words, offsets)
            found, at = S.shingle_hashes(words, offsets)
            first: dict[tuple[int, int], int] = {}
            sets: list[np.ndarray] = []
            which = []
            for k, key in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                if at[k] == at[k + 1]:
                    which.append(-1)
                    continue
                if key not in first:
                    first[key] = len(sets)
                    sets.append(np.unique(found[at[k] : at[k + 1]]))
                which.append(first[key])
            table = signatures(sets) if sets else np.zeros((0, HASHES), np.uint32)
            rows, bands = [x.tobytes() for x in table], list(band_keys(table))
            yield pa.record_batch(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([len(sets[i]) if i >= 0 else 0 for i in which], pa.int64()),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    pa.array([rows[i] if i >= 0 else None for i in which], pa.binary()),
                    pa.array([bands[i] if i >= 0 else None for i in which], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "h1", "h2", "signature", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, signature binary, bands array<long>")


def _signature_array(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def band_keys(table: np.ndarray) -> np.ndarray:
    """A hash of each band of each row of a signature table, with the band's place in it."""
    parts = table.reshape(len(table), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for i in range(ROWS):
        h = S.mixed(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i] + np.uint64(1))
    return h.view(np.int64)


def _sized(a: str, b: str, threshold: float):
    return F.least(a, b) >= F.greatest(a, b) * F.lit(threshold)


def _pruned(pairs: DataFrame, texts: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Those of the pairs (a, b) whose signatures leave them likely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                keep = pa.array(likely(_signature_array(x.column(2)), _signature_array(x.column(3)), threshold, miss))
                yield pa.record_batch([x.column(0).take(keep), x.column(1).take(keep)], names=["a", "b"])

    one = texts.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _placed(df: DataFrame, labels: DataFrame) -> DataFrame:
    """df with the component of its doc_id: its own id where it has no link."""
    return df.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _starred(shared: DataFrame, labels: DataFrame, threshold: float, salt: int) -> DataFrame:
    """Pairs (a, b) of the texts of each band with a pivot of it that is of another component."""
    rows = staged(_placed(shared, labels), "placed")
    by = F.xxhash64("doc_id", "band", F.lit(salt))
    pivots = rows.groupBy("band").agg(F.min_by("doc_id", by).alias("pivot"), F.min_by("n_shingles", by).alias("size"), F.min_by("component", by).alias("theirs"), F.min("component").alias("low"), F.max("component").alias("high"))
    rows = rows.join(pivots.filter("low <> high").drop("low", "high"), "band").filter((F.col("component") != F.col("theirs")) & _sized("size", "n_shingles", threshold))
    return rows.select(F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")).distinct()


def _across(texts: DataFrame, shared: DataFrame, labels: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Likely pairs of texts that share a band but are in different components, as rows (block_a, block_b, a[], b[]).

    A band's texts are its largest component and the others; each part is cut into blocks of about SPAN. Blocks of others
    meet one another and those of the largest component, whose own pairs need no look. So a band of one large component
    and a few others costs one copy of each row. Each pair of blocks is one bounded group. A pair is judged in the first
    band that it shares only.
    """
    banded = staged(_placed(shared, labels), "placed")
    parts = banded.groupBy("band", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("band").agg(F.sum("n").alias("m"), F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("top"))
    mixed = mixed.filter("parts > 1 and m > 2").select("band", F.col("top.component").alias("largest"), F.ceil(F.col("top.n") / SPAN).alias("inner"), F.ceil((F.col("m") - F.col("top.n")) / SPAN).alias("outer"))
    rows = banded.join(staged(mixed, "mixed"), "band")
    inside = F.col("component") == F.col("largest")
    rows = rows.withColumn("own", F.when(inside, F.col("outer") + F.pmod(F.xxhash64("doc_id", F.lit(3)), "inner")).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(3)), "outer")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(inside, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)))
    rows = rows.select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "at", "own", "doc_id")
    rows = staged(_placed(rows, labels), "across")
    carried = texts.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n_shingles", "signature")
    n = max(1, rows.select("doc_id").count() // 20_000)
    rows = rows.join(carried, "doc_id").select("band", "low", "high", "at", "own", "doc_id", "component", "n_shingles", "signature")
    rows = rows.repartition(max(n, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "band", "low", "high").sortWithinPartitions("band", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), group in groups(batches, 3):
            at, own, ids, component, size = (group.column(i).to_numpy() for i in (3, 4, 5, 6, 7))
            signature = _signature_array(group.column(8))
            bands = signature.reshape(len(ids), BANDS, ROWS)
            found = []
            mine, theirs = np.flatnonzero(own == low), np.flatnonzero(own == high)
            for i in mine:
                k = theirs if low != high else theirs[theirs > i]
                k = k[(component[k] != component[i]) & (np.minimum(size[k], size[i]) >= threshold * np.maximum(size[k], size[i]))]
                if at[i]:
                    k = k[~(bands[k, : at[i]] == bands[i, : at[i]]).all(2).any(1)]
                if len(k):
                    k = k[likely(np.broadcast_to(signature[i], (len(k), HASHES)), signature[k], threshold, miss)]
                    if len(k):
                        found.append((np.full(len(k), i), k))
            if found:
                a, b = (ids[np.concatenate(x)] for x in zip(*found, strict=True))
                yield pa.record_batch([pa.array([np.minimum(a, b)], pa.list_(pa.int64())), pa.array([np.maximum(a, b)], pa.list_(pa.int64()))], names=["a", "b"])

    return rows.mapInArrow(run, "a array<long>, b array<long>")


def verified(pairs: DataFrame, docs: DataFrame, numerator: int, denominator: int, blocks: int) -> DataFrame:
    """The links among packed pairs (a[], b[]): denominator * intersection >= numerator * union, on the full shingle sets.

    Ids are dealt to `blocks` blocks by hash; each pair of blocks is a group that gets every text it needs once.
    """
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = (x.column(k).flatten().to_numpy() for k in (0, 1))
            if not len(a):
                continue
            ha, hb = (S.mixed(v.view(np.uint64)) % np.uint64(blocks) for v in (a, b))
            key = (ha * np.uint64(blocks) + hb).astype(np.int64)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0, [True])))
            parts = [order[p:q] for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
            lists = pa.list_(pa.int64())
            columns = [[a[p] for p in parts], [b[p] for p in parts], [np.unique(np.concatenate((a[p], b[p]))) for p in parts]]
            yield pa.record_batch([pa.array(key[order][cuts[:-1]]), *[pa.array(c, lists) for c in columns]], names=["key", "a", "b", "docs"])

    # Written first, so that no task runs two Python workers.
    packed = staged(staged(pairs, "likely").mapInArrow(cut, "key long, a array<long>, b array<long>, docs array<long>"), "pairs")
    needed = staged(packed.select("key", F.explode("docs").alias("doc_id")).distinct(), "needed")
    ids = staged(needed.select("doc_id").distinct(), "ids")
    texts = docs.select("doc_id", "text")
    texts = texts.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= BROADCAST_IDS else texts.join(ids, "doc_id", "left_semi")
    rows = needed.join(texts, "doc_id").select("key", F.lit(0).alias("kind"), "doc_id", "text", F.lit(None).cast("array<long>").alias("a"), F.lit(None).cast("array<long>").alias("b"))
    rows = rows.union(packed.select("key", F.lit(1), F.lit(None).cast("long"), F.lit(None).cast("string"), "a", "b"))
    rows = rows.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        now = None
        for whole in batches:
            for x in pieces(iter([whole]), "text", 1 << 20):
                texts = x.filter(pa.compute.equal(x.column(1), 0))
                fresh = S.shingle_sets(strings(texts.column(3))) if texts.num_rows else []
                ready = iter(zip(texts.column(2).to_pylist(), fresh, strict=True))
                found: tuple[list[int], list[int]] = ([], [])
                for i, (key, kind) in enumerate(zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)):
                    if key != now:
                        now, sets = key, {}
                    if kind == 0:
                        doc, own = next(ready)
                        sets[doc] = own
                        continue
                    for a, b in zip(x.column(4)[i].as_py(), x.column(5)[i].as_py(), strict=True):
                        one, two = sets[a], sets[b]
                        both = len(np.intersect1d(one, two, assume_unique=True))
                        if both and denominator * both >= numerator * (len(one) + len(two) - both):
                            found[0].append(a)
                            found[1].append(b)
                yield pa.record_batch([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = 0.75, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are ignored).

    Two documents are linked if their sets of 5-word shingles have at least this Jaccard similarity, in hundredths;
    component_id is the smallest doc_id reachable. Null or blank texts have no shingles and stay alone. Fewer than five
    words make one shingle. Repeated rows with one doc_id are one document and each gives a row; a row whose doc_id is
    null is linked with nothing, has a null component_id and is kept. An empty table gives an empty result.
    """
    lean(docs.sparkSession)
    numerator = round(100 * similarity)
    described_ = staged(described(docs), "described")
    full = described_.filter("n_shingles > 0 and doc_id is not null")
    firsts = staged(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("first")), "firsts")
    copies = full.select("doc_id", "n_shingles", "h1", "h2").join(firsts, ["h1", "h2"]).select("doc_id", "n_shingles", "first")
    heads = firsts.select(F.col("first").alias("doc_id")).distinct()
    texts = full.join(heads, "doc_id", "left_semi").select("doc_id", "n_shingles", "signature", "bands")
    if not full.groupBy("doc_id").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["doc_id"])
    texts = staged(texts, "texts")

    banded = texts.select("doc_id", "n_shingles", F.posexplode("bands").alias("at", "band"))
    several = staged(banded.groupBy("band").count().filter("count > 1").select("band"), "bands")
    shared = staged(banded.join(several, "band"), "shared")
    blocks = max(1, texts.count() // BLOCK)
    links = labels = None
    for salt in range(ROUNDS):
        pairs = _pruned(_starred(shared, labels if labels is not None else _none(texts), similarity, salt), texts, similarity, miss)
        fresh = staged(verified(pairs.select(F.array("a").alias("a"), F.array("b").alias("b")), docs, numerator, 100, blocks), "links")
        links = fresh if links is None else links.union(fresh)
        if labels is not None and fresh.isEmpty():
            break
        labels = components(links)

    more = staged(verified(_across(texts, shared, labels, similarity, miss), docs, numerator, 100, blocks), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    found = copies.join(labels.select(F.col("node").alias("first"), "component"), "first", "left").select("doc_id", "n_shingles", F.coalesce("component", "first").alias("component_id"))
    rest = described_.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _none(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component")).limit(0)


def deduplicated(docs: DataFrame, similarity: float = 0.75) -> DataFrame:
    """docs with one document of each group of near-duplicates, that of the smallest id.

    Rows that repeat a doc_id are one document and stay or go together; rows with a null doc_id stay.
    """
    gone = near_duplicates(docs, similarity).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
