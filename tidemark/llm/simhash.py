"""SimHash near-duplicates: exact tiled comparison of 64-bit fingerprints.

Equal fingerprints collapse first. Two that differ in at most `radius` bits agree in at least P - radius of P parts of
their bits; P grows with the number of fingerprints, so that those that share such parts stay few. Fingerprints that
share one are cut into tiles by their population counts, and two tiles meet if their counts differ by no more than the
radius; numpy's exclusive-or and bit counts compare all of a pair of tiles. So nothing within the radius is missed.

A block of fingerprints that share parts and fill many tiles is first linked to one pivot, round by round; tiles of it
meet only as far as components differ. A pair of tiles tells links that connect its components, not all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, lean, pieces, staged
from .components import components

WIDTH, SEED, BITS = 4, 42, 64
#: Fingerprints of a tile at most, and at least where tasks are small; those of the strips in which numpy compares tiles.
TILE, LEAST, STRIP = 4096, 512, 256
#: Bytes of a text that are hashed at once, about.
PIECE = 1 << 20
#: Fingerprints that share parts, on average, beyond which there is one part more.
SHARED = 4096
#: Rounds of pivots in blocks of many tiles.
ROUNDS = 2
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _hashed(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of `width` words, joined by single spaces."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]), ">u8")


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """The hashes of all shingles of a text (UTF-8), repeats included, by pieces of about a megabyte."""
    at, words, found = 0, [], False
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        words += text[at:end].lower().split()
        at = end
        if len(words) >= WIDTH:
            found = True
            yield _hashed(words, WIDTH)
            words = words[1 - WIDTH :]
    if words and not found:
        yield _hashed(words, len(words))


def fingerprint(text: bytes | None) -> int:
    """The bits that are set in over half of the text's shingle hashes; 0 without words."""
    counts, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text or b""):
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a long) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = np.array([fingerprint(x) for x in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint long")


def parts_for(n: int, radius: int) -> int:
    """The fewest parts for which fingerprints of random bits share those that agree with SHARED others at most, on average."""
    parts = radius + 1
    while parts < 2 * radius + 4 and n > SHARED << (BITS * (parts - radius) // parts):
        parts += 1
    return parts


def shared_keys(values: np.ndarray, radius: int, parts: int) -> np.ndarray:
    """For every choice of parts - radius of the parts, the fingerprints' bits in them."""
    cuts = np.linspace(0, BITS, parts + 1).astype(int)
    masks = [np.uint64(((1 << int(b - a)) - 1) << int(a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.stack([values & np.bitwise_or.reduce(c) for c in combinations(masks, parts - radius)], 1).view(np.int64)


def tile_links(a: np.ndarray, b: np.ndarray, component_a: np.ndarray, component_b: np.ndarray, radius: int, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places (i of a, k of b) of pairs within the radius that join all components which such pairs join.

    Both tiles are sorted by population count and compared strip by strip; strips whose counts differ by more than the
    radius are skipped, and of a tile with itself (same) one of two equal pairs of strips.
    """
    order_a, order_b = (np.argsort(np.bitwise_count(x), kind="stable") for x in (a, b))
    count_a, count_b = np.bitwise_count(a)[order_a].astype(int), np.bitwise_count(b)[order_b].astype(int)
    labels, both = np.unique(np.concatenate((component_a, component_b)), return_inverse=True)
    root = np.arange(len(labels))
    label_a, label_b = both[: len(a)], both[len(a) :]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(a), STRIP):
        mine = order_a[i : i + STRIP]
        first, last = np.searchsorted(count_b, [count_a[i] - radius, count_a[i : i + STRIP][-1] + radius + 1])
        for k in range(i if same else first, last, STRIP):
            theirs = order_b[k : k + STRIP]
            near = np.bitwise_count(a[mine][:, None] ^ b[theirs][None, :]) <= radius
            if same and i == k:
                np.fill_diagonal(near, False)
            for row in np.flatnonzero(near.any(1)).tolist():
                one, hit = mine[row], theirs[near[row]]
                joined, at = np.unique(root[label_b[hit]], return_index=True)
                new = joined != root[label_a[one]]
                if new.any():
                    found.append((np.full(int(new.sum()), one), hit[at[new]]))
                    root[np.isin(root, joined)] = root[label_a[one]]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _blocks(prints: DataFrame, radius: int, parts: int) -> DataFrame:
    """choice, bits, node for each choice of parts and each fingerprint (node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            keys = shared_keys(values.view(np.uint64), radius, parts)
            n = keys.shape[1]
            yield pa.record_batch([pa.array(np.tile(np.arange(n, dtype=np.int32), len(values))), pa.array(keys.ravel()), pa.array(np.repeat(values, n))], names=["choice", "bits", "node"])

    return prints.mapInArrow(run, "choice int, bits long, node long")


def _placed(large: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with the component of their node: the node itself where it has no link."""
    return staged(large.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")


def _starred(rows: DataFrame, radius: int, salt: int) -> DataFrame:
    """Links (a, b) of the fingerprints of each large block with a pivot of it."""
    by = F.xxhash64("node", "choice", F.lit(salt))
    pivots = rows.groupBy("choice", "bits").agg(F.min_by("node", by).alias("pivot"), F.min_by("component", by).alias("theirs"))
    near = F.bit_count(F.col("node").bitwiseXOR(F.col("pivot"))) <= radius
    return rows.join(pivots, ["choice", "bits"]).filter(near & (F.col("component") != F.col("theirs"))).select(F.col("node").alias("a"), F.col("pivot").alias("b"))


def _tiles(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """Rows of large blocks, once for every pair of tiles (low, high) that may hold links between components.

    A tile holds fingerprints of one population count, and either of the block's largest component or of the others. Two
    tiles of the largest component don't meet, nor do those whose counts differ by more than the radius.
    """
    rows = rows.withColumn("ones", F.bit_count("node"))
    parts = rows.groupBy("choice", "bits", "component").agg(F.count("*").alias("n")).groupBy("choice", "bits")
    top = staged(parts.agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("several")).filter("several > 1").select("choice", "bits", F.col("top.component").alias("largest")), "largest")
    rows = rows.join(top, ["choice", "bits"]).withColumn("inside", F.col("component") == F.col("largest")).drop("largest")
    sizes = staged(rows.groupBy("choice", "bits", "inside", "ones").agg(F.ceil(F.count("*") / F.lit(tile)).alias("tiles")), "sizes")
    # At most 130 rows a block: each of its kinds of tile, with those that it meets.
    met = sizes.select("choice", "bits", F.col("inside").alias("inside_"), F.col("ones").alias("ones_"), F.col("tiles").alias("tiles_"))
    met = sizes.join(met, ["choice", "bits"]).filter((F.abs(F.col("ones") - F.col("ones_")) <= radius) & ~(F.col("inside") & F.col("inside_")))
    met = met.groupBy("choice", "bits", "inside", "ones", "tiles").agg(F.collect_list(F.struct("inside_", "ones_", "tiles_")).alias("met"))
    rows = rows.join(staged(met, "met"), ["choice", "bits", "inside", "ones"])

    def code(inside, ones, number):
        return (F.when(inside, 65).otherwise(0) + ones).cast("long") * F.lit(1 << 32) + number

    rows = rows.withColumn("own", code(F.col("inside"), F.col("ones"), F.pmod(F.xxhash64("node", F.lit(5)), "tiles")))
    others = F.flatten(F.transform("met", lambda m: F.transform(F.sequence(F.lit(0).cast("long"), m["tiles_"] - 1), lambda t: code(m["inside_"], m["ones_"], t))))
    rows = rows.select("choice", "bits", "node", "component", "own", F.explode(others).alias("other"))
    return rows.select("choice", "bits", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") == F.col("low")).alias("first"), "node", "component")


def _compared(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of pairs of tiles: rows choice, bits, low, high, first, node, component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, low, high), group in groups(batches, 4):
            if group.num_rows < 2:
                continue
            first, node, component = (group.column(i).to_numpy() for i in (4, 5, 6))
            one, two = np.flatnonzero(first), np.flatnonzero(first if low == high else ~first)
            value = node.view(np.uint64)
            i, k = tile_links(value[one], value[two], component[one], component[two], radius, bool(low == high))
            if len(i):
                yield pa.record_batch([pa.array(node[one[i]]), pa.array(node[two[k]])], names=["a", "b"])

    key = ("choice", "bits", "low", "high")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(rows.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long"), "links")


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints (one column of longs) that connect all that differ in at most `radius` bits."""
    spark = prints.sparkSession
    n = prints.count()
    parts = parts_for(n, radius)
    blocks = staged(_blocks(prints, radius, parts), "blocks")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tile = max(LEAST, min(TILE, 2 * n * comb(parts, radius) // tasks))
    sizes = staged(blocks.groupBy("choice", "bits").count().filter("count > 1"), "sizes")
    small = blocks.join(sizes.filter(F.col("count") <= tile).select("choice", "bits"), ["choice", "bits"], "left_semi")
    zero = F.lit(0).cast("long")
    found = _compared(small.select("choice", "bits", zero.alias("low"), zero.alias("high"), F.lit(True).alias("first"), "node", F.col("node").alias("component")), radius)
    large = sizes.filter(F.col("count") > tile).select("choice", "bits")
    if large.isEmpty():
        return found
    large = staged(blocks.join(large, ["choice", "bits"], "left_semi"), "large")
    rows = _placed(large, components(found))
    for salt in range(ROUNDS):
        fresh = staged(_starred(rows, radius, salt), "links")
        if fresh.isEmpty():
            break
        found = found.union(fresh)
        rows = _placed(large, components(found))
    return found.union(_compared(_tiles(rows, radius, tile), radius))


def simhash_near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs (doc_id, text; other columns are ignored).

    Two documents are linked if their fingerprints differ in at most `radius` bits; component_id is the smallest doc_id
    reachable. Texts that are null, or without words, have the fingerprint zero and are linked like any other; fewer than
    four words make one shingle. Repeated rows each give a row; rows of one doc_id with several texts are several
    documents, each of which has the component of its own fingerprint. A row whose doc_id is null is linked with nothing
    and has a null component_id. An empty table gives an empty result.
    """
    if not 0 <= radius < BITS // 4:
        raise ValueError(f"a radius of {radius} bits leaves too few bits that agree")
    lean(docs.sparkSession)
    described = staged(fingerprints(docs), "fingerprints")
    heads = staged(described.filter("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("head")), "heads")
    labels = components(links(heads.select("fingerprint"), radius)).select(F.col("node").alias("fingerprint"), "component")
    heads = staged(heads.join(labels, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint")), "heads")
    least = heads.groupBy("component").agg(F.min("head").alias("component_id"))
    known = staged(heads.join(least, "component").select("fingerprint", "component_id"), "known")
    found = described.filter("doc_id is not null").join(known, "fingerprint").select("doc_id", "fingerprint", "component_id")
    rest = described.filter("doc_id is null").select("doc_id", "fingerprint", F.lit(None).cast("long").alias("component_id"))
    return found.union(rest).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
