"""Repeated passages by compact windows.

Tokens are 5-word shingles. Under a hash function, a token is the minimum of every subsequence that lies in the window up
to the next smaller hashes on both sides: its node in the Cartesian tree. So the windows of some length or more stand for
all subsequences of that length, and a subsequence's min-hash is the token of the one window that holds it and its minimum.

Windows of WIDTH tokens or more of the first function (one in six tokens) give signatures: the minimum and the AFTER tokens
after it. Two documents that share a run of WIDTH + AFTER tokens have an equal one; passages of distinct tokens with
similarity 0.75 always share such a run. Around the places of equal signatures, windows of a passage's length are made in
both documents for HASHES functions. An interval join takes those with equal minima and counts, for each subsequence of a
passage's length, the functions whose windows hold it in the one document and in the other. Where AGREE of them do, all
that a passage could reach is verified on its shingles.

Each signature meets one pivot document, the smallest id that has it, so a passage that many documents share costs a row
each and no pairs. Where the pivot has only a part of a passage, as of one that begins with a frequent line, windows stay
that no passage found with it covers. Around these, all runs of a passage's length are keys in turn: documents with an equal
one have that passage whatever their pivot, so no exact one is lost. A passage with changes goes on past a line that is too
short for one, or past its changes, to tokens that are equal again: so the windows on either side of a gap are keys with each
token within a passage's length. Documents with equal word sequences are one during the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles as S
from .common import lean, pieces, staged, strings

WORDS = 50
SIMILARITY = 0.75
WIDTH, AFTER = 11, 5
#: Hash functions of the interval join, and how many must agree: at similarity 0.75 a passage has AGREE equal min-hashes of
#: HASHES with a chance of 0.9996.
HASHES, AGREE = 8, 2
#: Tokens whose windows are made at once.
TOKENS = 1 << 17
#: Tokens that are verified on either side of a window, and the widest gap between windows of one passage.
REACH, GAP = 60, 40
#: Runs of equal tokens in a passage that isn't alike as a whole, and pivots of a run or of a window and a token, by its key.
RUNS, PIVOTS = 12, 4
#: Places of windows so far apart may have a change between them: it takes 4 tokens at least, and a window AFTER.
APART = AFTER + 5
#: Ids that may be broadcast to thin the texts before they are shuffled; more are joined by shuffling.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(41)
_SALTS = _rng.integers(1, 2**63, 16, dtype=np.uint64)
_PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_minima(tokens: np.ndarray, offsets: np.ndarray, salt: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of the minima of all runs of `width` tokens, ascending, over all texts; all tokens' hashes and texts.

    Of equal hashes the first counts as smaller.
    """
    n = len(tokens)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.arange(n, dtype=np.uint64)
    x = (S.mixed(tokens ^ _SALTS[salt]) & ~np.uint64((1 << 28) - 1)) | place
    if n < width:
        return np.zeros(0, np.int64), x, text
    low, span = x, 1
    while 2 * span <= width:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    if span < width:
        low = np.minimum(low[: n - width + 1], low[width - span :])
    whole = text[: n - width + 1] == text[width - 1 :]
    return np.unique((low[whole] & np.uint64((1 << 28) - 1)).astype(np.int64)), x, text


def compact_windows(tokens: np.ndarray, offsets: np.ndarray, salt: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimum, first and last place (ascending minima) of all compact windows of `width` tokens or more, over all texts.

    The minima of such windows are the minima of the runs of `width` tokens. A window reaches to the next smaller minimum on
    both sides, its parent or an ancestor in the Cartesian tree, which all minima look for at once by doubled steps.
    """
    minima, x, text = window_minima(tokens, offsets, salt, width)
    values, owner = x[minima], text[minima]
    left, right = (_next_smaller(v, o) for v, o in ((values, owner), (values[::-1], owner[::-1])))
    right = len(minima) - 1 - right[::-1]
    at = np.concatenate((minima, [0]))
    first = np.where(left < 0, offsets[owner], at[left] + 1)
    last = np.where(right >= len(minima), offsets[owner + 1], at[np.minimum(right, len(minima))]) - 1
    return minima, first, last


def _next_smaller(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each place the last one before it with a smaller value and the same owner, or -1; values are distinct."""
    n = len(values)
    # A text's first place has none before it.
    to = np.arange(-1, n - 1)
    to[np.flatnonzero(np.diff(owner)) + 1] = -1
    low = np.concatenate((values, np.zeros(1, values.dtype)))
    todo = np.flatnonzero((to >= 0) & (low[to] > values))
    # All between a place and where it points is greater, so it may go on to where that one points.
    while len(todo):
        to[todo] = to[to[todo]]
        todo = todo[(to[todo] >= 0) & (low[to[todo]] > values[todo])]
    return to


def agreeing(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, least: int = AGREE) -> np.ndarray:
    """Whether each window (first to last token) holds a subsequence of `length` tokens that windows of `least` functions hold.

    A window holds the subsequences that begin from `first` to `last - length + 1`; windows of one function that overlap
    count once, by the stretches that they cover together.
    """
    out = np.zeros(len(hashes), bool)
    if len(np.unique(hashes)) < least:
        return out
    starts, ends = [], []
    for k in np.unique(hashes):
        own = np.flatnonzero(hashes == k)
        own = own[np.argsort(first[own], kind="stable")]
        a, b = first[own], np.maximum.accumulate(last[own] - length + 2)
        new = np.concatenate(([True], a[1:] > b[:-1]))
        starts.append(a[new])
        ends.append(b[np.concatenate((new[1:], [True]))])
    # Functions that cover a place: those that have begun less those that have ended.
    starts, ends = (np.sort(np.concatenate(x)) for x in (starts, ends))
    at = np.unique(np.concatenate((starts, ends)))
    covered = np.searchsorted(starts, at, "right") - np.searchsorted(ends, at, "right") >= least
    before = np.concatenate(([0], np.cumsum(covered)))
    # The stretches between neighbouring places that begin before a window's end and end after its first place.
    low = np.searchsorted(at, first, "right") - 1
    high = np.searchsorted(at, last - length + 2, "left")
    return before[high] > before[low]


def common(ones: list[np.ndarray], twos: list[np.ndarray]) -> np.ndarray:
    """For each pair of token sequences, how many tokens of the first are in the second, repeats included."""
    keys = []
    for parts in (ones, twos):
        pair = np.repeat(np.arange(len(parts), dtype=np.uint64), [len(p) for p in parts])
        keys.append(np.concatenate(parts) + pair * _PLACES[1])
    return np.bincount(np.repeat(np.arange(len(ones)), [len(p) for p in ones]), np.isin(*keys), len(ones)).astype(int)


def dense(ones: list[np.ndarray], twos: list[np.ndarray], least: int, similarity: float) -> np.ndarray:
    """For each pair of token sequences, whether each has a stretch that could be alike to one of the other.

    It has `least` tokens, the first and last of them in the other, and so many that are in the other that those that
    aren't, and are there once, leave the similarity possible. A bound: without such stretches no passage is found.
    """
    pairs = [np.repeat(np.arange(len(parts)), [len(p) for p in parts]) for parts in (ones, twos)]
    keys = [np.concatenate(parts) + pair.astype(np.uint64) * _PLACES[1] for parts, pair in zip((ones, twos), pairs, strict=True)]
    kinds = np.unique(np.concatenate(keys), return_inverse=True)[1]
    kinds = np.split(kinds, [len(keys[0])])
    times = [np.bincount(k, minlength=max(int(x.max(initial=-1)) for x in kinds) + 1) for k in kinds]
    out = np.ones(len(ones), bool)
    for pair, kind, own, other in zip(pairs, kinds, times, times[::-1], strict=True):
        some = np.zeros(len(ones), bool)
        if len(pair) >= least:
            hit = other[kind] > 0
            sums = np.concatenate((np.zeros(1), np.cumsum(np.where(hit, 1 - similarity, np.where(own[kind] == 1, -similarity, 0)))))
            # The least sum before a token that is in the other; those of earlier pairs are too great to count.
            apart = pair * (len(pair) + 1.0)
            low = np.minimum.accumulate(np.where(hit, sums[:-1], np.inf) - apart)
            enough = hit[least - 1 :] & (sums[least:] - apart[least - 1 :] - low[: len(low) - least + 1] >= -1e-6)
            some[pair[least - 1 :][enough]] = True
        out &= some
    return out


def interval_joined(ones: list[np.ndarray], twos: list[np.ndarray], least: int) -> np.ndarray:
    """For each pair of token sequences, whether some windows of AGREE functions hold one subsequence of `least` tokens in both.

    Windows of all sequences are made at once for each function; those of a pair meet where function and minimum are equal.
    """
    tables = []
    for parts in (ones, twos):
        tokens, offsets = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        owner = np.repeat(np.arange(len(parts)), np.diff(offsets))
        rows = []
        for k in range(HASHES):
            c, first, last = compact_windows(tokens, offsets, k, least)
            start = offsets[owner[c]]
            rows.append(np.stack((owner[c], np.full(len(c), k), tokens[c].view(np.int64), first - start, last - start)))
        tables.append(np.concatenate(rows, 1))
    # The keys that both sides have; a token that is a minimum again has one key, so repeats don't multiply.
    kinds = np.unique(np.concatenate([t[2] for t in tables]), return_inverse=True)[1]
    keys = [(t[0] * HASHES + t[1]) * (int(kinds.max(initial=0)) + 1) + kind for t, kind in zip(tables, np.split(kinds, [tables[0].shape[1]]), strict=True)]
    shared = np.intersect1d(*keys)
    # Places of different pairs are kept apart, so all pairs are swept at once.
    apart = max(len(p) for p in (*ones, *twos)) + 2
    held = []
    for t, key in zip(tables, keys, strict=True):
        met = np.isin(key, shared)
        pair, k, _, first, last = t[:, met]
        held.append(np.stack((key[met], pair))[:, agreeing(k, first + pair * apart, last + pair * apart, least)])
    out = np.zeros(len(ones), bool)
    out[held[0][1][np.isin(held[0][0], held[1][0])]] = True
    return out


def _described(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_words, h1, h2 and, of each window, its key and place (that of the minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            hashed, offsets = S.word_hashes(strings(batch.column(1)))
            one, two = S.sequence_hashes(hashed, offsets)
            tokens, at = S.shingle_hashes(hashed, offsets)
            n = np.diff(offsets)
            text = np.repeat(np.arange(len(n)), np.diff(at))
            after = np.zeros(len(tokens), np.uint64)
            padded = np.concatenate((tokens, np.zeros(AFTER, np.uint64)))
            for i in range(AFTER + 1):
                after += padded[i : i + len(tokens)] * _PLACES[i]
            # Only the minima are needed here; they are in order, text by text.
            c = window_minima(tokens, at, 0, WIDTH)[0]
            c = c[(c + AFTER < at[text[c] + 1]) & (n[text[c]] >= words)]
            cut = np.searchsorted(text[c], np.arange(len(n) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (S.mixed(after[c] + _SALTS[0]).view(np.int64), c - at[text[c]])]
            yield pa.record_batch([batch.column(0), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *lists], names=["doc_id", "n_words", "h1", "h2", "keys", "places"])

    schema = "doc_id long, n_words long, h1 long, h2 long, keys array<long>, places array<long>"
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema).filter(F.col("n_words") >= words)


def _chained(pairs: DataFrame) -> DataFrame:
    """Passages that may be alike, from the joined windows of each pair of documents: doc, s, e, pivot, ps, pe (tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows: list[tuple[int, ...]] = []
            for doc, pivot, places in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2), strict=True):
                mine, theirs = (np.asarray(places.values.field(i)) for i in (0, 1))
                order = np.argsort(mine, kind="stable")
                a, b = mine[order], theirs[order]
                # Insertions shift the diagonal a little, so only clear jumps part passages.
                apart = (np.diff(a) > GAP) | (np.abs(np.diff(a - b)) > GAP)
                cut = [0, *(np.flatnonzero(apart) + 1).tolist(), len(a)]
                for i, j in zip(cut[:-1], cut[1:], strict=True):
                    rows.append((doc, int(a[i]) - REACH, int(a[j - 1]) + REACH + 1, pivot, int(b[i:j].min()) - REACH, int(b[i:j].max()) + REACH + 1))
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], names=["doc", "s", "e", "pivot", "ps", "pe"])

    return pairs.mapInArrow(run, "doc long, s long, e long, pivot long, ps long, pe long")


class _Pair:
    """Two token sequences, and where the tokens of the first are in the second."""

    def __init__(self, one: np.ndarray, two: np.ndarray, least: int, similarity: float):
        self.least, self.similarity = least, similarity
        ids = np.unique(np.concatenate((one, two)), return_inverse=True)[1]
        self.one, self.two = ids[: len(one)], ids[len(one) :]
        kinds = int(ids.max(initial=-1)) + 1
        mine, theirs = np.bincount(self.one, minlength=kinds), np.bincount(self.two, minlength=kinds)
        self.hit = np.flatnonzero(theirs[self.one])
        #: Stretches of hits (first, end) that could hold a passage.
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(self.hit) > GAP) + 1, [len(self.hit)]))
        self.parts = [(p, q) for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if q - p >= least * similarity and self.hit[q - 1] + 1 - self.hit[p] >= least]
        if not self.parts:
            return
        order = np.argsort(self.two, kind="stable")
        self.width = len(one) + len(two) + 1
        self.keys = self.two[order] * self.width + order
        self.begins = np.cumsum(theirs) - theirs
        self.ends = self.begins + theirs
        token = self.one[self.hit]
        self.first = order[self.begins[token]]
        self.repeats = _sums(theirs[token] > 1)
        self.middle = int(np.median(self.first - self.hit))
        # Tokens that the other sequence lacks and that are there once: they count in any union.
        self.alone = _sums((mine[self.one] == 1) & (theirs[self.one] == 0)), _sums((theirs[self.two] == 1) & (mine[self.two] == 0))

    def _spots(self, p: int, q: int, shift: int) -> np.ndarray:
        """For the hits p to q (exclusive), the place in the second sequence nearest to the shifted one."""
        if self.repeats[q] == self.repeats[p]:
            return self.first[p:q]
        token, at = self.one[self.hit[p:q]], self.hit[p:q] + shift
        k = np.searchsorted(self.keys, token * self.width + np.clip(at, 0, self.width - 1))
        low, high = (self.keys[np.clip(x, self.begins[token], self.ends[token] - 1)] - token * self.width for x in (k - 1, k))
        return np.where(np.abs(low - at) <= np.abs(high - at), low, high)

    def judged(self, p: int, q: int) -> tuple[int, int, int, int, float] | None:
        """The stretch of the hits p to q (exclusive) if it is alike: start, end, start, end, similarity."""
        a, b = int(self.hit[p]), int(self.hit[q - 1]) + 1
        x = np.unique(self.one[a:b])
        if b - a < self.least or len(np.unique(self.one[self.hit[p:q]])) < self.similarity * len(x):
            return None
        shifts = [self.middle]
        if self.repeats[q] > self.repeats[p]:
            # Along the usual shift; where a token is repeated at other shifts only, from the first place on.
            shifts += [int(np.median(self.first[p:q] - self.hit[p:q])), int(self.first[p] - a)]
        for shift in dict.fromkeys(shifts):
            spots = self._spots(p, q, shift)
            c, d = int(spots.min()), int(spots.max()) + 1
            if d - c < self.least:
                continue
            y = np.unique(self.two[c:d])
            both = len(np.intersect1d(x, y, assume_unique=True))
            score = both / (len(x) + len(y) - both)
            if score >= self.similarity:
                return a, b, c, d, score
        return None

    def possible(self, cuts: np.ndarray) -> list[np.ndarray]:
        """For 1, 2, ... up to RUNS runs in a row (between the cuts), the first runs of those stretches that may be alike."""
        n = len(cuts) - 1
        low, high = (f.reduceat(self.first[: cuts[-1]], cuts[:-1]) for f in (np.minimum, np.maximum))
        c, d, out = low, high, []
        for k in range(1, min(n, RUNS) + 1):
            if k > 1:
                c, d = np.minimum(c[:-1], low[k - 1 :]), np.maximum(d[:-1], high[k - 1 :])
            begin, end = cuts[: n - k + 1], cuts[k:]
            a, b = self.hit[begin], self.hit[end - 1] + 1
            plain = self.repeats[end] == self.repeats[begin]
            rest = self.alone[0][b] - self.alone[0][a] + np.where(plain, self.alone[1][d + 1] - self.alone[1][c], 0)
            shared = end - begin
            out.append(np.flatnonzero((b - a >= self.least) & (shared >= self.least * self.similarity) & (shared >= self.similarity * (shared + rest)) & (~plain | (d + 1 - c >= self.least))))
        return out


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(x, dtype=np.int64)))


def alike(one: np.ndarray, two: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Stretches of two token sequences with that set similarity and `least` tokens: start, end, start, end, similarity.

    A stretch of hits that isn't alike as a whole is cut into runs of equal tokens; the longest stretches of up to RUNS
    runs that are alike are taken, then those on either side. Bounds from sums over the runs spare most comparisons.
    """
    pair = _Pair(one, two, least, similarity)
    found: list[tuple[int, int, int, int, float]] = []

    def search(cuts: np.ndarray) -> None:
        if len(cuts) < 2 or cuts[-1] - cuts[0] < least * similarity:
            return
        options = pair.possible(cuts)
        for k in range(len(options), 0, -1):
            for i in options[k - 1].tolist():
                got = pair.judged(int(cuts[i]), int(cuts[i + k]))
                if got:
                    found.append(got)
                    search(cuts[: i + 1])
                    search(cuts[i + k :])
                    return

    for p, q in pair.parts:
        got = pair.judged(p, q)
        if got:
            found.append(got)
        else:
            cuts = np.flatnonzero((np.diff(pair.hit[p:q]) > 1) | (np.abs(np.diff(pair.first[p:q] - pair.hit[p:q])) > RUNS)) + 1
            search(np.concatenate(([p], p + cuts, [q])))
    return found


def repeated_passages(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, start_word, end_word, match_id, match_start, match_end, similarity: stretches that other documents have too.

    A passage has at least `words` words; its set of 5-word shingles and that of its match have at least this Jaccard
    similarity. Its match is in the document of the smallest id that has the signature, or in another where that one's
    isn't alike; the match's own passage is given as well. Passages that overlap are one stretch, with the match of the longest of them. Documents with equal
    words match as a whole. Documents without such a passage, with a null text or id, or with fewer words give
    no row. Rows that repeat a doc_id are one document. Other columns are ignored; an empty table gives an empty result.
    """
    lean(docs.sparkSession)
    least = words - S.WIDTH + 1
    every = staged(_described(docs, words), "windows")
    brief = every.select("doc_id", "h1", "h2", "n_words")
    firsts = staged(brief.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("n_words").alias("n_words")).filter("first < last"), "firsts")
    copies = staged(brief.select("doc_id", "h1", "h2").join(firsts, ["h1", "h2"]).select("doc_id", "first", "last", "n_words").distinct(), "copies")
    later = copies.filter("doc_id <> first").select("doc_id")
    heads = every.join(F.broadcast(later) if copies.count() <= BROADCAST_IDS else later, "doc_id", "left_anti")
    rows = heads.select("doc_id", F.explode(F.arrays_zip("keys", "places")).alias("w")).select("doc_id", F.col("w.keys").alias("key"), F.col("w.places").alias("place"))
    # The small sides of joins on a signature are written first: then adaptive execution splits the rows of a hot one.
    shared = rows.groupBy("key").agg(F.min(F.struct("doc_id", "place")).alias("pivot"), F.max("doc_id").alias("last")).filter("pivot.doc_id < last")
    shared = staged(shared.select("key", F.col("pivot.doc_id").alias("pivot"), F.col("pivot.place").alias("theirs")), "shared")
    hits = staged(rows.join(shared, "key"), "hits")
    met = staged(_verified(docs, hits, least, similarity), "found")

    runs = staged(_runs(docs, _left(hits, met), least), "runs")
    by = F.xxhash64("doc_id", F.pmod("key", F.lit(PIVOTS)))
    shared = runs.groupBy("key").agg(F.min(F.struct(by.alias("by"), "doc_id", "place", "done")).alias("pivot"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("done").alias("done")).filter("low < high and not done")
    shared = staged(shared.select("key", F.col("pivot.doc_id").alias("pivot"), F.col("pivot.place").alias("theirs"), F.col("pivot.done").alias("closed")), "shared")
    found = met.union(staged(_verified(docs, runs.join(shared, "key").filter("not (done and closed)"), least, similarity), "again"))

    columns = ("doc_id", "start_word", "end_word", "match_id", "match_start", "match_end", "similarity")
    turned = found.groupBy(F.col("match_id").alias("doc_id"), F.col("match_start").alias("start_word"), F.col("match_end").alias("end_word")).agg(
        F.min("doc_id").alias("match_id"), *[F.min_by(c, "doc_id").alias(n) for c, n in (("start_word", "match_start"), ("end_word", "match_end"), ("similarity", "similarity"))]
    )
    whole = copies.select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"), F.when(F.col("doc_id") == F.col("first"), F.col("last")).otherwise(F.col("first")).alias("match_id"), F.lit(0).cast("long").alias("match_start"), F.col("n_words").alias("match_end"), F.lit(1.0).alias("similarity"))
    return _merged(found.select(*columns).union(turned.select(*columns)).union(whole.select(*columns)))


def _merged(rows: DataFrame) -> DataFrame:
    """One row for each stretch of a document that passages cover without a break, with the match of the longest of them."""
    by = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    before = F.max("end_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.coalesce(F.col("start_word") >= before, F.lit(True)).cast("int"))
    rows = rows.withColumn("stretch", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct("match_id", "match_start", "match_end", "similarity"), F.struct(F.col("end_word") - F.col("start_word"), -F.col("match_id"), -F.col("match_start"))).alias("best")
    return rows.groupBy("doc_id", "stretch").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), best).select("doc_id", "start_word", "end_word", "best.*")


def _verified(docs: DataFrame, hits: DataFrame, least: int, similarity: float) -> DataFrame:
    """Passages around the places (doc_id, place, pivot, theirs) that documents share with pivots."""
    pairs = hits.filter("doc_id <> pivot").groupBy("doc_id", "pivot").agg(F.collect_set(F.struct("place", "theirs")).alias("places"))
    spans = staged(_chained(pairs), "spans")
    wanted = spans.select(F.col("doc").alias("doc_id"), "s", "e").union(spans.select("pivot", "ps", "pe")).groupBy("doc_id").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    cut = staged(_cut(_texts(docs, staged(wanted, "wanted"))), "cut")
    mine = cut.select(F.col("doc_id").alias("doc"), "s", "e", F.col("tokens").alias("one"))
    theirs = cut.select(F.col("doc_id").alias("pivot"), F.col("s").alias("ps"), F.col("e").alias("pe"), F.col("tokens").alias("two"))
    return _judged(spans.join(mine, ["doc", "s", "e"]).join(theirs, ["pivot", "ps", "pe"]), least, similarity)


def _texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, text and the other columns of rows (one for each doc_id), for the documents in it."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = rows.select("doc_id")
    texts = texts.join(F.broadcast(ids), "doc_id", "left_semi") if rows.count() <= BROADCAST_IDS else texts.join(ids, "doc_id", "left_semi")
    return texts.dropDuplicates(["doc_id"]).join(rows, "doc_id")


def _left(hits: DataFrame, met: DataFrame) -> DataFrame:
    """doc_id, windows: those but the pivots' own of keys with one that no passage found with the pivot covers."""
    ranges = met.groupBy("doc_id", F.col("match_id").alias("pivot")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("ranges"))
    rows = hits.join(ranges, ["doc_id", "pivot"], "left")
    done = F.coalesce(F.exists("ranges", lambda r: (r["start_word"] <= F.col("place")) & (F.col("place") + S.WIDTH <= r["end_word"])), F.lit(False))
    rows = staged(rows.filter("doc_id <> pivot or place <> theirs").select("key", "doc_id", "place", done.alias("done")), "rest")
    keys = rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("done").alias("all")).filter("low < high and not all").select("key")
    return staged(rows.join(staged(keys, "open"), "key").groupBy("doc_id").agg(F.collect_set(F.struct("place", "done")).alias("windows")), "windows")


def run_keys(tokens: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` tokens."""
    if len(tokens) < length:
        return np.zeros(0, np.uint64)
    # Sums of token * M^place; dividing by M^start makes equal runs equal wherever they are.
    up, down = _powers(len(tokens))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens * up, dtype=np.uint64)))
    return S.mixed((sums[length:] - sums[:-length]) * down[: len(tokens) - length + 1] + np.uint64(length))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for m in (_PLACES[0], np.uint64(pow(int(_PLACES[0]), -1, 1 << 64))):
        x = np.full(n, m, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _runs(docs: DataFrame, left: DataFrame, least: int) -> DataFrame:
    """key, doc_id, place, done: the runs of `least` tokens that hold a window, done if all of these are, and the windows with
    one token near them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches, "text", 1 << 20):
            tokens, at = S.shingle_hashes(*S.word_hashes(strings(x.column(1))))
            cuts = x.column(2).offsets.to_numpy() - x.column(2).offsets[0].as_py()
            windows = [c.to_numpy(zero_copy_only=False) for c in x.column(2).flatten().flatten()]
            keys, ids, places, dones = [], [], [], []
            for i, doc in enumerate(x.column(0).to_pylist()):
                own = tokens[at[i] : at[i + 1]]
                place, done = (c[cuts[i] : cuts[i + 1]] for c in windows)
                order = np.argsort(place)
                place, done = place[order], done[order]
                found = run_keys(own, least)
                some, more = (_held(q, least, len(found)) for q in (place, place[~done]))
                start = np.flatnonzero(some)
                key, near = near_keys(own, place, least)
                keys += [found[start].view(np.int64), key.view(np.int64)]
                ids.append(np.full(len(start) + len(key), doc, np.int64))
                places += [start, place[near]]
                dones += [~more[start], done[near]]
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in (keys, ids, places, dones)], names=["key", "doc_id", "place", "done"])

    return _texts(docs, left).select("doc_id", "text", "windows").mapInArrow(run, "key long, doc_id long, place long, done boolean")


def _held(places: np.ndarray, length: int, n: int) -> np.ndarray:
    """For n runs of a length, by their first places, whether they hold one of the places."""
    change = np.bincount(np.maximum(places - length + 1, 0), minlength=n + 1)[: n + 1] - np.bincount(np.minimum(places + 1, n), minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def near_keys(tokens: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a window at one of the places (ascending) and one token within a passage's length, and which place each has.

    Only windows before and after a gap in the places are taken, with the tokens on that side.
    """
    window = run_keys(tokens, AFTER + 1)
    gap = np.diff(places) >= APART
    out = []
    for edge, steps in ((np.append(gap, True), np.arange(AFTER + 1, length)), (np.append(True, gap), -np.arange(1, length))):
        which = np.repeat(np.flatnonzero(edge), len(steps))
        at = places[which] + np.tile(steps, int(edge.sum()))
        inside = (at >= 0) & (at < len(tokens))
        which, at = which[inside], at[inside]
        out.append((S.mixed(window[places[which]] * _PLACES[1] + tokens[at] * _PLACES[2] + np.uint64(steps[0] > 0)), which))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _cut(texts: DataFrame) -> DataFrame:
    """doc_id, s, e and the tokens of each wanted stretch of each text (doc_id, text, spans), clipped to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches, "text", 1 << 20):
            tokens, at = S.shingle_hashes(*S.word_hashes(strings(x.column(1))))
            out: list[tuple] = []
            for i, (doc, spans) in enumerate(zip(x.column(0).to_pylist(), x.column(2).to_pylist(), strict=True)):
                own = tokens[at[i] : at[i + 1]]
                out += [(doc, p["s"], p["e"], own[max(0, p["s"]) : p["e"]].tobytes()) for p in spans]
            yield pa.record_batch([pa.array([o[k] for o in out], pa.int64()) for k in range(3)] + [pa.array([o[3] for o in out], pa.binary())], names=["doc_id", "s", "e", "tokens"])

    return texts.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, s long, e long, tokens binary")


FOUND = "doc_id long, start_word long, end_word long, match_id long, match_start long, match_end long, similarity double"


def _found(out: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([o[k] for o in out], pa.int64()) for k in range(6)] + [pa.array([o[6] for o in out], pa.float64())]
    return pa.record_batch(columns, names=["doc_id", "start_word", "end_word", "match_id", "match_start", "match_end", "similarity"])


def _judged(pairs: DataFrame, least: int, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out: list[tuple] = []
            if not x.num_rows:
                continue
            ones, twos = ([np.frombuffer(t, np.uint64) for t in x.column(i).to_pylist()] for i in (4, 5))
            near = np.zeros(len(ones), bool)
            # So many tokens at once, or one pair.
            part = np.cumsum([len(o) + len(t) for o, t in zip(ones, twos, strict=True)]) // TOKENS
            for rows in np.split(np.arange(len(ones)), np.flatnonzero(np.diff(part)) + 1):
                # Too few common tokens for a passage: neither windows nor shingles need a look.
                rows = rows[common([ones[i] for i in rows], [twos[i] for i in rows]) >= least * similarity]
                if len(rows):
                    rows = rows[dense([ones[i] for i in rows], [twos[i] for i in rows], least, similarity)]
                if len(rows):
                    near[rows] = interval_joined([ones[i] for i in rows], [twos[i] for i in rows], least)
            for doc, s, pivot, ps, one, two, agrees in zip(*(x.column(i).to_pylist() for i in range(4)), ones, twos, near.tolist(), strict=True):
                if not agrees:
                    continue
                for a, b, c, d, score in alike(one, two, least, similarity):
                    s0, p0 = max(0, s), max(0, ps)
                    out.append((doc, s0 + a, s0 + b + S.WIDTH - 1, pivot, p0 + c, p0 + d + S.WIDTH - 1, score))
            yield _found(out)

    return pairs.select("doc", "s", "pivot", "ps", "one", "two").mapInArrow(run, FOUND)
