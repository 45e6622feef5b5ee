"""Near-duplicates, repeated passages, benchmark leaks."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import decontamination, neardup, passages
from tidemark.llm import shingles as S
from tidemark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def shingles_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles_of(t) for i, t, *_ in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(rng, n):
    """Documents in chains of small edits, so that components are larger than links."""
    rows = []
    for g in range(n):
        base = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(rng.choice([3, 5, 30, 120]))]
        for _ in range(rng.randint(1, 6)):
            rows.append((len(rows), " ".join(base)))
            if rng.random() < 0.7:
                base = base[:]
                for _ in range(rng.randint(1, 3)):
                    base[rng.randrange(len(base))] = f"w{rng.randrange(10**6)}"
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = copies(random.Random(seed), 60)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_rows(spark, odd, odd_rows, empty):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute(odd_rows)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert neardup.near_duplicates(empty).collect() == []
    kept = neardup.deduplicated(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in brute(odd_rows).items() if i == c} | {None}


def test_hot_band_with_outsiders(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SPAN", 8)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(120):
        own = base[:]
        for k in rng.sample(range(100), i % 4):
            own[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_least_matches_keep_what_is_similar():
    rng = np.random.default_rng(4)
    for m in range(2, 5):
        agree = rng.random((2000, neardup.HASHES)) < 0.75
        one = np.zeros((2000, neardup.HASHES), np.uint32)
        assert len(neardup.likely(one, (~agree).astype(np.uint32), 0.75, neardup.MISS)) >= 1995 - m
    assert len(neardup.likely(np.zeros((9, neardup.HASHES), np.uint32), np.ones((9, neardup.HASHES), np.uint32), 0.75, neardup.MISS)) == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def test_word_hashes_follow_the_words():
    texts = ["A b\tC\x0bd e", "a B c D E", "", "é É x", "a b c d e f"]
    found, at = S.shingle_hashes(*S.word_hashes(texts))
    sets = [set(found[at[i] : at[i + 1]].tolist()) for i in range(len(texts))]
    assert sets[0] == sets[1] and not sets[2] and len(sets[3]) == 1 and sets[0] < sets[4]


def test_compact_windows_are_those_of_the_definition():
    rng = np.random.default_rng(5)
    tokens = rng.integers(0, 60, 300, dtype=np.uint64)
    offsets = np.array([0, 10, 10, 150, 300])
    got = sorted(zip(*(x.tolist() for x in passages.compact_windows(tokens, offsets, 0, 16)), strict=True))
    h = S.mixed(tokens ^ passages._SALTS[0]) & ~np.uint64((1 << 28) - 1)
    want = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        for c in range(a, b):
            first, last = c, c
            while first > a and h[first - 1] > h[c]:
                first -= 1
            while last + 1 < b and h[last + 1] >= h[c]:
                last += 1
            if last - first + 1 >= 16:
                want.append((c, first, last))
    assert got == want


def test_repeated_passages(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    shared, line = fresh(60), fresh(20)
    changed = shared[:]
    changed[5] = "other"
    rows = [(i, " ".join(fresh(rng.randint(0, 90)) + shared + fresh(30))) for i in range(40)]
    rows += [(100 + i, " ".join(fresh(60) + line + fresh(60))) for i in range(40)]
    rows += [(200, " ".join(fresh(50) + changed + fresh(50))), (300, " ".join(fresh(200))), (301, " ".join(fresh(49)))]
    rows += [(400, " ".join(x := fresh(70))), (401, "\n".join(x)), (402, " ".join(x[:49]))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {*range(40), 200, 400, 401}
    texts = {i: t.split() for i, t in rows}
    for r in got:
        one, two = shingles_of(" ".join(texts[r.doc_id][r.start_word : r.end_word])), shingles_of(" ".join(texts[r.match_id][r.match_start : r.match_end]))
        assert r.doc_id != r.match_id and r.end_word - r.start_word >= 50
        assert len(one & two) / len(one | two) >= 0.75
        if r.doc_id < 40:
            at = texts[r.doc_id].index(shared[0])
            assert (r.start_word, r.end_word) == (at, at + 60) or r.doc_id == 0 or r.match_id == 200


def test_passages_of_odd_rows(spark, odd, empty):
    got = passages.repeated_passages(odd).collect()
    assert {r.doc_id for r in got} == {9, 10, 11, 12, 13, 14}
    assert passages.repeated_passages(empty).collect() == []


def test_passages_behind_a_frequent_line(spark):
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    rows, want = [], set()
    for i in range(0, 4000, 40):
        # The first document has 45 words of the passage, too few for a passage of its own; the others share 60.
        shared = fresh(60)
        rows += [(i, " ".join(fresh(40) + shared[:45] + fresh(40))), (i + 1, " ".join(fresh(30) + shared + fresh(50))), (i + 2, " ".join(fresh(50) + shared + fresh(20)))]
        want |= {i + 1, i + 2}
    line = fresh(45)
    rows += [(5000 + i, " ".join(fresh(30) + line + fresh(30))) for i in range(30)]
    tail = line + fresh(12)
    rows += [(6000 + i, " ".join(fresh(30) + tail + fresh(30))) for i in range(2)]
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == want | {6000, 6001}
    assert all(got[i].end_word - got[i].start_word == 60 for i in want)


def test_run_keys_are_equal_for_equal_runs():
    rng = np.random.default_rng(3)
    one, two = rng.integers(0, 2**63, 90, dtype=np.uint64), rng.integers(0, 2**63, 70, dtype=np.uint64)
    two[20:50] = one[55:85]
    a, b = passages.run_keys(one, 24), passages.run_keys(two, 24)
    assert len(a) == 67 and len(b) == 47 and len(passages.run_keys(one[:5], 24)) == 0
    assert [(i, j) for i in range(67) for j in range(47) if a[i] == b[j]] == [(55 + k, 20 + k) for k in range(7)]


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_near_passages_behind_a_very_frequent_line(spark, edits):
    rng = random.Random(13)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    line, rows, want = fresh(45), [], set()
    rows += [(i, " ".join(fresh(30) + line + fresh(30))) for i in range(400)]
    for i in range(1000, 2000, 2):
        shared = line + fresh(rng.randint(5, 30))
        other = shared[:]
        for k in rng.sample(range(len(shared)), edits):
            other[k] = f"edit{i}{k}"
        # Both ends must be equal words, or the shared part is shorter than 50.
        if len(shingles_of(" ".join(shared)) & shingles_of(" ".join(other))) < 0.86 * (len(shared) - 4) or other[:5] != shared[:5] or other[-5:] != shared[-5:]:
            continue
        rows += [(i, " ".join(fresh(30) + shared + fresh(30))), (i + 1, " ".join(fresh(40) + other + fresh(10)))]
        want |= {i, i + 1}
    got = {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    print(edits, len(got & want), len(want), len(got - want))
    assert len(want) > 40 and len(got & want) >= (1.0 if not edits else 0.9) * len(want)
    assert not got & set(range(400))


@pytest.mark.parametrize("kind", ["halves", "line"])
def test_near_passages_whose_pivots_have_a_part(spark, kind):
    rng = random.Random(17)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    line, rows, want = fresh(45), [], set()
    if kind == "line":
        rows = [(i, " ".join(fresh(30) + line + fresh(30))) for i in range(400)]
    for i in range(1000, 7000, 20):
        if kind == "halves":
            # Smaller ids have the words before or after the change, too few for a passage.
            shared, k = fresh(60), 30
            rows += [(i + j, " ".join(fresh(30) + (shared[:k] if j % 2 else shared[k + 1 :]) + fresh(30))) for j in range(16)]
        else:
            # The change is in the first word behind a frequent line, with too few words after it for a window.
            shared, k = line + fresh(12), 45
        other = [*shared[:k], "edit", *shared[k + 1 :]]
        rows += [(i + 18, " ".join(fresh(30) + shared + fresh(30))), (i + 19, " ".join(fresh(40) + other + fresh(10)))]
        want |= {i + 18, i + 19}
    got = {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    print(kind, len(got & want), len(want), len(got - want))
    assert got == want


@pytest.mark.parametrize("n", [50, 51, 52, 56])
def test_short_passages_are_all_found(spark, n):
    rng = random.Random(n)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(0, 1200, 2):
        shared = fresh(n)
        other = shared[:]
        if i % 4:
            other[n // 2] = "other"
        rows += [(i, " ".join(fresh(30) + shared + fresh(30))), (i + 1, " ".join(fresh(20) + other + fresh(40)))]
        want |= {i: 30, i + 1: 20}
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.start_word for r in got} == want
    assert all(r.end_word - r.start_word == n for r in got)


@pytest.mark.parametrize("clustered", [False, True])
def test_near_passages_against_brute_force(spark, clustered):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    rows, want, exact = [], set(), set()
    for i in range(0, 3000, 2):
        shared = fresh(rng.randint(52, 120))
        other, k = shared[:], i % 8 // 2
        spots = range(at := rng.randint(5, len(shared) - 10), at + 2 * k, 2) if clustered else rng.sample(range(len(shared)), k)
        for s in sorted(spots, reverse=True):
            kind = rng.random()
            other[s : s + 1] = ["edit"] if kind < 0.6 else ["new", other[s]] if kind < 0.8 else []
        rows += [(i, " ".join(fresh(30) + shared + fresh(30))), (i + 1, " ".join(fresh(20) + other + fresh(40)))]
        one, two = shingles_of(" ".join(shared)), shingles_of(" ".join(other))
        if len(other) >= 50 and len(one & two) >= 0.75 * len(one | two):
            want |= {i, i + 1}
            exact |= {i, i + 1} if not k else set()
    found = {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 2000 and exact <= found
    assert len(want & found) >= 0.98 * len(want)
    print(clustered, len(want & found), len(want))


def test_ties_of_passages(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    one, two = fresh(60), fresh(60)
    rows = [(1, " ".join(one + fresh(30) + two)), (2, " ".join(one)), (3, " ".join(two)), (4, " ".join(one)), (5, " ".join(two + fresh(20)))]
    got = {(r.doc_id, r.start_word, r.end_word): r.match_id for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0, 60): 2, (1, 90, 150): 3, (2, 0, 60): 1, (3, 0, 60): 1, (4, 0, 60): 2, (5, 0, 60): 1} or got[(1, 0, 60)] == 2
    assert set(got) == {(1, 0, 60), (1, 90, 150), (2, 0, 60), (3, 0, 60), (4, 0, 60), (5, 0, 60)}


def items(rng, n):
    return [(i, " ".join(f"b{rng.randrange(10**6)}" for _ in range(rng.randint(15, 60))), "x", 0.1) for i in range(n)]


B = "item_id long, text string, doc_id string, similarity double"


def jaccard(a, b):
    x, y = (Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (a, b))
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


@pytest.mark.parametrize("block", [4096, 7])
def test_leaks_equal_brute_force(spark, block):
    rng = random.Random(7)
    bench = items(rng, 30)
    rows, want = [], set()
    for i in range(120):
        host = [f"h{rng.randrange(10**6)}" for _ in range(rng.choice([0, 40, 300]))]
        k = rng.randrange(30)
        own = bench[k][1].split()
        for _ in range(i % 3):
            own[rng.randrange(len(own))] = "edit"
        at = rng.randint(0, len(host))
        rows.append((i, " ".join(host[:at] + own + host[at:]).upper()))
        text = rows[-1][1].lower().split()
        for j, t, *_ in bench:
            w = t.split()
            if any(jaccard(text[p : p + len(w)], w) >= 0.75 for p in range(max(1, len(text) - len(w) + 1))):
                want.add((i, j))
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, B), block=block).collect()
    assert {(r.doc_id, r.item_id) for r in got} <= want
    assert len(got) >= 0.97 * len(want) and len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_lower_similarities_are_honoured(spark):
    rng = random.Random(9)
    bench = items(rng, 20)
    rows, want = [], set()
    for i in range(60):
        own = bench[i % 20][1].split()
        for _ in range(i // 20):
            own[rng.randrange(len(own))] = "edit"
        text = [f"h{rng.randrange(10**6)}" for _ in range(30)] + own + [f"h{rng.randrange(10**6)}" for _ in range(30)]
        rows.append((i, " ".join(text)))
        want |= {(i, j) for j, t, *_ in bench if any(jaccard(text[p : p + len(t.split())], t.split()) >= 0.4 for p in range(len(text) - len(t.split()) + 1))}
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, B), similarity=0.4, radius=23).collect()
    assert {(r.doc_id, r.item_id) for r in got} <= want and len(got) >= 0.9 * len(want) and min(r.similarity for r in got) < 0.6


def test_index_is_kept_for_the_worker():
    items = [(i, np.arange(10 * i, 10 * i + 20, dtype=np.uint64)) for i in range(3)]

    class Sent:
        value = items

    one = decontamination._index(Sent, 15)
    assert decontamination._index(Sent, 15) is one and decontamination._index(Sent, 7) is not one
    for k in range(6):
        Sent.value = [(k + 9, items[0][1])]
        decontamination._index(Sent, 15)
    assert len(decontamination._built) <= decontamination.PASS


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(8)
    index = decontamination.Index([(i, rng.integers(0, 2**63, 30, dtype=np.uint64)) for i in range(20)])
    c = index.classes[0]
    prints = c.prints[rng.integers(0, len(c.prints), 3000)].copy()
    for i in range(len(prints)):
        for b in rng.choice(64, int(rng.integers(0, 22)), replace=False):
            prints[i] ^= np.uint64(1) << np.uint64(b)
    rows, found = index.near(c, prints)
    near = np.bitwise_count(prints[:, None] ^ c.prints[None]) <= index.radius
    assert set(zip(rows.tolist(), found.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_leaks_in_documents_shorter_than_the_window(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    bench = [(i, fresh(44 if i < 60 else 54)) for i in range(120)]
    docs = [(i, " ".join(w[:35])) for i, w in bench[:60]]
    bench = [(i, " ".join(w)) for i, w in bench]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    # 31 of 40 shingles; whether a fingerprint is within the radius is a matter of chance.
    assert len(got) > 50 and all(r.doc_id == r.item_id and r.similarity == 31 / 40 for r in got)


def test_leaks_of_odd_rows(spark, odd, odd_rows, empty):
    bench = spark.createDataFrame([(5, odd_rows[11][1], "x", 0.1), (4, odd_rows[11][1], "x", 0.1), (6, None, "x", 0.1), (7, "too short", "x", 0.1), (None, "a b c d e f", "x", 0.1)], B)
    got = decontamination.contaminated(odd, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(9, 4), (10, 4), (11, 4), (None, 4)}
    assert decontamination.contaminated(empty, bench).collect() == []
    assert decontamination.contaminated(odd, spark.createDataFrame([], B)).collect() == []
    left = decontamination.decontaminated(odd, bench)
    assert left.columns == odd.columns and {r.doc_id for r in left.collect()} == {None, *range(17)} - {9, 10, 11}


@pytest.mark.parametrize("least", [1, 2, 3])
def test_interval_joins_count_functions_around_a_subsequence(least):
    rng = np.random.default_rng(least)
    for _ in range(60):
        n = int(rng.integers(1, 14))
        first = rng.integers(0, 60, n)
        last, k = first + rng.integers(9, 40, n), rng.integers(0, 4, n)
        want = [any(len({int(k[j]) for j in range(n) if first[j] <= s and s + 9 <= last[j]}) >= least for s in range(first[i], last[i] - 8)) for i in range(n)]
        assert passages.agreeing(k, first, last, 10, least).tolist() == want


def test_equal_passages_have_equal_windows_in_every_function():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 2**63, 46, dtype=np.uint64)
    texts = [np.concatenate((rng.integers(0, 2**63, a, dtype=np.uint64), shared, rng.integers(0, 2**63, 30, dtype=np.uint64))) for a in (5, 70)]
    for k in range(passages.HASHES):
        held = []
        for text, start in zip(texts, (5, 70), strict=True):
            c, first, last = passages.compact_windows(text, np.array([0, len(text)]), k, 46)
            own = [i for i in range(len(c)) if first[i] <= start and start + 45 <= last[i] and start <= c[i] < start + 46]
            assert len(own) == 1  # the one window that holds the passage and its minimum
            held.append(int(text[c[own[0]]]))
        assert held[0] == held[1]


def test_interval_join_of_pairs():
    rng = np.random.default_rng(6)
    fresh = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    ones, twos, want = [], [], []
    for i in range(60):
        shared = fresh(60 if i % 3 else 20)
        other = shared.copy()
        other[rng.choice(len(other), i % 4, replace=False)] = fresh(i % 4)
        ones.append(np.concatenate((fresh(int(rng.integers(30))), shared, fresh(10))))
        twos.append(np.concatenate((fresh(5), other, fresh(int(rng.integers(30))))) if i % 5 else fresh(80))
        want.append(bool(i % 3 and i % 5))
    got = passages.interval_joined(ones, twos, 46)
    assert got[np.array(want)].all()
    # Of 20 equal tokens among 46 or more some functions may agree, of none none.
    assert not got[::5].any()
    assert passages.interval_joined([fresh(3)], [fresh(0)], 46).tolist() == [False]


def test_pairs_that_are_too_thin_are_told_before_the_interval_join():
    rng = np.random.default_rng(8)
    fresh = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    line, far = fresh(41), fresh(3)
    # A line and three tokens that are far from it in one of the two: many equal tokens, but no stretch.
    thin = [np.concatenate((fresh(9), line, fresh(30), far)) for _ in range(2)]
    full = [np.concatenate((fresh(9), line, fresh(2), far, fresh(5))) for _ in range(2)]
    assert passages.dense([thin[0], full[0]], [thin[1], full[1]], 46, 0.75).tolist() == [False, True]
    assert (passages.common([thin[0]], [thin[1]]) == 44).all()
    # It loses none that is found.
    ones, twos = [], []
    for i in range(600):
        shared, kinds = fresh(int(rng.integers(30, 90))), fresh(12)
        if i % 4 == 0:
            shared = rng.choice(kinds, 80)
        other = shared.copy()
        other[rng.choice(len(other), i % 7, replace=False)] = fresh(i % 7) if i % 3 else kinds[0]
        ones.append(np.concatenate((fresh(int(rng.integers(30))), shared, fresh(10))))
        twos.append(np.concatenate((fresh(5), other, kinds, fresh(int(rng.integers(30))))))
    found = np.array([bool(passages.alike(a, b, 46, 0.75)) for a, b in zip(ones, twos, strict=True)])
    got = passages.dense(ones, twos, 46, 0.75)
    assert 100 < found.sum() < 600 and not (found & ~got).any()


def test_interval_join_of_repeats_takes_no_more_memory_than_its_windows():
    tracemalloc.start()
    one, two = np.tile(np.arange(1, 7, dtype=np.uint64), 700), np.tile(np.arange(1, 10, dtype=np.uint64), 500)
    try:
        assert passages.interval_joined([one, one[:90]], [one, two], 46)[0]
        assert tracemalloc.get_traced_memory()[1] < 20e6
    finally:
        tracemalloc.stop()


def test_common_tokens_of_pairs():
    rng = np.random.default_rng(2)
    ones, twos = ([rng.integers(0, 12, rng.integers(0, 9)).astype(np.uint64) for _ in range(30)] for _ in range(2))
    assert passages.common(ones, twos).tolist() == [int(np.isin(a, b).sum()) for a, b in zip(ones, twos, strict=True)]


def test_blocks_of_the_benchmark_are_released(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i * 10 : i * 10 + 30]) for i in range(30)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").repartition(4)
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(texts)] + [(99, "nothing of it " * 20)], "doc_id long, text string")
    made, context = [], type(spark.sparkContext)
    send = context.broadcast

    class Counted:
        live = most = 0

    def counted(self, value):
        one = send(self, value)
        if isinstance(value, list):
            made.append(len(value))
            Counted.live += 1
            Counted.most = max(Counted.most, Counted.live)
            destroy = one.destroy

            def gone(*a):
                Counted.live -= 1
                destroy(*a)

            one.destroy = gone
        return one

    whole = {tuple(r) for r in decontamination.contaminated(docs, bench).collect()}
    monkeypatch.setattr(context, "broadcast", counted)
    parts = {tuple(r) for r in decontamination.contaminated(docs, bench, block=2).collect()}
    assert parts == whole and {(r[0], r[1]) for r in whole} >= {(i, i) for i in range(30)} and not any(r[0] == 99 for r in whole)
    assert len(made) >= 15 > decontamination.PASS and max(made) <= 2 and Counted.most <= decontamination.PASS and Counted.live == 0
