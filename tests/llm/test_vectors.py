"""SimHash, centroid clusters and vector codes against brute force in Python's integers."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import clusters, codes, simhash
from tidemark.llm.whole import Entries, Totals, integers, limits

V = "vec_id long, embedding array<float>, label int, id int, v int, x string, cluster string, code string, component long"


def rooted(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_brute(rows, radius=4):
    rows = [(r[0], plain_fingerprint(r[1])) for r in rows]
    prints = sorted({f for i, f in rows if i is not None})
    of = rooted(prints, [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= radius])
    least = {}
    for i, f in rows:
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    return sorted(((i, f"{f:016x}", None if i is None else least[of[f]]) for i, f in rows), key=str)


def test_simhash_of_odd_rows(spark, odd, odd_rows, empty):
    got = simhash.simhash_near_duplicates(odd)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == simhash_brute(odd_rows)
    assert simhash.simhash_near_duplicates(empty).collect() == []


def test_simhash_of_one_id_with_two_texts(spark):
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "A  b c d e f"), (3, None), (4, " \v\f ")]
    got = simhash.simhash_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == simhash_brute(rows)


def test_texts_are_hashed_by_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab\xa0É \t\n\v\f\r漢"), 900)) for _ in range(20)] + ["x" * 3000, "", "a b", "a b c d", " a\tb  c "]
    for piece in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert [simhash.fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


def near_prints(rng, groups, size):
    """Fingerprints at 1 to 6 bits from others, so that some are just within the radius and some just beyond it."""
    out = []
    for x in rng.integers(0, 1 << 63, groups).tolist():
        own = [x]
        for _ in range(size):
            y = own[rng.integers(len(own))]
            for b in rng.choice(64, rng.integers(1, 7), replace=False).tolist():
                y ^= 1 << b
            own.append(y)
        out += own
    return sorted({(f + (1 << 63)) % (1 << 64) - (1 << 63) for f in out})


@pytest.mark.parametrize(("tile", "shared", "groups", "size"), [(4096, 4096, 40, 12), (8, 4096, 6, 150), (4, 1, 12, 40)])
def test_no_link_is_missed(spark, monkeypatch, tile, shared, groups, size):
    for name, value in (("TILE", tile), ("LEAST", tile), ("STRIP", 16), ("SHARED", shared)):
        monkeypatch.setattr(simhash, name, value)
    prints = near_prints(np.random.default_rng(groups), groups, size)
    want = rooted(prints, [(a, b) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 4])
    links = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in prints], "fingerprint long")).collect()]
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 4 for a, b in links)
    assert rooted(prints, links) == want and len(set(want.values())) > 1


@pytest.mark.parametrize("parts", [5, 6, 7, 8])
def test_near_fingerprints_share_bits(parts):
    rng = np.random.default_rng(parts)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, 4, replace=False).tolist():
            b[i] ^= np.uint64(1 << bit)
    assert (simhash.shared_keys(a, 4, parts) == simhash.shared_keys(b, 4, parts)).any(1).all()
    assert simhash.parts_for(10**5, 4) == 5 < simhash.parts_for(10**9, 4) < simhash.parts_for(10**12, 4)


def whole(rows, dims):
    """(vec_id, components) of the rows that take part."""
    return [(r[0], [math.floor(1024 * float(np.float32(x))) for x in r[1]]) for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == dims and all(x is not None and np.isfinite(x) for x in r[1])]


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def closest(v, entries):
    return min((apart(v, e), i) for i, e in enumerate(entries))[::-1]


def averaged(vectors, entries, chosen):
    out = []
    for i, e in enumerate(entries):
        own = [v for v, c in zip(vectors, chosen, strict=True) if c == i]
        out.append([sum(x) // len(own) for x in zip(*own, strict=True)] if own else e)
    return out


def clip(x):
    return min(x, (1 << 63) - 1)


def lloyd_brute(rows, dims, k, rounds):
    kept = whole(rows, dims)
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    vectors = [v for _, v in kept]
    for _ in range(rounds):
        centroids = averaged(vectors, centroids, [closest(v, centroids)[0] for v in vectors])
    last = [closest(v, centroids) for v in vectors]
    sums = {c: clip(sum(clip(d) for o, d in last if o == c)) for c, _ in last}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, c, clip(d), sums[c], clip(sum(clip(e) for _, e in last)), digest[c]) for (i, _), (c, d) in zip(kept, last, strict=True))


def codes_brute(rows, dims, parts, entries, rounds):
    width = dims // parts
    kept = whole(rows, dims)
    labels = [r[2] for r in rows if whole([r], dims)]
    first = sorted(kept)[:entries]
    books, last = [], []
    for p in range(parts):
        part = [v[p * width : (p + 1) * width] for _, v in kept]
        book = [v[p * width : (p + 1) * width] for _, v in first]
        for _ in range(rounds):
            book = averaged(part, book, [closest(v, book)[0] for v in part])
        books += [x for e in book for x in e]
        last.append([closest(v, book) for v in part])
    error = [clip(sum(d for _, d in row)) for row in zip(*last, strict=True)]
    by = {}
    for label, e in zip(labels, error, strict=True):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted((i, "".join(f"{c:02x}" for c, _ in row), e, clip(by[label]), digest) for (i, _), row, e, label in zip(kept, zip(*last, strict=True), error, labels, strict=True))


def filled(rows):
    return [(*r, *(None,) * (9 - len(r))) for r in rows]


def odd_vectors(dims, n=120, seed=1):
    """Clusters, ties, equal rows under one and several ids, repeated rows, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, dims))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.2 if i % 3 else 1, dims)).round(3).tolist(), i % 4 if i % 5 else None) for i in range(n)]
    rows += [(n + i, [0.25] * dims, 1) for i in range(40)] + [(n + 40 + i, [float(i % 2)] * dims, 2) for i in range(20)]
    rows += [rows[3], rows[3], (5, [0.5] * dims, 1), (None, [0.1] * dims, 1), (900, None, 1), (901, [float("nan")] * dims, None), (902, [None] * dims, 1), (903, [float("inf")] + [0.0] * (dims - 1), 1), (904, [], 1), (905, [0.5] * (dims + 1), 1)]
    return filled(rows)


@pytest.mark.parametrize(("dims", "k", "rounds"), [(4, 8, 10), (64, 5, 3), (3, 40, 4), (1, 1, 2)])
def test_clusters_equal_brute_force(spark, monkeypatch, dims, k, rounds):
    monkeypatch.setattr(clusters, "ROWS", 64)
    rows = odd_vectors(dims)
    got = clusters.clustered(spark.createDataFrame(rows, V), k, rounds, dims=dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect())) == lloyd_brute(rows, dims, k, rounds)


@pytest.mark.parametrize("sizes", [(1.0, 1e5, 1e9), (1e30, 1e38), (3e4, 6e4, 2e5)])
def test_vectors_of_any_size(spark, sizes):
    rng = np.random.default_rng(7)
    rows = filled([(i, (rng.normal(0, 1, 4) * sizes[i % len(sizes)]).astype(np.float32).tolist(), i % 3) for i in range(60)])
    df = spark.createDataFrame(rows, V)
    assert sorted(map(tuple, clusters.clustered(df, 5, 4, dims=4).collect())) == lloyd_brute(rows, 4, 5, 4)
    assert sorted(map(tuple, codes.compressed(df, dims=4, parts=2, entries=6).collect())) == codes_brute(rows, 4, 2, 6, 4)


@pytest.mark.parametrize(("dims", "parts", "entries", "rounds"), [(8, 4, 16, 4), (64, 4, 256, 2), (4, 1, 3, 0), (6, 6, 20, 3)])
def test_codes_equal_brute_force(spark, monkeypatch, dims, parts, entries, rounds):
    monkeypatch.setattr(codes, "ROWS", 50)
    rows = odd_vectors(dims)
    got = codes.compressed(spark.createDataFrame(rows, V), dims=dims, parts=parts, entries=entries, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == codes_brute(rows, dims, parts, entries, rounds)


def test_vectors_of_nothing(spark):
    none = spark.createDataFrame([], V)
    bad = spark.createDataFrame(filled([(1, None, 1), (2, [0.5], 1)]), V)
    for df in (none, bad):
        assert clusters.clustered(df).collect() == [] == codes.compressed(df).collect()
    with pytest.raises(ValueError, match="can't be cut"):
        codes.compressed(none, dims=10)


def test_labels_joined_by_shuffling(spark, monkeypatch):
    rows = odd_vectors(4)
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    got = codes.compressed(spark.createDataFrame(rows, V), dims=4, parts=2, entries=5)
    assert sorted(map(tuple, got.collect())) == codes_brute(rows, 4, 2, 5, 4)


@pytest.mark.parametrize("n", [1, 2, 9, 300])
def test_cover_tree_holds_its_rules(n):
    rng = np.random.default_rng(n)
    values = np.concatenate((rng.integers(-500, 500, (n, 3)), np.full((n // 3, 3), 7)))
    tree = clusters.CoverTree(values)
    rows = values[tree.order]
    assert sorted(tree.order.tolist()) == list(range(len(values)))
    for i in range(len(tree.first)):
        own = rows[tree.first[i] : tree.last[i]]
        centre = rows[tree.centre[i]]
        assert tree.first[i] <= tree.centre[i] < tree.last[i]
        assert np.sqrt(((own - centre) ** 2).sum(1)).max() <= tree.radius[i] * (1 + 1e-9)
        a, b = tree.children[i]
        if not b:
            assert len(own) <= clusters.LEAF or tree.radius[i] == 0
            continue
        assert tree.centre[a] == tree.centre[i] and tree.first[a] == tree.first[i] and tree.last[b - 1] == tree.last[i] and (tree.last[a : b - 1] == tree.first[a + 1 : b]).all()
        half = 2.0 ** (np.ceil(np.log2(tree.radius[i] / (1 + 1e-12))) - 1)
        assert tree.radius[a:b].max() <= half * (1 + 1e-9)
        centres = rows[tree.centre[a:b]]
        gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))[np.triu_indices(b - a, 1)]
        assert (gaps > half * (1 - 1e-9)).all()


def test_tight_clusters_are_dealt_by_nodes():
    rng = np.random.default_rng(2)
    values = (rng.integers(-10_000, 10_000, (4, 8))[rng.integers(0, 4, 1000)] + rng.integers(-20, 20, (1000, 8))).astype(np.int64)
    tree = clusters.CoverTree(values)
    rows = values[tree.order]
    first, last, number = clusters.Centroids(integers(values[:6])).deal(tree, rows)
    order = np.argsort(first)
    assert (np.repeat(number[order], (last - first)[order]) == Entries(integers(values[:6])).nearest(rows.T)[0]).all()
    assert len(first) < 800


def test_sums_and_limits():
    narrow, reach = limits(64)
    assert 64 * (narrow + reach) ** 2 < 1 << 62 and (reach - narrow) ** 2 > 64 * (2 * narrow) ** 2
    total = Totals(3, 2).add(np.array([0, 0, 2]), np.array([[1, -3], [2, -4], [5, 5]])).merge(Totals(3, 2).add(np.array([0]), integers(np.array([[1e30, 0.0]]))))
    assert total.means(integers(np.array([[9, 9]] * 3))).tolist() == [[(int(1e30) + 3) // 3, -7 // 3], [9, 9], [5, 5]]
