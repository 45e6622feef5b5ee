"""Exact top-k, token sequences, packing."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from tidemark.llm import bitsliced, packing, sequences
from tidemark.llm.tokens import WordEncoder, default_path

V = "vec_id long, embedding array<float>, score int, dims int, own int"


def brute(rows, queries, k):
    def q(v):
        return None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(1024 * float(np.float32(x)))) for x in v]

    vectors = [(i, w) for i, v, *_ in rows if i is not None and (w := q(v)) is not None]
    scores: dict = {}
    for i, v in vectors:
        if i in queries:
            scores.setdefault(i, []).extend((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in vectors if j != i and len(w) == len(v))
    long = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    return sorted((i, n + 1, j, long(-s)) for i, found in scores.items() for n, (s, j) in enumerate(sorted(found)[:k]))


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 16).round(2 if i % 3 else 1).tolist(), 1, 2, 3) for i in range(400)]
    rows += [(400 + i, [0.5] * 16, 1, 2, 3) for i in range(30)] + [rows[0], (None, [0.1] * 16, 1, 2, 3), (500, None, 1, 2, 3), (501, [float("nan")] + [0.1] * 15, 1, 2, 3), (502, [None] + [0.1] * 15, 1, 2, 3), (503, [], 1, 2, 3), (504, [0.5, 0.25], 1, 2, 3), (505, [-90.0] * 16, 1, 2, 3)]
    rows += [(506, [], 1, 2, 3), (507, [], 1, 2, 3), rows[7], rows[405]]
    df = spark.createDataFrame(rows, V)
    wanted = {0, 7, 100, 405, 500, 501, 503, 504, 505}
    got = bitsliced.top_k(df, df.filter(df.vec_id.isin(*wanted)), 10).collect()
    assert sorted(map(tuple, got)) == brute(rows, wanted, 10)


def test_top_k_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "ROW_BLOCK", 50)
    monkeypatch.setattr(bitsliced, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1, 8).tolist(), 1, 2, 3) for i in range(300)]
    df = spark.createDataFrame(rows, V)
    wanted = set(range(0, 300, 30))
    assert sorted(map(tuple, bitsliced.top_k(df, df.filter("vec_id % 30 = 0"), 5).collect())) == brute(rows, wanted, 5)


def test_top_k_of_huge_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1, 4).tolist(), 1, 2, 3) for i in range(60)]
    rows += [(60 + i, (rng.normal(0, 1, 4) * 10.0 ** rng.integers(5, 38)).tolist(), 1, 2, 3) for i in range(40)]
    rows += [(100, [3e5, 1.0, 0.0, 0.0], 1, 2, 3), (101, [1e6] * 4, 1, 2, 3), (102, [1e9, -1e9, 0.0, 0.0], 1, 2, 3), (103, [3e38] * 4, 1, 2, 3), (104, [2e38] * 4, 1, 2, 3), (105, [float("inf")] * 4, 1, 2, 3)]
    df = spark.createDataFrame(rows, V)
    wanted = {0, 7, 60, 61, 75, 100, 101, 102, 103, 105}
    got = bitsliced.top_k(df, df.filter(df.vec_id.isin(*wanted)), 10).collect()
    assert sorted(map(tuple, got)) == brute(rows, wanted, 10)


def test_sql_of_top_k_takes_the_same_rows(spark, tmp_path):
    import duckdb

    from tidemark.llm import queries

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 4).tolist(), 1, 2, 3) for i in range(250)]
    rows += [rows[100], rows[3], (300, [], 1, 2, 3), (301, [], 1, 2, 3), (400, None, 1, 2, 3), (None, [1.0] * 4, 1, 2, 3), (500, [3e5, 1.0, 0.0, 0.0], 1, 2, 3), (501, [None] * 4, 1, 2, 3)]
    spark.createDataFrame(rows, V).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(queries.ORACLES["op1_bit_sliced_top_k"]).fetchall())
    assert sorted(map(tuple, queries.op1_bit_sliced_top_k(spark, str(tmp_path)).collect())) == want == brute(rows, {0, 100, 200, 300, 400, 500}, 10)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], V)
    assert bitsliced.top_k(df, df).collect() == []


def test_words_encode_as_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    texts = ["The cat, the CAT!! don't x.y a.b", "", "ÉTÉ naïve 漢字 \U0001f600 éá. <|endoftext|>x", "a\tb\r\nc \x0b d", "'s 'll it's", "x" * 300, "##$$%% a###b", "A <|ENDOFTEXT|> B", "ÀÖØÞß µª"]
    encode = WordEncoder(default_path())
    for _ in range(2):
        assert [e.tolist() for e in encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_sequences_round_trip(spark, odd, odd_rows, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    path = str(tmp_path / "ids")
    got = sequences.round_trip(odd, path, length=64).collect()
    want = sorted((-1 if i is None else i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t, *_ in odd_rows for ids in [[*whole.encode(t or "", add_special_tokens=False).ids, 1]])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *[r.n_tokens for r in ordered]])[:-1].tolist()
    assert [r.doc_id or 0 for r in ordered] == sorted(r.doc_id or 0 for r in ordered)
    from pyarrow import fs

    for name, documents, ids in sequences.listing(path)["files"]:
        file = sequences.Sequences(fs.LocalFileSystem(), f"{path}/part-{name}")
        row, mask = file.row(file.rows - 1)
        assert len(row) == 64 and file.rows == -(-ids // 64)
        assert sum(int((file.row(r)[1] == 2).sum()) for r in range(file.rows)) == documents
        assert not row.flags.owndata


def test_sequences_of_nothing(spark, empty):
    assert sequences.round_trip(empty).collect() == []


def total(held, capacities, cost):
    sizes = np.array(sorted(capacities))
    return sum(cost(int(c)) for c in sizes[np.searchsorted(sizes, held)])


@pytest.mark.parametrize("seed", range(3))
def test_packing_fills_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(4096, rng.lognormal(6, 1, 3000).astype(np.int64) + 1)
    bins, capacity = packing.pack(lengths)
    held = np.bincount(bins, lengths)
    sizes = np.array(packing.CAPACITIES)
    assert (held <= capacity).all() and (capacity == sizes[np.searchsorted(sizes, held)]).all()
    assert held.sum() / capacity.sum() > 0.95
    each = [total(packing.best_fit(lengths, packing.CAPACITIES, k)[1], packing.CAPACITIES, packing.default_cost) for k in (None, 0, 1, 2, 3)]
    assert sum(map(packing.default_cost, capacity.tolist())) == pytest.approx(min(each)) and each[0] < 1.01 * min(each)


def optimum(lengths, capacities, cost):
    """The least cost over all partitions of the pieces into bins."""
    best = [float("inf")]

    def place(i, held):
        if i == len(lengths):
            best[0] = min(best[0], total(np.array(held), capacities, cost))
            return
        for b in range(len(held)):
            if held[b] + lengths[i] <= max(capacities):
                place(i + 1, [h + lengths[i] * (k == b) for k, h in enumerate(held)])
        place(i + 1, [*held, lengths[i]])

    place(0, [])
    return best[0]


def test_packing_is_near_the_optimum_of_small_cases():
    rng = np.random.default_rng(8)
    ratios = []
    for _ in range(150):
        capacities = [int(c) for c in sorted(rng.choice([8, 12, 16, 24, 32], int(rng.integers(1, 4)), replace=False))]
        lengths = rng.integers(1, capacities[-1] + 1, int(rng.integers(1, 8)))
        cost = lambda c: c * (1 + c / 64) + 2
        bins, capacity = packing.pack(lengths, capacities, cost)
        held = np.bincount(bins, lengths)
        assert (held <= capacity).all() and len(bins) == len(lengths)
        ratios.append(sum(map(cost, capacity.tolist())) / optimum(lengths.tolist(), capacities, cost))
    assert min(ratios) > 1 - 1e-9 and max(ratios) < 1.35 and np.mean(np.array(ratios) < 1 + 1e-9) > 0.85


def test_best_fit_takes_the_tightest_bin():
    bins, held = packing.best_fit(np.array([60, 50, 40, 35]), [100], 0)
    assert bins.tolist() == [0, 1, 0, 1] and held.tolist() == [100, 85]


def test_least_cost_size_is_opened():
    # At these prices two pieces of 5 cost less in one bin of 10 than in two of 6; a piece that stays alone gets the 6.
    cost = {6: 6.0, 10: 9.0}.get
    assert packing.best_fit(np.array([5, 5]), [6, 10], None, cost)[1].tolist() == [10]
    assert packing.best_fit(np.array([5]), [6, 10], None, cost)[1].tolist() == [5]
    # At these, two of 6.
    assert packing.best_fit(np.array([5, 5]), [6, 10], None, {6: 4.0, 10: 9.0}.get)[1].tolist() == [5, 5]
    # Ties: equal pieces, and sizes of equal cost a token, of which the smaller opens.
    assert packing.best_fit(np.array([5, 5, 5, 5]), [5, 10], None, float)[1].tolist() == [5, 5, 5, 5]
    assert packing.pack(np.zeros(0, np.int64))[0].tolist() == []


def test_packing_of_documents(spark, odd, odd_rows, empty):
    got = packing.packed(odd, group=7).collect()
    encode = WordEncoder(default_path())
    want = sorted((-1 if i is None else i, len(encode([t or ""])[0]) + 1) for i, t, *_ in odd_rows)
    total: dict = {}
    for r in got:
        assert r.bin_offset + r.n_tokens <= r.bin_capacity
        total.setdefault(r.doc_id, 0)
        total[r.doc_id] += r.n_tokens
    merged: dict = {}
    for i, n in want:
        merged[i] = merged.get(i, 0) + n
    assert {-1 if k is None else k: v for k, v in total.items()} == merged
    by_bin: dict = {}
    for r in got:
        by_bin.setdefault(r.bin_id, []).append((r.bin_offset, r.n_tokens))
    for parts in by_bin.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0, *[p[1] for p in parts]])[:-1].tolist()
    assert packing.packed(empty).collect() == []
