"""The pipeline's stages, one after the other, and the registered corpus queries."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from test_duplicates import brute
from tidemark.llm import pii, queries
from tidemark.llm.language import has_letter
from tidemark.llm.neardup import near_duplicates
from tidemark.llm.pii import base_spans
from tidemark.llm.tokens import WordEncoder, default_path

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids
        if name != "best-fit packing":
            assert docs.columns == columns
        if name == "MinHash near-dedup":
            assert all(r.kept for r in near_duplicates(docs).collect())
        if name in ("PII", "best-fit packing"):
            assert left == ids
        seen.append(len(left))
        ids = left
    assert seen == sorted(seen, reverse=True) and seen[-1] > 100


def test_odd_rows_pass_all_stages(spark, odd, empty):
    for start in (odd, empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            before = [tuple(r) for r in docs.collect()]
            out = stage(spark, docs, DATA)
            rows = [tuple(r) for r in out.collect()]
            ids = lambda x: sorted(-1 if r[0] is None else r[0] for r in x)
            if name == "language ID":
                assert all(has_letter(r[1]) for r in rows) and set(rows) <= set(before)
            elif name == "MinHash near-dedup":
                kept = {i for i, (_, c) in brute(before).items() if i == c} | {None}
                assert sorted(rows, key=str) == sorted([r for r in before if r[0] in kept], key=str)
            elif name == "benchmark decontamination":
                assert set(rows) <= set(before) and len(rows) >= len(before) - 1
            elif name == "PII":
                model = pii.detector()
                assert ids(rows) == ids(before) and not any(base_spans(r[1] or "") for r in rows)
                assert all(r[4] == (None if r[1] is None else len(r[1])) for r in rows) and model.thresholds
            else:
                assert set(ids(rows)) == set(ids(before))
                encode = WordEncoder(default_path())
                assert sum(r[3] for r in rows) == sum(len(encode([r[1] or ""])[0]) + 1 for r in before)
            docs = spark.createDataFrame(rows, out.schema)
        assert (start is odd) == bool(docs.count())


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA).toPandas()
    want = con.execute(queries.ORACLES[name]).df()[got.columns]
    order = [c for c in ("query_id", "rank", "doc_id", "vec_id") if c in got.columns]
    kinds = {c: "str" if c in ("code", "codebooks_sha256", "centroid_sha256") else "int64" for c in got.columns}
    got, want = (d.sort_values(order).reset_index(drop=True).astype(kinds) for d in (got, want))
    assert got.equals(want)
