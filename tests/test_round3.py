"""Results that must not depend on the order of rows, and what is pushed below the joins."""

from __future__ import annotations

import json
import math
import os

import pandas as pd
import pytest

from pyspark.sql import functions as F

from tidemark.operators import capture, lab, replays, scores, series, specialist, stats, stretch, trades
from tidemark.operators.outcomes import LAG
from tidemark.plans import queries
from tidemark.streaming import replay

DATA = "/root/testdata/sf0.001"


def test_trial_metrics_sum_exactly(spark):
    steps = [0.1, 0.2, -0.3] * 10  # as doubles these sum to no zero, or to minus zero, by their order
    for rows in (steps, steps[::-1], sorted(steps)):
        df = spark.createDataFrame([(0, x, x - 0.01, x > 0) for x in rows], "trial int, pnl double, pnl_after double, won boolean").coalesce(1)
        r = capture.trial_metrics(df, 10.0).first()
        assert (r.n, r.wins, r.pnl, r.pnl_after, r.expectancy) == (30, 20, 0.0, -0.3, -0.01)
        assert math.copysign(1, r.pnl) == 1


def test_snapshots_of_one_second_are_the_same_in_any_order(spark):
    ends = spark.createDataFrame([("m", 100)], "market string, end long")
    for at, before, want in ((90, 60, 1.0), (30, 60, 2.0)):  # the nearest after the target; the last before it
        for values in ((1.0, 2.0), (2.0, 1.0)):
            points = spark.createDataFrame([("m", at, v) for v in values], "market string, at long, value double").coalesce(1)
            assert [tuple(r) for r in lab.snapshot_before(points, ends, "market", "at", "value", "end", before).collect()] == [("m", at, want)]
            assert [r.value for r in lab.snapshots_before(points, ends, "market", "at", "value", "end", {"a": before}).collect()] == [want]


def test_signals_read_the_trades_once(spark, tmp_path):
    rows = [("W", "C1", "BUY", "Up", "BTC", True, 100, 0.5, 10.0, 1), ("W", "C1", "BUY", "Up", "BTC", True, 90, 0.4, 1.0, 2), ("W", "C1", "SELL", "Up", "BTC", True, 80, 0.5, 1.0, 3), ("W", "C1", "BUY", "Up", "ETH", True, 70, 0.5, 1.0, 4), ("W", "C1", "BUY", "Up", "BTC", False, 60, 0.5, 1.0, 5)]
    spark.createDataFrame(rows, "wallet string, condition string, side string, outcome string, asset_class string, up_down boolean, t long, price double, notional double, trade int").write.parquet(f"{tmp_path}/trades")
    known = spark.createDataFrame([("c1", "up", 300, "btc-updown-5m-0", "BTC")], "condition string, winner string, expiry long, slug string, asset_class string")
    got = specialist.signals(specialist.candidates(spark.read.parquet(f"{tmp_path}/trades"), known, spark.createDataFrame([("w", "BTC")], "wallet string, asset_class string")))
    assert got.inputFiles() and not any(str(tmp_path) in f for f in got.inputFiles())
    assert [(r.t, r.trade, r.fold) for r in got.collect()] == [(90, 2, 1)]


def test_a_page_is_read_once_whatever_its_rows(spark):
    rows = [{"type": "TRADE", "proxyWallet": "0xA"}, {"type": "REDEEM"}, "no object"]
    lines = spark.createDataFrame([(json.dumps({"wallet_id": w, "payload": r}),) for w, r in (("W1", rows), ("W2", []), ("W3", {"value": rows}))] + [(" ",)], "value string")
    df = trades.pages(lines)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan.split("Generate")[1] and "sha2" not in plan.split("Generate")[0]  # below the Generate, by page
    got = sorted((r.page.wallet_id, r.place, r.row and r.row.type, r.first_wallet) for r in df.collect() if r.raw)
    assert got == [("W1", 0, "TRADE", "0xA"), ("W1", 1, "REDEEM", "0xA"), ("W3", 0, "TRADE", "0xA"), ("W3", 1, "REDEEM", "0xA")]
    assert [(r.page.wallet_id, r.row) for r in df.collect() if not r.raw] == [("W2", None)]
    found = {(r.violation, r.wallet) for r in trades.limit_violations(lines, limits={"wallets": 2, "rows_each": 1, "pages_each": 1, "rows": 3}).collect()}
    assert found == {("rows_exceed_limit", "w1"), ("rows_exceed_limit", "w3"), ("wallet_count_exceeds_limit", None), ("total_activity_rows_exceeds_limit", None)}


def test_a_quote_meets_its_path_once_for_both_sides(spark):
    quotes = spark.createDataFrame([(0, "m", "BTC", t * 1_000_000, p, 100.0) for t, p in ((0, 0.50), (1, 0.52), (2, 0.54), (2, 0.40))], "session int, market string, asset string, t long, price double, seconds_to_expiry double")
    df = capture.candidate_pool(quotes)
    assert df._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].count("YES") == 0  # sides come after the join
    got = {(r.side, r.t): (r.exit_at, round(r.pnl, 6), r.won) for r in df.collect() if r.t == 0}
    assert got == {("YES", 0): (2_000_000, 0.04, True), ("NO", 0): (2_000_000, 0.1, True)}


def test_a_score_at_a_bands_edge_is_in_the_band(spark):
    row = {"wallet": "w", "positions": 12, "partial_exit": 0, "fast": 8, "oversold_bounded_history": 2, "near_flat": 0, "fast_share": 8 / 12, "open_share": 7 / 12, "sell_only_share": 2 / 12, "sells_each": 1.0, "events_each": 0.9, "asset_concentration": 0.5, "outcome_concentration": 0.6, "dominant_asset": "btc"}
    s = scores.wallet_scores(spark.createDataFrame([tuple(row.values())], list(row))).first()
    assert (s.fast_crypto, s.bounded_history) == (20 * (8 / 12) + 2, 20 * (2 / 12) + 5)
    assert (s.score, s.score_band) == (25.0, "low_priority")  # 24.999999999999996 if the penalties are summed first


def test_draws_are_dealt_out_and_not_sorted(spark):
    rows = spark.createDataFrame([(k % 2, k, float(k % 2)) for k in range(100)] + [(2, 100, None)], "f int, k long, v double").coalesce(1)
    null = stats.matched_null(rows, "f", "k", "v", 4)
    plan = null._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ShuffledHashJoin" in plan
    assert [(r.trial, r["mean"]) for r in null.orderBy("trial").collect()] == [(t, 0.5) for t in range(4)]


class Map(dict):
    """A map state that counts how often it is asked."""

    calls = 0

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Value:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Handle:
    def __init__(self):
        self.maps = {}

    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, value):
        return self.maps.setdefault(name, Map())


def test_a_batch_reads_and_writes_a_market_once(spark):
    first = {"n": 1, "t": 0, "kind": replays.REFERENCE, "market": None, "question": None, "source": "live", "price": 100.0, "yes": None, "bid": None, "ask": None, "liquidity": None, "seconds_left": None, "reason": None}
    rows = [first, first | {"n": 2, "kind": replays.LIFECYCLE, "market": "m", "question": "q", "source": None, "price": None}]
    rows += [first | {"n": 3 + i, "kind": replays.SNAPSHOT, "market": "m", "source": None, "price": None, "yes": 0.5, "bid": 0.49, "ask": 0.51, "liquidity": 900.0, "seconds_left": 200.0} for i in range(100)]
    handle, machine = Handle(), replay.Replayer(LAG, 60.0, 10)
    machine.init(handle)
    found = pd.concat(list(machine.handleInputRows(("s", "a"), iter([pd.DataFrame(rows)]), None)))
    assert (len(found), set(found.reason)) == (100, {"external_move_below_threshold"})
    assert handle.maps["markets"][("m",)] == ("q", 0, 100.0, "live", 0.5, False) and handle.maps["references"][(0,)] == (100.0, "live")
    assert handle.maps["markets"].calls <= 3 and handle.maps["references"].calls <= 3


def test_sums_and_their_peaks_in_one_sort(spark):
    rows = [(k, i, i // 3, v) for k, values in (("a", [None, 1.0, -3.0, 5.0, None, -1.0, 2.0]), (None, [-2.0, 1.0, 4.0, -1.0])) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, i int, part int, v double")
    both = stretch.greatest(stretch.total(df, "k", "i", F.col("v"), "e", "part").withColumn("e", F.col("e") + 1.0), "k", "i", F.col("e"), "p", "part")
    got = stretch.peaked(df, "k", "i", F.col("v"), "e", "p", "part", 1.0)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, both.select("k", "e", "p").collect()))
    # One join of starts to rows, so the rows are read for it twice, not four times.
    assert series.drawdowns(df.select("k", "i", "v"), "k", "i", "v")._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["wallet_metrics_checks", "copyability", "wallet_score"])
def test_positions_are_made_once(spark, name):
    files = queries.QUERIES[name](spark, DATA).inputFiles()
    assert files and not any("lineitem" in f for f in files)


@pytest.mark.parametrize("kinds", ["FO", "OF"])
def test_of_equal_lines_the_first_in_the_table_is_kept(spark, tmp_path, kinds):
    import duckdb

    lines = [{"l_orderkey": k, "l_partkey": 7, "l_suppkey": 3, "l_linenumber": 2, "l_quantity": 5.0, "l_tax": 0.02, "l_returnflag": "R", "l_linestatus": s} for k in range(20) for s in kinds]
    pd.DataFrame(lines).to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = con.execute(queries.ORACLES["trade_pages"]).df()
    got = queries.QUERIES["trade_pages"](spark, str(tmp_path)).toPandas()
    assert set(got["activity_type"]) == {"TRADE" if kinds == "FO" else "REDEEM"}
    assert sorted(map(repr, got[want.columns].values.tolist())) == sorted(map(repr, want.values.tolist()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pages_shuffle_no_texts_that_can_be_made_later(spark):
    run = queries.QUERIES["trade_pages"](spark, DATA)._jdf.queryExecution()
    plan = run.optimizedPlan().toString()
    lists = [x for x in run.executedPlan().toString().splitlines() if "partial_collect_list" in x]
    assert len(lists) == 1 and "l_partkey" in lists[0] and "Rain in Rome" not in lists[0]  # lines by order: their own columns
    assert "sha2" not in plan  # trades by key: no hashes, as they aren't asked for
    assert sum("StructsToJson" in x for x in plan.splitlines()) == 1  # a page's text is made once, not for a filter too


def test_of_quotes_of_one_time_the_last_counts_on_both_sides(spark):
    rows = [(0, 0.50), (1, 0.54), (1, 0.58), (1, 0.51), (2, 0.51), (2, 0.51)]
    quotes = spark.createDataFrame([(i, 0, "m", "BTC", t * 1_000_000, p, 100.0) for i, (t, p) in enumerate(rows)], "quote int, session int, market string, asset string, t long, price double, seconds_to_expiry double")
    got = sorted((r.t, r.side, round(r.pnl, 6), r.won) for r in capture.candidate_pool(quotes, order="quote").collect())
    assert [x for x in got if x[0] == 0] == [(0, "NO", -0.08, False), (0, "YES", 0.08, True)]
    moves = [x[2] for x in got if x[0] == 1_000_000 and x[1] == "YES"]
    assert sorted(moves) == [-0.07, -0.03, 0.0]  # three quotes of one time are three entries


def test_trial_metrics_take_the_quotes_that_the_sql_takes(spark, tmp_path):
    import duckdb

    events = [{"event_id": i, "ts": pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i // 4), "user_id": i % 3, "event_type": "view", "value": float(i * 37 % 90), "props": "{}"} for i in range(600)]
    pd.DataFrame(events).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(queries.ORACLES["trial_metrics"]).df()
    got = queries.QUERIES["trial_metrics"](spark, str(tmp_path)).toPandas()
    assert len(want) and sorted(map(repr, got[want.columns].values.tolist())) == sorted(map(repr, want.values.tolist()))


def test_blank_lines_give_no_trades(spark):
    lines = spark.createDataFrame([(" ",), ("",), (None,), (json.dumps({"wallet_id": "W1", "payload": [{"type": "TRADE"}]}),), (json.dumps({"wallet_id": "W2", "payload": []}),)], "value string")
    assert [r.wallet_id for r in trades.normalised(lines).collect()] == ["w1"]
    assert sorted(r.page.wallet_id for r in trades.pages(lines).collect()) == ["W1", "W2"]
