"""Golden values of the scalar expressions, outcomes, metrics and positions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.functions import quantiles as Q
from tidemark.operators import asof, metrics, outcomes, series, stats, tables, trading
from tidemark.streaming import positions


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scores_and_prices(spark):
    assert value(spark, X.edge_score(F.lit(0.8), F.lit(0.6), F.lit(0.5), F.lit(0.9))) == 0.69
    assert value(spark, X.executable_price(F.lit("NO"), F.lit(0.48), F.lit(0.5))) == pytest.approx(0.52)
    assert value(spark, X.book_imbalance(F.lit(90.0), F.lit(110.0))) == pytest.approx(-0.1)
    assert value(spark, X.midpoint(F.lit(None).cast("double"), F.lit(0.5))) == 0.5
    assert value(spark, X.price_bucket(F.lit(0.25))) == "0.25-0.50"
    assert value(spark, X.slug_epoch(F.lit("btc-updown-5m-1700000000"))) == 1_700_000_000
    assert value(spark, X.plain_decimal(F.lit("1.500").cast("decimal(10,3)"))) == "1.5"
    assert value(spark, X.typed(F.lit(" "), "int")) is None
    assert value(spark, X.only_match(F.lit("btc and eth"), {"BTC": "btc", "ETH": "eth"})) is None


def test_intervals(spark):
    assert value(spark, X.wilson_clamped(F.lit(0), F.lit(0))).asDict() == {"low": 0.0, "high": 0.0}
    assert value(spark, X.wilson_open(F.lit(0), F.lit(0))).asDict() == {"low": 0.0, "high": 1.0}
    assert value(spark, X.proportion_z(F.lit(5), F.lit(10), F.lit(1.0))) == 0.0


def test_quantile_rules(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10)], "x double")
    assert tuple(df.agg(Q.linear("x", 0.95), Q.nearest_rank("x", 0.95), Q.truncated("x", 0.5)).first()) == (pytest.approx(8.8), 10.0, 3.0)


def test_probability_metrics(spark):
    df = spark.createDataFrame([(0, 0.25), (1, 0.75)], "y int, p double")
    m = metrics.probability_metrics(df, "y", "p").first()
    assert (m.brier, m.accuracy) == (0.0625, 1.0)
    assert m.log_loss == pytest.approx(0.2876820725)
    assert metrics.auc(df, "y", "p").first().auc == 1.0


def test_logistic_regression(spark):
    df = spark.createDataFrame([(-1.0, 0), (-0.5, 0), (0.5, 1), (1.0, 1)], "x double, y int")
    w = stats.logistic_fit(df, ["x"], "y")
    p = {r.x: r.p for r in stats.logistic_predict(df, ["x"], w).collect()}
    assert p[-1.0] < 0.5 < p[1.0]


@pytest.mark.parametrize(
    ("change", "status", "outcome"),
    [({}, "resolved", 1), ({"closed": False}, "unresolved", None), ({"outcomePrices": ["0.5", "0.5"]}, "ambiguous", None), ({"conditionId": "other"}, "missing", None), ({"cancelled": True}, "cancelled", None), ({"outcomePrices": ["x", "0"]}, "malformed", None)],
)
def test_resolutions(spark, change, status, outcome):
    market = {"conditionId": "c", "closed": True, "cancelled": False, "umaResolutionStatus": "resolved", "outcomes": ["Up", "Down"], "outcomePrices": ["1", "0"]} | change
    df = spark.createDataFrame([("c", json.dumps({"markets": [market]}))], "id string, payload string")
    r = outcomes.resolutions(df, "payload", "id").first().resolution
    assert (r.status, r.outcome) == (status, outcome)


def lag(spark, reference=60_180.0, market=0.52, liquidity=10_000.0, left=100.0, bid=0.51, ask=0.53):
    return value(spark, outcomes.lag_measurement(F.lit(reference), F.lit(60_000.0), F.lit(market), F.lit(0.51), F.lit(-2.0), F.lit(liquidity), F.lit(left), F.lit(bid), F.lit(ask)))


def test_lag_measurement_by_hand(spark):
    # 30 basis points: expected 0.03, made 0.01, so a third; strength 1; score 2/3; confidence 0.7 * 2/3 + 0.2 + 0.1 * 0.8.
    m = lag(spark)
    assert (m.direction, m.qualified, m.reason, m.lag_seconds) == ("UP", True, "qualified_external_move_not_repriced", 0.0)
    assert (m.external_change, m.market_change, m.lag_score, m.confidence) == (0.003, 0.01, round(2 / 3, 6), round(0.7 * 2 / 3 + 0.28, 6))
    # Two thresholds are half the strength; a fall is aligned with a fall.
    m = lag(spark, reference=59_952.0, market=0.51)
    assert (m.direction, m.lag_score, m.confidence) == ("DOWN", 0.5, round(0.35 + 0.1 + 0.08, 6)) and m.reason == "confidence_below_threshold"
    assert lag(spark, liquidity=499.0, left=1.0).reason == "liquidity_below_minimum"
    assert lag(spark, left=19.0, reference=60_000.0).reason == "near_expiry_insufficient_time"
    assert lag(spark, reference=60_000.0).reason == "external_move_below_threshold"
    assert lag(spark, market=0.5296).reason == "polymarket_already_repriced"
    guard = lambda q, s: tuple(value(spark, outcomes.entry_guard(F.lit(q), F.lit("r"), F.lit(s))))
    assert [guard(True, 29.0), guard(True, 30.0), guard(False, 1.0)] == [(False, "late_entry_window"), (True, "r"), (False, "r")]


def test_window_states_by_hand(spark):
    state = lambda now, end=300.0: value(spark, outcomes.window_state(F.lit(float(now)), F.lit(0.0), F.lit(end)))
    assert [state(t) for t in (-1, 0, 30, 31, 239, 240, 299, 300)] == ["WAITING_FOR_NEXT_WINDOW", "NEWLY_OPENED", "NEWLY_OPENED", "ACTIVE", "ACTIVE", "NEAR_EXPIRY", "NEAR_EXPIRY", "CLOSED"]
    assert state(20, 40.0) == "NEWLY_OPENED"
    rows = [("m", t, 0, 300, a) for t, a in ((-5, None), (50, True), (60, False), (70, None), (80, True), (250, False), (301, None))]
    got = outcomes.tracked_states(spark.createDataFrame(rows, "market string, ts int, start int, end int, ok boolean"), "market", "ts", "start", "end", "ok").orderBy("ts").collect()
    assert [r.state for r in got] == ["WAITING_FOR_NEXT_WINDOW", "ACTIVE", "QUOTE_UNAVAILABLE", "QUOTE_UNAVAILABLE", "ACTIVE", "QUOTE_UNAVAILABLE", "CLOSED"]


def test_current_market_and_helpers(spark):
    markets = spark.createDataFrame([("a", "m1", 0, 300), ("a", "m2", 200, 500), ("b", "m3", 400, 700), ("b", "m4", 600, 900), ("c", "m5", 0, 100)], "asset string, market_id string, start int, end int")
    assert {r.asset: r.market_id for r in outcomes.current_market(markets, "asset", F.lit(250)).collect()} == {"a": "m2", "b": "m3"}
    assert value(spark, X.same_text(F.lit(" Up "), F.lit("uP"))) is True
    assert [value(spark, X.measured_delay(F.lit(x).cast("double"))) for x in (None, -1.0, 0.0)] == ["unknown", "invalid", "measured"]
    links = spark.createDataFrame([("k", 1, 10, "h1", None), ("k", 2, 11, "h2", "h1"), ("k", 4, 12, "h3", "h2"), ("k", 5, 9, "h4", "h3")], "k string, n int, t int, own string, before string")
    assert tuple(series.chain_violations(links, "k", "n", "t", "own", "before").first()) == ("k", 4, 2)
    null = spark.createDataFrame([(float(i),) for i in range(99)], "m double")
    assert (got := stats.empirical_p(null, "m", 95.0).first()).p == pytest.approx(0.05) and got.n == 99
    one, two = (trading.fingerprint(spark.createDataFrame(r, "a int, b string"), ["a", "b"]).first() for r in ([(1, "x"), (2, "y")], [(2, "y"), (1, "x")]))
    assert one == two


def test_recursive_mean_equals_its_definition(spark):
    import random

    rng = random.Random(3)
    rows = [(k, i, None if rng.random() < 0.1 else rng.uniform(-5, 5)) for k in range(2) for i in range(700)]
    for alpha in (0.12, 0.9, 0.001):
        got = {(r.k, r.t): r.ewma for r in series.ewma(spark.createDataFrame(rows, "k int, t int, v double"), "k", "t", "v", alpha).collect()}
        m: dict = {}
        for k, t, v in rows:
            m[k] = m.get(k) if v is None else v if m.get(k) is None else alpha * v + (1 - alpha) * m[k]
            assert got[k, t] is None if m[k] is None else got[k, t] == pytest.approx(m[k], rel=1e-9, abs=1e-12)


def test_bootstrap_and_logistic_within_tolerance(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    values = rng.normal(0.3, 1, 600)
    df = spark.createDataFrame([(i // 3, float(v)) for i, v in enumerate(values)], "cluster int, v double")
    r = stats.bootstrap_mean(df, "cluster", "v", 2000).first()
    sums = values.reshape(-1, 3).sum(1)
    half = 1.96 * np.std(sums - 3 * values.mean()) / 3 / np.sqrt(200)
    assert r["mean"] == pytest.approx(values.mean()) and r.low == pytest.approx(values.mean() - half, abs=0.25 * half) and r.high == pytest.approx(values.mean() + half, abs=0.25 * half)
    x = rng.normal(0, 1, (400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.4 + x @ [1.0, -2.0])))).astype(int)
    w = stats.logistic_fit(spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int"), ["a", "b"], "y", l2=1.0)
    z = np.column_stack([np.ones(400), x])
    p = 1 / (1 + np.exp(-z @ w))
    assert np.abs(z.T @ (p - y) + np.array([0.0, w[1], w[2]])).max() < 1e-6


def test_asof_by_stretches_equals_plain(spark):
    left = spark.range(500).select((F.col("id") % 7).alias("k"), (F.col("id") * 37 % 1000).alias("t"), "id")
    right = spark.range(90).select((F.col("id") % 9).alias("k"), (F.col("id") * 53 % 1000).alias("t"), F.col("id").alias("v"))
    for direction in ("backward", "forward", "nearest"):
        plain = asof.asof_join(left, right, "k", "t", direction=direction).collect()
        assert sorted(plain) == sorted(asof.asof_join(left, right, "k", "t", direction=direction, bucket=50).collect())


def test_purge_and_embargo(spark):
    df = spark.range(20).withColumnRenamed("id", "w")
    parts = {r.w: r.part for r in tables.purged_split(df, "w", 1, 1).collect()}
    assert [parts[i] for i in (12, 13, 14, 15, 16, 17, 18)] == ["train", "purged", "embargoed", "validation", "purged", "embargoed", "test"]


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    schema = "key long, id long, t long, value double, signal boolean"
    rows = [(1, 1, 10, 100.0, True), (1, 2, 20, 110.0, True), (1, 3, 30, 125.0, False), (1, 4, 40, 90.0, True), (1, 5, 50, 60.0, False)]
    source = str(tmp_path / "in")
    stream = lambda: positions.stream_positions(spark.readStream.schema(schema).parquet(source))
    for part in (rows[:2], rows[2:4], rows[1:5]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        out = positions.run_to_table(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    want = positions.batch_positions(spark.createDataFrame(rows, schema)).collect()
    assert sorted(out.collect()) == sorted(want)
    assert sorted((r.entry_id, r.exit_id, r.reason) for r in want) == [(1, 3, "target"), (4, 5, "stop")]


def test_polls(spark):
    seen = spark.createDataFrame([("w", 1, "a"), ("w", 2, "a"), ("w", 2, "b"), ("w", 3, "b"), ("w", 4, "a")], "wallet string, poll int, trade string")
    rows = {r.trade: r for r in positions.polls(seen, "wallet", "poll", "trade").collect()}
    assert (rows["a"].kind, rows["a"].gaps, rows["b"].kind) == ("baseline", 1, "new")
