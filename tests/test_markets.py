"""Trade pages, behaviour, outcomes, quote states, replays, specialists, experiments and sealed splits, on cases worked by hand."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import behaviour, evaluation, governance, lab, outcomes, replay, specialist, structural, trades


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def s(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(
    ("title", "slug", "want"),
    [
        ("Bitcoin Up or Down", "x", ("fast_crypto_up_down", "BTC", True)),
        ("x", "sol-updown-5m-1", ("fast_crypto_up_down", "SOL", True)),
        ("Will ETH close", "eth-up", ("fast_crypto_up_down", "ETH", True)),
        ("Ethereum at 5k", "ethereum-5k", ("crypto_other", "ETH", False)),
        ("Method of rain", None, ("weather", "other", False)),
        ("Solid ethics", None, ("other", "other", False)),
    ],
)
def test_market_classes(spark, title, slug, want):
    assert tuple(value(spark, trades.market_class(s(title), s(slug)))) == want


def test_classes_of_activity_and_positions(spark):
    assert [value(spark, trades.entry_or_exit(s(a), s(b))) for a, b in (("trade", "buy"), ("TRADE", "SELL"), ("redeem", None), ("REWARD", "BUY"), (None, "BUY"))] == ["entry_candidate", "exit_candidate", "resolution_candidate", "rebate_or_other", "unknown"]
    assert [value(spark, trades.snapshot_class(s(t), s(u))) for t, u in (("BTC 5m", ""), ("Snow", ""), ("bitcoin", "x"), ("a", "b"))] == ["fast_crypto", "weather", "crypto_other", "other"]
    assert [value(spark, trades.exposure(s(t), s(""))) for t in ("Bitcoin", "eth now", "method", "sol day")] == ["BTC", "ETH", "OTHER", "SOL"]
    assert [value(spark, trades.timeframe(s(t), s(u))) for t, u in (("", "a-15m"), ("5-min", ""), ("up or down", ""), ("", ""))] == ["15m", "5m", "updown_window_unknown", "other_timeframe"]
    assert value(spark, trades.wallet_address(s("bob"), s("0x" + "aB" * 20 + "/x"))) == "0x" + "aB" * 20
    one, two = "0x" + "1" * 40, "0x" + "2" * 40
    assert value(spark, trades.address_candidates(s(json.dumps({"a": [{"u": "Bob", "w": one}, {"u": "eve", "w": two}]})), s("bob"))) == [one]
    assert value(spark, trades.address_candidates(s(json.dumps({"a": {"w": one, "k": [two]}})), s("nobody"))) == [one, two]
    assert value(spark, trades.page_data(s('<html><script id="__NEXT_DATA__" type="x">{"a": 1}</script>'))) == '{"a": 1}'
    assert value(spark, trades.outcome_prices(s('["Up","Down"]'), s('["0.4","0.6"]'))) == {"Up": 0.4, "Down": 0.6}
    assert value(spark, trades.forbidden(s("total_PnL"))) and not value(spark, trades.forbidden(s("size")))
    assert value(spark, trades.slug(s("BTC"), F.lit(300))) == "btc-updown-5m-300"


def test_pages(spark):
    row = {"title": "Bitcoin Up or Down", "slug": "x", "eventSlug": "e", "type": "trade", "timestamp": 1700000000, "asset": "t", "conditionId": "0xC", "side": "buy", "price": 0.4, "size": "10.0", "transactionHash": "0xH", "outcome": "Up"}
    more = row | {"usdcSize": 5, "size": 3, "eventSlug": None, "timestamp": "soon", "title": "x"}
    lines = [{"wallet_id": "0xW", "fetched_at": "2024", "url": "u", "payload": {"value": [row, row, more, "junk"]}}, {"payload": [row | {"proxyWallet": "0xP"}]}, {"user": "U", "payload": []}]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("",)], "value string")
    got = trades.normalised(df).orderBy("wallet_id", "place").collect()
    assert [(r.wallet_id, float(r.notional), r.notional_source, r.quality) for r in got] == [("0xp", 4.0, "computed_price_times_size", "computed_notional"), ("0xw", 4.0, "computed_price_times_size", "computed_notional"), ("0xw", 4.0, "computed_price_times_size", "computed_notional"), ("0xw", 5.0, "endpoint_usdcSize", "missing_event_slug;timestamp_parse_failed;non_crypto_or_unclassified_market")]
    assert got[1].dedupe_key == "0xw|activity_primary|0xh|0xc|t|1700000000|buy|0.4|10" and got[1].lifecycle_group_key == "0xw|0xc|t|Up"
    unique = trades.deduplicated(trades.normalised(df))
    assert sorted(r.copies for r in unique.collect()) == [1, 1, 2]
    gates = {r.gate: r.passed for r in trades.ingestion_gates(unique, 1).collect()}
    assert not gates["duplicate_rate"] and not gates["timestamp_parse_rate"] and gates["market_classification_coverage"] and not gates["required_field_coverage"]
    bad = trades.limit_violations(df, limits={"wallets": 2, "rows_each": 2, "pages_each": 3, "rows": 99}).collect()
    assert sorted((r.violation, r.wallet) for r in bad if r.wallet) == [("rows_exceed_limit", "0xw")] and [r.violation for r in bad if not r.wallet] == ["wallet_count_exceeds_limit"]
    assert [r.place for r in trades.ordered(trades.normalised(df)).orderBy("place").collect()] == [0, 1, 2, 3]
    assert trades.normalised(spark.createDataFrame([], "value string")).count() == 0


def test_behaviour_by_hand(spark):
    assert [value(spark, behaviour.entry_bucket(F.lit(p))) for p in (0.0, 0.1, 0.2, 0.599, 1.0, 1.1)] == ["0_10c", "10_20c", "20_40c", "40_60c", "80_100c", "outside_0_100c"]
    assert value(spark, behaviour.position_size(F.lit(0.0), F.lit(0.0), F.lit(7.0))) == 7.0
    rows = [("w", "fast_crypto", "BTC", "Up" if i % 2 else "no", 0.15, 10.0, "closed", 1.0, "btc-5m", "") for i in range(12)]
    r = behaviour.behaviour(spark.createDataFrame(rows, "wallet string, market_type string, exposure string, outcome string, avg_price double, size double, status string, cur_price double, slug string, title string"))
    b = r.first()
    # 20 - 10 for unknown exits, + 15 fast, + 5 balanced, + 5 cheap, - 10 delay.
    assert (b.wallet_class, b.delay_risk, b.fill_uncertainty, b.completeness, b.score, b.yes_no_balance, b.resolution_like_share, b.repeated_cheap) == ("fast_crypto_focused", "high", "medium", "partial_public_snapshot", 25, 1.0, 1.0, "yes")
    assert r.select(behaviour.clusters().alias("c")).first().c == ["fast_crypto_directional", "cheap_side_buyer"] and len(r.select(behaviour.feature_vector().alias("v")).first().v) == 15
    score = lambda *a: value(spark, behaviour.snapshot_score(*map(F.lit, a)))
    assert [score(False, 9, 9, 0.1, True), score(True, 0, 0, 0.1, True), score(True, 9, 20, 0.3, True), score(True, 9, 0, 0.5, False)] == [0, 5, 55, 5]
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [1.0, 1.0]), ("d", [0.0, 0.0]), ("e", [3.0, 0.0])], "w string, v array<double>")
    got = behaviour.similar_to(vectors, vectors.filter("w in ('a', 'd')"), "w", "v", 2).orderBy("asked", "place").collect()
    assert [(r.asked, r.w, round(r.similarity, 3)) for r in got] == [("a", "b", 1.0), ("a", "e", 1.0), ("d", "a", 0.0), ("d", "b", 0.0)]
    acts = spark.createDataFrame([("w", "Trade", 100, 200), ("w", "buy", 0, 200), ("w", "sell", 300, 200), ("w", "reward", 1, 2), ("w", "trade", None, 9)], "w string, kind string, at long, end long")
    assert tuple(behaviour.late_entries(acts, "w", "kind", "at", "end").first()) == ("w", 4, 3, 1)


def test_outcome_rules(spark):
    win = lambda closed, status, auto, names, prices: tuple(value(spark, outcomes.winning_outcome(F.lit(closed), s(status), F.lit(auto), s(names), s(prices))))
    two = '["Up","Down"]'
    assert win(True, None, False, two, '["0.9995","0.0005"]') == ("resolved", "Up", "terminal_outcome_prices")
    assert win(False, "resolved", True, two, '["1","0"]')[2] == "market_not_closed" and win(True, "Proposed", False, two, '["1","0"]')[2] == "resolution_status:proposed"
    assert win(True, "proposed", True, two, '["0","1"]')[1] == "Down" and win(True, "", False, two, '["1"]')[2] == "outcome_price_length_mismatch"
    assert win(True, "", False, "nonsense", '["1","0"]')[2] == "invalid_outcome_prices" and win(True, "", False, two, '["0.6","0.4"]') == ("insufficient_evidence", None, "non_terminal_or_ambiguous_outcome_prices")
    got = value(spark, outcomes.resolved_expiry(s(" "), s("sol-updown-5m-1700000000")))
    assert (got.source, got.confidence) == ("market_slug_epoch_plus_300", "medium") and got.expiry.timestamp() == 1700000300
    assert value(spark, outcomes.resolved_expiry(s("bad"), s("x"))).source == "source_dataset" and value(spark, outcomes.resolved_expiry(s(None), s("x"))).confidence == "none"


Q = "session int, market string, asset string, t long, quote_t long, bid double, ask double, bid_size double, ask_size double, seconds_to_expiry double"


def test_states_episodes_and_passive_quotes(spark):
    q = lambda sec, bid, ask, left=200.0, age=0, size=200.0: (1, "m", "BTC", sec * 10**6, (sec - age) * 10**6, bid, ask, size, size, left)
    rows = [q(0, 0.40, 0.50), q(2, 0.41, 0.50), q(6, 0.39, 0.51), q(9, 0.45, 0.45), q(12, 0.46, 0.45), q(20, 0.40, None), q(30, 0.40, 0.50, age=6)]
    states = structural.quote_states(spark.createDataFrame(rows, Q))
    flags = [(r.valid, r.stale, r.crossed, r.locked, r.wide) for r in states.orderBy("t").collect()]
    assert flags == [(True, False, False, False, True)] * 3 + [(True, False, False, True, False), (True, False, True, False, False), (False, False, False, False, False), (True, True, False, False, True)]
    e = {r.kind: r for r in structural.state_episodes(states).collect()}
    assert (e["wide"].states, e["wide"].seconds, e["wide"].persists_5, e["locked"].states, e["crossed"].persists_2) == (3, 6.0, True, 1, False)
    assert e["wide"].margin == pytest.approx(-0.10) and e["wide"].capacity == 125.0
    c = {r.candidate: r for r in structural.structural_candidates(states, structural.state_episodes(states), 2.0).collect()}
    assert (c["locked_book"].states, c["complete_set_acquisition"].states, c["temporary_wide_spread_capture"].episodes, c["multi_outcome_pricing_inconsistency"].states) == (1, 0, 1, 0)
    assert c["complete_set_acquisition"].best_margin == pytest.approx(0.0) and c["locked_book"].states_per_hour == 0.5
    starts = structural.state_episodes(states).filter("kind = 'wide'").select("session", "market", "first.*")
    got = {r.policy: r for r in structural.passive_attempts(starts, structural.histories(states)).collect()}
    # Posted 0.40 / 0.50; 2 s and 2 s to cancel: the exit is the state at 6 s, where both sides were hit.
    p = got["all_assets_2s"]
    assert (p.bid_shares, p.ask_shares, p.matched) == (46.875, 46.875, 46.875) and p.pnl == pytest.approx(46.875 * 0.09)
    assert set(got) == {"all_assets_2s", "all_assets_5s"}
    summary = structural.passive_summary(structural.passive_attempts(starts, structural.histories(states)), 1.0).collect()
    assert all(r.two_sided == 1 and r.largest_asset_share == 1.0 and not r.passes for r in summary)


def test_replays_by_hand(spark):
    quotes = [("m", sec * 10**6, b, a, 100.0, 100.0) for sec, b, a in ((0, 0.40, 0.42), (3, 0.41, 0.43), (20, 0.45, 0.47), (31, 0.50, 0.52), (61, 0.30, 0.32))]
    quotes = spark.createDataFrame(quotes, "market string, t long, bid double, ask double, bid_size double, ask_size double")
    signals = spark.createDataFrame([(1, "m", 1, "BTC", "YES", 0, 90.0), (2, "m", 1, "BTC", "NO", 58 * 10**6, 90.0)], "signal int, market string, session int, asset string, side string, t long, seconds_to_expiry double")
    got = {(r.signal, r.horizon, r.direction): r for r in replay.slower_horizons(signals, quotes).collect()}
    # Entry at 3 s at 0.43, exit at 31 s at 0.50; the other side pays 1 - 0.41 and gets 1 - 0.52.
    assert got[1, 30, "continuation"].pnl == pytest.approx(0.07 - 0.005) and got[1, 30, "mean_reversion"].pnl == pytest.approx(0.48 - 0.59 - 0.005)
    assert set(got) == {(1, h, d) for h in (30, 60) for d in replay.DIRECTIONS}
    s0 = {r.horizon: r for r in replay.horizon_summary(replay.slower_horizons(signals, quotes)).filter("direction = 'continuation'").collect()}
    assert (s0[30].n, s0[30].largest_asset_share, s0[60].max_drawdown) == (1, 1.0, pytest.approx(0.135))
    scenarios = [{"scenario": "now", "delay": 0.0, "order_size": 0.0, "cost": 0.0}, {"scenario": "late", "delay": 2.0, "order_size": 200.0, "cost": 0.01}]
    r = {(x.signal, x.scenario): x for x in replay.replayed(signals, quotes, scenarios).collect()}
    # 0.42 in; 0.45 at 20 s is the first move of 0.03. Late: 0.43 in, 0.50 at 31 s, half of the order filled.
    assert r[1, "now"].pnl == pytest.approx(0.03) and r[1, "late"].pnl == pytest.approx(0.5 * (0.50 - 0.43 - 0.01))
    assert r[2, "late"].fill == 0.5 and not r[2, "now"].missed and r[2, "now"].pnl == 0.0 - (1 - 0.30) + (1 - 0.30)


def test_specialists_by_hand(spark):
    rows = [("W", "C1", "BUY", "Up", "BTC", True, 100, 0.5, 10.0, 1), ("W", "C1", "BUY", "Down", "BTC", True, 100, 0.4, 20.0, 2), ("W", "C1", "SELL", "Up", "BTC", True, 90, 0.5, 1.0, 3), ("W", "C2", "BUY", "Up", "ETH", True, 100, 0.5, 1.0, 4), ("W", "C3", "BUY", "Up", "BTC", True, 100, 0.97, 1.0, 5), ("W", "C4", "BUY", "Up", "BTC", True, 260, 0.5, 1.0, 6), ("X", "C1", "BUY", "Up", "BTC", True, 1, 0.5, 1.0, 7), ("W", "C5", "BUY", "Up", "BTC", True, 1, 0.5, 1.0, 8)]
    t = spark.createDataFrame(rows, "wallet string, condition string, side string, outcome string, asset_class string, up_down boolean, t long, price double, notional double, trade int")
    meta = [("c1", "down"), ("c2", "up"), ("c3", "up"), ("c4", "up"), ("c5", "up"), ("c5", "down")]
    o = spark.createDataFrame([(c, w, 300, "btc-updown-5m-0", "BTC") for c, w in meta], "condition string, winner string, expiry long, slug string, asset_class string")
    rows = specialist.candidates(t, o, spark.createDataFrame([("w", "BTC")], "wallet string, asset_class string"))
    assert {r.exclusion: r.n for r in specialist.exclusion_counts(rows).collect()} == {"non_buy": 1, "outside_frozen_specialty": 1, "missing_or_conflicting_resolution": 1, "insufficient_modeled_decision_window": 1}
    got = {r.condition: r for r in specialist.signals(rows).collect()}
    assert set(got) == {"c1", "c3"} and (got["c1"].outcome, got["c1"].matched) == ("Down", True)
    assert got["c1"].conservative_value == pytest.approx(1 - 0.45) and got["c3"].conservative_value == pytest.approx(1 - 0.99)
    gates = {r.gate: r.passed for r in specialist.specialist_gates(specialist.signals(rows), 1, 3).collect()}
    assert gates["all_wallets_present"] and gates["market_group_leakage_absent"] and not gates["consensus_sample_at_least_30"]


def test_experiments_by_hand(spark):
    assert [value(spark, lab.execution_price(F.lit(0.5), m, F.lit(0.2))) for m in ("base", "stress", "ultra", "consume_0.5", "gross")] == pytest.approx([0.535, 0.57, 0.605, 0.6, 0.5])
    assert [value(spark, lab.edge_side(F.lit(m), F.lit(0.5), F.lit(0.09))) for m in (0.6, 0.55, 0.4)] == ["UP", None, "DOWN"]
    f = value(spark, lab.close_features(F.array(*[F.lit(float(x)) for x in (100, 110, 99)])))
    assert (f.price, f.return_1, f.return_5) == (99.0, pytest.approx(-0.1), None) and f.volatility == pytest.approx(0.1)
    tokens = F.array(F.struct(F.lit("a").alias("token_id"), F.lit(False).alias("winner")), F.struct(F.lit("b").alias("token_id"), F.lit(True).alias("winner")))
    flag = lambda closed: value(spark, lab.winner_by_flag(F.lit(closed), tokens, F.array(F.lit("a"), F.lit("b")), F.array(F.lit("Up"), F.lit("Down"))))
    assert (flag(True), flag(False)) == (0, None)
    assert [value(spark, lab.rotation_state(F.lit(n), F.lit(0), F.lit(300), F.lit(k))) for n, k in ((-1, False), (0, False), (270, False), (300, False), (10, True))] == ["DISCOVERED", "ACTIVE", "NEAR_EXPIRY", "CLOSED", "SKIPPED"]
    closes = spark.createDataFrame([("k", 1, 10.0), ("k", 20, 30.0)], "k string, m long, c double")
    asked = spark.createDataFrame([("k", 60 * m + 5) for m in (0, 1, 10, 11, 20)], "k string, at long")
    assert [r.close for r in lab.minute_close(closes, asked, "k", "m", "c", "at").orderBy("at").collect()] == [None, 10.0, 10.0, None, 30.0]
    cache = spark.createDataFrame([("a", 1)], "m string, o int")
    assert {r.m: (r.o, r.resolved) for r in lab.filled_outcomes(spark.createDataFrame([("a", None), ("b", None), ("c", 0)], "m string, o int"), cache, "m", "o").collect()} == {"a": (1, True), "b": (None, False), "c": (0, True)}


def test_evaluation_rules(spark):
    assert [value(spark, evaluation.coefficient_stability(F.lit(m), F.lit(d))) for m, d in ((10.0, 10.0), (0.0, 1.0), (0.0, 0.0))] == [50.0, 0.0, 100.0]
    assert [value(spark, evaluation.downside_ratio(F.lit(a), F.lit(b))) for a, b in ((1.0, 2.0), (5.0, 2.0), (-1.0, 2.0), (1.0, 0.0))] == [0.5, 1.0, 0.0, 0.0]
    status = lambda k, n, ready=True: value(spark, evaluation.hypothesis_status(F.lit(k), F.lit(n), F.lit(ready), (0.8, 0.7), (0.5, 0.6)))
    assert [status(90, 100), status(90, 100, False), status(30, 100), status(60, 100), status(0, 0)] == ["SUPPORTED", "INCONCLUSIVE", "REJECTED", "INCONCLUSIVE", "INCONCLUSIVE"]
    trades_ = spark.createDataFrame([(i, p, 10.0) for i, p in enumerate((100.0, -50.0, 30.0, 20.0))], "k int, pnl double, quantity double")
    m = evaluation.evidence_metrics(trades_, "k", 9, 4, 2, (10, 10), (9, 8)).withColumn("verdict", evaluation.evidence_verdict()).first()
    assert (m.pnl, m.win_rate, m.edge_decay, m.latency_sensitivity, m.reference_coverage, m.data_gap) == (100.0, 0.75, 0.0, 0.0008, 90.0, 20.0)
    assert m.max_drawdown == pytest.approx(50 / 10_100, abs=1e-8) and m.verdict == "INSUFFICIENT_DATA"
    verdict = lambda **k: value(spark, F.expr("1")) and spark.createDataFrame([tuple((dict(windows=30, trades=20, reference_coverage=95.0, data_gap=10.0, pnl=1.0, win_rate=0.5, max_drawdown=0.05, edge_decay=0.5, latency_sensitivity=0.5) | k).values())], "windows int, trades int, reference_coverage double, data_gap double, pnl double, win_rate double, max_drawdown double, edge_decay double, latency_sensitivity double").select(evaluation.evidence_verdict().alias("v")).first().v
    assert [verdict(), verdict(trades=19), verdict(pnl=0.0), verdict(win_rate=0.47), verdict(max_drawdown=0.11)] == ["POTENTIAL_EDGE", "INSUFFICIENT_DATA", "NO_EDGE", "WEAK_EDGE", "NO_EDGE"]


def dataset(spark, n=40, **change):
    at = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        for a in ("BTC", "ETH"):
            start = at + dt.timedelta(minutes=5 * i)
            row = {"market_id": f"{a}{i}", "asset": a, "market_source": "public", "window_start": start, "window_end": start + dt.timedelta(minutes=5), "feature_timestamp": start + dt.timedelta(minutes=1), "outcome": i % 2, "resolution_timestamp": "r", "label_source": "polymarket_gamma_resolved", "f": float(i)}
            rows.append(tuple((row | (change if i == 3 and a == "BTC" else {})).values()))
    return spark.createDataFrame(rows, "market_id string, asset string, market_source string, window_start timestamp, window_end timestamp, feature_timestamp timestamp, outcome int, resolution_timestamp string, label_source string, f double")


def test_sealed_split(spark, tmp_path):
    df, path = dataset(spark), str(tmp_path / "frozen")
    governance.freeze(df, path)
    assert set(governance.verify(df, path)["artifacts"]) == set(governance.ARTIFACTS)
    train, validation = governance.development(spark, path)
    governance.separate(train, validation)
    # 40 windows: cuts at 28 and 34, one window purged before and one embargoed after each.
    assert (train.count(), validation.count()) == (2 * 27, 2 * 4)
    assert {(r.reason, r["count"]) for r in spark.read.parquet(f"{path}/split_assignments").groupBy("reason").count().collect()} == {("chronological_split", 72), ("train_validation_purge", 2), ("train_validation_embargo", 2), ("validation_holdout_purge", 2), ("validation_holdout_embargo", 2)}
    assert not set(governance.LABELS) & set(spark.read.parquet(f"{path}/holdout_features").columns) and spark.read.parquet(f"{path}/sealed_holdout_labels").count() == 10
    with pytest.raises(ValueError, match="source"):
        governance.verify(df.withColumn("f", F.col("f") + 1), path)
    train.limit(3).write.mode("append").parquet(f"{path}/validation")
    with pytest.raises(ValueError, match="artifact differs: validation"):
        governance.verify(df, path)
    with pytest.raises(ValueError, match="both parts"):
        governance.separate(train, train)


@pytest.mark.parametrize("change", [{"market_source": "mock"}, {"label_source": "x"}, {"market_id": "ETH3"}, {"window_end": dt.datetime(2024, 1, 2)}, {"feature_timestamp": dt.datetime(2025, 1, 1)}])
def test_split_refuses(spark, change):
    with pytest.raises(ValueError):
        governance.validated(dataset(spark, **change))


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from tidemark import storage

    none = SimpleNamespace(get=lambda *a: None)
    fake = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_path(fake, "x")
