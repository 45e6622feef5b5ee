"""Rules that departed from the survey before: pages without a wallet, equal purchases, wallets alike, the passive gate; and small helpers."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import behaviour, capture, evaluation, features, outcomes, replay, specialist, structural, trades


def test_a_page_without_a_wallet_takes_its_first_rows(spark):
    row = {"type": "TRADE", "side": "BUY", "price": "0.5", "size": "2", "timestamp": "1700000000", "conditionId": "c", "asset": "t", "outcome": "Up", "title": "x", "slug": "s", "eventSlug": "e"}
    page = {"wallet_id": " ", "url": "", "source_endpoint": "end", "fetched_at": " ", "retrieved_at": "2024-01-01", "payload": [{**row, "proxyWallet": "0xA"}, {**row, "proxyWallet": "0xB", "type": ""}, {**row, "side": "SELL"}]}
    bare = {"wallet_id": None, "payload": [row]}
    got = trades.normalised(spark.createDataFrame([(json.dumps(p),) for p in (page, bare)], "value string")).collect()
    assert sorted(r.wallet_id for r in got) == ["0xa", "0xa", "0xa", "unknown_wallet"]
    assert {(r.source_endpoint, r.source_fetch_timestamp, r.activity_type) for r in got if r.wallet_id == "0xa"} == {("end", "2024-01-01", "TRADE")}


def test_of_equal_purchases_the_least_trade_counts(spark):
    rows = [("w", "c", t, 5.0, o, trade, 0.1 * i, "BTC", (300.0, "Up")) for i, (t, o, trade) in enumerate([(10, "Up", "b"), (10, "Up", "a"), (10, "Down", "0"), (20, "Up", "A")])]
    df = spark.createDataFrame(rows, "wallet string, condition string, t long, notional double, outcome string, trade string, price double, asset_class string, market struct<expiry: double, winner: string>").withColumn("exclusion", F.lit(None).cast("string"))
    got = specialist.signals(df).collect()
    assert [(r.t, r.outcome, r.trade, round(r.price, 1)) for r in got] == [(10, "Up", "a", 0.1)]


def test_wallets_alike_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = [(f"w{i:02}", [float(rng.randrange(3)) for _ in range(3)]) for i in range(60)] + [("zero", [0.0] * 3)]
    df = spark.createDataFrame(rows, "w string, v array<double>").repartition(5)
    got = behaviour.similar_to(df, df.filter("w like '%5' or w = 'zero'"), "w", "v", 4).collect()

    def cosine(a, b):
        norm = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / norm, 9) if norm else 0.0

    asked = [r for r in rows if r[0].endswith("5") or r[0] == "zero"]
    want = {(a, i + 1): (w, -s) for a, v in asked for i, (s, w) in enumerate(sorted((-cosine(v, u), w) for w, u in rows if w != a)[:4])}
    assert {(r.asked, r.place): (r.w, r.similarity) for r in got} == want


def test_the_passive_gate_can_pass(spark):
    names = "policy string, session string, asset string, market string, t long, bid_shares double, ask_shares double, filled double, pnl double"
    rows = [("good", s, a, f"m{a}{s}", i, 1.0, 1.0, 2.0, 0.2 + 0.01 * i) for i, (s, a) in enumerate((s, a) for s in "pqr" for a in "xyz")]
    rows += [("late", s, a, "m", i, 1.0, 1.0, 2.0, 0.5 if i < 5 else -0.4) for i, (s, a) in enumerate((s, a) for s in "pqr" for a in "xyz")]
    low = spark.createDataFrame([("good", 0.1), ("late", 0.1)], "policy string, low double")
    got = {r.policy: r for r in structural.passive_summary(spark.createDataFrame(rows, names), 1.0, low).collect()}
    assert got["good"].passes and got["good"].max_drawdown == 0.0 and not got["late"].passes and round(got["late"].max_drawdown, 9) == 1.6


def test_helpers_by_hand(spark):
    t = spark.createDataFrame([("a", 10.0, 1), ("b", 70.0, 0), ("c", None, 2)], "m string, delay double, errors int")
    assert tuple(outcomes.tracker_summary(t, "delay", "errors").first()) == (3, 40.0, 1, 1, 3)
    chosen = spark.createDataFrame([("BTC", 1, "m1"), ("BTC", 2, "m1"), ("BTC", 3, "m2"), ("ETH", 1, "m3")], "asset string, t int, market string")
    assert [tuple(r) for r in outcomes.rollovers(chosen, "asset", "t", "market").collect()] == [("BTC", 3, "m1", "m2")]
    kinds = spark.createDataFrame([("regime_beats", "r")], "kind string, name string")
    assert evaluation.conclusion(kinds).first().conclusion == "REGIME_SPECIFIC_SIGNAL_PRESENT" and evaluation.conclusion(kinds.limit(0)).first().conclusion == "FEATURE_SET_INCOMPLETE"
    seen = spark.createDataFrame([("x", "p"), ("x", "q"), ("x", None)], "a string, b string")
    assert {(r.pattern, r.value): r.wallets for r in behaviour.common_patterns(seen, ["a", "b"]).collect()} == {("a", "x"): 3, ("b", "p"): 1, ("b", "q"): 1, ("b", None): 1}
    events = spark.createDataFrame([("s", "session_started", 1, "public", None, None), ("s", "session_completed", 9, None, "complete", "continuous"), ("u", "session_started", 1, "mock", None, None), ("u", "session_completed", 2, None, "complete", "continuous"), ("v", "session_started", 1, "public", None, None)], "session string, event string, t int, mode string, campaign string, continuity string")
    assert {r.session: r.status for r in structural.session_integrity(events).collect()} == {"s": "ok", "u": "non_public", "v": "incomplete"}


def test_further_helpers_by_hand(spark):
    hits = spark.createDataFrame([(True,), (False,), (True,)], "h boolean")
    assert round(hits.agg(capture.hit_share(F.col("h")).alias("s")).first().s, 6) == 0.666667 and hits.limit(0).agg(capture.hit_share(F.col("h")).alias("s")).first().s == 0.0
    ids = spark.createDataFrame([(" A", "x"), ("a ", "X"), ("b", "x")], "p string, q string").select(trades.trade_identity("p", "q").alias("i")).collect()
    assert ids[0].i == ids[1].i != ids[2].i and len(ids[0].i) == 64
    assert spark.range(1).select(X.event_age_ms(F.lit(1_500_000), F.lit(1_200)).alias("a")).first().a == 300.0
    pnl = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", -1.0)], "k string, pnl double")
    assert {(r.dimension, r.value): (r.n, r.total, r.expectancy) for r in replay.group_expectancy(pnl, ["k"]).collect()} == {("all", "all"): (3, 3.0, 1.0), ("k", "a"): (2, 4.0, 2.0), ("k", "b"): (1, -1.0, -1.0)}
    gates = spark.createDataFrame([(5, 0.1, 0.01, 0.01, 2, 2, 0.3, 0.3), (5, 0.1, 0.01, 0.2, 2, 2, 0.3, 0.3), (5, 0.1, None, 0.01, 2, 2, 0.3, 0.3)], "n int, expectancy double, low double, holm double, positive_sessions int, sessions int, largest_session_share double, largest_asset_share double")
    assert [r.passes for r in replay.horizon_gates(gates).collect()] == [True, False, False]
    rows = spark.createDataFrame([(1, 1.0, None, None), (2, None, None, None), (3, 1.0, 1.0, "late")], "i int, a double, b double, skip_reason string")
    good, skipped = features.complete(rows, ["a", "b"], 1)
    assert [r.i for r in good.collect()] == [1] and {r.i: r.skip_reason for r in skipped.collect()} == {2: "incomplete_features", 3: "late"}
