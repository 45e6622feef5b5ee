"""Wallet lifecycles, metrics, scores and what follows from them, on cases worked by hand."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scores, tables, wallets

TRADES = "wallet string, token string, side string, size decimal(20,8), price decimal(20,8), t long, tx string, flags string"


def D(x):
    return None if x is None else Decimal(str(x))


def test_lifecycles_by_hand(spark):
    rows = [("w", "open", "buy", 10, 0.5, 1, "0xB", "late"), ("w", "open", "BUY", 30, 0.7, 2, "0xa", "none"), ("w", "part", "BUY", 10, 0.5, 1, "", None), ("w", "part", "SELL", 4, 0.8, 2, None, "x;late")]
    rows += [("w", "full", "BUY", 10, 0.5, 1, "", ""), ("w", "full", "SELL", 10, 0.4, 2, "", ""), ("w", "over", "BUY", 1, 0.5, 1, "", ""), ("w", "over", "SELL", 3, 0.6, 2, "", ""), ("w", "none", "HOLD", 1, 0.5, 1, "", ""), ("w", "none", "BUY", None, None, 2, "", "")]
    df = spark.createDataFrame([(w, k, s, D(n), D(p), t, x, f) for w, k, s, n, p, t, x, f in rows], TRADES)
    got = {r.token: r for r in wallets.lifecycles(df, hashes="tx", flags="flags").collect()}
    assert {k: r.status for k, r in got.items()} == {"open": "still_open", "part": "partial_exit", "full": "full_exit", "over": "oversold_bounded_history", "none": "no_position_change"}
    o = got["open"]
    assert (float(o.bought), float(o.remaining), o.entry_price, o.exit_price, o.transactions, o.quality) == (40.0, 40.0, pytest.approx(0.65), None, "0xa;0xb", "late")
    assert got["part"].realized == pytest.approx(4 * 0.3) and got["part"].quality == "late;x"
    assert (float(got["over"].oversold), got["over"].quality) == (2.0, "bounded_history_missing_prior_buy")
    assert (got["none"].others, got["none"].buys, got["none"].quality, float(got["none"].bought)) == (1, 1, "ignored_non_buy_sell_side", 0.0)
    assert wallets.conservation_violations(wallets.lifecycles(df)).count() == 0


POSITIONS = "wallet string, bought decimal(38,8), sold decimal(38,8), remaining decimal(38,8), oversold decimal(38,8), status string, buys long, sells long, asset_class string, outcome string, market_type string"


def position(bought, sold, asset="BTC", outcome="Up", kind="fast_crypto_up_down", buys=None, sells=None):
    status = "oversold_bounded_history" if sold > bought else "still_open" if bought and not sold else "partial_exit" if bought > sold else "full_exit" if bought else "no_position_change"
    return ("w", D(bought), D(sold), D(max(bought - sold, 0)), D(max(sold - bought, 0)), status, int(bought > 0) if buys is None else buys, int(sold > 0) if sells is None else sells, asset, outcome, kind)


def test_wallet_metrics_by_hand(spark):
    rows = [position(10, 0), position(10, 9.95, "ETH"), position(10, 9.9, "ETH", "Down"), position(0, 4, "ETH", None, "other"), position(5, 5, None, "Down")]
    m = wallets.wallet_metrics(spark.createDataFrame(rows, POSITIONS)).first()
    assert (m.positions, m.still_open, m.partial_exit, m.full_exit, m.oversold_bounded_history) == (5, 1, 2, 1, 1)
    assert (m.mean_size, m.median_size, m.sells_each, m.events_each, m.sell_only_share) == (7.8, 10.0, 0.8, 1.6, 0.2)
    assert (m.near_flat, m.fast, m.fast_share) == (2, 4, 0.8)
    assert (m.dominant_asset, m.asset_concentration, m.dominant_outcome, m.outcome_concentration) == ("ETH", 0.6, "Down", 0.4)
    df = spark.createDataFrame(rows, POSITIONS)
    assert all(r.violations == 0 for r in wallets.metrics_violations(wallets.wallet_metrics(df), df).collect())
    assert {r.check for r in wallets.metrics_violations(wallets.wallet_metrics(df).withColumn("fast_share", F.lit(1.5)), df).collect() if r.violations} == {"fast_share"}


BASE = {"wallet": "w", "positions": 50, "partial_exit": 20, "fast": 25, "oversold_bounded_history": 0, "near_flat": 0, "fast_share": 1.0, "open_share": 0.5, "sell_only_share": 0.0, "sells_each": 1.0, "events_each": 3.0, "asset_concentration": 0.5, "outcome_concentration": 0.6, "dominant_asset": "btc"}


def scored(spark, *changes):
    rows = [BASE | {"wallet": f"w{i}"} | c for i, c in enumerate(changes)]
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'long' if isinstance(v, int) else 'double'}" for k, v in BASE.items())
    return scores.wallet_scores(spark.createDataFrame([tuple(r[k] for k in BASE) for r in rows], schema)).orderBy(F.expr("cast(substr(wallet, 2) as int)"))


def ladder(spark, part, *changes):
    return [r[part] for r in scored(spark, *changes).collect()]


def test_score_ladders_by_hand(spark):
    n = lambda k, *xs: [{k: x} for x in xs]
    assert ladder(spark, "coverage", *n("positions", 0, 4, 5, 9, 10, 24, 25, 49, 50)) == [0, 0, 8, 8, 15, 15, 21, 21, 25]
    assert ladder(spark, "small_sample", *n("positions", 4, 5, 9, 10, 14, 15)) == [20, 10, 10, 5, 5, 0]
    assert ladder(spark, "fast_crypto", *[{"fast_share": s, "fast": k} for s, k in ((0.0, 4), (0.5, 5), (0.5, 9), (0.5, 10), (1.0, 24), (1.0, 25))]) == [0, 12, 12, 14, 24, 25]
    assert ladder(spark, "lifecycle_activity", *[{"positions": 100, "partial_exit": k, "sells_each": s} for k, s in ((0, 0.0), (9, 0.0), (10, 0.0), (34, 1.0), (35, 0.0), (75, 1.0), (76, 1.0))]) == [0, 4, 8, 11, 12, 15, 11]
    assert ladder(spark, "event_density", *n("events_each", 0.9, 1.0, 1.99, 2.0, 8.0, 8.1, 20.0, 20.1)) == [0, 8, 8, 15, 15, 11, 11, 6]
    assert ladder(spark, "specialization", *[{"dominant_asset": a, "asset_concentration": c, "outcome_concentration": o} for a, c, o in (("other", 0.29, 0.71), ("ETH", 0.30, 0.70), ("SOL", 0.80, 0.9), ("BTC", 0.81, 0.9), ("BTC", 0.95, 0.9), ("BTC", 0.96, 0.5))]) == [0, 10, 8, 7, 7, 7]
    assert ladder(spark, "bounded_history", *[{"sell_only_share": s, "oversold_bounded_history": k} for s, k in ((0.0, 0), (0.5, 1), (0.9, 1), (0.9, 5))]) == [0, 12.5, 17.5, 20]
    assert ladder(spark, "still_open_penalty", *n("open_share", 0.50, 0.51, 0.75, 0.76, 0.90, 0.91)) == [0, 5, 5, 10, 10, 15]
    assert ladder(spark, "concentration", *[{"asset_concentration": a, "outcome_concentration": o} for a, o in ((0.95, 0.75), (0.96, 0.75), (0.96, 0.76))]) == [0, 5, 10]
    assert ladder(spark, "near_flat_ambiguity", *[{"positions": 100, "near_flat": k} for k in (5, 6, 20, 21)]) == [0, 2, 2, 5]
    assert ladder(spark, "score_band", {}, {"positions": 12}, {"positions": 4, "fast": 4}, {"positions": 4, "fast": 0, "fast_share": 0.0, "events_each": 0.5, "partial_exit": 0, "sells_each": 0.0}) == ["high_priority", "medium_priority", "low_priority", "insufficient_visible_structure"]


def test_scores_watchlist_and_copyability(spark):
    s = scored(spark, {}, {"positions": 12, "open_share": 0.95, "oversold_bounded_history": 1}, {"positions": 4}, {"positions": 20, "fast_share": None}, {"positions": 6, "fast": 0, "fast_share": 0.0, "partial_exit": 0})
    assert [r.missing for r in s.collect()] == [0, 0, 0, 1, 0]
    assert all(r.violations == 0 for r in scores.score_violations(s).collect())
    assert {r.check for r in scores.score_violations(s.withColumn("score", F.col("score") + 200)).collect() if r.violations} == {"score_bounds", "formula", "band"}
    listed = scores.watchlist(s).collect()
    assert [r.wallet for r in listed] == ["w0", "w1", "w4"]
    assert listed[0].reason_codes == "bucket_high_priority;minimum_visibility_passed;fast_crypto_relevant;visible_partial_exit_activity"
    assert listed[0].strengths.startswith("strong visible lifecycle coverage; high fast-crypto lifecycle share")
    got = {r.wallet: r for r in scores.copyability(s, scores.watchlist(s)).collect()}
    assert {w: r.recommendation for w, r in got.items()} == {"w0": "monitor_candidate", "w1": "needs_more_history", "w2": "exclude_for_now", "w3": "insufficient_signal", "w4": "needs_more_history" if got["w4"].score >= 25 else "insufficient_signal"}
    assert {w: r.confidence for w, r in got.items()} == {"w0": "medium_structural", "w1": "low_to_medium_structural", "w2": "insufficient_visible_history", "w3": "low_to_medium_structural", "w4": "low_structural"}
    assert got["w2"].included == "excluded_minimum_visibility" and got["w1"].missing_evidence == "later exits beyond bounded window; prior buys before bounded window"
    ranges = {r.component: r.range for r in scores.component_ranges(s).collect()}
    assert ranges["coverage"] == 25 and ranges["concentration"] == 0


def test_skill_evidence(spark):
    rows = [("good", i < 90) for i in range(100)] + [("bad", i < 20) for i in range(100)] + [("even", i % 2 == 0) for i in range(100)] + [("few", True)] * 29
    got = {r.w: r for r in wallets.skill(spark.createDataFrame(rows, "w string, won boolean"), "w", "won").collect()}
    assert {w: r.evidence for w, r in got.items()} == {"good": "above_baseline_evidence", "bad": "below_baseline_evidence", "even": "sample_size_consistent_with_baseline", "few": "insufficient_evidence"}
    assert got["good"].baseline == pytest.approx(99 / 229)
    assert wallets.h1_conclusion(wallets.skill(spark.createDataFrame(rows, "w string, won boolean"), "w", "won")).first().verdict == "INCONCLUSIVE"


def test_quality_by_hand(spark):
    schema = "market_id string, market_source string, outcome string, f1 double, f2 double, micro double"
    rows = [(f"m{i}", "public" if i < 9 else "mock", str(i % 2), 1.0, None if i == 0 else 2.0, None) for i in range(10)]
    q = tables.quality_score(spark.createDataFrame(rows, schema), ["f1", "f2"], ["micro"]).first()
    assert (q.public_sample_ratio, q.class_balance, q.missing_value_control, q.duplicate_control, q.feature_completeness) == (90.0, 100.0, 98.0, 100.0, 95.0)
    assert q.score == 95.7 and q.recommended and q.failures == []
    rows = [("m", "mock", "1", 1.0, None, None)] * 4 + [("n", "public", " ", None, None, None)]
    q = tables.quality_score(spark.createDataFrame(rows, schema), ["f1", "f2"], ["micro"]).first()
    assert (q.duplicate_rows, q.duplicate_markets, q.minority, q.missing_values) == (3, 3, 0.0, 7) and not q.recommended
    assert q.failures == ["public sample ratio is below 80%", "minority class share is below 30%", "feature completeness is below 95%", "duplicate rate exceeds 1%", "quality score is below 75"]
    q = tables.quality_score(spark.createDataFrame([], schema), ["f1"], []).first()
    assert q.failures[0] == "dataset is empty" and q.score == 0.0
