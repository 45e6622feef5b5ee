"""Event logs to typed rows and the training table."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import pytest

from tidemark.operators import features
from tidemark.sources import events as E

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def line(kind: str, at: float, **payload) -> str:
    return json.dumps({"event": kind, "timestamp": (START + timedelta(seconds=at)).isoformat(), "payload": payload})


def market(asset: str) -> str:
    m = {"market_id": f"m-{asset}", "question": "up?", "asset": asset, "window_start": START.isoformat(), "window_end": (START + timedelta(seconds=300)).isoformat(), "active": True, "closed": False}
    return line("market_lifecycle", 0, market=m)


def price(asset: str, at: float, value: float) -> str:
    return line("reference_price", at, asset=asset, price=value, source="x", timestamp=(START + timedelta(seconds=at)).isoformat())


def quote(asset: str, at: float, yes: float) -> str:
    return line("venue_snapshot", at, market_id=f"m-{asset}", asset=asset, timestamp=(START + timedelta(seconds=at)).isoformat(), yes_price=yes, no_price=1 - yes, seconds_to_expiry=300 - at)


@pytest.fixture
def log(tmp_path):
    folder = tmp_path / "runs" / "s1"
    folder.mkdir(parents=True)
    lines = [market("BTC"), market("ETH"), price("BTC", 0, 100.0), price("ETH", 0, 50.0)]
    lines += [price("BTC", t, 100.0 + t / 100) for t in (30, 45, 55, 60)] + [price("ETH", t, 50.0 - t / 100) for t in (30, 45, 55, 60)]
    lines += [quote(a, t, 0.5 + t / 1000) for a in ("BTC", "ETH") for t in (30, 45, 58)]
    lines += [line("microstructure_snapshot", 55, market_id="m-BTC", asset="BTC", repricing_velocity=0.001, bid_ask_spread=0.02), line("microstructure_snapshot", 65, market_id="m-BTC", asset="BTC", repricing_velocity=999.0)]
    lines += [price("BTC", 300, 103.0), price("ETH", 300, 49.0), "{broken", "", "[1]"]
    (folder / "session.jsonl").write_text("\n".join(lines))
    return str(tmp_path / "runs" / "*" / "session.jsonl")


def test_scan_counts_malformed(spark, log):
    e = E.read_sessions(spark, log)
    counts = E.malformed_counts(e).first()
    assert (counts.source_session, counts.malformed) == ("s1", 2)
    assert e.count() == counts.events
    assert E.of_kind(e, "reference_price").count() == 12


def test_strict_scan_fails(spark, log):
    with pytest.raises(Exception, match="malformed event"):
        E.read_sessions(spark, log, strict=True).collect()


def test_training_rows(spark, log):
    rows = {r.asset: r for r in features.training_rows(E.read_sessions(spark, log, names={"venue_snapshot": "market_snapshot"})).collect()}
    btc, eth = rows["BTC"], rows["ETH"]
    assert (btc.outcome, eth.outcome) == (1, 0)
    assert btc.label_source == "reference_window_return" and btc.skip_reason is None
    assert (btc.market_age_seconds, btc.seconds_to_expiry) == (60.0, 240.0)
    assert btc.repricing_velocity == 0.001 and btc.bid_ask_spread == 0.02
    assert eth.repricing_velocity is None
    assert btc.return_5s == pytest.approx(100.6 / 100.55 - 1)
    assert btc.return_60s == pytest.approx(100.6 / 100.0 - 1)
    assert btc.yes_price == pytest.approx(0.558)


def test_resolution_wins_over_reference(spark, log):
    known = spark.createDataFrame([("m-BTC", 0)], "market_id string, outcome int")
    rows = {r.asset: r for r in features.training_rows(E.read_sessions(spark, log, names={"venue_snapshot": "market_snapshot"}), known).collect()}
    assert (rows["BTC"].outcome, rows["BTC"].label_source) == (0, "resolution")


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, START)], "k string, v double, at timestamp")
    E.write_jsonl(df, str(tmp_path / "s" / "log"), "thing", "at")
    back = E.read_sessions(spark, str(tmp_path / "s" / "log" / "*.txt"))
    assert E.of_kind(back, "thing", "k string, v double").select("k", "v").collect() == [("a", 1.5)]
    E.write_csv(df, str(tmp_path / "csv"), ["v", "k"])
    assert E.read_csv(spark, str(tmp_path / "csv"), "v double, k string", ["k"]).collect() == [("a", 1.5)]
