"""Replays of sessions: a session worked by hand, random ones against a plain walk, and streams against their twins."""

from __future__ import annotations

import random

import pytest

from tidemark.operators import replays as R
from tidemark.operators import stretch
from tidemark.operators.outcomes import LAG
from tidemark.streaming import positions as P
from tidemark.streaming import replay as S

NAMES = [c.split()[0] for c in R.EVENT.split(", ")]
# The case that the survey gives: 60,000 to 60,180 within 2 s, .500 to .505, .495 and .515, 10,000, 298 s left.
BASE = {"session": "s", "asset": "BTC", "market": "m"}


def event(n, t, kind, **more):
    row = dict.fromkeys(NAMES) | {"session": "s", "asset": "BTC", "n": n, "t": t * 1_000_000, "kind": kind} | more
    return tuple(row[c] for c in NAMES)


def snapshot(n, t, yes, **more):
    return event(n, t, R.SNAPSHOT, **({"market": "m", "yes": yes, "bid": round(yes - 0.01, 3), "ask": round(yes + 0.01, 3), "liquidity": 10_000.0, "seconds_left": 298.0} | more))


def reference(n, t, price, source="live", **more):
    return event(n, t, R.REFERENCE, price=price, source=source, **more)


def session():
    return [
        event(0, 0, "session_started", mode="public"),
        snapshot(1, 0, 0.5),
        event(2, 0, R.LIFECYCLE, market="m", question="up?", current="active"),
        snapshot(3, 0, 0.5),
        reference(4, 1, 60_000.0),
        snapshot(5, 1, 0.5),
        reference(6, 3, 60_180.0),
        snapshot(7, 3, 0.505, bid=0.495, ask=0.515, seconds_left=59.0),
        snapshot(8, 3, 0.505, bid=0.495, ask=0.515),
        snapshot(9, 3, 0.505, bid=0.495, ask=0.515),
        event(10, 3, R.SKIP, market="x", question="other?", reason="confidence_below_threshold"),
        event(11, 4, R.SKIP, market="x", question="other?", reason="polymarket_quote_error: timeout"),
        reference(12, 5, 60_200.0, "mock"),
        snapshot(13, 5, 0.506),
        reference(14, 6, 60_210.0, "mock"),
        snapshot(15, 6, 0.506, liquidity=1.0),
        event(16, 7, R.LIFECYCLE, market="m", current="closed"),
        event(17, 7, R.LIFECYCLE, market="y", current="closed"),
    ]


def test_a_session_by_hand(spark):
    events = spark.createDataFrame(session(), R.EVENT)
    got = {r.n: r for r in R.replay(events).collect()}
    reasons = {n: (r.kind, r.reason) for n, r in got.items()}
    assert reasons == {
        1: ("skipped", R.UNKNOWN),
        3: ("skipped", R.MISSING),
        5: ("skipped", "external_move_below_threshold"),
        7: ("skipped", "late_entry_window"),
        8: ("opportunity", "qualified_external_move_not_repriced"),
        9: ("skipped", R.DUPLICATE),
        11: ("skipped", "polymarket_quote_error: timeout"),
        13: ("skipped", "reference_source_changed:live->mock"),
        15: ("skipped", "liquidity_below_minimum"),
    }
    assert (got[8].direction, got[8].external_change, got[8].lag_seconds, got[8].question) == ("UP", 0.003, 2.0, "up?") and got[8].lag_score > 0.7
    assert got[15].market_change == 0.0 and got[13].lag_score is None
    market = R.replay_markets(events, R.replay(events)).collect()
    assert [(r.market, r.state, r.snapshots, r.opportunities, r.completed, r.updated_at) for r in market] == [("m", "closed", 7, 2, True, 7_000_000)]
    report = R.replay_report(events, R.replay(events), 2).first()
    assert (report.expected_reference_points, report.successful_reference_points, report.expected_market_points, report.successful_market_points) == (12, 4, 9, 8)
    assert (report["mode"], report.fallback) == ("mock_fallback", "inferred_counters_missing_session_completed;mock_reference_events_detected:2")
    assert (report.markets, report.completed, report.opportunities, report.skipped, report.opportunity_rate, report.reference_coverage) == (1, 1, 1, 8, 1.0, 33.3333)


def test_counters_are_those_of_the_last_checkpoint(spark):
    counts = dict(zip(R.COUNTERS, (10, 9, 8, 7), strict=True))
    rows = [*session()[:6], event(20, 8, "capture_checkpoint", counters=dict.fromkeys(R.COUNTERS, 1), mode="public"), event(21, 9, "session_completed", counters=counts, fallback="")]
    got = R.replay_counters(spark.createDataFrame(rows, R.EVENT), 2).first()
    assert [got[c] for c in R.COUNTERS] == [10, 9, 8, 7] and (got["mode"], got.fallback) == ("public", "")


def test_a_bundle_by_hand(spark):
    rows = [event(0, 0, R.LIFECYCLE, market="m", question="up?"), event(1, 0, R.LIFECYCLE, market="o", question="or?"), snapshot(2, 3, 0.505, bid=0.495, ask=0.515), snapshot(3, 1, 0.5), snapshot(4, 3, 0.7, market="o", bid=0.69, ask=0.71), snapshot(5, 4, 0.5)]
    rows += [reference(6, 1, 60_000.0), reference(7, 3, 1.0), reference(8, 3, 60_180.0)]
    got = {r.n: (r.kind, r.reason) for r in R.replay_bundle(spark.createDataFrame(rows, R.EVENT)).collect()}
    assert got == {2: ("opportunity", "qualified_external_move_not_repriced"), 3: ("skipped", "external_move_below_threshold"), 4: ("opportunity", "qualified_external_move_not_repriced"), 5: ("skipped", R.MISSING)}


def random_sessions(seed, n=500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s, a = rng.choice("pq"), rng.choice(("BTC", "ETH"))
        t, more = i // 6, {"session": s, "asset": a}
        m = f"{a}{rng.randrange(3)}"
        kind = rng.random()
        if kind < 0.08:
            rows.append(event(i, t, R.LIFECYCLE, **more, market=m, question=rng.choice((None, m)), current="active"))
        elif kind < 0.4:
            rows.append(reference(i, t, 100 + rng.gauss(0, 0.3), "mock" if rng.random() < 0.03 else "live", **more))
        elif kind < 0.45:
            rows.append(event(i, t, R.SKIP, **more, market=m, reason=rng.choice((None, "quote", R.DUPLICATE, f"{R.SOURCE_CHANGED}a->b"))))
        else:
            rows.append(snapshot(i, t, round(0.5 + rng.gauss(0, 0.02), 3), **more | {"market": m, "seconds_left": rng.uniform(10, 300), "liquidity": rng.choice((100.0, 900.0))}))
    return rows


def walked(rows):
    """The surveyed rules, event by event."""
    out, markets, refs = {}, {}, {}
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        e = dict(zip(NAMES, row, strict=True))
        m = markets.get((e["session"], e["market"]))
        if e["kind"] == R.LIFECYCLE and e["question"] and m is None:
            markets[e["session"], e["market"]] = {"seen": False}
        elif e["kind"] == R.REFERENCE:
            refs[e["session"], e["asset"], e["t"]] = (e["price"], e["source"])
        elif e["kind"] == R.SKIP and e["reason"] in (None, "quote"):
            out[e["session"], e["n"]] = ("skipped", e["reason"])
        elif e["kind"] == R.SNAPSHOT:
            ref = refs.get((e["session"], e["asset"], e["t"]))
            if m is None:
                said = ("skipped", R.UNKNOWN)
            elif ref is None:
                said = ("skipped", R.MISSING)
            elif "source" in m and m["source"] != ref[1]:
                said = ("skipped", f"{R.SOURCE_CHANGED}{m['source']}->{ref[1]}")
                m |= {"source": ref[1], "price": ref[0], "t": e["t"], "yes": e["yes"]}
            else:
                for k, v in {"source": ref[1], "price": ref[0], "t": e["t"], "yes": e["yes"]}.items():
                    m.setdefault(k, v)
                good, reason, _ = S.measured(ref[0], m["price"], e["yes"], m["yes"], 0.0, e["liquidity"], e["seconds_left"], e["bid"], e["ask"], LAG)
                if good and e["seconds_left"] < 60:
                    good, reason = False, "late_entry_window"
                said = ("opportunity" if good and not m["seen"] else "skipped", R.DUPLICATE if good and m["seen"] else reason)
                m["seen"] |= good
            out[e["session"], e["n"]] = said
    return out


@pytest.mark.parametrize("bucket", [None, 40])
def test_random_sessions_equal_a_walk(spark, bucket):
    rows = random_sessions(3)
    got = R.replay(spark.createDataFrame(rows, R.EVENT), bucket=bucket)
    want = walked(rows)
    assert {(r.session, r.n): (r.kind, r.reason) for r in got.collect()} == want
    assert sum(k == "opportunity" for k, _ in want.values()) > 3 and any("->" in (r or "") for _, r in want.values())


def test_stream_equals_its_twin_and_goes_on_after_a_restart(spark, tmp_path):
    S.with_maps(spark)
    rows = random_sessions(5, 300)
    source, out, state = (str(tmp_path / x) for x in ("source", "out", "state"))
    for part in (rows[:170], rows[150:]):  # twenty events come twice, and the stream is started anew
        spark.createDataFrame(part, R.EVENT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(R.EVENT).parquet(source)
        got = P.run_to_table(S.stream_replay(stream), out, state)
    want = R.replay(spark.createDataFrame(rows, R.EVENT)).select(*S._COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) != []


def test_stretches_equal_plain_windows(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(rng.choice((None, "a", "b")), rng.choice((None, *range(90))), i, rng.choice((None, i % 5))) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v long")
    for f in (stretch.prior, stretch.latest, stretch.total):
        plain, cut = (sorted(map(tuple, f(df, "k", ["t", "i"], F.col("v"), "x", b).collect()), key=str) for b in (None, 10))
        assert plain == cut
