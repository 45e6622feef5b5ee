"""Windows by stretches against plain ones, drawdowns against a walk, exact order statistics against their rules."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranks, series, stretch


@pytest.fixture
def many_parts(spark):
    """Small tables keep their ranges, which adaptive execution would join."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def spread(rng, n=400):
    """Series with a hot key, a null key, gaps, repeats and nulls; times are distinct within a key."""
    keys = [None if x < 0.05 else "hot" if x < 0.6 else rng.choice("abc") for x in (rng.random() for _ in range(n))]
    times = rng.sample(range(3_000), n)
    return [(k, t * 1_000_000, i, rng.choice((None, 1.0, 2.0, 2.0, 3.5)), rng.choice("xyz")) for i, (k, t) in enumerate(zip(keys, times, strict=True))]


SERIES = {
    "velocity": lambda df, b: series.velocity(df, "k", "t", "v", bucket=b),
    "acceleration": lambda df, b: series.acceleration(df, "k", "t", "v", bucket=b),
    "difference": lambda df, b: series.difference(df, "k", "t", "v", bucket=b),
    "run_length": lambda df, b: series.run_length(df, "k", "t", ["v", "a"], bucket=b),
    "time_since_change": lambda df, b: series.time_since_change(df, "k", "t", "v", bucket=b),
    "change_frequency": lambda df, b: series.change_frequency(df, "k", "t", "v", 200_000_000, bucket=b),
    "volatility": lambda df, b: series.realized_volatility(df, "k", "t", "v", 200_000_000, bucket=b).withColumn("volatility", F.round("volatility", 9)),
    "without_repeats": lambda df, b: series.without_repeats(df, "k", "t", "a", b),
    "episodes": lambda df, b: series.episodes(df, "k", "t", F.col("v") > 1, 60_000_000, b),
    "gaps": lambda df, b: series.gaps(df, "k", "t", bucket=b),
    "sequence_gaps": lambda df, b: series.sequence_gaps(df, "k", "t", b),
    "numbered": lambda df, b: series.numbered(df, "k", "t", bucket=b),
    "state_changes": lambda df, b: series.state_changes(df, "k", "t", "a", b),
    "dispersion": lambda df, b: series.dispersion(df, "k", "t", "a", "v", list("xyz"), 300_000_000, b),
    "chain_violations": lambda df, b: series.chain_violations(df, "k", "i", "t", "a", "a", b),
}


@pytest.mark.parametrize("name", SERIES)
def test_stretches_equal_the_plain_form(spark, name):
    df = spark.createDataFrame(spread(random.Random(4)), "k string, t long, i long, v double, a string")
    plain, cut = (sorted(map(tuple, SERIES[name](df, b).collect()), key=str) for b in (None, 7 if name == "chain_violations" else 150_000_000))
    assert plain == cut and plain


def test_a_hot_key_is_many_stretches(spark, many_parts):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("t"))
    parts = stretch.ranged(df, "k", "t").groupBy("_part").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 600


def walked(pnls, start):
    equity, peaks, out = start, [], [0.0, 0.0, 0.0]
    for x in pnls:
        equity += x
        peaks.append(max([equity, *peaks[-1:]]))
        peak = max(start, peaks[-1])
        out[0] = max(out[0], peak - equity)
        fraction = peak if start > 0 else peaks[-1]
        out[1] = max(out[1], (fraction - equity) / fraction if fraction > 0 else 0.0)
        out[2] = min(out[2], equity - peaks[-1])
    return tuple(round(x, 9) for x in out)


@pytest.mark.parametrize("start", [0.0, 100.0])
def test_drawdowns_equal_a_walk(spark, many_parts, start):
    rng = random.Random(9)
    rows = [(rng.choice((None, "a", "b", "b", "b")), i, round(rng.gauss(0, 3), 2)) for i in range(300)]
    got = series.drawdowns(spark.createDataFrame(rows, "k string, i long, p double"), "k", "i", "p", start).collect()
    want = {k: walked([p for key, _, p in rows if key == k], start) for k in {r[0] for r in rows}}
    assert {r.k: tuple(round(x, 9) for x in tuple(r)[1:]) for r in got} == want


def rule(values, name, p):
    n = len(values)
    at = {"linear": (n - 1) * p, "nearest_rank": max(0, math.ceil(n * p) - 1), "truncated": min(n - 1, math.floor(n * p))}[name]
    low, part = math.floor(at), at - math.floor(at)
    return values[low] if part == 0 else (1 - part) * values[low] + part * values[math.ceil(at)]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_order_statistics_equal_their_rules(spark, many_parts, by):
    rng = random.Random(3)
    rows = [(rng.choice((None, "a", "a", "a", "b")), rng.choice((None, *range(30)))) for _ in range(500)] + [("one", 7), ("none", None)]
    wanted = {f"{n}_{i}": (n, p) for n in ranks.RULES for i, p in enumerate((0.0, 0.1, 1 / 3, 0.5, 0.95, 1.0))}
    got = ranks.quantiles(spark.createDataFrame(rows, "g string, v int"), by, "v", wanted).collect()
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g if by else None, []).append(v)
    assert len(got) == len(groups)
    for r in got:
        values = sorted(groups[r["g"] if by else None])
        assert [r[n] for n in wanted] == pytest.approx([rule(values, *w) for w in wanted.values()], abs=1e-12)


def test_order_statistics_of_columns(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (2.0, None)], "a double, b double")
    assert ranks.of_columns(df, ["a", "b"], {"m": ("linear", 0.5)}) == {"a": {"m": 2.0}, "b": {"m": None}}
    assert ranks.of_columns(df.limit(0), ["a"], {"m": ("linear", 0.5)}) == {"a": {"m": None}}


def test_microstructure_by_stretches_and_by_hand(spark):
    from tidemark.operators import trading

    names = "id long, market string, asset string, t long, yes double, bid double, ask double, b double, a double, s string"
    rng = random.Random(6)
    rows = [(i, f"m{i % 3}", "xyz"[i % 3], i * 1_000_000, rng.choice((0.5, 0.5, 0.52)), 0.49, rng.choice((0.51, 0.53)), 100.0, rng.choice((0.0, 80.0)), "s") for i in range(200)]
    run = lambda data, b: trading.microstructure(spark.createDataFrame(data, names), "market", "t", "yes", "bid", "ask", "b", "a", "s", "asset", list("xyz"), "t", bucket=b)
    assert sorted(map(tuple, run(rows, None).collect())) == sorted(map(tuple, run(rows, 35_000_000).select(run(rows, None).columns).collect()))
    hand = [(0, "btc", "x", 0, 0.50, 0.49, 0.51, 100.0, 80.0, "s"), (1, "eth", "y", 1, 0.55, 0.54, 0.56, 90.0, 110.0, "s"), (2, "btc", "x", 2, 0.52, 0.51, 0.53, 120.0, 80.0, "s"), (3, "btc", "x", 4, 0.52, 0.51, 0.54, 120.0, 80.0, "s"), (4, "btc", "x", 9, 0.52, 0.51, 0.54, 120.0, 80.0, "s")]
    got = {r.id: r for r in run([(*r[:3], r[3] * 1_000_000, *r[4:]) for r in hand], None).collect()}
    assert got[0].repricing_velocity is None and round(got[1].book_imbalance, 9) == -0.1 and round(got[2].repricing_velocity, 9) == 0.01 and round(got[2].book_imbalance, 9) == 0.2
    assert round(got[2].cross_asset_dispersion, 9) == 0.03 and got[0].cross_asset_dispersion is None and got[4].cross_asset_dispersion is None
    # A moved ask is a change though the price stays.
    assert [got[i].consecutive_quote_stability for i in (0, 2, 3, 4)] == [1, 1, 1, 2] and got[4].time_since_quote_update == 5.0 and round(got[3].spread_compression, 9) == -0.01
    assert round(got[3].repricing_acceleration, 9) == -0.005 and got[4].yes_change_frequency == 1 / 30


def test_first_of_a_step_with_ties(spark):
    rows = [("k", 5, 2, 1.0), ("k", 5, 1, 9.0), ("k", 12, 3, 4.0)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v double")
    assert [tuple(r) for r in series.resampled(df, "k", "t", 10, "i").orderBy("t").collect()] == [("k", 5, 1, 9.0, 0), ("k", 12, 3, 4.0, 10)]
