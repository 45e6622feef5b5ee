"""Random baselines without overlap: rules against a plain check, uniform draws, and errors where a stratum runs out."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from tidemark.operators import redraws

POOL = "stratum string, market string, start long, end long, won boolean, pnl double, pnl_after double"


def drawn(spark, entries, pool, trials, **more):
    e = spark.createDataFrame(entries, "entry long, stratum string")
    p = spark.createDataFrame([(*c, c[2] % 2 == 0, c[2] / 10, c[2] / 10 - 1) for c in pool], POOL)
    return redraws.redrawn(e, p, "entry", ["stratum"], ["market"], "start", "end", trials, **more)


def test_no_overlap_and_no_repeat(spark):
    rng = random.Random(1)
    pool = [(s, m, t, t + rng.choice((0, 3, 12))) for s in "ab" for m in "xyz" for t in rng.sample(range(400), 40)]
    entries = [(i, "ab"[i % 2]) for i in range(24)]
    rows = [tuple(r) for r in drawn(spark, entries, pool, 6).select("trial", "entry", "stratum", "market", "start", "end").collect()]
    assert sorted((t, e) for t, e, *_ in rows) == [(t, e) for t in range(1, 7) for e, _ in entries]
    assert all(s == entries[e][1] and (s, m, a, b) in pool for _, e, s, m, a, b in rows)
    for trial in range(1, 7):
        own = [r[3:] for r in rows if r[0] == trial]
        assert all(a != c and not (a < d and b > c) for i, (m, a, b) in enumerate(own) for n, c, d in own[:i] if m == n)
    again = [tuple(r) for r in drawn(spark, entries, pool, 6).select("trial", "entry", "stratum", "market", "start", "end").collect()]
    assert sorted(again) == sorted(rows)


def test_a_full_stratum_takes_every_candidate(spark):
    pool = [("a", "x", 10 * i, 10 * i + 10) for i in range(6)]
    rows = drawn(spark, [(i, "a") for i in range(6)], pool, 3).collect()
    assert all(sorted(r.start for r in rows if r.trial == t) == [0, 10, 20, 30, 40, 50] for t in (1, 2, 3))


def test_draws_are_even(spark):
    pool = [("a", f"m{i}", 0, 5) for i in range(5)]
    seen = Counter(r.market for r in drawn(spark, [(0, "a")], pool, 2_000).collect())
    assert len(seen) == 5 and min(seen.values()) > 320


def test_errors_name_the_stratum(spark):
    with pytest.raises(ValueError, match="no random candidates.*'b'"):
        drawn(spark, [(0, "a"), (1, "b")], [("a", "x", 0, 1)], 1)
    with pytest.raises(ValueError, match="after 4 rounds.*'a'"):
        drawn(spark, [(0, "a"), (1, "a")], [("a", "x", 0, 9), ("a", "x", 5, 12)], 1, rounds=4)


def test_metrics_of_trials_by_hand(spark):
    rows = spark.createDataFrame([(1, 0, True, 0.5, 0.4), (1, 2, False, -0.3, -0.4), (1, 1, False, -0.1, -0.2), (2, 0, True, 0.2, 0.1)], "trial int, start long, won boolean, pnl double, pnl_after double")
    got = {r.trial: r for r in redraws.baseline_metrics(rows, "trial", ["start"], 2.0).collect()}
    assert (got[1].n, got[1].wins, got[1].pnl, got[1].pnl_after, got[1].max_drawdown, got[1].per_hour) == (3, 1, 0.1, -0.2, 0.6, 1.5)
    assert got[2].max_drawdown == 0.0 and got[2].win_rate == 1.0
