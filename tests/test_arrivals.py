"""As-of joins in order of arrival, against the rule read row by row."""

from __future__ import annotations

import random

from tidemark.operators.asof import last_arrived

LEFT, RIGHT = "id long, k string, t long, v long", "k string, t long, n long, v long"


def by_rule(left, right, tolerance):
    out = {}
    for i, k, t, _ in left:
        # The series is in order of arrival; the last of its rows at or before t counts, fresh or not.
        before = [r for r in sorted((r for r in right if None not in r[:3]), key=lambda r: (r[2], r[1], r[3])) if k is not None and r[0] == k and t is not None and r[1] <= t]
        row = before[-1] if before else None
        out[i] = row[1:] if row and (tolerance is None or t - row[1] <= tolerance) else (None, None, None)
    return out


def test_last_arrived_equals_the_rule(spark):
    rng = random.Random(3)
    left = [(i, rng.choice(["a", "a", "b", "c", None]), rng.choice([rng.randint(-50, 200), None]) if i % 9 == 0 else rng.randint(-50, 200), 7) for i in range(300)]
    right = [(rng.choice(["a", "a", "b", None]), rng.randint(-60, 180) if rng.random() > 0.05 else None, rng.randint(0, 60) if rng.random() > 0.05 else None, rng.randint(0, 9)) for _ in range(200)]
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    for tolerance in (None, 20):
        want = by_rule(left, right, tolerance)
        for bucket in (None, 10, 64):
            got = last_arrived(a, b, "k", "t", "n", tolerance=tolerance, bucket=bucket)
            assert got.columns == ["id", "k", "t", "v", "right_t", "right_n", "right_v"]
            assert {r.id: (r.right_t, r.right_n, r.right_v) for r in got.collect()} == want


def test_a_late_row_hides_the_rows_before_it(spark):
    a = spark.createDataFrame([(1, "a", 100, 0)], LEFT)
    b = spark.createDataFrame([("a", 95, 1, 5), ("a", 20, 2, 6)], RIGHT)
    one = last_arrived(a, b, "k", "t", "n").collect()[0]
    assert (one.right_t, one.right_v) == (20, 6)
    # What arrived last is too old; the fresher one before it doesn't count.
    assert last_arrived(a, b, "k", "t", "n", tolerance=30).collect()[0].right_v is None
    assert last_arrived(a, b.limit(0), "k", "t", "n", bucket=10).collect()[0].right_v is None
    assert last_arrived(a.limit(0), b, "k", "t", "n").collect() == []
