"""Regressions from one scan against one by one; datasets, descents and scalers against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tidemark.operators import refits, stats

GROUPS = {"one": ["a"], "two": ["b", "a"], "all": ["a", "b", "c"]}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    out = []
    for i in range(400):
        a, b, c = (rng.gauss(0, 1) for _ in range(3))
        out.append((i, "xy"[i % 2], a, b, c, int(rng.random() < 1 / (1 + math.exp(-(0.4 + a - 0.5 * b)))), rng.uniform(0.1, 0.9)))
    return spark.createDataFrame(out, "i long, part string, a double, b double, c double, y int, price double").cache()


def test_weights_are_those_of_single_fits(rows):
    found = refits.logistic_groups(rows, GROUPS, "y")
    for g, columns in GROUPS.items():
        assert found[None, g] == pytest.approx(stats.logistic_fit(rows, columns, "y"), abs=1e-8)


def test_parts_are_fitted_apart_in_the_same_scans(rows):
    found = refits.logistic_groups(rows, GROUPS, "y", part="part")
    assert set(found) == {(p, g) for p in "xy" for g in GROUPS}
    assert found["y", "two"] == pytest.approx(stats.logistic_fit(rows.filter("part = 'y'"), ["b", "a"], "y"), abs=1e-8)


def test_eight_groups_take_the_scans_of_one(spark, rows):
    def jobs(groups):
        tracker, name = spark.sparkContext.statusTracker(), f"refits{len(groups)}"
        spark.sparkContext.setJobGroup(name, name)
        refits.logistic_groups(rows, groups, "y")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(name))

    assert jobs({f"g{i}": ["a", "b"] for i in range(8)}) == jobs({"g": ["a", "b"]})


def test_missing_numbers_are_an_error(spark):
    with pytest.raises(ValueError, match="1 rows without a number"):
        refits.logistic_groups(spark.createDataFrame([(1.0, 1), (None, 0)], "a double, y int"), {"g": ["a"]}, "y")


def test_groups_against_a_baseline(rows):
    train, test = rows.filter("i % 4 > 0"), rows.filter("i % 4 = 0")
    out, weights = refits.refit_groups(train, test, GROUPS, "y", "price")
    figures = stats.preprocessing(train, ["a", "b", "c"])
    for r in out.collect():
        fit = stats.logistic_fit(stats.standardised(train, figures), GROUPS[r.name], "y")
        assert weights[r.name] == pytest.approx(fit, abs=1e-8)
        losses, base = [], []
        for x in stats.standardised(test, figures).collect():
            p = 1 / (1 + math.exp(-(fit[0] + sum(w * x[c] for w, c in zip(fit[1:], GROUPS[r.name], strict=True)))))
            losses.append(-math.log(p if x.y else 1 - p))
            base.append(-math.log(x.price if x.y else 1 - x.price))
        assert r.log_loss == pytest.approx(np.mean(losses)) and r.delta_log_loss == pytest.approx(np.mean(losses) - np.mean(base)) and r.n == 100


def test_datasets_are_compared_on_their_own_splits(rows):
    got = {(r.dataset, r.name): r for r in refits.compare_datasets(rows.withColumnRenamed("part", "dataset"), {"s": ["a", "b"]}, "y", "price", ["i"]).collect()}
    assert set(got) == {(d, n) for d in "xy" for n in ("s", "raw")} and all((r.train, r.n) == (140, 60) for r in got.values())
    own = [r for r in rows.orderBy("i").collect() if r.part == "x"]
    m = {c: (np.mean([r[c] for r in own[:140]]), np.std([r[c] for r in own[:140]])) for c in "ab"}
    x = np.array([[1, *((r[c] - m[c][0]) / m[c][1] for c in "ab")] for r in own])
    y = np.array([r.y for r in own])
    w = np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-x[:140] @ w))
        w -= np.linalg.solve(x[:140].T @ (x[:140] * (q * (1 - q))[:, None]) + np.diag([0, 1, 1]), x[:140].T @ (q - y[:140]) + np.array([0, 1, 1]) * w)
    q = 1 / (1 + np.exp(-x[140:] @ w))
    assert got["x", "s"].brier == pytest.approx(np.mean((q - y[140:]) ** 2)) and got["x", "s"].beats_raw


def test_descent_follows_the_rule(spark):
    rng = random.Random(1)
    data = [(float(rng.randrange(3)), float(rng.randrange(2)), int(rng.random() < 0.3)) for _ in range(300)]
    df = spark.createDataFrame(data, "a double, b double, y int")
    got = refits.descent_fit(df, ["a", "b"], "y", epochs=200)
    n, base = len(data), sum(r[2] for r in data) / len(data)
    w = [math.log(base / (1 - base)), 0.0, 0.0]
    for _ in range(200):
        g = [0.0, 0.0, 0.0]
        for a, b, y in data:
            e = 1 / (1 + math.exp(-(w[0] + w[1] * a + w[2] * b))) - y
            g = [g[0] + e, g[1] + e * a, g[2] + e * b]
        w = [w[0] - 0.08 * g[0] / n, *(w[j] - 0.08 * (g[j] + w[j]) / n for j in (1, 2))]
    assert got == pytest.approx(w, abs=1e-9)
    with pytest.raises(ValueError, match="more than 4 distinct rows"):
        refits.descent_fit(df, ["a", "b"], "y", most=4)
    assert refits.descent_fit(df.limit(0), ["a"], "y").tolist() == [0.0, 0.0]


def test_minute_features_by_hand(spark):
    closes = [("k", m, 100.0 + m) for m in range(30) if m not in (17, 18)]
    asked = spark.createDataFrame([(1, "k", 20 * 60 + 5), (2, "k", 3 * 60), (3, "z", 60)], "id long, key string, at long")
    got = {r.id: r for r in refits.minute_features(spark.createDataFrame(closes, "key string, minute long, value double"), asked, "key", "minute", "value", "at", "id").collect()}
    price = {m: 100.0 + (16 if m in (17, 18) else m) for m in range(30)}
    logs = [math.log(price[20 - i + 1] / price[20 - i]) for i in range(1, 16)]
    assert (got[1].close, got[1].return_1m, got[1].return_15m) == pytest.approx((120.0, 120 / 119 - 1, 120 / 105 - 1)) and got[1].volatility == pytest.approx(np.std(logs))
    assert got[2].return_1m == pytest.approx(103 / 102 - 1) and got[2].return_5m is None and got[2].volatility is None and got[3].close is None


def test_scaler_of_a_prefix(spark):
    df = spark.createDataFrame([(i, float(i), 5.0) for i in range(10)], "i long, a double, b double")
    assert {r.column: (r.mean, r.deviation) for r in refits.prefix_scaler(df, ["a", "b"], ["i"]).collect()} == {"a": (3.0, 2.0), "b": (5.0, 1.0)}
