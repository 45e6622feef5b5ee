"""Robustness statistics: cost scenarios, matched nulls, bootstrap intervals, multiple tests, logistic regression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import hash_uniform
from .order import ordinal
from .ranks import of_columns


def with_scenarios(df: DataFrame, scenarios: Sequence[dict], most: int = 1_000) -> DataFrame:
    """Each row once for each scenario, with its parameters as columns; the scenarios are part of the plan, not a join."""
    if len(scenarios) > most:
        raise ValueError(f"{len(scenarios)} scenarios; {most} at most")
    names = list(scenarios[0])
    grid = F.array(*[F.struct(*[F.lit(s[n]).alias(n) for n in names]) for s in scenarios])
    return df.withColumn("_s", F.explode(grid)).select(*df.columns, "_s.*")


def stress_summary(rows: DataFrame, by: Sequence[str], pnl: str) -> DataFrame:
    """n, win rate, mean, deviation, total, the interval of the mean and the share of the largest result, by scenario."""
    out = rows.groupBy(*by).agg(F.count(pnl).alias("n"), F.avg((F.col(pnl) > 0).cast("double")).alias("win_rate"), F.avg(pnl).alias("mean"), F.stddev_samp(pnl).alias("deviation"), F.sum(pnl).alias("total"), F.max(pnl).alias("best"))
    half = F.when(F.col("n") < 2, 0.0).otherwise(1.96 * F.col("deviation") / F.sqrt("n"))
    return out.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def matched_null(rows: DataFrame, stratum: str, key: str, value: str, trials: int, seed: int = 1) -> DataFrame:
    """trial, mean: the mean value when each row draws, by a hash, another row of its stratum, for each trial.

    Draws are positions in the stratum, so the draw is an equi-join on positions; a stratum's rows are numbered in blocks,
    not in one task. A position is drawn about once in a trial, so draws aren't counted before the join, and only the
    numbered rows, one for each `trials` draws, are kept in a hash table.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = ordinal(rows.select(stratum, key, value), [stratum, key], "_place")
    bounds = placed.groupBy(stratum).agg(F.min("_place").alias("_low"), F.count("*").alias("_n"))
    # Dealt out first: as many tasks draw, however few files the rows lie in.
    asked = rows.select(stratum, key).repartition(parts, key).join(bounds, stratum).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    draw = F.floor(hash_uniform(F.lit(seed), "trial", key) * F.col("_n"))
    asked = asked.select("trial", (F.col("_low") + draw).alias("_place"))
    drawn = asked.join(placed.filter(F.col(value).isNotNull()).select("_place", value).hint("shuffle_hash"), "_place")
    return drawn.groupBy("trial").agg(F.avg(value).alias("mean"))


def empirical_p(null: DataFrame, statistic: str, observed: float) -> DataFrame:
    """One row: n, p = (trials at or above the observed one + 1) / (n + 1), and the 5th and 95th percentile."""
    return null.agg(F.count("*").alias("n"), ((F.count(F.when(F.col(statistic) >= observed, 1)) + 1) / (F.count("*") + 1)).alias("p"), F.percentile(statistic, F.lit(0.05)).alias("low"), F.percentile(statistic, F.lit(0.95)).alias("high"))


def bootstrap_mean(df: DataFrame, cluster: str, value: str, trials: int = 1_000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """One row: mean, low, high of the mean by resampling clusters: Poisson(1) weights, drawn for each (cluster, trial).

    Clusters are summed first; each task adds its clusters' weighted sums for all trials at once, and only those
    `trials` sums leave it.
    """
    clusters = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n")).withColumn("h", F.xxhash64(cluster, F.lit(seed)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros(trials), np.zeros(trials)
        for x in batches:
            for h, s, n in zip(x.h.tolist(), x.s.fillna(0).tolist(), x.n.tolist(), strict=True):
                w = np.random.default_rng(h & (2**63 - 1)).poisson(1.0, trials)
                sums += w * s
                counts += w * n
        yield pd.DataFrame({"trial": np.arange(trials), "s": sums, "n": counts})

    parts = clusters.select("h", "s", "n").mapInPandas(run, "trial long, s double, n double")
    means = parts.groupBy("trial").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m"))
    tail = (1 - level) / 2
    out = means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    return df.agg(F.avg(value).alias("mean")).crossJoin(F.broadcast(out))  # two single rows


def holm(tests: DataFrame, name: str, p: str, alpha: float = 0.05) -> DataFrame:
    """tests with holm and bonferroni adjusted p-values and whether each is under alpha; one row a test, all in one window."""
    w = Window.orderBy(p, name)
    m = F.count("*").over(Window.partitionBy())
    out = tests.withColumn("_k", F.row_number().over(w)).withColumn("_a", F.least(F.lit(1.0), (m - F.col("_k") + 1) * F.col(p)))
    out = out.withColumn("holm", F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("bonferroni", F.least(F.lit(1.0), m * F.col(p)))
    return out.withColumn("holm_passes", F.col("holm") < alpha).withColumn("bonferroni_passes", F.col("bonferroni") < alpha).drop("_k", "_a")


def preprocessing(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """For each column its median, and the mean and population deviation (1 if nearly 0) after nulls became the median."""
    medians = {c: m["median"] or 0.0 for c, m in of_columns(df, columns, {"median": ("linear", 0.5)}).items()}
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(medians[c])).alias(c) for c in columns]
    row = df.select(*filled).agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (medians[c], float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"]) if (row[f"s_{c}"] or 0.0) >= 1e-12 else 1.0) for c in columns}


def standardised(df: DataFrame, figures: dict[str, tuple[float, float, float]]) -> DataFrame:
    return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(fill)) - mean) / deviation for c, (fill, mean, deviation) in figures.items()})


def logistic_fit(df: DataFrame, columns: Sequence[str], outcome: str, l2: float = 1.0, tolerance: float = 1e-9, most: int = 100) -> np.ndarray:
    """Intercept and coefficients by Newton steps, with an unpenalised intercept. Each step is one aggregate over the rows
    (gradient and Hessian sums); the driver solves a system of as many unknowns as columns."""
    d = len(columns) + 1
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    w = np.zeros(d)
    ridge = np.full(d, l2)
    ridge[0] = 0.0
    for _ in range(most):
        z: Column = sum((float(w[i]) * x[i] for i in range(1, d)), F.lit(float(w[0])))
        rows = df.select(*[v.alias(f"x{i}") for i, v in enumerate(x)], (1 / (1 + F.exp(-z))).alias("p"), F.col(outcome).cast("double").alias("y"))
        s = F.col("p") * (1 - F.col("p"))
        got = rows.agg(*[F.sum((F.col("p") - F.col("y")) * F.col(f"x{i}")) for i in range(d)], *[F.sum(s * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in upper]).first()
        gradient = np.array(got[:d]) + ridge * w
        hessian = np.zeros((d, d))
        for (i, j), v in zip(upper, got[d:], strict=True):
            hessian[i, j] = hessian[j, i] = v
        step = np.linalg.solve(hessian + np.diag(ridge) + 1e-9 * np.eye(d), gradient)
        w -= step
        if np.abs(step).max() < tolerance:
            break
    return w


def logistic_predict(df: DataFrame, columns: Sequence[str], w: np.ndarray, name: str = "p") -> DataFrame:
    z = sum((float(v) * F.col(c).cast("double") for v, c in zip(w[1:], columns, strict=True)), F.lit(float(w[0])))
    return df.withColumn(name, 1 / (1 + F.exp(-z)))


def coefficients(spark: SparkSession, columns: Sequence[str], w: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(n, float(v)) for n, v in zip(["intercept", *columns], w, strict=True)], "feature string, weight double")
