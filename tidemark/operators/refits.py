"""Many logistic regressions from one scan, and datasets and feature sets compared by them.

A Newton step of all regressions is one pass over the rows: each task adds the gradient and Hessian block of every
regression over its own columns, with numpy, and hands on one row a regression; the driver solves systems of as many
unknowns as a regression has columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .lab import minute_close, snapshots_before
from .metrics import probability_metrics
from .order import ordinal
from .stats import preprocessing, standardised


def logistic_groups(df: DataFrame, groups: dict[str, Sequence[str]], outcome: str, l2: float = 1.0, tolerance: float = 1e-9, most: int = 100, part: str | None = None) -> dict[tuple, np.ndarray]:
    """Intercept and coefficients of each (part, group), as `logistic_fit` gives them; without `part`, the part is None.

    Every step is one scan for all that haven't converged. Columns must hold numbers everywhere; fill them first.
    """
    union = list(dict.fromkeys(c for g in groups.values() for c in g))
    places = {g: [0, *[union.index(c) + 1 for c in columns]] for g, columns in groups.items()}
    rows = written(df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(union)], F.col(outcome).cast("double").alias("y"), (F.col(part) if part else F.lit("")).cast("string").alias("part")), "refits")
    bad = rows.filter(" or ".join(f"{c} is null or isnan({c})" for c in [*(f"x{i}" for i in range(len(union))), "y"])).count()
    if bad:
        raise ValueError(f"{bad} rows without a number in a feature or the outcome")
    parts = [r["part"] for r in rows.select("part").distinct().collect()]
    weights = {(p, g): np.zeros(len(at)) for p in parts for g, at in places.items()}
    live = set(weights)

    def step(now: dict[tuple, np.ndarray]) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {k: np.zeros(len(w) * (len(w) + 1)) for k, w in now.items()}
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.column_stack([np.ones(b.num_rows), *[b.column(i).to_numpy() for i in range(len(union))]])
                y, of = b.column(len(union)).to_numpy(), np.array(b.column(len(union) + 1).to_pylist(), object)
                inside = {p: of == p for p in {k[0] for k in now}}
                for (p, g), w in now.items():
                    own, t = x[inside[p]][:, places[g]], y[inside[p]]
                    q = 1 / (1 + np.exp(-np.clip(own @ w, -700, 700)))
                    sums[p, g] += np.concatenate((own.T @ (q - t), (own.T @ (own * (q * (1 - q))[:, None])).ravel()))
            yield pa.record_batch([pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums]), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["p", "g", "v"])

        added = rows.mapInArrow(run, "p string, g string, v array<double>").select("p", "g", F.posexplode("v").alias("i", "v")).groupBy("p", "g", "i").agg(F.sum("v").alias("v"))
        found: dict[tuple, dict[int, float]] = {}
        for r in added.collect():  # as many numbers as the systems have
            found.setdefault((r["p"], r["g"]), {})[r["i"]] = r["v"]
        out = {}
        for k, v in found.items():
            d = len(now[k])
            flat = np.array([v[i] for i in range(d * (d + 1))])
            out[k] = flat[:d], flat[d:].reshape(d, d)
        return out

    for _ in range(most):
        for k, (gradient, hessian) in step({k: weights[k] for k in live}).items():
            ridge = np.full(len(gradient), l2)
            ridge[0] = 0.0
            move = np.linalg.solve(hessian + np.diag(ridge) + 1e-9 * np.eye(len(ridge)), gradient + ridge * weights[k])
            weights[k] = weights[k] - move
            if np.abs(move).max() < tolerance:
                live.discard(k)
        if not live:
            break
    return {(k[0] if part else None, k[1]): w for k, w in weights.items()}


def predictions(df: DataFrame, groups: dict[str, Sequence[str]], weights: dict[tuple, np.ndarray], part: str | None = None) -> DataFrame:
    """df with `name` and `p` (in place of columns so named): a row for each group, with its prediction; of the row's own part, if there are parts."""

    def one(p, g):
        w = weights[p, g]
        return 1 / (1 + F.exp(-sum((float(v) * F.col(c).cast("double") for v, c in zip(w[1:], groups[g], strict=True)), F.lit(float(w[0])))))

    def of(g):
        if part is None:
            return one(None, g)
        return F.coalesce(*[F.when(F.col(part).cast("string") == p, one(p, g)) for p in dict.fromkeys(k[0] for k in weights)])

    return df.withColumn("_g", F.explode(F.array(*[F.struct(F.lit(g).alias("name"), of(g).alias("p")) for g in groups]))).select(*[c for c in df.columns if c not in ("name", "p")], "_g.*")


def refit_groups(train: DataFrame, validation: DataFrame, groups: dict[str, Sequence[str]], outcome: str, baseline: str, l2: float = 1.0) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """A row a group: name, n, log_loss, brier, and what each is less the baseline's (a column of probabilities); and the weights.

    Missing values become the training median and columns are standardised by the training rows, once for all groups.
    """
    union = list(dict.fromkeys(c for g in groups.values() for c in g))
    figures = preprocessing(train, union)
    weights = logistic_groups(standardised(train, figures), groups, outcome, l2)
    # The baseline is a feature too, perhaps, so it is kept beside.
    rows = predictions(standardised(validation.withColumn("_baseline", F.col(baseline).cast("double")), figures), groups, weights)
    metrics = probability_metrics(rows.select(outcome, "name", "p").unionByName(validation.select(outcome, F.lit(None).cast("string").alias("name"), F.col(baseline).cast("double").alias("p"))), outcome, "p", ["name"])
    against = metrics.filter("name is null").select(F.col("log_loss").alias("_l"), F.col("brier").alias("_b"))
    out = metrics.filter("name is not null").crossJoin(F.broadcast(against))  # a single row
    return out.select("name", "n", "log_loss", "brier", "accuracy", (F.col("log_loss") - F.col("_l")).alias("delta_log_loss"), (F.col("brier") - F.col("_b")).alias("delta_brier")), {g: weights[None, g] for g in groups}


def placed(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with `_place` (from 0) of each row in its group's order, and the group's `_size`, by ranges of (group, order)."""
    rows = ordinal(df, [*by, *order], "_n")
    bounds = rows.groupBy(*by).agg(F.min("_n").alias("_low"), F.count("*").alias("_size"))
    return rows.join(bounds, list(by)).withColumn("_place", F.col("_n") - F.col("_low")).drop("_n", "_low")


def descent_fit(df: DataFrame, columns: Sequence[str], outcome: str, epochs: int = 30_000, rate: float = 0.08, l2: float = 1.0, most: int = 1_000_000) -> np.ndarray:
    """Intercept and coefficients by full-batch gradient descent: w -= rate * (gradient + l2 * w, intercept apart) / rows.

    It starts from zero and the log odds of the base rate.
    Rows are compressed to distinct (features, outcome) with their counts, which is all that the descent reads, so the
    epochs run on one table of `most` rows at most, in the driver; an error says so where the rows don't compress to that.
    """
    counted = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.col(outcome).cast("double").alias("y")).groupBy(*[f"x{i}" for i in range(len(columns))], "y").agg(F.count("*").cast("double").alias("n"))
    found = counted.limit(most + 1).toPandas().to_numpy(float)
    if len(found) > most:
        raise ValueError(f"more than {most} distinct rows; use logistic_fit, which scans them")
    if np.isnan(found).any():
        raise ValueError("rows without a number in a feature or the outcome")
    w = np.zeros(len(columns) + 1)
    if not len(found):
        return w
    x, y, n = np.column_stack((np.ones(len(found)), found[:, : len(columns)])), found[:, -2], found[:, -1]
    base = np.clip((n @ y) / n.sum(), 1e-12, 1 - 1e-12)
    w[0] = np.log(base / (1 - base))
    penalty = np.full(len(w), l2)
    penalty[0] = 0.0
    for _ in range(epochs):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        w = w - rate * ((n * (q - y)) @ x + penalty * w) / n.sum()
    return w


def minute_features(closes: DataFrame, asked: DataFrame, key: str, minute: str, value: str, at: str, entry: str, returns: Sequence[int] = (1, 5, 15), steps: int = 15, least: int = 5) -> DataFrame:
    """asked with close, return_<k>m and volatility: of the closes of its minute and those before, each at most nine minutes old.

    volatility is the population deviation of the log returns between neighbours of the last `steps` minutes; NULL with
    fewer than `least`. `entry` tells the asked rows apart. All minutes of a row are joined at once and regrouped.
    """
    back = sorted({*returns, *range(steps + 1)})
    rows = asked.select(entry, key, at, F.explode(F.array(*map(F.lit, back))).alias("_back")).withColumn("_then", F.col(at) - 60 * F.col("_back"))
    met = minute_close(closes, rows, key, minute, value, "_then", name="_close").groupBy(entry).agg(F.map_from_entries(F.collect_list(F.struct("_back", "_close"))).alias("_c"))
    close = lambda i: F.col("_c")[i]
    pairs = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: F.struct(F.col("_c")[i].alias("a"), F.col("_c")[i - 1].alias("b")))
    logs = F.transform(F.filter(pairs, lambda p: (p["a"] > 0) & (p["b"] != 0)), lambda p: F.ln(p["b"] / p["a"]))
    mean = F.aggregate(F.col("_r"), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.lit(1), F.size("_r"))
    spread = F.aggregate(F.col("_r"), F.lit(0.0), lambda s, x: s + (x - F.col("_mean")) * (x - F.col("_mean")))
    out = asked.join(met, entry).withColumn("_r", logs).withColumn("_mean", mean)
    out = out.withColumns({"close": close(0)} | {f"return_{k}m": F.try_divide(close(0), F.nullif(close(k), F.lit(0.0))) - 1 for k in returns} | {"volatility": F.when(F.size("_r") >= least, F.sqrt(spread / F.greatest(F.lit(1), F.size("_r"))))})
    return out.drop("_c", "_r", "_mean")


def datasets(points: DataFrame, markets: DataFrame, closes: DataFrame, horizons: dict[str, int], market: str = "market", at: str = "at", probability: str = "probability", end: str = "end", outcome: str = "outcome", key: str = "key") -> DataFrame:
    """dataset, market, at, probability, close, returns, volatility and outcome: a row for each horizon and market that has them all.

    points has market, at (seconds) and probability; markets the end, outcome and the key of its closes (minute, value).
    """
    snaps = snapshots_before(points, markets, market, at, probability, end, horizons)
    rows = snaps.join(markets.select(market, key, outcome), market).withColumn("_entry", F.struct("dataset", market))
    out = minute_features(closes, rows, key, "minute", "value", at, "_entry")
    names = ["close", "return_1m", "return_5m", "return_15m", "volatility"]
    return out.dropna(subset=[probability, *names]).select("dataset", market, at, probability, *names, outcome)


def compare_datasets(rows: DataFrame, sets: dict[str, Sequence[str]], outcome: str, raw: str, order: Sequence[str], dataset: str = "dataset", share: float = 0.70, l2: float = 1.0) -> DataFrame:
    """dataset, name, train, n, log_loss, brier, accuracy and beats_raw: each feature set of each dataset, and the raw probability.

    A dataset's first int(n * share) rows in order train, standardised by those; the others test. All regressions of all
    datasets take their steps in the same scans. Datasets are few, and each is named in the plan.
    """
    cut = placed(rows, [dataset], order).withColumn("_train", F.col("_place") < F.floor(F.col("_size") * share))
    cut = written(cut.withColumn("_raw", F.col(raw).cast("double")), "datasets")
    union = list(dict.fromkeys(c for s in sets.values() for c in s))
    figures = {r[dataset]: r for r in cut.filter("_train").groupBy(dataset).agg(*[F.avg(c).alias(f"m_{c}") for c in union], *[F.stddev_pop(c).alias(f"s_{c}") for c in union]).collect()}  # a row a dataset
    scaled = cut
    for c in union:
        x = F.col(c).cast("double")
        scaled = scaled.withColumn(c, F.coalesce(*[F.when(F.col(dataset) == d, (x - r[f"m_{c}"]) / (r[f"s_{c}"] if r[f"s_{c}"] and r[f"s_{c}"] > 1e-12 else 1.0)) for d, r in figures.items()]))
    weights = logistic_groups(scaled.filter("_train"), sets, outcome, l2, part=dataset)
    test = scaled.filter("not _train")
    rows = predictions(test, sets, weights, dataset).select(dataset, "name", "p", outcome).unionByName(test.select(dataset, F.lit("raw").alias("name"), F.col("_raw").alias("p"), outcome))
    metrics = probability_metrics(rows, outcome, "p", [dataset, "name"])
    sizes = cut.groupBy(dataset).agg(F.count(F.when(F.col("_train"), 1)).alias("train"))
    base = metrics.filter("name = 'raw'").select(dataset, F.col("log_loss").alias("_l"), F.col("brier").alias("_b"))
    out = metrics.join(base, dataset).join(sizes, dataset)
    return out.select(dataset, "name", "train", "n", "log_loss", "brier", "accuracy", ((F.col("brier") < F.col("_b")) & (F.col("log_loss") < F.col("_l"))).alias("beats_raw"))


def prefix_scaler(df: DataFrame, columns: Sequence[str], order: Sequence[str], share: float = 0.70) -> DataFrame:
    """column, mean, deviation (population; 1 if it is 0) over the first int(n * share) rows in the total order."""
    first = placed(df.withColumn("_all", F.lit(0)), ["_all"], order).filter(F.col("_place") < F.floor(F.col("_size") * share))
    one = first.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    told = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("mean"), F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0).alias("deviation")) for c in columns])
    return one.select(F.explode(told).alias("r")).select("r.*")
