"""Joins, sets and checks over tables: reconciliation, first-wins unions, keep-first duplicates, quality, splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import reasons
from .order import ordinal


def reconciled(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, other, status: matched, mismatched or missing, for every row of left; right has one row a key."""
    other = right.select(key, F.col(value).alias("other"), F.lit(True).alias("_there"))
    out = left.select(key, value).join(other, key, "left")
    status = F.when(F.col("_there").isNull(), "missing").when(F.col(value).eqNullSafe(F.col("other")), "matched").otherwise("mismatched")
    return out.withColumn("status", status).drop("_there")


def reconciliation_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """One row: matched, mismatched, missing, coverage and agreement in per cent."""
    n = lambda s: F.count(F.when(F.col(status) == s, 1))
    out = rows.agg(n("matched").alias("matched"), n("mismatched").alias("mismatched"), n("missing").alias("missing"))
    met = F.col("matched") + F.col("mismatched")
    return out.withColumn("coverage", 100 * F.try_divide(met, met + F.col("missing"))).withColumn("agreement", 100 * F.try_divide("matched", met))


def without_conflicts(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key and columns of the keys that have one distinct combination of them."""
    row = F.struct(*columns)
    out = df.groupBy(key).agg(F.min(row).alias("_a"), F.max(row).alias("_b"))
    return out.filter(F.col("_a").eqNullSafe(F.col("_b"))).select(key, "_a.*")


def first_wins(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Each key's row of the first table that has it, with the table's place as `origin`; one row a key within a table."""
    rows = reduce(lambda a, b: a.unionByName(b), [t.withColumn("origin", F.lit(i)) for i, t in enumerate(tables)])
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct("origin", *[c for c in columns if c != "origin"])).alias("_row")).select(key, "_row.*")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each combination of keys, with the number of rows that it stands for as `copies`.

    A grouped minimum rather than a window: it is pre-aggregated, so a frequent combination isn't sorted in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"), F.count("*").alias("copies"))
    return out.select(*keys, "_row.*", "copies")


def best_version(df: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """Each key's row with the greatest values of `by`."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_row")).select(key, "_row.*")


def intervals_meet(a: DataFrame, b: DataFrame, key: str, begin: str, end: str, stretch: float) -> DataFrame:
    """Rows of a that share a key with a row of b and overlap it in time.

    Intervals are dealt to the stretches of time that they touch, so a busy key is spread over its stretches and a row
    meets only those of its own; `stretch` should be about an interval's length.
    """
    touched = lambda x, y: F.explode(F.sequence(F.floor(x / F.lit(stretch)), F.greatest(F.floor(x / F.lit(stretch)), F.ceil(y / F.lit(stretch)) - 1)))
    left = a.withColumn("_id", F.monotonically_increasing_id()).withColumn("_s", touched(F.col(begin), F.col(end)))
    other = b.select(F.col(key).alias("_k"), F.col(begin).alias("_b"), F.col(end).alias("_e"), touched(F.col(begin), F.col(end)).alias("_t"))
    met = left.join(other, (left[key] == other["_k"]) & (left["_s"] == other["_t"]) & (left[begin] < other["_e"]) & (left[end] > other["_b"]), "left_semi")
    return met.dropDuplicates(["_id"]).drop("_id", "_s")


# Data quality


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, rows, nulls, completeness for each column, from one pass."""
    one = df.agg(F.count("*").alias("rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(c).alias("nulls")) for c in columns])).alias("r")).select("r.*", (1 - F.try_divide("r.nulls", "r.rows")).alias("completeness"))


def duplicate_rate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows, distinct, duplicates, rate."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct"))
    return out.withColumn("duplicates", F.col("rows") - F.col("distinct")).withColumn("rate", F.coalesce(F.try_divide("duplicates", "rows"), F.lit(0.0)))


def correlations(df: DataFrame, columns: Sequence[str], digits: int = 8) -> DataFrame:
    """a, b, n, correlation of each pair over the rows that have both; NULL if one is constant. One pass, no self-join."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = []
    for k, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
        sums += [F.count(F.when(both, 1)).alias(f"n{k}"), F.covar_pop(x, y).alias(f"c{k}"), F.stddev_pop(x).alias(f"x{k}"), F.stddev_pop(y).alias(f"y{k}")]
    row = lambda k, a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{k}").alias("n"), F.round(F.try_divide(f"c{k}", F.nullif(F.col(f"x{k}") * F.col(f"y{k}"), F.lit(0.0))), digits).alias("correlation"))
    return df.agg(*sums).select(F.explode(F.array(*[row(k, a, b) for k, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


#: Fixed weights of the parts of the quality score, each from 0 to 100.
QUALITY_WEIGHTS = {"public_sample_ratio": 0.30, "class_balance": 0.25, "missing_value_control": 0.15, "duplicate_control": 0.10, "feature_completeness": 0.20}
#: The bounds of its gates: shares in per cent.
LEAST_PUBLIC, LEAST_MINORITY, LEAST_COMPLETE, MOST_DUPLICATES, LEAST_QUALITY = 80.0, 30.0, 95.0, 1.0, 75.0


def quality_score(df: DataFrame, features: Sequence[str], optional: Sequence[str] = (), source: str = "market_source", outcome: str = "outcome", market: str = "market_id", digits: int = 4) -> DataFrame:
    """One row: counts, the five parts of QUALITY_WEIGHTS, their weighted score, the gates that fail, and `recommended`.

    A value is missing if it is NULL or blank. Missing values are counted over all columns but the `optional` ones,
    completeness over `features`, duplicates over whole rows. Balance is 100 at a minority of one half. An empty table
    has no public rows, wholly missing values and wholly duplicate rows.
    """
    n, count = F.count("*"), lambda c: F.count(F.when(c, 1))
    blank = lambda c: (F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).cast("int")
    judged = [c for c in df.columns if c not in optional]
    up, down = count(F.col(outcome).try_cast("double") == 1), count(F.col(outcome).try_cast("double") == 0)
    pct = lambda a, b, empty: F.coalesce(100 * F.try_divide(a, b), F.lit(empty))
    one = df.agg(
        n.alias("rows"),
        count(F.col(source) == "public").alias("public_rows"),
        count(F.col(source) == "mock").alias("mock_rows"),
        up.alias("up"),
        down.alias("down"),
        F.coalesce(F.sum(sum((blank(c) for c in judged[1:]), blank(judged[0]))), F.lit(0)).alias("missing_values"),
        F.coalesce(F.sum(sum((blank(c) for c in features[1:]), blank(features[0]))), F.lit(0)).alias("missing_features"),
        (n - F.countDistinct(market) - F.max(F.col(market).isNull().cast("int"))).alias("duplicate_markets"),
    )
    twice = df.groupBy(*df.columns).agg(n.alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    out = one.crossJoin(F.broadcast(twice))  # two single rows
    cells, feature_cells = F.col("rows") * len(judged), F.col("rows") * len(features)
    minority = pct(F.least("up", "down"), F.col("up") + F.col("down"), 0.0)
    duplicates = pct(F.col("duplicate_rows"), F.col("rows"), 100.0)
    out = out.withColumns(
        {
            "imbalance": pct(F.abs(F.col("up") - F.col("down")), F.col("up") + F.col("down"), 100.0),
            "minority": minority,
            "duplicate_rate": duplicates,
            "public_sample_ratio": F.round(pct(F.col("public_rows"), F.col("rows"), 0.0), digits),
            "class_balance": F.round(F.least(F.lit(100.0), minority * 2), digits),
            "missing_value_control": F.round(F.greatest(F.lit(0.0), 100 - pct(F.col("missing_values"), cells, 100.0)), digits),
            "duplicate_control": F.round(F.greatest(F.lit(0.0), 100 - duplicates), digits),
            "feature_completeness": F.round(pct(feature_cells - F.col("missing_features"), feature_cells, 0.0), digits),
        }
    )
    out = out.withColumn("score", F.round(reduce(lambda a, b: a + b, [F.lit(w) * F.col(k) for k, w in QUALITY_WEIGHTS.items()]), 2))
    failures = reasons(
        (F.col("rows") == 0, "dataset is empty"),
        (pct(F.col("public_rows"), F.col("rows"), 0.0) < LEAST_PUBLIC, "public sample ratio is below 80%"),
        (F.col("minority") < LEAST_MINORITY, "minority class share is below 30%"),
        (pct(feature_cells - F.col("missing_features"), feature_cells, 0.0) < LEAST_COMPLETE, "feature completeness is below 95%"),
        (F.col("duplicate_rate") > MOST_DUPLICATES, "duplicate rate exceeds 1%"),
        (F.col("score") < LEAST_QUALITY, "quality score is below 75"),
    )
    return out.withColumn("failures", failures).withColumn("recommended", F.size("failures") == 0)


def missingness(df: DataFrame, columns: Sequence[str], session: str) -> DataFrame:
    """column, session (NULL: all), rows, nulls, completeness: in one pass over rows, expanded for the total and the session."""
    both = df.select(F.explode(F.array(F.lit(None).cast("string"), F.col(session).cast("string"))).alias("session"), *columns)
    own = both.groupBy("session").agg(F.count("*").alias("rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("nulls")) for c in columns])
    return own.select("session", "rows", F.explode(rows).alias("r")).select("r.column", "session", "rows", "r.nulls", (1 - F.try_divide("r.nulls", "rows")).alias("completeness"))


def dataset_summary(df: DataFrame, group: str, outcome: str, columns: Sequence[str]) -> DataFrame:
    """item, name, value: rows, rows of each group, rows of each outcome, and nulls of each column, from one aggregation."""
    entry = lambda item, name: F.struct(F.lit(item).alias("item"), F.coalesce(name.cast("string"), F.lit("none")).alias("name"))
    parts = [entry("rows", F.lit("all")), entry("group", F.col(group)), entry("outcome", F.col(outcome))]
    nulls = [F.when(F.col(c).isNull(), entry("nulls", F.lit(c))) for c in columns]
    return df.select(F.explode(F.array_compact(F.array(*parts, *nulls))).alias("r")).groupBy("r.item", "r.name").agg(F.count("*").alias("value"))


def require(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """df; fails when run if a row violates a check, with the counts of violations of all of them."""
    counts = df.agg(*[F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(n) for n, c in checks.items()]).first()
    bad = {k: v for k, v in counts.asDict().items() if v}
    if bad:
        raise ValueError(f"rows violate: {bad}")
    return df


# Splits


def purged_split(df: DataFrame, window: str, purge: int, embargo: int, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """df with `part`: train, validation, test, or purged and embargoed around the cuts, by the rank of the distinct window.

    The cuts are int(n * train) and int(n * (train + validation)) windows, in floating point. The `purge` windows before
    a cut and the `embargo` windows after it belong to no part. Windows are one small row each.
    """
    windows = ordinal(df.select(window).filter(F.col(window).isNotNull()).distinct(), [window], "_i")
    n = windows.count()
    cuts = int(n * train), int(n * (train + validation))
    i = F.col("_i")
    part = F.when(i < cuts[0], "train").when(i < cuts[1], "validation").otherwise("test")
    for c in cuts:
        part = F.when((i >= c - purge) & (i < c), "purged").when((i >= c) & (i < c + embargo), "embargoed").otherwise(part)
    return df.join(windows.select(window, part.alias("part")), window)


def folds(df: DataFrame, key: str, order: str, n: int = 3) -> DataFrame:
    """df with `fold` (1 to n): keys in the order in which they are first seen, place * n // keys + 1.

    Places are counted by range-partitioned blocks, so that no task sorts all keys.
    """
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    total = first.count()
    placed = ordinal(first, ["_first", key], "_place")
    return df.join(placed.select(key, (F.floor(F.col("_place") * n / F.lit(max(1, total))) + 1).cast("int").alias("fold")), key)
