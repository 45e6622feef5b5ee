"""Quote features, rule candidates, decision windows, model evaluation helpers and runtime summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import first_reason, hash_uniform
from ..storage import written
from . import series
from .ranks import of_columns
from .stretch import carried, framed


def microstructure(df: DataFrame, key: str, ts: str, yes: str, bid: str, ask: str, bid_depth: str, ask_depth: str, session: str, asset: str, assets: Sequence[str], quote_ts: str | None = None, span: int = 30_000_000, fresh: int = 5_000_000, bucket: int | None = None) -> DataFrame:
    """df with all quote features of a market's observations, and those across the assets of its session.

    velocity and acceleration of the price; changes of it per second in the trailing `span`; the run of equal quotes and
    the seconds since one changed, where price, bid, ask and both depths count; age of the quote; imbalance of the
    depths; change, compression (its negative) and velocity of the spread; the spread of the assets' latest prices no
    older than `fresh`, and the own price less their mean. With `bucket`, markets and sessions are sorted by stretches.
    """
    quote = F.struct(*[F.col(c) for c in (yes, bid, ask, bid_depth, ask_depth)])
    keep = (lambda x: written(x, "quotes")) if bucket else (lambda x: x)
    out = df.withColumn("_spread", F.col(ask) - F.col(bid))
    # One pass finds what the row before was, a second what depends on that; between them the rows are written.
    out = keep(carried(out, key, ts, {"_before": ("prior", F.struct(F.col(ts), F.col("_spread"), F.col(yes), quote.alias("_quote"))), "_n": ("total", F.lit(1))}, bucket))
    seconds = (F.col(ts) - F.col("_before")[ts]) / F.lit(1e6)
    change = F.col("_spread") - F.col("_before._spread")
    new = F.col("_before").isNull() | ~quote.eqNullSafe(F.col("_before._quote"))
    moved = F.coalesce((F.col("_before").isNotNull() & ~F.col(yes).eqNullSafe(F.col("_before")[yes])).cast("int"), F.lit(0))
    depth = F.col(bid_depth) + F.col(ask_depth)
    out = out.withColumn("repricing_velocity", F.when(seconds > 0, (F.col(yes) - F.col("_before")[yes]) / seconds)).withColumn("_moved", moved)
    out = carried(out, key, ts, {"_last": ("prior", F.col("repricing_velocity")), "_since": ("latest", F.when(new, F.col(ts))), "_from": ("latest", F.when(new, F.col("_n")))}, bucket)
    out = out.withColumns({
        "repricing_acceleration": (F.col("repricing_velocity") - F.col("_last")) / F.greatest(F.lit(1e-9), seconds),
        "spread_change": change,
        "spread_compression": -change,
        "spread_velocity": F.when(seconds > 0, change / seconds),
        "quote_age": F.greatest(F.lit(0.0), (F.col(ts) - F.col(quote_ts)) / F.lit(1e6)) if quote_ts else F.lit(None).cast("double"),
        "book_imbalance": F.try_divide(F.col(bid_depth) - F.col(ask_depth), F.nullif(depth.cast("double"), F.lit(0.0))),
        "time_since_quote_update": (F.col(ts) - F.col("_since")) / F.lit(1e6),
        "consecutive_quote_stability": (F.col("_n") - F.col("_from") + 1).cast("int"),
    }).drop("_before", "_spread", "_n", "_last", "_since", "_from")
    # The first row of a frame moved against a row outside of it.
    out = keep(framed(out, key, ts, span, {"yes_change_frequency": lambda w: (F.sum("_moved").over(w) - F.first("_moved").over(w)) / F.lit(span / 1e6)}, bucket).drop("_moved"))
    out = series.dispersion(out, session, ts, asset, yes, assets, fresh, bucket)
    return out.withColumnsRenamed({"dispersion": "cross_asset_dispersion", "relative": "cross_asset_relative"})


def rule_candidates(df: DataFrame, rules: dict[str, Column], market: str, margin: str) -> DataFrame:
    """rule, states, markets, best_margin, mean_margin for each rule, from one pass: a row counts for every rule it meets."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return df.withColumn("rule", F.explode(names)).groupBy("rule").agg(F.count("*").alias("states"), F.countDistinct(market).alias("markets"), F.max(margin).alias("best_margin"), F.avg(margin).alias("mean_margin"))


# Fixed bounds in seconds of a decision window.
SUFFICIENT, MARGINAL = 60, 30


def decision_class(seconds: Column) -> Column:
    return F.when(seconds >= SUFFICIENT, "sufficient_decision_window").when(seconds >= MARGINAL, "marginal_decision_window").when(seconds.isNotNull(), "insufficient_decision_window")


def decision_windows(df: DataFrame, prospective: Column, five_minute: Column, seen: Column, expiry: Column) -> DataFrame:
    """df with exclusion, the seconds from first seen to expiry, and their class.

    `seen` and `expiry` are microseconds. The first exclusion that holds counts: not seen prospectively, not a
    five-minute market, no time first seen, no expiry, seen after it. Excluded rows have neither seconds nor class.
    """
    reason = first_reason(
        (~F.coalesce(prospective, F.lit(False)), "non_prospective_or_page_churn"),
        (~F.coalesce(five_minute, F.lit(False)), "non_five_minute_market"),
        (seen.isNull(), "missing_first_seen_timestamp"),
        (expiry.isNull(), "missing_expiry"),
        (expiry < seen, "first_seen_after_expiry"),
    )
    seconds = F.when(reason.isNull(), (expiry - seen) / F.lit(1e6))
    out = df.withColumns({"exclusion": reason, "window_seconds": seconds})
    return out.withColumn("window_class", decision_class(F.col("window_seconds")))


def window_distribution(df: DataFrame, seconds: str, gates: Sequence[int] = (60, 120, 180)) -> DataFrame:
    """One row: n, min, median, mean and max, the five bins of windows, and the share at or over each gate."""
    x = F.col(seconds)
    n = lambda c: F.count(F.when(c, 1))
    edges = (30, 60, 120, 180)
    bins = [n(x < edges[0]).alias("under_30"), *[n((x >= a) & (x < b)).alias(f"from_{a}_to_{b}") for a, b in zip(edges[:-1], edges[1:], strict=True)], n(x >= edges[-1]).alias("from_180")]
    median = of_columns(df, [seconds], {"median": ("linear", 0.5)})[seconds]["median"]
    return df.agg(F.count(seconds).alias("n"), F.min(x).alias("least"), F.lit(median).cast("double").alias("median"), F.avg(x).alias("mean"), F.max(x).alias("most"), *bins, *[F.avg((x >= g).cast("double")).alias(f"share_{g}") for g in gates])


def group_priors(train: DataFrame, group: str, outcome: str) -> DataFrame:
    """group, prior: the mean outcome of each group; NULL stands for the overall one, which unseen groups take."""
    own = train.groupBy(group).agg(F.avg(F.col(outcome).cast("double")).alias("prior"))
    return own.filter(F.col(group).isNotNull()).unionByName(train.agg(F.avg(F.col(outcome).cast("double")).alias("prior")).withColumn(group, F.lit(None).cast(train.schema[group].dataType)).select(group, "prior"))


def with_priors(df: DataFrame, priors: DataFrame, group: str) -> DataFrame:
    overall = priors.filter(F.col(group).isNull()).select(F.col("prior").alias("_all"))
    return df.join(priors.filter(F.col(group).isNotNull()), group, "left").crossJoin(F.broadcast(overall)).withColumn("prior", F.coalesce("prior", "_all")).drop("_all")  # a single row


def regimes(df: DataFrame, train: DataFrame, value: str, name: str = "regime") -> DataFrame:
    """df with low, medium or high by the terciles of the training rows."""
    found = of_columns(train, [value], {"a": ("linear", 1 / 3), "b": ("linear", 2 / 3)})[value]
    low, high = found["a"], found["b"]
    if low is None:
        return df.withColumn(name, F.lit(None).cast("string"))
    return df.withColumn(name, F.when(F.col(value) <= low, "low").when(F.col(value) <= high, "medium").when(F.col(value).isNotNull(), "high"))


def perturbed(df: DataFrame, value: str, key: str, noise: float = 0.0, dropout: float = 0.0, seed: int = 1, name: str = "perturbed") -> DataFrame:
    """df with the value times 1 + noise * u, u from -1 to 1, or NULL for a share `dropout` of rows; both by hashes of the key."""
    u = 2 * hash_uniform(F.lit(seed), F.lit("noise"), key) - 1
    kept = hash_uniform(F.lit(seed), F.lit("dropout"), key) >= dropout
    return df.withColumn(name, F.when(kept, F.col(value) * (1 + noise * u)))


def daily_deltas(df: DataFrame, key: str, ts: str, counters: Sequence[str], day: Column) -> DataFrame:
    """key, day and the sum of each cumulative counter's increases; a fall, as after a restart, counts as 0."""
    w = Window.partitionBy(key).orderBy(ts)
    out = df.withColumn("day", day).withColumns({c: F.greatest(F.lit(0), F.col(c) - F.coalesce(F.lag(c).over(w), F.col(c))) for c in counters})
    return out.groupBy(key, "day").agg(*[F.sum(c).alias(c) for c in counters])


def periods(df: DataFrame, ts: str, n: int, name: str = "period") -> DataFrame:
    """df with the number (from 0) of the one of n equally long periods in which its time lies."""
    bounds = df.agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    place = F.least(F.lit(n - 1), F.floor((F.col(ts) - F.col("_a")) * n / F.greatest(F.lit(1), F.col("_b") - F.col("_a"))))
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, place.cast("int")).drop("_a", "_b")  # a single row


def histogram_json(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, histogram: the counts of each value as JSON, by value."""
    parts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return parts.groupBy(key).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n"))))).alias("histogram"))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows and an order-free digest of the columns: the sum and the exclusive or of 64-bit row hashes."""
    h = F.xxhash64(*columns)
    return df.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("total"), F.bit_xor(h).alias("parity"))
