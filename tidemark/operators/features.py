"""The training table of completed market windows: one row a market, features as of an anchor in the window, and a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import first_reason, iso_timestamp
from ..sources import events as E
from .asof import asof_join

SECOND = 1_000_000


def _at(df: DataFrame, ts: Column) -> DataFrame:
    return df.withColumn("t", F.unix_micros(ts)).filter("t is not null")


def training_rows(events: DataFrame, resolutions: DataFrame | None = None, anchor: int = 60, age: int = 30, horizons: tuple[int, ...] = (5, 15, 30, 60)) -> DataFrame:
    """One row for each market with a window: timing, reference returns, quotes, lag and microstructure, outcome, skip_reason.

    Features are the latest values at or before window start + `anchor` seconds and no older than `age` seconds. The
    outcome is that of `resolutions` (market_id, outcome), else whether the reference rose over the window; label_source
    says which. skip_reason is NULL for usable rows: missing_window, missing_reference, missing_snapshot or missing_label.
    """
    markets = E.instruments(events).withColumn("t0", F.unix_micros("window_start")).withColumn("t1", F.unix_micros("window_end")).withColumn("t", F.col("t0") + anchor * SECOND)
    reference = _at(E.of_kind(events, "reference_price"), F.coalesce(iso_timestamp("timestamp"), F.col("event_time"))).select("asset", "t", "price")
    snapshots = _at(E.of_kind(events, "market_snapshot"), F.coalesce(iso_timestamp("timestamp"), F.col("event_time"))).select("market_id", "t", "yes_price", "no_price", "yes_bid", "yes_ask", "liquidity")
    lags = _at(E.of_kind(events, "lag_measurement"), F.col("event_time")).select("market_id", "t", "measurement.lag_score", "measurement.confidence")
    micro = _at(E.of_kind(events, "microstructure_snapshot"), F.col("event_time")).drop("event_time", "source_session", "event_index", "asset", "schema_version")

    out = markets.select("market_id", "asset", "source_session", "window_start", "window_end", "t0", "t1", "t")
    out = out.withColumn("market_age_seconds", (F.col("t") - F.col("t0")) / F.lit(1e6)).withColumn("seconds_to_expiry", (F.col("t1") - F.col("t")) / F.lit(1e6))
    for name, back in [("p_now", 0), *[(f"p_{h}", h) for h in horizons]]:
        out = asof_join(out.withColumn("_q", F.col("t") - back * SECOND), reference.withColumnRenamed("t", "_t"), "asset", "_q", "_t", tolerance=age * SECOND, prefix=f"{name}_", tie="price").withColumnRenamed(f"{name}_price", name).drop("_q", f"{name}__t")
    for h in horizons:
        out = out.withColumn(f"return_{h}s", F.when(F.col(f"p_{h}") > 0, F.try_divide("p_now", f"p_{h}") - 1))
    out = out.withColumn("momentum_short", F.col("return_5s") - F.col("return_15s")).withColumn("momentum_medium", F.col("return_15s") - F.col("return_60s"))
    for name, moment in (("p_open", "t0"), ("p_close", "t1")):
        out = asof_join(out, reference.withColumnRenamed("t", "_t"), "asset", moment, "_t", tolerance=age * SECOND, prefix=f"{name}_", tie="price").withColumnRenamed(f"{name}_price", name).drop(f"{name}__t")

    now = asof_join(out, snapshots.withColumnRenamed("t", "_t"), "market_id", "t", "_t", tolerance=age * SECOND, prefix="s_").drop("s__t")
    for back in (15, 30):
        past = snapshots.select("market_id", F.col("t").alias("_t"), "yes_price")
        now = asof_join(now.withColumn("_q", F.col("t") - back * SECOND), past, "market_id", "_q", "_t", tolerance=age * SECOND, prefix=f"b{back}_").drop("_q", f"b{back}__t")
        now = now.withColumn(f"probability_change_{back}s", F.col("s_yes_price") - F.col(f"b{back}_yes_price")).drop(f"b{back}_yes_price")
    now = asof_join(now, lags.withColumnRenamed("t", "_t"), "market_id", "t", "_t", tolerance=age * SECOND, prefix="").drop("_t")
    now = asof_join(now, micro.withColumnRenamed("t", "_t"), "market_id", "t", "_t", tolerance=age * SECOND, prefix="").drop("_t")
    now = now.withColumnsRenamed({"s_yes_price": "yes_price", "s_no_price": "no_price"}).withColumn("yes_no_spread", F.abs(1 - F.col("yes_price") - F.col("no_price")))

    if resolutions is not None:
        now = now.join(resolutions.select("market_id", F.col("outcome").alias("_resolved")), "market_id", "left")
    else:
        now = now.withColumn("_resolved", F.lit(None).cast("int"))
    moved = F.when(F.col("p_open").isNotNull() & F.col("p_close").isNotNull(), (F.col("p_close") > F.col("p_open")).cast("int"))
    now = now.withColumn("outcome", F.coalesce("_resolved", moved)).withColumn("label_source", F.when(F.col("_resolved").isNotNull(), "resolution").when(moved.isNotNull(), "reference_window_return"))
    reason = first_reason(
        (F.col("t0").isNull() | F.col("t1").isNull(), "missing_window"),
        (F.col("p_now").isNull(), "missing_reference"),
        (F.col("yes_price").isNull(), "missing_snapshot"),
        (F.col("outcome").isNull(), "missing_label"),
    )
    return now.withColumn("feature_timestamp", F.timestamp_micros("t")).withColumn("skip_reason", reason).drop("_resolved", "t", "t0", "t1", "p_now", "p_open", "p_close", *[f"p_{h}" for h in horizons], "s_yes_bid", "s_yes_ask", "s_liquidity")


def complete(rows: DataFrame, core: list[str], most: int = 0) -> tuple[DataFrame, DataFrame]:
    """The usable rows with at most `most` null core features, and the others with their reason."""
    nulls = sum((F.col(c).isNull().cast("int") for c in core), F.lit(0))
    rows = rows.withColumn("skip_reason", F.coalesce("skip_reason", F.when(nulls > most, F.lit("incomplete_features"))))
    return rows.filter("skip_reason is null").drop("skip_reason"), rows.filter("skip_reason is not null")
