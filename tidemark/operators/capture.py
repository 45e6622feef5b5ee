"""Captured sessions and public observations: baselines, latencies, visibility, labels of signals, random candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .behaviour import outcome_side, position_size
from .order import ordinal
from .paths import admitted, future
from .ranks import quantiles
from .trades import exposure, snapshot_class

# Fixed values of a signal's labels and of random candidates: seconds and probability points.
LONGEST, TARGET, STOP, SLIPPAGE, LEAST_LEFT, BUCKET = 180, 0.03, 0.03, 0.01, 20.0, 60


def baselines(df: DataFrame, key: str | Sequence[str], order: str, value: str, name: str = "from_baseline") -> DataFrame:
    """df with the value less the key's first one; the first is a grouped minimum, so no key is sorted."""
    keys = [key] if isinstance(key, str) else list(key)
    first = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias("_first"))
    return df.join(first, keys, "left").withColumn(name, F.col(value) - F.col("_first")).drop("_first")


def rollover_baselines(df: DataFrame, asset: str, market: str, order: str, value: str, name: str = "from_baseline") -> DataFrame:
    """df with the value less that of the asset's first row since its market last changed."""
    w = Window.partitionBy(asset).orderBy(order)
    runs = df.withColumn("_run", F.sum(F.when(F.col(market).eqNullSafe(F.lag(market).over(w)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return baselines(runs, [asset, "_run"], order, value, name).drop("_run")


def sessions_until(events: DataFrame, session: str, ts: str, cutoff) -> DataFrame:
    """The events of the sessions whose last one is at the cut-off or before."""
    kept = events.groupBy(session).agg(F.max(ts).alias("_last")).filter(F.col("_last") <= cutoff).select(session)
    return events.join(kept, session, "left_semi")


def latencies(df: DataFrame, source: str, asset: str, order: str, stages: Sequence[str], sequence: str, stale: float) -> DataFrame:
    """df with, for neighbouring stages (nanoseconds), `<stage>_ms`, the source's gap since its message before, skipped numbers, and stale.

    A quote is stale if its first stage took over `stale` milliseconds. Gaps and skips are windows by source and by (source, asset).
    """
    out = df.withColumns({f"{b}_ms": (F.col(b) - F.col(a)) / F.lit(1e6) for a, b in zip(stages[:-1], stages[1:], strict=True)})
    gap = (F.col(order) - F.lag(order).over(Window.partitionBy(source).orderBy(order))) / F.lit(1e6)
    skipped = F.col(sequence) - F.lag(sequence).over(Window.partitionBy(source, asset).orderBy(order)) - 1
    return out.withColumns({"gap_ms": gap, "sequence_gap": F.greatest(F.lit(0), F.coalesce(skipped, F.lit(0))), "stale": F.coalesce(F.col(f"{stages[1]}_ms") > stale, F.lit(False))})


def latency_by_source(df: DataFrame, source: str, metrics: Sequence[str]) -> DataFrame:
    """source, metric, n, least, mean, p50, p90, p95, p99 (nearest rank), most: metrics as rows, in one aggregation."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])
    rows = df.select(source, F.explode(entries).alias("r")).select(source, "r.*").filter("x is not null")
    plain = rows.groupBy(source, "metric").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.avg("x").alias("mean"), F.max("x").alias("most"))
    places = {f"p{p}": ("nearest_rank", p / 100) for p in (50, 90, 95, 99)}
    found = quantiles(rows, [source, "metric"], "x", places).withColumnsRenamed({source: "_s", "metric": "_m"})
    return plain.join(found, F.col(source).eqNullSafe(F.col("_s")) & (F.col("metric") == F.col("_m"))).select(source, "metric", "n", "least", "mean", *places, "most")


def timing_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, n, least, median, mean, most of a group's times; rows without one don't count."""
    plain = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    found = quantiles(df, by, value, {"median": ("linear", 0.5)}).withColumnsRenamed({c: f"_{c}" for c in by})
    return plain.join(found, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").select(*by, "n", "least", "median", "mean", "most")


def visibility(trades: DataFrame, groups: DataFrame, wallet: str = "wallet") -> DataFrame:
    """trades of the grouped wallets with sequence, delay to publication and its status, retrieval lag and completeness.

    trades has t, published and fetched (microseconds, NULL if unknown), tx and key; groups has wallet, and columns of its
    own. Sequence numbers follow (t, tx, key), unknown times last.
    """
    out = trades.withColumn(wallet, F.lower(wallet)).join(groups, wallet)
    delay = (F.col("published") - F.col("t")) / F.lit(1e6)
    status = F.when(delay.isNull(), "unknown_missing_publication_timestamp").when(delay < 0, "invalid_publication_precedes_trade").otherwise("measured_trade_to_publication")
    known = sum((F.col(c).isNotNull().cast("int") for c in ("published", "fetched")), F.col("t").isNotNull().cast("int"))
    place = F.row_number().over(Window.partitionBy(wallet).orderBy(F.col("t").asc_nulls_last(), F.coalesce("tx", F.lit("")), F.coalesce("key", F.lit(""))))
    return out.withColumns({"sequence": place, "delay": F.when(delay >= 0, delay), "delay_status": status, "retrieval_lag": (F.col("fetched") - F.col("t")) / F.lit(1e6), "completeness": known})


def label_rows(signals: DataFrame, quotes: DataFrame, target: float = TARGET, stop: float = STOP, slippage: float = SLIPPAGE) -> DataFrame:
    """What followed each signal: side, entry, excursions, first hits, exit, reason, pnl before and after slippage.

    signals has signal, market, direction (UP or DOWN), t and seconds_to_expiry of the quote at its time, and price, that
    of yes; quotes has market, t and price. The path runs to 180 s or a second before expiry and must hold two quotes, the
    entry's own included. A target hit no later than the stop wins; else the stop, else the last quote.
    Signals too near expiry, without direction, or repeated, give no row, nor do those that overlap an open one of the
    same market and side.
    """
    rows = signals.filter(F.col("direction").isin("UP", "DOWN") & (F.col("seconds_to_expiry") >= LEAST_LEFT)).dropDuplicates(["market", "direction", "t"])
    rows = rows.withColumns({"side": F.when(F.col("direction") == "UP", "YES").otherwise("NO"), "_last": F.col("t") + F.least(F.lit(LONGEST), F.floor(F.col("seconds_to_expiry")) - 1) * 1_000_000})
    met = future(rows, quotes.select("market", F.col("t").alias("at"), F.col("price").alias("q")), "market", "t", LONGEST * 1_000_000, "at", "p_").filter(F.col("p_at") <= F.col("_last"))
    move = F.when(F.col("side") == "YES", F.col("p_q") - F.col("price")).otherwise(F.col("price") - F.col("p_q"))
    step = F.struct(F.col("p_at").alias("at"), move.alias("move"))
    keep = ["signal", "market", "side", "t", "price"]
    out = met.groupBy(*keep).agg(F.count("*").alias("observations"), F.max(move).alias("_up"), F.min(move).alias("_down"), F.min(F.when(move >= target - 1e-12, step)).alias("hit"), F.min(F.when(move <= -stop + 1e-12, step)).alias("lost"), F.max(step).alias("last"))
    won = F.col("hit").isNotNull() & (F.col("lost").isNull() | (F.col("hit.at") <= F.col("lost.at")))
    leave = F.when(won, F.col("hit")).when(F.col("lost").isNotNull(), F.col("lost")).otherwise(F.col("last"))
    entry = F.when(F.col("side") == "YES", F.col("price")).otherwise(1 - F.col("price"))
    out = out.withColumns({"mfe": F.greatest(F.lit(0.0), F.col("_up")), "mae": F.least(F.lit(0.0), F.col("_down")), "entry": entry, "exit_at": leave["at"], "pnl": leave["move"], "reason": F.when(won, "repricing_target").when(F.col("lost").isNotNull(), "stop_loss").otherwise("timeout")})
    out = out.withColumns({"won": F.col("reason") == "repricing_target", "pnl_after": F.col("pnl") - slippage, "_position": F.concat_ws("|", "market", "side")}).drop("_up", "_down", "hit", "lost", "last")
    return admitted(out, "_position", "t", "exit_at", "signal").drop("_position")


def candidate_pool(quotes: DataFrame, batch: str = "session", order: str | None = None) -> DataFrame:
    """batch, asset, side, bucket, t, exit_at, pnl, pnl_after, won: every quote as an entry on either side, to its first hit.

    quotes has the batch, market, asset, t, price (of yes) and seconds_to_expiry; buckets are of 60 s to expiry. A quote
    meets its path once for both sides. `order` is a column of numbers that tells a market's quotes of one time apart: each
    is an entry of its own, and where several of one time hit, or end the path, the last of them counts, on both sides the
    same. Without it a market's quotes must differ in time.
    """
    place = F.col(order) if order else F.lit(0)
    quotes = quotes.withColumn("_order", place.cast("long"))
    keys = (batch, "market", "asset", "t", "seconds_to_expiry", "_order")
    rows = quotes.filter(F.col("seconds_to_expiry") >= LEAST_LEFT).select(*keys, "price")
    rows = rows.withColumn("_last", F.col("t") + F.least(F.lit(LONGEST), F.floor(F.col("seconds_to_expiry")) - 1) * 1_000_000)
    met = future(rows, quotes.select("market", F.col("t").alias("at"), F.col("price").alias("q"), F.col("_order").alias("order")), "market", "t", LONGEST * 1_000_000, "at", "p_").filter(F.col("p_at") <= F.col("_last"))
    found = []
    for side, move in (("YES", F.col("p_q") - F.col("price")), ("NO", F.col("price") - F.col("p_q"))):
        first, last = (F.struct(F.col("p_at").alias("at"), o.alias("order"), move.alias("move")) for o in (-F.col("p_order"), F.col("p_order")))
        hit, lost = F.min(F.when(move >= TARGET - 1e-12, first)), F.min(F.when(move <= -STOP + 1e-12, first))
        found.append(F.struct(F.lit(side).alias("side"), hit.alias("hit"), lost.alias("lost"), F.max(last).alias("last")))
    out = met.groupBy(*keys).agg(F.array(*found).alias("_sides")).select(*keys, F.explode("_sides").alias("_side")).select(*keys, "_side.*")
    won = F.col("hit").isNotNull() & (F.col("lost").isNull() | (F.col("hit.at") <= F.col("lost.at")))
    leave = F.when(won, F.col("hit")).when(F.col("lost").isNotNull(), F.col("lost")).otherwise(F.col("last"))
    bucket = (F.floor(F.col("seconds_to_expiry") / BUCKET) * BUCKET).cast("int")
    return out.select(batch, "market", "asset", "side", bucket.alias("bucket"), "t", leave["at"].alias("exit_at"), leave["move"].alias("pnl"), (leave["move"] - SLIPPAGE).alias("pnl_after"), F.coalesce(won, F.lit(False)).alias("won"))


def trial_metrics(drawn: DataFrame, hours: float, trial: str = "trial") -> DataFrame:
    """trial, n, wins, win_rate, pnl before and after slippage, expectancy, signals an hour.

    Results are summed as decimals of 12 places, so that sums don't depend on the order of rows and none is minus zero.
    """
    total = lambda c: F.sum(F.col(c).cast("decimal(28,12)")).cast("double")
    out = drawn.groupBy(trial).agg(F.count("*").alias("n"), F.count(F.when(F.col("won"), 1)).alias("wins"), total("pnl").alias("pnl"), total("pnl_after").alias("pnl_after"), F.count("pnl_after").alias("_n"))
    return out.withColumns({"expectancy": F.try_divide("pnl_after", "_n"), "win_rate": F.try_divide("wins", "n"), "per_hour": F.col("n") / hours}).drop("_n")


def wallet_manifest(seeds: DataFrame, candidates: DataFrame, most: int, wallet: str = "wallet") -> DataFrame:
    """place, wallet, origin of at most `most` wallets: seeds first by place, then candidates by (priority, wallet), each once.

    seeds has wallet and priority as candidates has.
    """
    both = seeds.select(F.lower(wallet).alias(wallet), "priority", F.lit(0).alias("_o")).unionByName(candidates.select(F.lower(wallet).alias(wallet), "priority", F.lit(1).alias("_o")))
    one = both.groupBy(wallet).agg(F.min(F.struct("_o", "priority")).alias("_k")).orderBy("_k", wallet).limit(most)
    return ordinal(one, ["_k", wallet], "place").select("place", wallet, F.when(F.col("_k._o") == 0, "seed").otherwise("discovered").alias("origin"))


def chronological_split(df: DataFrame, order: Sequence[str], train: float = 0.70, name: str = "part") -> DataFrame:
    """df with train for the first int(n * train) rows in the total order, test for the others."""
    placed = ordinal(df, list(order), "_place")
    n = placed.count()
    return placed.withColumn(name, F.when(F.col("_place") < int(n * train), "train").otherwise("test")).drop("_place")


def normalised_positions(df: DataFrame) -> DataFrame:
    """df (text columns of a public position) with its prices as numbers, market_type, exposure, cheap and its visible size."""
    number = lambda c: F.col(c).try_cast("double")
    slug = F.coalesce(F.nullif(F.col("slug"), F.lit("")), F.col("event_slug"))
    return df.withColumns(
        {
            **{c: number(c) for c in ("avg_price", "cur_price", "total_bought", "size", "initial_value", "realized_pnl")},
            "market_type": snapshot_class(F.col("title"), slug),
            "exposure": exposure(F.col("title"), slug),
            "cheap": F.coalesce(number("avg_price") <= 0.2, F.lit(False)),
            "visible_size": position_size(number("total_bought"), number("size"), number("initial_value")),
        }
    )


def wallet_snapshot(positions: DataFrame, wallet: str = "wallet") -> DataFrame:
    """A wallet's profile over `normalised_positions`: counts by status, market and side, prices, results, sizes as JSON."""
    n = lambda c: F.count(F.when(c, 1))
    closed = F.col("status") == "closed"
    side = outcome_side(F.col("outcome"))
    bought = F.col("total_bought")
    sizing = F.to_json(F.struct(F.count(bought).alias("count"), F.round(F.max(bought), 6).alias("max"), F.round(F.avg(bought), 6).alias("mean"), F.round(F.percentile("total_bought", F.lit(0.5)), 6).alias("median"), F.round(F.min(bought), 6).alias("min")))
    return positions.groupBy(wallet).agg(
        n(~closed).alias("active"),
        n(closed).alias("closed"),
        F.sum("realized_pnl").alias("total_pnl"),
        F.max("realized_pnl").alias("biggest_win"),
        *[n(F.col("exposure") == a).alias(a.lower()) for a in ("BTC", "ETH", "SOL")],
        n(F.col("market_type") == "fast_crypto").alias("fast"),
        n(F.col("market_type") != "fast_crypto").alias("other"),
        n(side == "YES").alias("yes"),
        n(side == "NO").alias("no"),
        F.avg("avg_price").alias("mean_entry"),
        F.avg(F.when(closed, F.col("cur_price"))).alias("mean_exit"),
        n(F.col("cheap")).alias("cheap"),
        n(closed & F.col("cur_price").isin(0.0, 1.0)).alias("resolution_like"),
        F.when(F.count(bought) > 0, sizing).alias("sizing"),
    )


def hit_share(found: Column) -> Column:
    """The share of observations for which something was found."""
    return F.coalesce(F.avg(found.cast("double")), F.lit(0.0))
