"""What a wallet's visible positions tell of its behaviour: shares, price buckets, classes, risks, similarity."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import first_reason, reasons
from .metrics import dominant
from .trades import timeframe

# Fixed price buckets; each holds its lower bound, the last its upper one too.
BUCKETS = (("0_10c", 0.0, 0.10), ("10_20c", 0.10, 0.20), ("20_40c", 0.20, 0.40), ("40_60c", 0.40, 0.60), ("60_80c", 0.60, 0.80), ("80_100c", 0.80, 1.0000001))
OUTSIDE = "outside_0_100c"


def entry_bucket(price: Column) -> Column:
    return first_reason(*[((price >= low) & (price < high), name) for name, low, high in BUCKETS], otherwise=OUTSIDE)


def outcome_side(outcome: Column) -> Column:
    """YES (or up), NO (or down), else OTHER."""
    name = F.lower(F.trim(F.coalesce(outcome, F.lit(""))))
    return F.when(name.isin("yes", "up"), "YES").when(name.isin("no", "down"), "NO").otherwise("OTHER")


def position_size(bought: Column, size: Column, initial: Column) -> Column:
    """The first that there is; 0 counts as missing."""
    return F.coalesce(F.nullif(bought, F.lit(0.0)), F.nullif(size, F.lit(0.0)), initial)


def wallet_class(positions: Column, fast_share: Column, weather_share: Column) -> Column:
    return F.when(positions < 10, "inactive_or_insufficient_data").when(fast_share >= 0.60, "fast_crypto_focused").when(weather_share >= 0.60, "weather_focused").otherwise("mixed")


def delay_risk(kind: Column, fast_share: Column) -> Column:
    return F.when((kind == "fast_crypto_focused") | (fast_share >= 0.50), "high").when(kind == "weather_focused", "medium").otherwise("medium_high")


def fill_uncertainty(largest: Column, concentration: Column) -> Column:
    return F.when(largest.isNull(), "unknown").when((largest >= 10_000) | (concentration >= 0.50), "high").when(largest >= 1_000, "medium_high").otherwise("medium")


def completeness(positions: Column, notes: Column) -> Column:
    return F.when(F.contains(F.lower(F.coalesce(notes, F.lit(""))), F.lit("truncated")) | (positions >= 50), "partial_truncated_snapshot").when(positions > 0, "partial_public_snapshot").otherwise("insufficient")


def behaviour(positions: DataFrame, wallet: str = "wallet", notes: str | None = None) -> DataFrame:
    """One row a wallet: counts and shares of its positions, entry prices, sizes, classes, risks and a bounded score.

    positions has market_type, exposure, outcome, avg_price, size (see `position_size`), status, cur_price, slug and title.
    A share without rows to count is NULL. The score, from 0 to 60, starts at 20.
    """
    n, count = F.count("*"), lambda c: F.count(F.when(c, 1))
    fast, weather = F.col("market_type") == "fast_crypto", F.col("market_type") == "weather"
    p, size, side = F.col("avg_price"), F.col("size"), outcome_side(F.col("outcome"))
    priced = F.count(p)
    closed = F.col("status") == "closed"
    out = positions.groupBy(wallet).agg(
        n.alias("positions"),
        count(fast).alias("fast"),
        count(weather).alias("weather"),
        *[count(fast & (F.col("exposure") == a)).alias(f"{a.lower()}_updown") for a in ("BTC", "ETH", "SOL")],
        count(F.col("exposure") == "OTHER").alias("non_crypto"),
        F.try_divide(count(fast), n).alias("fast_share"),
        F.try_divide(count(weather), n).alias("weather_share"),
        count(side == "YES").alias("yes"),
        count(side == "NO").alias("no"),
        count(p <= 0.20).alias("cheap"),
        F.try_divide(count(p <= 0.20), priced).alias("cheap_share"),
        F.try_divide(count(p >= 0.60), priced).alias("favourite_share"),
        F.avg(p).alias("mean_entry"),
        F.percentile("avg_price", F.lit(0.5)).alias("median_entry"),
        *[count((p >= low) & (p < high)).alias(f"bucket_{name}") for name, low, high in BUCKETS],
        F.avg(size).alias("mean_size"),
        F.percentile("size", F.lit(0.5)).alias("median_size"),
        F.max(size).alias("largest"),
        F.try_divide(F.max(size), F.nullif(F.sum(size), F.lit(0.0))).alias("concentration"),
        F.try_divide(count(closed & F.col("cur_price").isin(0.0, 1.0)), count(closed)).alias("resolution_like_share"),
        F.max(F.col(notes) if notes else F.lit(None).cast("string")).alias("_notes"),
    )
    total = F.col("yes") + F.col("no")
    out = out.withColumns({"yes_no_balance": 1 - F.try_divide(F.abs(F.col("yes") - F.col("no")), total), "wallet_class": wallet_class(F.col("positions"), F.col("fast_share"), F.col("weather_share")), "completeness": completeness(F.col("positions"), F.col("_notes")), "repeated_cheap": F.when((F.col("cheap") >= 10) | (F.coalesce("cheap_share", F.lit(0.0)) >= 0.25), "yes").otherwise("no")})
    out = out.withColumns({"delay_risk": delay_risk(F.col("wallet_class"), F.col("fast_share")), "fill_uncertainty": fill_uncertainty(F.col("largest"), F.coalesce("concentration", F.lit(0.0)))})
    return out.withColumn("score", behaviour_score()).drop("_notes")


def behaviour_score() -> Column:
    """From 0 to 60, of the columns of `behaviour`; that exit times are unknown takes off 10 for all."""
    add = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0)
    total = (
        10 + add(F.col("wallet_class") == "fast_crypto_focused", 15) + add(F.col("yes_no_balance") >= 0.70, 5) + add(F.col("cheap_share") >= 0.20, 5)
        + add(F.col("completeness") == "partial_truncated_snapshot", -10) + add(F.col("delay_risk") == "high", -10) + add(F.col("fill_uncertainty") == "high", -5)
    )
    return F.greatest(F.lit(0), F.least(F.lit(60), total))


def snapshot_score(resolved: Column, positions: Column, fast: Column, mean_entry: Column, late_known: Column) -> Column:
    """The score of an ingested snapshot, from 0 to 60: 0 without an address, 5 without positions, else 15 and more."""
    total = 15 + F.least(F.lit(30), 3 * fast) + F.when(F.coalesce(mean_entry <= 0.35, F.lit(False)), 10).otherwise(0) - F.when(late_known, 0).otherwise(10)
    return F.when(~resolved, 0).when(positions == 0, 5).otherwise(F.greatest(F.lit(0), F.least(F.lit(60), total)))


def late_entries(activity: DataFrame, wallet: str, kind: str, at: str, end: str, seconds: int = 180) -> DataFrame:
    """wallet, trades, analysable, late: trades at most `seconds` before their market's end (times in seconds)."""
    traded = F.lower(kind).isin("trade", "buy", "sell")
    left = F.col(end) - F.col(at)
    return activity.filter(traded).groupBy(wallet).agg(F.count("*").alias("trades"), F.count(left).alias("analysable"), F.count(F.when(left.between(0, seconds), 1)).alias("late"))


def repeated_patterns(positions: DataFrame, wallet: str = "wallet") -> DataFrame:
    """wallet, pattern, share: its commonest asset:timeframe; ties to the lesser one."""
    label = F.concat_ws(":", F.coalesce(F.nullif(F.col("exposure"), F.lit("")), F.lit("OTHER")), timeframe(F.col("title"), F.col("slug")))
    return dominant(positions.select(wallet, label.alias("pattern")), wallet, "pattern")


def feature_vector() -> Column:
    """15 numbers of a wallet's `behaviour`: shares as they are, counts over positions."""
    share = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    each = lambda c: share(c) / F.greatest(F.lit(1), F.col("positions"))
    return F.array(share("fast_share"), *[each(c) for c in ("btc_updown", "eth_updown", "sol_updown", "non_crypto")], *[share(c) for c in ("cheap_share", "favourite_share", "yes_no_balance", "concentration")], *[each(f"bucket_{name}") for name, _, _ in BUCKETS])


def clusters() -> Column:
    """The clusters that a wallet belongs to, in a fixed order; the first is its primary one."""
    found = reasons(
        (F.col("wallet_class") == "fast_crypto_focused", "fast_crypto_directional"),
        (F.col("cheap_share") >= 0.20, "cheap_side_buyer"),
        ((F.col("positions") >= 75) & (F.col("fast_share") >= 0.50), "high_volume_repeated_pattern"),
        (F.col("wallet_class") == "weather_focused", "weather_other"),
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("mixed_or_insufficient")))


def similar_to(vectors: DataFrame, asked: DataFrame, wallet: str, vector: str, k: int) -> DataFrame:
    """asked, wallet, similarity, place: the k wallets most like each asked one, by cosine to nine decimals, ties to the lesser wallet.

    `asked` is a stated set of wallets, whose vectors are checked to be few enough (100,000) to be sent to all tasks. A
    task compares its wallets with them block by block and hands on the k best of each only.
    """
    rows = asked.select(F.col(wallet).alias("w"), F.col(vector).alias("v")).limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 wallets are asked for")
    kind = dict(vectors.dtypes)[wallet]
    sent = vectors.sparkSession.sparkContext.broadcast(([r["w"] for r in rows], np.array([r["v"] for r in rows], float)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = sent.value
        best: list[list[tuple]] = [[] for _ in names]
        for x in frames:
            if not len(x) or not names:
                continue
            v = np.array(x["v"].tolist(), float)
            for i, (name, one) in enumerate(zip(names, q, strict=True)):
                # Sums run over the dimensions in order, as in SQL.
                dot, a, b = (functools.reduce(lambda s, d, m=m, n=n: s + m[..., d] * n[..., d], range(v.shape[1]), 0.0) for m, n in ((v, one), (v, v), (one, one)))
                norm = np.sqrt(a) * np.sqrt(b)
                found = np.round(np.divide(dot, norm, out=np.zeros(len(v)), where=norm > 0), 9)
                others = np.flatnonzero(x["w"].to_numpy() != name)
                near = others[np.argsort(-found[others], kind="stable")]
                # All ties of the k-th stay until the names decide.
                near = near[found[near] >= found[near[min(k, len(near)) - 1]]] if len(near) else near
                best[i] = sorted([*best[i], *((-float(found[j]), x["w"].iat[j]) for j in near)])[:k]
        yield pd.DataFrame([(n, w, -s) for n, b in zip(names, best, strict=True) for s, w in b], columns=["asked", "w", "similarity"])

    found = vectors.select(F.col(wallet).alias("w"), F.col(vector).alias("v")).mapInPandas(run, f"asked {kind}, w {kind}, similarity double")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("similarity"), "w"))
    return found.withColumn("place", place).filter(F.col("place") <= k).withColumnRenamed("w", wallet)


def common_patterns(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """pattern, value, wallets: how many wallets have each value of each column."""
    entries = F.array(*[F.struct(F.lit(c).alias("pattern"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(entries).alias("r")).groupBy("r.pattern", "r.value").agg(F.count("*").alias("wallets"))
