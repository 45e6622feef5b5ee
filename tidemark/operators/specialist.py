"""Signals of wallets in their specialties: the first purchase in a market, what it was worth, folds, stress and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import first_reason, wilson_open
from ..storage import written
from .metrics import consensus
from .series import drawdowns
from .stats import with_scenarios
from .tables import folds

# Seconds, probability points, parts.
DELAY, LEAST_WINDOW, ENTRY_COST, DEAREST, FOLDS = 30.0, 60.0, 0.05, 0.99, 3
Z = 1.959963984540054


def candidates(trades: DataFrame, outcomes: DataFrame, specialties: DataFrame) -> DataFrame:
    """trades of the specialised wallets with their market's outcome and `exclusion`, the first reason that holds.

    trades has wallet, condition, side, outcome, asset_class, up_down, t (seconds), price, notional and trade; outcomes
    condition, winner, expiry (seconds), slug and asset_class; specialties wallet and asset_class. Markets with different
    outcomes on record count as conflicting.
    """
    meta = F.struct("winner", "expiry", "slug", "asset_class")
    known = outcomes.filter("winner is not null").groupBy(F.lower("condition").alias("condition")).agg(F.min(meta).alias("_a"), F.max(meta).alias("_z"))
    known = known.select("condition", F.when(F.col("_a").eqNullSafe(F.col("_z")), F.struct("_a.winner", "_a.expiry", "_a.slug")).alias("market"))
    # One row a wallet, with the set of its assets.
    own = specialties.groupBy(F.lower("wallet").alias("wallet")).agg(F.collect_set("asset_class").alias("_assets"))
    rows = trades.withColumns({"wallet": F.lower("wallet"), "condition": F.lower("condition")}).join(own, "wallet")
    rows = rows.withColumn("specialised", F.coalesce(F.col("up_down") & F.array_contains("_assets", F.col("asset_class")), F.lit(False))).join(known, "condition", "left")
    reason = first_reason(
        (~F.coalesce(F.col("side") == "BUY", F.lit(False)), "non_buy"),
        (~F.col("specialised"), "outside_frozen_specialty"),
        (F.col("market").isNull(), "missing_or_conflicting_resolution"),
        (~F.contains(F.col("market.slug"), F.lit("-updown-5m-")), "non_five_minute_market"),
    )
    return rows.withColumn("exclusion", reason).drop("_assets")


def signals(rows: DataFrame) -> DataFrame:
    """The first purchase of each wallet and market among `candidates`, with its modelled window, entry and values, and fold.

    Of purchases at the earliest time the one of the greatest notional counts, ties to the greater outcome, then to the
    lesser trade. A window,
    less the delay of observation, under 60 s gives no signal. Folds number the markets in the order of their first signal.
    """
    # What having no exclusion implies is filtered by itself too, so that it goes below the joins; the signals are
    # written, as folds and metrics read them several times.
    usable = rows.filter("exclusion is null")
    for name, implied in (("side", "side = 'BUY'"), ("up_down", "up_down"), ("specialised", "specialised")):
        usable = usable.filter(implied) if name in rows.columns else usable
    usable = usable.withColumn("_rank", F.struct(-F.col("t"), F.coalesce("notional", F.lit(0.0)), "outcome"))
    least = usable.groupBy("wallet", "condition", "_rank").agg(F.min_by(F.struct("t", "price", "outcome", "asset_class", "market", "trade"), "trade").alias("r"))
    first = least.groupBy("wallet", "condition").agg(F.max_by("r", "_rank").alias("r")).select("wallet", "condition", "r.*")
    raw = F.col("market.expiry") - F.col("t")
    matched = F.lower("outcome") == F.lower("market.winner")
    out = first.withColumns({"raw_window": raw, "modelled_window": raw - DELAY, "modelled_entry": F.when(F.col("price").isNotNull(), F.least(F.lit(DEAREST), F.col("price") + ENTRY_COST)), "matched": matched}).filter(F.col("modelled_window") >= LEAST_WINDOW)
    paid = F.col("matched").cast("double")
    out = out.withColumns({"reported_value": paid - F.col("price"), "conservative_value": paid - F.col("modelled_entry"), "winner": F.col("market.winner")}).drop("market")
    return folds(written(out, "signals"), "condition", "t", FOLDS)


def exclusion_counts(rows: DataFrame) -> DataFrame:
    """exclusion, n; too short windows are counted by (wallet, market)."""
    short = rows.filter("exclusion is null").groupBy("wallet", "condition").agg((F.min("market.expiry") - F.min("t")).alias("raw")).filter(F.col("raw") - DELAY < LEAST_WINDOW)
    return rows.filter("exclusion is not null").select("exclusion").union(short.select(F.lit("insufficient_modeled_decision_window"))).groupBy("exclusion").agg(F.count("*").alias("n"))


def signal_metrics(rows: DataFrame, by: Sequence[str], value: str = "conservative_value") -> DataFrame:
    """by, n, wins, win rate with its interval, expectancy with its interval, and the greatest drawdown in time order."""
    x = F.col(value)
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(F.col("matched"), 1)).alias("wins"), F.avg(x).alias("expectancy"), F.stddev_samp(x).alias("_d"), F.min("t").alias("first"), F.max("t").alias("last"), F.countDistinct("condition").alias("markets"))
    half = F.when(F.col("n") < 2, 0.0).otherwise(Z * F.col("_d") / F.sqrt("n"))
    interval = wilson_open("wins", "n")
    out = out.withColumns({"win_rate": F.try_divide("wins", "n"), "win_low": interval["low"], "win_high": interval["high"], "low": F.col("expectancy") - half, "high": F.col("expectancy") + half}).drop("_d")
    cell = F.struct(*by) if by else F.struct(F.lit(1).alias("one"))
    deep = drawdowns(rows.withColumn("_cell", cell), "_cell", ["t", "condition", "wallet"], value).select(*([f"_cell.{c}" for c in by]), F.col("drawdown_absolute").alias("max_drawdown"))
    return out.join(deep, list(by)) if by else out.crossJoin(F.broadcast(deep))  # two single rows


def wallet_summary(rows: DataFrame) -> DataFrame:
    """signal_metrics by wallet with its positive folds, stability, the share of its busiest day, and robustness."""
    out = signal_metrics(rows, ["wallet"])
    each = rows.groupBy("wallet", "fold").agg(F.avg("conservative_value").alias("e")).groupBy("wallet").agg(F.count("*").alias("folds"), F.count(F.when(F.col("e") > 0, 1)).alias("positive_folds"))
    days = rows.groupBy("wallet", F.to_date(F.timestamp_seconds("t")).alias("d")).agg(F.count("*").alias("c")).groupBy("wallet").agg((F.max("c") / F.sum("c")).alias("busiest_day_share"))
    out = out.join(each, "wallet").join(days, "wallet")
    return out.withColumns({"stability": F.col("positive_folds") / F.col("folds"), "robustness": F.when(F.col("expectancy") > 0, "positive_after_conservative_cost").otherwise("fails_conservative_cost")})


def consensus_rows(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """condition, wallets, agreement, side by equal votes and by weight (TIE if two share the most), whether these won, their value.

    Markets with one signal are left out. weights has wallet and weight. A side's price is the dearest reported one.
    """
    known = rows.join(weights, "wallet")
    both = known.groupBy("condition").agg(F.count("*").alias("wallets"), F.min("outcome").alias("_least"), F.max("outcome").alias("_most"), F.first("winner").alias("winner")).filter("wallets >= 2")
    voted = consensus(known, "condition", "outcome", F.col("weight")).select("condition", F.col("winner").alias("weighted_side"))
    dearest = rows.groupBy("condition", "outcome").agg(F.max("price").alias("_price"))
    agreed = F.col("_least") == F.col("_most")
    out = both.join(voted, "condition").withColumns({"status": F.when(agreed, "agreement").otherwise("disagreement"), "equal_side": F.when(agreed, F.col("_least")).otherwise("DISAGREEMENT")})
    for side in ("equal", "weighted"):
        price = dearest.select("condition", F.col("outcome").alias(f"{side}_side"), F.col("_price").alias(f"_{side}"))
        out = out.join(price, ["condition", f"{side}_side"], "left")
        won = F.coalesce(F.lower(f"{side}_side") == F.lower("winner"), F.lit(False))
        out = out.withColumns({f"{side}_matched": won, f"{side}_value": won.cast("double") - F.when(F.col(f"_{side}").isNotNull(), F.least(F.lit(DEAREST), F.col(f"_{side}") + ENTRY_COST))}).drop(f"_{side}")
    return out.drop("_least", "_most")


def stress(rows: DataFrame, delays: Sequence[float], costs: Sequence[float]) -> DataFrame:
    """delay, cost, n, expectancy: the signals that a delay leaves 60 s, entered dearer by a cost."""
    grid = [{"delay": float(d), "cost": float(c)} for d in delays for c in costs]
    out = with_scenarios(rows, grid).withColumn("kept", F.col("raw_window") - F.col("delay") >= LEAST_WINDOW)
    value = F.col("matched").cast("double") - F.least(F.lit(DEAREST), F.col("price") + F.col("cost"))
    return out.groupBy("delay", "cost").agg(F.count(F.when(F.col("kept"), 1)).alias("n"), F.coalesce(F.avg(F.when(F.col("kept"), value)), F.lit(0.0)).alias("expectancy"))


def specialist_gates(rows: DataFrame, wallets: int, consensus_n: int) -> DataFrame:
    """gate, passed: leakage between folds, their order, expectancy and its interval, folds, wallets, days and sample.

    `wallets` is how many there should be. Selection leakage, and the missing join with spreads, are never cleared here.
    """
    one = signal_metrics(rows, []).first()
    fold = signal_metrics(rows, ["fold"]).orderBy("fold").collect()  # three rows
    own = signal_metrics(rows, ["wallet"]).agg(F.count("*").alias("n"), F.count(F.when(F.col("low") > 0, 1)).alias("sure")).first()
    leaks = rows.groupBy("condition").agg(F.countDistinct("fold").alias("k")).filter("k > 1").limit(1).count()
    days = rows.groupBy(F.to_date(F.timestamp_seconds("t")).alias("d")).agg(F.count("*").alias("c")).agg((F.max("c") / F.sum("c")).alias("s")).first().s
    gates = [
        ("all_wallets_present", own.n == wallets),
        ("market_group_leakage_absent", leaks == 0),
        ("chronological_fold_order", all(a["last"] <= b["first"] for a, b in zip(fold[:-1], fold[1:], strict=True))),
        ("selection_leakage_absent", False),
        ("positive_conservative_expectancy", bool(one.n and one.expectancy > 0)),
        ("positive_expectancy_confidence", bool(one.n and one.low > 0)),
        ("all_three_folds_positive", len(fold) == FOLDS and all(f.expectancy > 0 for f in fold)),
        ("at_least_two_wallets_confidently_positive", own.sure >= 2),
        ("date_concentration_below_40_percent", days is not None and days <= 0.40),
        ("consensus_sample_at_least_30", consensus_n >= 30),
        ("direct_liquidity_and_spread_join_available", False),
    ]
    return rows.sparkSession.createDataFrame([(g, bool(p)) for g, p in gates], "gate string, passed boolean")

