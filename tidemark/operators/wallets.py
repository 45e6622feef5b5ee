"""Trades of wallets: position lifecycles, wallet metrics, skill against a baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import first_reason, proportion_z, wilson_clamped
from .metrics import dominant

SIZE = "decimal(20,8)"
_NONE = "cast(0 as decimal(38,8))"
#: Shares; a smaller difference of what was bought and sold is a residual, not a position.
NEAR_FLAT = "0.1"
STATUSES = ("still_open", "partial_exit", "full_exit", "oversold_bounded_history", "no_position_change")
#: A sample gate and the two-sided 5% point (fixed values).
LEAST_RESOLVED, Z, RANDOM_RATE = 30, 1.96, 0.5


def lifecycles(trades: DataFrame, keys: Sequence[str] = ("wallet", "token"), carried: Sequence[str] = (), order: Sequence[str] = ("t",), hashes: str | None = None, flags: str | None = None) -> DataFrame:
    """One row for each position: sizes and volume-weighted prices of its buys and sells, what remains, and its status.

    trades has the keys, side, size and price as decimals, and t. Sides are compared in upper case; others than BUY and
    SELL change nothing. A null size is 0; a null price adds nothing to a position's cost. `carried` columns are those of
    the position's first trade in `order`. `transactions` are the distinct hashes and `quality` the distinct flags
    (given as `;`-joined text), with those that the position itself raises.
    """
    side, size = F.upper("side"), F.coalesce(F.col("size"), F.lit(0)).cast(SIZE)
    buy, sell = F.coalesce(side == "BUY", F.lit(False)), F.coalesce(side == "SELL", F.lit(False))
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.expr(_NONE)).cast("decimal(38,8)")
    cost = (size * F.col("price")).cast("decimal(38,12)")
    found = [F.min_by(c, F.struct(*order)).alias(c) for c in carried]
    if hashes:
        found.append(F.array_join(F.array_sort(F.collect_set(F.lower(F.nullif(F.col(hashes), F.lit(""))))), ";").alias("transactions"))
    given = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(F.when(~F.col(flags).isin("", "none"), F.col(flags)), ";"))))) if flags else F.array().cast("array<string>")
    out = trades.groupBy(*keys).agg(
        total(buy, size).alias("bought"),
        total(sell, size).alias("sold"),
        F.coalesce(F.sum(F.when(buy, cost)).cast("double"), F.lit(0.0)).alias("entry_cost"),
        F.coalesce(F.sum(F.when(sell, cost)).cast("double"), F.lit(0.0)).alias("exit_value"),
        F.count(F.when(buy, 1)).alias("buys"),
        F.count(F.when(sell, 1)).alias("sells"),
        F.count(F.when(~buy & ~sell, 1)).alias("others"),
        F.min("t").alias("opened"),
        F.max("t").alias("last"),
        given.alias("_flags"),
        *found,
    )
    bought, sold, zero = F.col("bought"), F.col("sold"), F.expr(_NONE)
    status = (
        F.when(sold > bought, "oversold_bounded_history").when((bought > 0) & (sold == 0), "still_open").when((bought > sold) & (sold > 0), "partial_exit").when((bought == sold) & (bought > 0), "full_exit").otherwise("no_position_change")
    )
    raised = F.array_compact(F.array(F.when(F.col("others") > 0, "ignored_non_buy_sell_side"), F.when(sold > bought, "bounded_history_missing_prior_buy")))
    quality = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.concat("_flags", raised)))), ";")
    entry, leave = F.try_divide("entry_cost", bought.cast("double")), F.try_divide("exit_value", sold.cast("double"))
    closed = F.least("bought", "sold").cast("double")
    return (
        out.withColumns({"remaining": F.greatest(bought - sold, zero), "oversold": F.greatest(sold - bought, zero), "status": status})
        .withColumns({"entry_price": F.when(bought > 0, entry), "exit_price": F.when(sold > 0, leave), "quality": F.when(quality == "", "none").otherwise(quality)})
        .withColumn("realized", F.when(closed > 0, (F.col("exit_price") - F.col("entry_price")) * closed))
        .drop("_flags")
    )


def conservation_violations(positions: DataFrame) -> DataFrame:
    """Positions where bought + oversold isn't sold + remaining."""
    return positions.filter(F.col("bought") + F.col("oversold") != F.col("sold") + F.col("remaining"))


def near_flat() -> Column:
    """Bought and sold, with a residual of at most NEAR_FLAT shares."""
    residual = F.abs(F.col("bought") - F.col("sold"))
    return (F.col("bought") > 0) & (F.col("sold") > 0) & (residual > 0) & (residual <= F.expr(f"cast('{NEAR_FLAT}' as decimal(38,8))"))


def wallet_metrics(positions: DataFrame, wallet: str = "wallet", asset: str = "asset_class", outcome: str = "outcome", kind: str = "market_type", fast: str = "fast_crypto_up_down") -> DataFrame:
    """Counts by status, mean and median visible size, trades a position, shares, and the dominant asset and outcome.

    A position's visible size is what was bought, or what was sold if nothing was. Ties of a dominant value go to the
    lesser one; a null asset or outcome counts as `unknown`.
    """
    n = lambda c: F.count(F.when(c, 1))
    visible = F.when(F.col("bought") > 0, F.col("bought")).otherwise(F.col("sold")).cast("double")
    share = lambda c: F.try_divide(c, F.count("*"))
    out = positions.groupBy(wallet).agg(
        F.count("*").alias("positions"),
        *[n(F.col("status") == s).alias(s) for s in STATUSES],
        F.avg(visible).alias("mean_size"),
        F.percentile(visible, F.lit(0.5)).alias("median_size"),
        F.sum("buys").alias("buys"),
        F.sum("sells").alias("sells"),
        share(F.sum("buys")).alias("buys_each"),
        share(F.sum("sells")).alias("sells_each"),
        share(F.sum(F.col("buys") + F.col("sells"))).alias("events_each"),
        share(n(F.col("status") == "still_open")).alias("open_share"),
        share(n((F.col("buys") == 0) & (F.col("sells") > 0))).alias("sell_only_share"),
        *[F.sum(c).cast("double").alias(f"{c}_size") for c in ("bought", "sold", "remaining", "oversold")],
        n(near_flat()).alias("near_flat"),
        n(F.col(kind) == fast).alias("fast"),
        share(n(F.col(kind) == fast)).alias("fast_share"),
    )
    for column, name in ((asset, "asset"), (outcome, "outcome")):
        known = positions.select(wallet, F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown")).alias("_v"))
        out = out.join(dominant(known, wallet, "_v").select(wallet, F.col("_v").alias(f"dominant_{name}"), F.col("share").alias(f"{name}_concentration")), wallet, "left")
    return out


def metrics_violations(metrics: DataFrame, positions: DataFrame, wallet: str = "wallet") -> DataFrame:
    """check, violations: positions not counted once, counts that don't add up, shares out of range, wallets that repeat."""
    status = sum((F.col(s) for s in STATUSES[1:]), F.col(STATUSES[0]))
    bad = lambda c: F.count(F.when(~F.coalesce(c, F.lit(False)), 1))
    shares = ("open_share", "sell_only_share", "fast_share", "asset_concentration", "outcome_concentration")
    own = metrics.agg(
        bad(F.col("positions") == status).alias("status_counts"),
        bad(F.abs(F.col("bought_size") + F.col("oversold_size") - F.col("sold_size") - F.col("remaining_size")) <= 1e-6 * (1 + F.col("bought_size"))).alias("size_conservation"),
        *[bad(F.col(c).between(0, 1)).alias(c) for c in shares],
        F.sum("positions").alias("_counted"),
        (F.count("*") - F.countDistinct(wallet)).alias("repeated_wallets"),
    )
    one = own.crossJoin(F.broadcast(positions.agg(F.count("*").alias("_all"))))  # two single rows
    one = one.withColumn("positions_covered", F.abs(F.coalesce("_counted", F.lit(0)) - F.col("_all")))
    names = ("status_counts", "size_conservation", *shares, "repeated_wallets", "positions_covered")
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("violations")) for c in names])).alias("r")).select("r.*")


def aggregate_summary(positions: DataFrame) -> DataFrame:
    """status, n, buys, sells, near_flat, sell_only over all wallets; status NULL is the total."""
    return positions.rollup("status").agg(
        F.count("*").alias("n"), F.sum("buys").alias("buys"), F.sum("sells").alias("sells"), F.count(F.when(near_flat(), 1)).alias("near_flat"), F.count(F.when((F.col("buys") == 0) & (F.col("sells") > 0), 1)).alias("sell_only")
    )


def skill(results: DataFrame, wallet: str, won: str) -> DataFrame:
    """wallet, n, wins, rate, population, baseline (of all other wallets), z against it, the Wilson interval, and what it shows.

    z_population and z_random are against the rate of all and one half. `evidence`: insufficient_evidence under 30
    results; above_baseline_evidence if z_population is 1.96 or more and the interval lies over both rates;
    below_baseline_evidence if it is -1.96 or less and the interval lies under the population's.
    """
    own = results.groupBy(wallet).agg(F.count("*").alias("n"), F.sum(F.col(won).cast("long")).alias("wins"))
    total = own.agg(F.sum("n").alias("_n"), F.sum("wins").alias("_w"))
    out = own.crossJoin(F.broadcast(total))  # a single row
    out = out.withColumns({"rate": F.try_divide("wins", "n"), "population": F.try_divide("_w", "_n"), "baseline": F.coalesce(F.try_divide(F.col("_w") - F.col("wins"), F.col("_n") - F.col("n")), F.try_divide("_w", "_n"))})
    interval = wilson_clamped("wins", "n")
    out = out.withColumns({"z": proportion_z("wins", "n", "baseline"), "z_population": proportion_z("wins", "n", "population"), "z_random": proportion_z("wins", "n", F.lit(RANDOM_RATE)), "low": interval["low"], "high": interval["high"]})
    evidence = first_reason(
        (F.col("n") < LEAST_RESOLVED, "insufficient_evidence"),
        ((F.col("z_population") >= Z) & (F.col("low") > RANDOM_RATE) & (F.col("low") > F.col("population")), "above_baseline_evidence"),
        ((F.col("z_population") <= -Z) & (F.col("high") < F.col("population")), "below_baseline_evidence"),
        otherwise="sample_size_consistent_with_baseline",
    )
    return out.select(wallet, "n", "wins", "rate", "population", "baseline", "z", "z_population", "z_random", "low", "high", evidence.alias("evidence"))


def outcome_breakdown(rows: DataFrame, by: str, status: str = "resolution") -> DataFrame:
    """by, resolved, matched, unmatched: the positions with an outcome, in each group."""
    n = lambda s: F.count(F.when(F.col(status) == s, 1))
    out = rows.filter(F.col(status).isin("matched_outcome", "unmatched_outcome")).groupBy(F.coalesce(F.nullif(F.col(by), F.lit("")), F.lit("other")).alias(by))
    return out.agg(F.count("*").alias("resolved"), n("matched_outcome").alias("matched"), n("unmatched_outcome").alias("unmatched"))


def h1_conclusion(skills: DataFrame) -> DataFrame:
    """One row: above, below, population and the verdict on whether some wallets decide better than by chance.

    SUPPORTED with two wallets above and none below, and a population 0.03 over one half; REJECTED with none above and a
    population of at most 0.51; else INCONCLUSIVE.
    """
    n = lambda s: F.count(F.when(F.col("evidence") == s, 1))
    one = skills.agg(n("above_baseline_evidence").alias("above"), n("below_baseline_evidence").alias("below"), F.coalesce(F.max("population"), F.lit(0.0)).alias("population"))
    verdict = first_reason(((F.col("above") >= 2) & (F.col("below") == 0) & (F.col("population") - RANDOM_RATE >= 0.03), "SUPPORTED"), ((F.col("above") == 0) & (F.col("population") <= RANDOM_RATE + 0.01), "REJECTED"), otherwise="INCONCLUSIVE")
    return one.withColumn("verdict", verdict)
