"""Wallet scores from lifecycle metrics, their bands and checks, and the watchlist drawn from them.

A score adds five components and takes off five penalties, each a ladder over one or two metrics, and is kept from 0 to
100. The metrics are those of `wallets.wallet_metrics`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, first_reason, reasons, step_score

# Fixed ladders: the least value (or, for `over`, the value that must be exceeded) and the points it gives, from high to low.
COVERAGE = [(50, 25.0), (25, 21.0), (10, 15.0), (5, 8.0)]
FAST_COUNT = [(25, 5.0), (10, 4.0), (5, 2.0)]
SMALL_SAMPLE = [(15, 0.0), (10, 5.0), (5, 10.0)]
OPEN_OVER = [(0.90, 15.0), (0.75, 10.0), (0.50, 5.0)]
NEAR_FLAT_OVER = [(0.20, 5.0), (0.05, 2.0)]
BANDS = [(75, "high_priority"), (50, "medium_priority"), (25, "low_priority")]
LOWEST_BAND = "insufficient_visible_structure"
ASSETS = ("BTC", "ETH", "SOL")
COMPONENTS = ("coverage", "fast_crypto", "lifecycle_activity", "event_density", "specialization")
PENALTIES = ("bounded_history", "still_open_penalty", "small_sample", "concentration", "near_flat_ambiguity")
REQUIRED = ("positions", "fast", "partial_exit", "oversold_bounded_history", "near_flat", "fast_share", "open_share", "sell_only_share", "sells_each", "events_each", "asset_concentration", "outcome_concentration")
#: Positions that a wallet on the watchlist has at least.
LEAST_POSITIONS = 5


def _over(x: Column, steps: list[tuple[float, float]]) -> Column:
    return reduce(lambda out, s: F.when(x > s[0], s[1]).otherwise(out), reversed(steps), F.lit(0.0))


def _n(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def components() -> dict[str, Column]:
    """The five components and five penalties of a wallet's metrics; a missing metric counts as 0."""
    part = F.coalesce(F.try_divide(_n("partial_exit"), _n("positions")), F.lit(0.0))
    residual = F.coalesce(F.try_divide(_n("near_flat"), _n("positions")), F.lit(0.0))
    events, asset, outcome = _n("events_each"), _n("asset_concentration"), _n("outcome_concentration")
    exits = first_value((part == 0, 0.0), (part < 0.10, 4.0), (part < 0.35, 8.0), (part <= 0.75, 12.0), otherwise=8.0)
    spread = first_value((asset > 0.95, 1.0), (asset > 0.80, 3.0), (asset >= 0.30, 4.0))
    known = F.when(F.upper("dominant_asset").isin(*ASSETS), 4.0).otherwise(0.0)
    return {
        "coverage": step_score(_n("positions"), COVERAGE),
        "fast_crypto": clip(clip(20 * _n("fast_share"), 0.0, 20.0) + step_score(_n("fast"), FAST_COUNT), 0.0, 25.0),
        "lifecycle_activity": clip(exits + F.when(_n("sells_each") > 0, 3.0).otherwise(0.0), 0.0, 15.0),
        "event_density": first_value((events < 1, 0.0), (events < 2, 8.0), (events <= 8, 15.0), (events <= 20, 11.0), otherwise=6.0),
        "specialization": clip(known + spread + F.when(outcome <= 0.70, 2.0).otherwise(0.0), 0.0, 10.0),
        "bounded_history": clip(clip(20 * _n("sell_only_share"), 0.0, 15.0) + F.least(F.lit(5.0), 2.5 * _n("oversold_bounded_history")), 0.0, 20.0),
        "still_open_penalty": _over(_n("open_share"), OPEN_OVER),
        "small_sample": step_score(_n("positions"), SMALL_SAMPLE, 20.0),
        "concentration": F.when(asset > 0.95, 5.0).otherwise(0.0) + F.when(outcome > 0.75, 5.0).otherwise(0.0),
        "near_flat_ambiguity": _over(residual, NEAR_FLAT_OVER),
    }


def first_value(*pairs: tuple[Column, float], otherwise: float = 0.0) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda out, p: F.when(p[0], p[1]).otherwise(out), reversed(pairs), F.lit(otherwise))


def score_band(score: Column) -> Column:
    return first_reason(*[(score >= least, name) for least, name in BANDS], otherwise=LOWEST_BAND)


def _total() -> Column:
    # One part after the other: a sum of penalties taken off at once can end just under a band's least score.
    return reduce(lambda out, c: out - F.col(c), PENALTIES, reduce(lambda out, c: out + F.col(c), COMPONENTS[1:], F.col(COMPONENTS[0])))


def wallet_scores(metrics: DataFrame) -> DataFrame:
    """metrics with the components, the penalties, score, score_band and missing (how many required metrics are NULL)."""
    out = metrics.withColumns(components()).withColumn("score", clip(_total(), 0.0, 100.0))
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in REQUIRED])
    return out.withColumn("score_band", score_band(F.col("score"))).withColumn("missing", missing)


def ranked_scores(scores: DataFrame, wallet: str = "wallet") -> DataFrame:
    """Sorted by score, share of fast markets and positions, each falling, then by wallet."""
    return scores.orderBy(F.desc("score"), F.desc("fast_share"), F.desc("positions"), wallet)


def score_violations(scores: DataFrame, wallet: str = "wallet") -> DataFrame:
    """check, violations: scores or parts out of bounds, scores that aren't the sum, wrong bands, repeated or missing wallets."""
    bounds = dict(zip((*COMPONENTS, *PENALTIES), (25, 25, 15, 15, 10, 20, 15, 20, 10, 5), strict=True))
    bad = lambda c: F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).cast("long")
    checks = {
        "score_bounds": bad(F.col("score").between(0, 100)),
        "part_bounds": bad(reduce(lambda a, b: a & b, [F.col(c).between(0, high) for c, high in bounds.items()])),
        "formula": bad(F.abs(F.col("score") - clip(_total(), 0.0, 100.0)) < 1e-9),
        "band": bad(F.col("score_band") == score_band(F.col("score"))),
        "wallet_present": bad(F.col(wallet).isNotNull()),
        "wallet_unique": (F.count(wallet) - F.countDistinct(wallet)).cast("long"),
    }
    one = scores.agg(*[c.alias(n) for n, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])).alias("r")).select("r.*")


# Watchlist


def passes_visibility() -> Column:
    """Enough positions, no metric missing, a known band."""
    return (F.col("positions") >= LEAST_POSITIONS) & (F.col("missing") == 0) & F.col("score_band").isin(*[b for _, b in BANDS], LOWEST_BAND)


def reason_codes() -> Column:
    """Why a wallet is on the list and what to beware of, in a fixed order."""
    return F.concat(
        F.array(F.concat(F.lit("bucket_"), F.coalesce("score_band", F.lit("unknown"))), F.lit("minimum_visibility_passed")),
        reasons(
            (F.col("fast_share") >= 0.75, "fast_crypto_relevant"),
            (_n("fast_share") == 0, "no_fast_crypto_visibility"),
            (F.col("partial_exit") > 0, "visible_partial_exit_activity"),
            (F.col("open_share") >= 0.90, "all_or_mostly_open_visibility"),
            ((F.col("bounded_history") > 0) | (_n("oversold_bounded_history") > 0), "bounded_history_artifact_risk"),
            (F.col("concentration") > 0, "concentration_risk"),
            (F.col("small_sample") > 0, "small_visible_sample"),
            (F.col("near_flat_ambiguity") > 0, "near_flat_residual_ambiguity"),
        ),
    )


def strengths() -> Column:
    return reasons(
        (F.col("positions") >= 25, "strong visible lifecycle coverage"),
        ((F.col("positions") < 25) & (F.col("positions") >= LEAST_POSITIONS), "minimum visible lifecycle coverage"),
        (F.col("fast_share") >= 0.75, "high fast-crypto lifecycle share"),
        (F.col("partial_exit") > 0, "visible partial-exit structure"),
        (F.col("event_density") >= 8, "visible repeated event density"),
        (F.col("specialization") >= 7, "interpretable market specialization"),
    )


def watchlist(scores: DataFrame, wallet: str = "wallet") -> DataFrame:
    """place, wallet, score, bucket, reason_codes, strengths of the wallets that pass, by bucket, falling score, wallet.

    Places are counted within buckets; a bucket's rows are sorted by range partitions when written in that order.
    """
    order = first_reason(*[(F.col("score_band") == b, i) for i, b in enumerate([*[b for _, b in BANDS], LOWEST_BAND])])
    rows = scores.filter(passes_visibility()).select(wallet, "score", F.col("score_band").alias("bucket"), order.cast("int").alias("bucket_order"), F.array_join(reason_codes(), ";").alias("reason_codes"), F.coalesce(F.nullif(F.array_join(strengths(), "; "), F.lit("")), F.lit("none")).alias("strengths"))
    return rows.orderBy("bucket_order", F.desc("score"), wallet)


# Copyability


def structural_confidence() -> Column:
    """How much the visible history tells, by its size and shares."""
    solid = (F.col("positions") >= 25) & (F.col("fast_share") >= 0.5) & (F.col("open_share") < 0.75) & (_n("oversold_bounded_history") == 0)
    return first_reason((solid, "medium_structural"), (F.col("positions") >= 10, "low_to_medium_structural"), (F.col("positions") >= LEAST_POSITIONS, "low_structural"), otherwise="insufficient_visible_history")


def recommendation(listed: Column) -> Column:
    """What to do with a wallet, `listed` telling whether it is on the watchlist."""
    watch = F.coalesce(listed, F.lit(False))
    return first_reason(
        (watch & F.col("score_band").isin("high_priority", "medium_priority") & (F.col("positions") >= 15) & (F.col("fast_share") >= 0.5) & (F.col("open_share") < 0.9), "monitor_candidate"),
        (watch & F.col("score_band").isin("medium_priority", "low_priority") & (F.col("positions") >= LEAST_POSITIONS), "needs_more_history"),
        (F.col("positions") >= LEAST_POSITIONS, "insufficient_signal"),
        otherwise="exclude_for_now",
    )


def copyability(scores: DataFrame, listed: DataFrame, wallet: str = "wallet") -> DataFrame:
    """wallet, score, score_band, included, reason_codes, confidence, recommendation and what evidence is missing."""
    own = listed.select(wallet, F.col("reason_codes").alias("_codes"), F.lit(True).alias("_listed"))
    out = scores.join(own, wallet, "left")
    missing = reasons(
        (F.col("open_share") >= 0.9, "later exits beyond bounded window"),
        (_n("oversold_bounded_history") > 0, "prior buys before bounded window"),
        (_n("fast_share") == 0, "fast crypto relevance"),
    )
    return out.select(
        wallet,
        "score",
        "score_band",
        F.when(F.col("_listed"), "included").otherwise("excluded_minimum_visibility").alias("included"),
        F.coalesce("_codes", F.lit("minimum_visibility_failed")).alias("reason_codes"),
        structural_confidence().alias("confidence"),
        recommendation(F.col("_listed")).alias("recommendation"),
        F.array_join(missing, "; ").alias("missing_evidence"),
    )


def component_ranges(scores: DataFrame) -> DataFrame:
    """component, low, high, range, mean: a component without a range tells wallets apart in nothing."""
    names = (*COMPONENTS, *PENALTIES)
    one = scores.agg(*[a.alias(f"{c}_{k}") for c in names for k, a in (("low", F.min(c)), ("high", F.max(c)), ("mean", F.avg(c)))])
    rows = F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"{c}_low").alias("low"), F.col(f"{c}_high").alias("high"), (F.col(f"{c}_high") - F.col(f"{c}_low")).alias("range"), F.col(f"{c}_mean").alias("mean")) for c in names])
    return one.select(F.explode(rows).alias("r")).select("r.*")
