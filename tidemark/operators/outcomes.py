"""Markets and their outcomes: resolution payloads, confidence, lag measurement, entry rules, expiry buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, first_reason, iso_timestamp, slug_epoch

# Fixed layout of a resolution event.
RESOLUTION = "struct<markets:array<struct<conditionId:string,closed:boolean,cancelled:boolean,umaResolutionStatus:string,automaticallyResolved:boolean,outcomes:array<string>,outcomePrices:array<string>,closedTime:string,resolutionSource:string>>>"
#: How near to 0 or 1 a final price must be.
TERMINAL = 0.001


def resolutions(df: DataFrame, payload: str, condition: str, accept_blank: bool = False) -> DataFrame:
    """df with `resolution`: status, reason, winner and outcome (1 for the first outcome, 0 for the second).

    status: missing, cancelled, unresolved, malformed, ambiguous or resolved. A market counts as final if it is closed
    and its status is `resolved` (or blank, with accept_blank) or it was resolved automatically; then one price must be
    1 and the other 0, within TERMINAL.
    """
    parsed = df.withColumn("_m", F.from_json(payload, RESOLUTION)["markets"])
    parsed = parsed.withColumn("_m", F.when(F.size("_m") > 0, F.try_element_at(F.filter("_m", lambda m: m["conditionId"] == F.col(condition)), F.lit(1))))
    m = F.col("_m")
    prices = F.transform(m["outcomePrices"], lambda p: p.try_cast("double"))
    status = F.lower(F.trim(F.coalesce(m["umaResolutionStatus"], F.lit(""))))
    final = F.coalesce(m["closed"], F.lit(False)) & ((status == "resolved") | F.coalesce(m["automaticallyResolved"], F.lit(False)) | (F.lit(accept_blank) & (status == "")))
    shaped = F.coalesce((F.size(m["outcomes"]) == 2) & (F.size(prices) == 2) & ~F.exists(prices, lambda p: p.isNull()), F.lit(False))
    first, second = F.try_element_at(prices, F.lit(1)), F.try_element_at(prices, F.lit(2))
    up, down = (first >= 1 - TERMINAL) & (second <= TERMINAL), (second >= 1 - TERMINAL) & (first <= TERMINAL)
    reason = first_reason(
        (m.isNull(), "condition_id_not_found"),
        (F.coalesce(m["cancelled"], F.lit(False)), "market_cancelled"),
        (~final, "not_final"),
        (~shaped, "malformed_prices"),
        (~(up | down), "non_terminal_prices"),
    )
    named = F.when(m.isNull(), "missing").when(reason == "market_cancelled", "cancelled").when(reason == "not_final", "unresolved").when(reason == "malformed_prices", "malformed").when(reason == "non_terminal_prices", "ambiguous").otherwise("resolved")
    outcome = F.when(reason.isNull(), F.when(up, 1).otherwise(0))
    winner = F.when(outcome == 1, F.try_element_at(m["outcomes"], F.lit(1))).when(outcome == 0, F.try_element_at(m["outcomes"], F.lit(2)))
    return parsed.withColumn("resolution", F.struct(named.alias("status"), reason.alias("reason"), winner.alias("winner"), outcome.alias("outcome"))).drop("_m")


# Fixed bounds of a lag measurement: basis points, liquidity, seconds, the share that is repriced, and confidence.
LAG = {"threshold_bps": 4.0, "min_liquidity": 500.0, "min_seconds": 20.0, "repricing_ratio": 0.65, "min_confidence": 0.55}


def lag_measurement(reference: Column, reference_before: Column, market: Column, market_before: Column, lag_seconds: Column, liquidity: Column, seconds_to_expiry: Column, bid: Column, ask: Column, bounds: dict[str, float] = LAG) -> Column:
    """How far a market's price lags behind a reference price, as a struct.

    external_change is the reference's relative change, market_change the market's. The market is expected to move by a
    thousandth of the change in basis points, 0.30 at most; repricing_ratio is the part of it that it has made in that
    direction (1 if none is expected). lag_score is what is left, times the strength of the move, which is 1 from four
    thresholds on. confidence is 0.70 of the score, 0.20 of the strength and 0.10 of a spread under 0.10. reason is the
    first in this order: liquidity, time left, no direction, repriced already, confidence.
    """
    change = F.coalesce(F.try_divide(reference, F.nullif(reference_before, F.lit(0.0))) - 1, F.lit(0.0))
    bps, moved = change * 10_000, market - market_before
    expected = F.least(F.lit(0.30), F.abs(bps) / 1000)
    direction = F.when(bps >= bounds["threshold_bps"], "UP").when(bps <= -bounds["threshold_bps"], "DOWN").otherwise("NONE")
    aligned = F.when(direction == "UP", moved).otherwise(-moved)
    ratio = F.when(expected > 0, F.greatest(F.lit(0.0), aligned) / F.nullif(expected, F.lit(0.0))).otherwise(1.0)
    strength = F.least(F.lit(1.0), F.abs(bps) / max(4 * bounds["threshold_bps"], 1.0))
    score = F.greatest(F.lit(0.0), 1 - ratio) * strength
    confidence = clip(0.70 * score + 0.20 * strength + 0.10 * (1 - F.least(F.lit(1.0), (ask - bid) / 0.10)), 0.0, 1.0)
    reason = first_reason(
        (liquidity < bounds["min_liquidity"], "liquidity_below_minimum"),
        (seconds_to_expiry < bounds["min_seconds"], "near_expiry_insufficient_time"),
        (direction == "NONE", "external_move_below_threshold"),
        (ratio >= bounds["repricing_ratio"], "polymarket_already_repriced"),
        (confidence < bounds["min_confidence"], "confidence_below_threshold"),
        otherwise=QUALIFIED,
    )
    return F.struct(
        F.round(change, 8).alias("external_change"),
        F.round(moved, 8).alias("market_change"),
        F.round(F.greatest(F.lit(0.0), lag_seconds), 3).alias("lag_seconds"),
        F.round(score, 6).alias("lag_score"),
        direction.alias("direction"),
        F.round(confidence, 6).alias("confidence"),
        (reason == QUALIFIED).alias("qualified"),
        reason.alias("reason"),
        ratio.alias("repricing_ratio"),
    )


#: The reason of a measurement that counts (fixed value).
QUALIFIED = "qualified_external_move_not_repriced"


def entry_guard(qualified: Column, reason: Column, seconds_to_expiry: Column, least: float = 30.0) -> Column:
    """qualified and reason as a struct: a qualified measurement with less than `least` seconds left is late_entry_window."""
    late = qualified & F.coalesce(seconds_to_expiry < least, F.lit(False))
    return F.struct((qualified & ~late).alias("qualified"), F.when(late, "late_entry_window").otherwise(reason).alias("reason"))


def window_state(now: Column, start: Column, end: Column, fresh: float = 30.0, near: float = 60.0) -> Column:
    """The state of a market's window at a time, all in seconds: a window newly opened is that even if it is near its end."""
    return F.when(now < start, "WAITING_FOR_NEXT_WINDOW").when(now >= end, "CLOSED").when(now - start <= fresh, "NEWLY_OPENED").when(end - now <= near, "NEAR_EXPIRY").otherwise("ACTIVE")


def tracked_states(quotes: DataFrame, market: str, ts: str, start: str, end: str, available: str | None = None, fresh: float = 30.0, near: float = 60.0) -> DataFrame:
    """quotes with `state`: the window's, but QUOTE_UNAVAILABLE from a failed quote until one succeeds, while the window is open.

    ts, start and end are seconds; `available` is false where a quote failed, true where one came, and NULL for an
    observation of time only.
    """
    own = window_state(F.col(ts), F.col(start), F.col(end), fresh, near)
    if available is None:
        return quotes.withColumn("state", own)
    w = Window.partitionBy(market).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(available, ignorenulls=True).over(w)
    held = F.coalesce(~latest, F.lit(False)) & ((F.col(available).isNotNull() & ~F.col(available)) | ~own.isin("CLOSED", "WAITING_FOR_NEXT_WINDOW"))
    return quotes.withColumn("state", F.when(held, "QUOTE_UNAVAILABLE").otherwise(own))


def tracker_summary(detected: DataFrame, delay: str, errors: str) -> DataFrame:
    """One row: markets, their average delay of detection, those caught within 15 s and after 60 s, and failed quotes."""
    n = lambda c: F.count(F.when(c, 1))
    return detected.agg(F.count("*").alias("markets"), F.coalesce(F.round(F.avg(delay), 3), F.lit(0.0)).alias("mean_delay"), n(F.col(delay) <= 15).alias("within_15"), n(F.col(delay) > 60).alias("after_60"), F.coalesce(F.sum(errors), F.lit(0)).alias("quote_errors"))


def rollovers(selected: DataFrame, asset: str, ts: str, market: str) -> DataFrame:
    """asset, ts, before, after: where an asset's selected market gives way to another."""
    before = F.lag(market).over(Window.partitionBy(asset).orderBy(ts))
    return selected.select(asset, ts, before.alias("before"), F.col(market).alias("after")).filter("before <> after")


def winning_outcome(closed: Column, status: Column, automatic: Column, outcomes: Column, prices: Column) -> Column:
    """status, winner and reason of a market by its final prices, as a struct.

    outcomes and prices are JSON arrays in text. A blank resolution status of a closed market is accepted. One price must
    be 1 and all others 0, within TERMINAL.
    """
    named = F.lower(F.coalesce(status, F.lit("")))
    names = F.from_json(outcomes, "array<string>")
    values = F.transform(F.from_json(prices, "array<string>"), lambda p: p.try_cast("double"))
    bad = names.isNull() | values.isNull() | F.exists(values, lambda p: p.isNull())
    wins = F.filter(F.arrays_zip(names.alias("name"), values.alias("price")), lambda z: F.abs(z["price"] - 1) <= TERMINAL + EPSILON)
    losses = F.filter(values, lambda p: F.abs(p) <= TERMINAL + EPSILON)
    reason = first_reason(
        (~F.coalesce(closed, F.lit(False)), "market_not_closed"),
        (~named.isin("resolved", "") & ~F.coalesce(automatic, F.lit(False)), "resolution_status"),
        (F.coalesce(bad, F.lit(True)), "invalid_outcome_prices"),
        ((F.size(names) != F.size(values)) | (F.size(names) == 0), "outcome_price_length_mismatch"),
        ((F.size(wins) != 1) | (F.size(losses) != F.size(names) - 1), "non_terminal_or_ambiguous_outcome_prices"),
        otherwise="terminal_outcome_prices",
    )
    state = F.when(reason == "terminal_outcome_prices", "resolved").when(reason.isin("market_not_closed", "resolution_status"), "unresolved").otherwise("insufficient_evidence")
    winner = F.when(state == "resolved", F.element_at(wins, 1)["name"])
    full = F.when(reason == "resolution_status", F.concat(F.lit("resolution_status:"), named)).otherwise(reason)
    return F.struct(state.alias("status"), winner.alias("winner"), full.alias("reason"))


EPSILON = 1e-12


def token_status(tokens: Column, token: Column, outcome: Column) -> Column:
    """matched, conflict, token_missing or unavailable: what an array of (token_id, outcome) structs says of a position's token."""
    own = F.filter(tokens, lambda t: t["token_id"] == token)
    same = F.lower(F.trim(F.try_element_at(own, F.lit(1))["outcome"])) == F.lower(F.trim(outcome))
    return F.when(tokens.isNull(), "unavailable").when(F.size(own) == 0, "token_missing").when(F.coalesce(same, F.lit(False)), "matched").otherwise("conflict")


def metadata_key(condition: Column, market_slug: Column, event_slug: Column) -> Column:
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws("|", F.lower(text(condition)), text(market_slug), text(event_slug))


def outcome_joins(positions: DataFrame, metadata: DataFrame, key: str = "metadata_key") -> DataFrame:
    """positions with lifecycle_status, confidence, join_status and join_reason from their market's metadata.

    positions has key, condition_id, token_id and outcome; metadata has key and market, a struct of condition_id, closed,
    status, automatic, outcomes, prices and tokens (see `winning_outcome`, `token_status`). A key with several different
    metadata rows counts as one with conflicting metadata; one without metadata fails.
    """
    own = metadata.groupBy(key).agg(F.min(F.struct("market")).alias("_m"), F.max(F.struct("market")).alias("_z"))
    own = own.select(key, F.col("_m.market").alias("_market"), (~F.col("_m").eqNullSafe(F.col("_z"))).alias("_several"))
    out = positions.join(own, key, "left")
    m = F.col("_market")
    theirs, mine = F.lower(F.coalesce(m["condition_id"], F.lit(""))), F.lower(F.coalesce("condition_id", F.lit("")))
    match = (theirs != "") & (theirs == mine)
    conflict = F.coalesce(F.col("_several"), F.lit(False)) | ((theirs != "") & (mine != "") & (theirs != mine))
    result = winning_outcome(m["closed"], m["status"], m["automatic"], m["outcomes"], m["prices"])
    out = out.withColumns({"_result": result, "token_status": token_status(m["tokens"], F.col("token_id"), F.col("outcome"))})
    resolved, open_ = F.col("_result.status") == "resolved", F.col("_result.status") == "unresolved"
    same = F.lower(F.trim("outcome")) == F.lower(F.trim("_result.winner"))
    status = F.when(m.isNull() | conflict, "insufficient_evidence").when(resolved, F.when(F.coalesce(same, F.lit(False)), "matched_outcome").otherwise("unmatched_outcome")).when(open_, "unresolved_market").otherwise("insufficient_evidence")
    confidence = F.when(m.isNull() | conflict, "low").when(resolved, F.when(match & F.col("token_status").isin("matched", "unavailable"), "high").otherwise("medium")).when(open_, F.when(match, "medium").otherwise("low")).otherwise("low")
    joined = F.when(m.isNull(), "failed").when(conflict, "conflicting_metadata").when(resolved | open_, "joined").otherwise("ambiguous")
    why = F.when(m.isNull(), "missing_market_metadata").when(conflict, "condition_id_conflict").when(resolved, "resolved_terminal_outcome").otherwise(F.col("_result.reason"))
    out = out.withColumns({"lifecycle_status": status, "confidence": confidence, "join_status": joined, "join_reason": why, "winner": F.when(~conflict, F.col("_result.winner"))})
    return out.drop("_market", "_several", "_result")


def resolved_expiry(explicit: Column, slug: Column, verified: Column | None = None) -> Column:
    """expiry (a timestamp), source and confidence, as a struct.

    The explicit time of the source if it has one, else a verified one, else five minutes after the epoch at the end of a
    five-minute market's slug.
    """
    given = F.nullif(F.trim(explicit), F.lit(""))
    checked = F.lit(None).cast("timestamp") if verified is None else verified
    epoch = F.timestamp_seconds(slug_epoch(slug) + 300)
    return F.struct(
        F.when(given.isNotNull(), iso_timestamp(given)).when(checked.isNotNull(), checked).otherwise(epoch).alias("expiry"),
        F.when(given.isNotNull(), "source_dataset").when(checked.isNotNull(), "gamma_market_slug_cross_check").when(epoch.isNotNull(), "market_slug_epoch_plus_300").otherwise("unavailable").alias("source"),
        F.when(given.isNotNull() | checked.isNotNull(), "high").when(epoch.isNotNull(), "medium").otherwise("none").alias("confidence"),
    )


def current_market(markets: DataFrame, asset: str, now: Column) -> DataFrame:
    """Each asset's active market that opened last, else its next one."""
    active = (F.col("start") <= now) & (now < F.col("end"))
    rows = markets.filter(active | (F.col("start") > now)).withColumn("_rank", F.when(active, F.struct(F.lit(0).alias("k"), (-F.col("start")).alias("at"))).otherwise(F.struct(F.lit(1).alias("k"), F.col("start").alias("at"))))
    w = Window.partitionBy(asset).orderBy("_rank", "market_id")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_rank")
