"""Replays of recorded sessions: what a detector would have reported, from the events alone.

An event is one row of EVENT; `n` is its place in the session. Snapshots meet the reference price of their asset at the
same time, if it came before them. A market's baseline is its first snapshot that met one, with that reference; it is
taken anew, and the snapshot skipped, where the reference comes from another source. The first snapshot of a market that
qualifies is an opportunity, later ones are duplicates, all others are skipped with a reason.

`tidemark.streaming.replay` gives the same rows from a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .outcomes import LAG, entry_guard, lag_measurement
from .stretch import latest, prior

EVENT = "session string, n long, t long, kind string, asset string, market string, question string, current string, source string, price double, yes double, bid double, ask double, liquidity double, seconds_left double, reason string, counters map<string,long>, mode string, fallback string"

# Kinds of event, counters and reasons (fixed values).
SNAPSHOT, REFERENCE, LIFECYCLE, SKIP = "market_snapshot", "reference_price", "market_lifecycle", "skipped"
ENDS = ("capture_checkpoint", "session_completed")
COUNTERS = ("expected_reference_points", "successful_reference_points", "expected_market_points", "successful_market_points")
RECOMPUTED = ("liquidity_below_minimum", "near_expiry_insufficient_time", "external_move_below_threshold", "polymarket_already_repriced", "confidence_below_threshold", "duplicate_opportunity_suppressed")
SOURCE_CHANGED, MISSING, DUPLICATE, UNKNOWN = "reference_source_changed:", "missing_reference_price", "duplicate_opportunity_suppressed", "market_not_registered"
QUOTE_FAILURES = ("polymarket_quote_error", "missing_reference")

MEASURED = ("external_change", "market_change", "lag_seconds", "lag_score", "direction", "confidence")


def registry(events: DataFrame) -> DataFrame:
    """session, market, question, registered (place) and discovered_at of the first event that describes each market."""
    first = events.filter((F.col("kind") == LIFECYCLE) & F.col("question").isNotNull() & F.col("market").isNotNull())
    return first.groupBy("session", "market").agg(F.min_by("question", "n").alias("question"), F.min("n").alias("registered"), F.min_by("t", "n").alias("discovered_at"))


def _snapshots(events: DataFrame) -> DataFrame:
    """Snapshots with `question` and `known` of their market, and `reference`: struct(t, price, source) or NULL."""
    own = events.filter(F.col("kind") == SNAPSHOT).drop("question")
    # Only snapshots and references of one asset and time are sorted together.
    both = own.unionByName(events.filter(F.col("kind") == REFERENCE).drop("question"))
    met = latest(both, ["session", "asset", "t"], "n", F.when(F.col("kind") == REFERENCE, F.struct("t", "price", "source")), "reference").filter(F.col("kind") == SNAPSHOT)
    return met.join(registry(events).drop("discovered_at"), ["session", "market"], "left").withColumn("known", F.coalesce(F.col("registered") < F.col("n"), F.lit(False))).withColumn("question", F.when(F.col("known"), F.col("question")))


def _measured(rows: DataFrame, bounds: dict[str, float]) -> DataFrame:
    """rows with `m`, the measurement of the snapshot against `base`: struct(t, price, source, yes)."""
    m = lag_measurement(F.col("reference.price"), F.col("base.price"), F.col("yes"), F.col("base.yes"), (F.col("reference.t") - F.col("base.t")) / F.lit(1e6), F.col("liquidity"), F.col("seconds_left"), F.col("bid"), F.col("ask"), bounds)
    return rows.withColumn("m", m)


def _reported(rows: DataFrame, kind, reason, measured) -> DataFrame:
    fields = [F.when(measured, F.col(f"m.{c}")).alias(c) for c in MEASURED]
    return rows.select("session", "n", "t", "market", "asset", "question", kind.alias("kind"), reason.alias("reason"), *fields)


def _preserved(events: DataFrame) -> DataFrame:
    """Skips of the recording that no snapshot can give again."""
    reason = F.coalesce("reason", F.lit(""))
    kept = events.filter((F.col("kind") == SKIP) & ~reason.isin(*RECOMPUTED) & ~reason.startswith(SOURCE_CHANGED))
    nulls = [F.lit(None).cast("string" if c == "direction" else "double").alias(c) for c in MEASURED]
    return kept.select("session", "n", "t", "market", "asset", "question", F.lit("skipped").alias("kind"), "reason", *nulls)


def replay(events: DataFrame, bounds: dict[str, float] = LAG, least_left: float = 60.0, bucket: int | None = None) -> DataFrame:
    """session, n, t, market, asset, question, kind (opportunity or skipped), reason and the measurement, a row for each snapshot and kept skip.

    A qualified snapshot with less than `least_left` seconds left is skipped as late. A snapshot of a market that no event
    before it describes is skipped as not registered. bucket: how many places of a market's events are sorted at once.
    """
    rows = written(_snapshots(events), "snapshots") if bucket else _snapshots(events)
    usable = F.col("known") & F.col("reference").isNotNull()
    met = prior(rows.filter(usable), ["session", "market"], "n", F.struct("reference.source"), "before", bucket)
    changed = F.col("before").isNotNull() & ~F.col("before.source").eqNullSafe(F.col("reference.source"))
    start = F.struct(F.col("reference.t").alias("t"), F.col("reference.price").alias("price"), F.col("reference.source").alias("source"), F.col("yes").alias("yes"))
    met = latest(met, ["session", "market"], "n", F.when(F.col("before").isNull() | changed, start), "base", bucket)
    met = _measured(met, bounds).withColumn("changed", changed)
    met = met.withColumn("guard", entry_guard(F.col("m.qualified"), F.col("m.reason"), F.col("seconds_left"), least_left))
    met = met.withColumn("candidate", F.col("guard.qualified") & ~F.col("changed"))
    first = met.filter("candidate").groupBy("session", "market").agg(F.min("n").alias("first"))
    met = met.join(first, ["session", "market"], "left")
    accepted = F.col("candidate") & (F.col("n") == F.col("first"))
    reason = F.when(F.col("changed"), F.concat(F.lit(SOURCE_CHANGED), "before.source", F.lit("->"), "reference.source")).when(F.col("candidate") & ~accepted, F.lit(DUPLICATE)).otherwise(F.col("guard.reason"))
    out = _reported(met, F.when(accepted, "opportunity").otherwise("skipped"), reason, ~F.col("changed"))
    missed = _reported(rows.filter(~usable).withColumn("m", F.lit(None).cast(met.schema["m"].dataType)), F.lit("skipped"), F.when(F.col("known"), MISSING).otherwise(UNKNOWN), F.lit(False))
    return out.unionByName(missed).unionByName(_preserved(events))


def replay_bundle(events: DataFrame, bounds: dict[str, float] = LAG) -> DataFrame:
    """The same columns for a bundle of markets, references and snapshots that carries no order: n isn't used to order.

    A snapshot meets the reference of its asset and time wherever it stands. An asset's reference baseline is that of its
    first snapshot, in order of (t, market), that met one, a market's is its own first such snapshot; every snapshot that
    qualifies is an opportunity. Of several references of one asset and time that of the greatest n counts.
    """
    own = events.filter(F.col("kind") == SNAPSHOT).drop("question")
    refs = events.filter(F.col("kind") == REFERENCE).groupBy("session", "asset", "t").agg(F.max_by(F.struct("t", "price", "source"), "n").alias("reference"))
    rows = own.join(refs, ["session", "asset", "t"], "left").join(registry(events).select("session", "market", "question"), ["session", "market"], "left")
    met = rows.filter(F.col("reference").isNotNull())
    order = F.struct("t", "market", "n")
    by_asset = met.groupBy("session", "asset").agg(F.min_by("reference", order).alias("first"))
    by_market = met.groupBy("session", "market").agg(F.min_by("yes", order).alias("first_yes"))
    met = met.join(by_asset, ["session", "asset"]).join(by_market, ["session", "market"]).withColumn("base", F.struct(F.col("first.t").alias("t"), F.col("first.price").alias("price"), F.col("first.source").alias("source"), F.col("first_yes").alias("yes")))
    met = _measured(met, bounds)
    out = _reported(met, F.when(F.col("m.qualified"), "opportunity").otherwise("skipped"), F.col("m.reason"), F.lit(True))
    missed = _reported(rows.filter(F.col("reference").isNull()).withColumn("m", F.lit(None).cast(met.schema["m"].dataType)), F.lit("skipped"), F.lit(MISSING), F.lit(False))
    return out.unionByName(missed)


def replay_markets(events: DataFrame, replayed: DataFrame) -> DataFrame:
    """session, market, question, state, discovered_at, updated_at, snapshots, opportunities (duplicates too) and completed."""
    known = registry(events)
    states = events.filter((F.col("kind") == LIFECYCLE) & F.col("market").isNotNull()).select("session", "market", "n", "t", "current")
    states = states.join(known.select("session", "market", "registered"), ["session", "market"]).filter("n >= registered")
    states = states.groupBy("session", "market").agg(F.max_by("current", "n").alias("state"), F.max_by("t", "n").alias("updated_at"))
    seen = events.filter(F.col("kind") == SNAPSHOT).select("session", "market", "n").join(known.select("session", "market", "registered"), ["session", "market"]).filter("n > registered")
    seen = seen.groupBy("session", "market").agg(F.count("*").alias("snapshots"))
    found = replayed.filter((F.col("kind") == "opportunity") | (F.col("reason") == DUPLICATE)).groupBy("session", "market").agg(F.count("*").alias("opportunities"))
    out = known.drop("registered").join(states, ["session", "market"], "left").join(seen, ["session", "market"], "left").join(found, ["session", "market"], "left").fillna(0, ["snapshots", "opportunities"])
    return out.withColumn("completed", (F.col("state") == "closed") & (F.col("snapshots") > 0))


def replay_counters(events: DataFrame, assets: int) -> DataFrame:
    """session, the four counters, mode and fallback: those of the last checkpoint or completion.

    A session without one gets what its events bear out: every asset was due at each time of a reference, snapshot or
    failed quote. A public session with prices of the source `mock` is a fallback.
    """
    kind, reason = F.col("kind"), F.coalesce("reason", F.lit(""))
    failed = (kind == SKIP) & (reason.startswith(QUOTE_FAILURES[0]) | reason.startswith(QUOTE_FAILURES[1]))
    due = events.filter(kind.isin(SNAPSHOT, REFERENCE) | failed).select("session", "t").distinct().groupBy("session").agg(F.count("*").alias("times"))
    last = F.struct("counters", "mode", "fallback")
    out = events.groupBy("session").agg(
        F.max_by(last, F.when(kind.isin(*ENDS), F.col("n"))).alias("last"),
        F.min_by("mode", F.when(kind == "session_started", F.col("n"))).alias("began"),
        F.count(F.when(kind == REFERENCE, 1)).alias("references"),
        F.count(F.when(kind == SNAPSHOT, 1)).alias("snapshots"),
        F.count(F.when(failed, 1)).alias("failed"),
        F.count(F.when((kind == REFERENCE) & (F.col("source") == "mock"), 1)).alias("mock"),
    ).join(due, "session", "left")
    inferred = {COUNTERS[0]: F.coalesce("times", F.lit(0)) * assets, COUNTERS[1]: F.col("references"), COUNTERS[2]: F.col("snapshots") + F.col("failed"), COUNTERS[3]: F.col("snapshots")}
    told = F.col("last").isNotNull()
    counters = [F.when(told, F.col("last.counters")[c]).otherwise(v).cast("long").alias(c) for c, v in inferred.items()]
    mode = F.when(told, F.coalesce("last.mode", "began")).otherwise(F.col("began"))
    fallback = F.when(told, F.coalesce("last.fallback", F.lit(""))).otherwise("inferred_counters_missing_session_completed")
    mocked = (F.col("mock") > 0) & (mode == "public")
    text = F.when(mocked, F.ltrim(F.concat(fallback, F.lit(";mock_reference_events_detected:"), F.col("mock").cast("string")), F.lit(";"))).otherwise(fallback)
    return out.select("session", *counters, F.when(mocked, "mock_fallback").otherwise(mode).alias("mode"), text.alias("fallback"))


def replay_report(events: DataFrame, replayed: DataFrame, assets: int) -> DataFrame:
    """A row a session: counters, markets, completed windows, opportunities, skips, their rate and the coverage in percent."""
    markets = replay_markets(events, replayed).groupBy("session").agg(F.count("*").alias("markets"), F.count(F.when(F.col("completed"), 1)).alias("completed"))
    found = replayed.groupBy("session").agg(F.count(F.when(F.col("kind") == "opportunity", 1)).alias("opportunities"), F.count(F.when(F.col("kind") == "skipped", 1)).alias("skipped"))
    out = replay_counters(events, assets).join(markets, "session", "left").join(found, "session", "left").fillna(0, ["markets", "completed", "opportunities", "skipped"])
    share = lambda a, b, none: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(none))
    return out.withColumns({
        "opportunity_rate": F.round(share("opportunities", "completed", 0.0), 6),
        "reference_coverage": F.round(100 * share(COUNTERS[1], COUNTERS[0], 0.0), 4),
        "data_gap": F.round(100 * (1 - share(COUNTERS[3], COUNTERS[2], 0.0)), 4),
    })
