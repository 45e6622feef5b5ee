"""Quote states of markets: flags, episodes of unusual books, candidate rules, and passive quotes at their starts.

States carry a session, a market, an asset, t (microseconds), the quote's own time, bid, ask, their sizes and the seconds
to expiry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import series
from .paths import future
from .stats import with_scenarios

# Fixed bounds: probability points, shares, seconds.
COST, ORDER, FILL, MOST_AGE, NEAR_EXPIRY, WIDE = 0.01, 250.0, 0.50, 5.0, 30.0, 0.03
KINDS = ("crossed", "locked", "wide")
# Passive quotes (fixed values): shares of a side that are filled, the cost of a filled leg, seconds to cancel, greatest age.
QUEUE, LEG_COST, CANCEL, FRESH, BUFFER = 0.375, 0.005, 2.0, 2.0, 30.0
POLICIES = (
    {"policy": "all_assets_2s", "lifetime": 2, "only": "ALL", "regime": "standard"},
    {"policy": "all_assets_5s", "lifetime": 5, "only": "ALL", "regime": "standard"},
    {"policy": "all_assets_15s", "lifetime": 15, "only": "ALL", "regime": "standard"},
    {"policy": "all_assets_30s", "lifetime": 30, "only": "ALL", "regime": "standard"},
    {"policy": "btc_15s", "lifetime": 15, "only": "BTC", "regime": "standard"},
    {"policy": "eth_15s", "lifetime": 15, "only": "ETH", "regime": "standard"},
    {"policy": "sol_15s", "lifetime": 15, "only": "SOL", "regime": "standard"},
    {"policy": "near_expiry_5s", "lifetime": 5, "only": "ALL", "regime": "near_expiry"},
)


def quote_states(quotes: DataFrame, quote_time: str = "quote_t") -> DataFrame:
    """quotes with valid, stale, crossed, locked, wide, near_expiry, spread, age, capacity and margin.

    A state is valid if bid and ask lie from 0 to 1, both sizes are positive and the time to expiry is known; stale if
    its quote is over 5 s old or of unknown age. The other flags, spread and margin are those of valid states.
    """
    known = lambda *names: _all(*[F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in names])
    bid, ask = F.col("bid"), F.col("ask")
    valid = F.coalesce(known("bid", "ask", "bid_size", "ask_size", "seconds_to_expiry") & bid.between(0, 1) & ask.between(0, 1) & (F.col("bid_size") > 0) & (F.col("ask_size") > 0), F.lit(False))
    age = (F.col("t") - F.col(quote_time)) / F.lit(1e6)
    out = quotes.withColumns({"valid": valid, "age": age, "stale": F.coalesce(age > MOST_AGE, F.lit(True)), "spread": F.when(valid, ask - bid)})
    return out.withColumns(
        {
            "crossed": F.col("valid") & (bid > ask),
            "locked": F.col("valid") & (bid == ask),
            "wide": F.col("valid") & (F.col("spread") > WIDE),
            "near_expiry": F.col("valid") & F.col("seconds_to_expiry").between(0, NEAR_EXPIRY),
            "capacity": F.when(F.col("valid"), F.least("bid_size", "ask_size", F.lit(ORDER * FILL))).otherwise(0.0),
            "margin": F.when(F.col("valid"), bid - ask - COST),
        }
    )


def _all(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def distinct_states(quotes: DataFrame, key: Sequence[str] = ("session", "market"), quote_time: str = "quote_t") -> DataFrame:
    """quotes without those that repeat the one before them in quote time, prices and sizes."""
    return series.without_repeats(quotes, list(key), "t", [quote_time, "bid", "ask", "bid_size", "ask_size"])


def histories(states: DataFrame) -> DataFrame:
    return states.filter("valid and not stale")


def state_episodes(states: DataFrame, key: Sequence[str] = ("session", "market")) -> DataFrame:
    """kind, key, start, end, states, seconds, persists_2, persists_5, capacity, margin and first row of each episode.

    An episode is a stretch of valid, fresh states of a kind, no more than 5 s apart; any other state of the market ends it.
    Kinds are three windows over one shuffle of the states.
    """
    w = series._by(list(key), "t")
    fresh = F.col("valid") & ~F.col("stale")
    parts = []
    for kind in KINDS:
        holds = fresh & F.col(kind)
        before = F.lag(holds).over(w) & ((F.col("t") - F.lag("t").over(w)) / F.lit(1e6) <= MOST_AGE)
        opens = holds & ~F.coalesce(before, F.lit(False))
        parts.append(F.struct(F.lit(kind).alias("kind"), holds.alias("holds"), opens.cast("int").alias("opens")))
    rows = states.withColumns({f"_{k}": p for k, p in zip(KINDS, parts, strict=True)}).withColumn("_k", F.explode(F.array(*[F.col(f"_{k}") for k in KINDS])))
    rows = rows.withColumn("_n", F.sum("_k.opens").over(series._by([*key, "_k.kind"], "t"))).filter("_k.holds")
    first = F.min_by(F.struct("t", "asset", "bid", "ask", "bid_size", "ask_size", "age", "seconds_to_expiry"), F.col("t")).alias("first")
    out = rows.groupBy(F.col("_k.kind").alias("kind"), *key, F.col("_n").alias("episode")).agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("states"), F.max("capacity").alias("capacity"), F.max("margin").alias("margin"), first)
    seconds = (F.col("end") - F.col("start")) / F.lit(1e6)
    return out.withColumns({"seconds": seconds, "persists_2": seconds >= 2, "persists_5": seconds >= 5, "asset": F.col("first.asset")})


# Fixed candidates: name, which states count (NULL: none can), and which episodes.
CANDIDATES = (
    ("crossed_or_inverted_yes_book", "fresh and crossed", "crossed"),
    ("complete_set_acquisition", None, None),
    ("complete_set_liquidation", None, None),
    ("locked_book", "fresh and locked", "locked"),
    ("stale_bid_ask_inconsistency", "valid and stale and crossed", None),
    ("temporary_wide_spread_capture", "fresh and wide", "wide"),
    ("near_expiry_structural_distortion", "fresh and near_expiry and crossed", None),
    ("multi_outcome_pricing_inconsistency", None, None),
    ("executable_bid_ask_anomaly", "fresh and crossed", "crossed"),
    ("liquidity_aware_arbitrage_like_setup", "fresh and crossed", "crossed"),
)


def structural_candidates(states: DataFrame, episodes: DataFrame, hours: float) -> DataFrame:
    """One row for each of CANDIDATES, by rank: states, markets, assets, margins, capacity, episodes, their median length.

    Margins of the complete-set rules are those of all fresh states, as are, near expiry, those of that rule. States are
    expanded to the rules that they meet, so that one aggregation serves all.
    """
    marked = states.withColumn("fresh", F.col("valid") & ~F.col("stale"))
    whole = {"complete_set_acquisition": "fresh", "complete_set_liquidation": "fresh", "near_expiry_structural_distortion": "fresh and near_expiry"}
    entries = []
    for name, rule, _ in CANDIDATES:
        counts = F.expr(rule) if rule else F.lit(False)
        priced = F.expr(whole[name]) if name in whole else counts
        entries.append(F.when(counts | priced, F.struct(F.lit(name).alias("candidate"), counts.alias("counts"), priced.alias("priced"))))
    rows = marked.withColumn("_c", F.explode(F.array_compact(F.array(*entries))))
    c = F.col("_c.counts")
    own = rows.groupBy("_c.candidate").agg(
        F.count(F.when(c, 1)).alias("states"),
        F.countDistinct(F.when(c, F.col("market"))).alias("markets"),
        F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("asset")))), ";").alias("assets"),
        F.max(F.when(F.col("_c.priced"), F.col("margin"))).alias("best_margin"),
        F.avg(F.when(F.col("_c.priced"), F.col("margin"))).alias("mean_margin"),
        F.coalesce(F.max(F.when(c, F.col("capacity"))), F.lit(0.0)).alias("capacity"),
    )
    of = F.explode(F.array_compact(F.array(*[F.when(F.col("kind") == kind, F.lit(name)) for name, _, kind in CANDIDATES if kind])))
    runs = episodes.withColumn("candidate", of).groupBy("candidate").agg(F.count("*").alias("episodes"), F.count(F.when(F.col("persists_2"), 1)).alias("persist_2"), F.count(F.when(F.col("persists_5"), 1)).alias("persist_5"), F.percentile("seconds", F.lit(0.5)).alias("median_seconds"))
    names = states.sparkSession.createDataFrame([(i + 1, n) for i, (n, *_) in enumerate(CANDIDATES)], "rank int, candidate string")
    out = names.join(F.broadcast(own), "candidate", "left").join(F.broadcast(runs), "candidate", "left")  # ten rows each
    out = out.fillna(0, ["states", "markets", "episodes", "persist_2", "persist_5"]).fillna({"assets": "", "capacity": 0.0})
    return out.withColumns({"states_per_hour": F.col("states") / hours, "episodes_per_hour": F.col("episodes") / hours})


def passive_attempts(starts: DataFrame, states: DataFrame, policies: Sequence[dict] = POLICIES) -> DataFrame:
    """What each policy's quotes at the starts of wide episodes come to: fills, matched and left shares, and their pnl.

    starts has session, market, asset, t, bid, ask, sizes, age and seconds_to_expiry; `states` the valid, fresh ones. Bid
    and ask are posted at the start's own, for the policy's lifetime and the time to cancel. A side is filled, for a
    fixed share of its size (125 shares at most), if the best bid later falls under it or the best ask rises over it.
    What isn't matched is closed at the first state from the deadline on, which may be 5 s late at most; starts without
    one, of another asset, too old, or too near expiry give no row.
    """
    rows = with_scenarios(starts, list(policies))
    left = F.col("seconds_to_expiry")
    need = F.col("lifetime") + CANCEL
    standard, near = (F.col("regime") == "standard") & (left > need + BUFFER), (F.col("regime") == "near_expiry") & (left > need) & (left <= BUFFER)
    rows = rows.filter(((F.col("only") == "ALL") | (F.col("only") == F.col("asset"))) & (F.col("age") <= FRESH) & (standard | near))
    rows = rows.withColumns({"_key": F.struct("session", "market"), "deadline": F.col("t") + (need * 1_000_000).cast("long")})
    path = states.select(F.struct("session", "market").alias("_key"), F.col("t").alias("at"), F.col("bid").alias("b"), F.col("ask").alias("a"))
    most = int((max(p["lifetime"] for p in policies) + CANCEL + MOST_AGE) * 1_000_000)
    met = future(rows, path, "_key", "t", most, "at", "p_")
    # The exit is the first state from the deadline on; fills count up to it.
    late = F.col("p_at") >= F.col("deadline")
    ids = ["session", "market", "asset", "t", "policy", "lifetime", "bid", "ask", "bid_size", "ask_size", "deadline"]
    out = met.groupBy(*ids).agg(
        F.min(F.when(late, F.struct(F.col("p_at").alias("at"), F.col("p_b").alias("b"), F.col("p_a").alias("a")))).alias("exit"),
        F.min(F.when(F.col("p_b") < F.col("bid"), F.col("p_at"))).alias("bid_hit"),
        F.min(F.when(F.col("p_a") > F.col("ask"), F.col("p_at"))).alias("ask_hit"),
    )
    out = out.filter((F.col("exit.at") - F.col("deadline")) / F.lit(1e6) <= MOST_AGE)
    fill = lambda hit, size: F.when(F.col(hit) <= F.col("exit.at"), F.least(F.col(size), F.lit(ORDER * FILL)) * QUEUE).otherwise(0.0)
    out = out.withColumns({"bid_shares": fill("bid_hit", "bid_size"), "ask_shares": fill("ask_hit", "ask_size")})
    out = out.withColumn("matched", F.least("bid_shares", "ask_shares"))
    out = out.withColumns({"long": F.col("bid_shares") - F.col("matched"), "short": F.col("ask_shares") - F.col("matched")})
    out = out.withColumns(
        {
            "spread_pnl": F.col("matched") * (F.col("ask") - F.col("bid") - 2 * LEG_COST),
            "long_pnl": F.col("long") * (F.col("exit.b") - F.col("bid") - LEG_COST),
            "short_pnl": F.col("short") * (F.col("ask") - F.col("exit.a") - LEG_COST),
        }
    )
    return out.withColumns({"pnl": F.col("spread_pnl") + F.col("long_pnl") + F.col("short_pnl"), "filled": F.col("bid_shares") + F.col("ask_shares")}).drop("exit", "bid_hit", "ask_hit")


def passive_summary(attempts: DataFrame, hours: float, intervals: DataFrame | None = None) -> DataFrame:
    """policy, attempts, fill shares, pnl, expectancy, wins, positive assets and sessions, largest shares, greatest drawdown and the gate.

    `intervals` has policy and low, the lower bound of the mean by clusters of markets (see `stats.bootstrap_mean`);
    without it no policy passes the gate. The gate asks for positive expectancy and interval, at most half of the
    triggered ones filled on one side only, every asset and session positive, and none with over 0.40 of the pnl.
    """
    b, a = F.col("bid_shares") > 0, F.col("ask_shares") > 0
    n, count = F.count("*"), lambda c: F.count(F.when(c, 1))
    out = attempts.groupBy("policy").agg(
        n.alias("attempts"),
        (n / hours).alias("attempts_per_hour"),
        count(b | a).alias("any_fill"),
        count(b & a).alias("two_sided"),
        count(b != a).alias("one_sided"),
        F.sum("filled").alias("filled"),
        (F.sum(F.least(F.col("filled"), F.lit(ORDER))) / hours).alias("capacity_per_hour"),
        F.sum("pnl").alias("pnl"),
        F.avg("pnl").alias("expectancy"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
    )
    out = out.withColumns(
        {
            "any_fill_probability": F.col("any_fill") / F.col("attempts") * QUEUE,
            "two_sided_probability": F.col("two_sided") / F.col("attempts") * QUEUE,
            "one_sided_share": F.coalesce(F.try_divide("one_sided", "any_fill"), F.lit(0.0)),
            "pnl_per_share": F.coalesce(F.try_divide("pnl", F.nullif(F.col("filled"), F.lit(0.0))), F.lit(0.0)),
        }
    )
    for group in ("asset", "session"):
        each = attempts.groupBy("policy", group).agg(F.sum("pnl").alias("p"), F.avg("pnl").alias("e")).groupBy("policy").agg(F.count("*").alias(f"{group}s"), F.count(F.when(F.col("e") > 0, 1)).alias(f"positive_{group}s"), F.max("p").alias("_best"))
        out = out.join(each, "policy").withColumn(f"largest_{group}_share", F.when(F.col("pnl") > 0, F.col("_best") / F.col("pnl"))).drop("_best")
    out = out.join(intervals.select("policy", F.col("low").alias("cluster_low")), "policy", "left") if intervals is not None else out.withColumn("cluster_low", F.lit(None).cast("double"))
    deep = series.drawdowns(attempts, "policy", ["t", "session", "market"], "pnl").select("policy", F.col("drawdown_absolute").alias("max_drawdown"))
    out = out.join(deep, "policy")
    gate = (F.col("expectancy") > 0) & (F.col("cluster_low") > 0) & (F.col("one_sided_share") <= 0.50) & (F.col("positive_assets") == F.col("assets")) & (F.col("positive_sessions") == F.col("sessions")) & (F.col("largest_asset_share") <= 0.40) & (F.col("largest_session_share") <= 0.40)
    return out.withColumn("passes", F.coalesce(gate, F.lit(False)))


def session_integrity(events: DataFrame) -> DataFrame:
    """session, mode, started, completed, status: ok, incomplete, non_public or failed_integrity, by its own start and end events.

    events has session, event, t and mode (of session_started), campaign and continuity (of session_completed).
    """
    of = lambda kind, c: F.max(F.when(F.col("event") == kind, F.col(c)))
    out = events.groupBy("session").agg(of("session_started", "mode").alias("mode"), of("session_started", "t").alias("started"), of("session_completed", "t").alias("completed"), of("session_completed", "campaign").alias("campaign"), of("session_completed", "continuity").alias("continuity"))
    status = F.when(F.col("started").isNull() | F.col("completed").isNull(), "incomplete").when(~F.coalesce(F.col("mode") == "public", F.lit(False)), "non_public").when(~F.coalesce((F.col("campaign") == "complete") & (F.col("continuity") == "continuous"), F.lit(False)), "failed_integrity").otherwise("ok")
    return out.withColumn("status", status)

