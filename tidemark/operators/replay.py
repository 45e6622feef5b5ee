"""Signals replayed on later quotes: delayed entries, fixed horizons, cost scenarios, matched random timing.

Signals have signal (an id), market, session, asset, side (YES or NO), t (microseconds) and seconds_to_expiry; quotes have
market, t, bid, ask and their sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import executable_price, hash_uniform
from .metrics import by_grouping_sets
from .order import ordinal
from .paths import future
from .series import drawdowns as deepest
from .stats import with_scenarios

# Fixed values of the slower horizons: seconds, directions, probability points.
HORIZONS, DIRECTIONS = (30, 60, 120, 180), ("continuation", "mean_reversion")
ENTRY_DELAY, MOST_LAG, TRANSACTION = 2.0, 5.0, 0.005
# Fixed values of a replayed exit: target and stop in probability points, seconds.
MOVE, LONGEST = 0.03, 180.0


def executable(side: Column, bid: Column, ask: Column, bid_size: Column, ask_size: Column, entry: bool) -> Column:
    """price and size of a taker of a side, as a struct."""
    buys = F.lit(entry)
    size = F.when((side == "YES") == buys, ask_size).otherwise(bid_size)
    return F.struct(executable_price(side, bid, ask, entry).alias("price"), size.alias("size"))


def sound(price: Column) -> Column:
    return F.when(price.between(0, 1), price)


def slower_horizons(signals: DataFrame, quotes: DataFrame, horizons: Sequence[int] = HORIZONS, directions: Sequence[str] = DIRECTIONS) -> DataFrame:
    """A row for each signal, horizon and direction that can be traded: traded_side, entry and exit, pnl.

    A trade enters at the first quote 2 s after the signal or later and leaves at the first one at the horizon or later;
    both may come 5 s late at most, and the exit must be a later quote than the entry. Horizons beyond the time to expiry
    are left out, as are prices outside 0 to 1. Mean reversion trades the other side.
    """
    grid = [{"horizon": h, "direction": d} for h in horizons for d in directions]
    rows = with_scenarios(signals, grid).filter(F.col("seconds_to_expiry") >= F.col("horizon"))
    most = int((max(horizons) + MOST_LAG) * 1_000_000)
    path = quotes.select("market", F.col("t").alias("at"), "bid", "ask")
    # A signal meets its path once; the grid is laid over the two quotes that each horizon needs.
    met = future(signals.select("signal", "market", "t"), path, "market", "t", most, "at", "p_")
    quote = F.struct(F.col("p_at").alias("at"), F.col("p_bid").alias("bid"), F.col("p_ask").alias("ask"))
    first = lambda seconds: F.min(F.when(F.col("p_at") >= F.col("t") + int(seconds * 1_000_000), quote))
    found = met.groupBy("signal").agg(first(ENTRY_DELAY).alias("enter"), F.array(*[F.struct(F.lit(h).alias("horizon"), first(h).alias("quote")) for h in horizons]).alias("exits"))
    rows = rows.join(found, "signal").withColumn("leave", F.try_element_at(F.filter("exits", lambda x: x["horizon"] == F.col("horizon")), F.lit(1))["quote"])
    late = lambda q, seconds: (F.col(f"{q}.at") - F.col("t")) / F.lit(1e6) - seconds
    rows = rows.filter((F.col("leave.at") > F.col("enter.at")) & (late("enter", F.lit(ENTRY_DELAY)) <= MOST_LAG) & (late("leave", F.col("horizon")) <= MOST_LAG))
    side = F.when(F.col("direction") == "continuation", F.col("side")).when(F.col("side") == "YES", "NO").otherwise("YES")
    rows = rows.withColumn("traded_side", side)
    entry = sound(executable_price("traded_side", "enter.bid", "enter.ask", True))
    leave = sound(executable_price("traded_side", "leave.bid", "leave.ask", False))
    rows = rows.withColumns({"entry_price": entry, "exit_price": leave}).filter("entry_price is not null and exit_price is not null")
    return rows.withColumns({"entry_at": F.col("enter.at"), "exit_at": F.col("leave.at"), "pnl": F.col("exit_price") - F.col("entry_price") - TRANSACTION}).drop("enter", "leave", "exits")


def horizon_summary(rows: DataFrame, drawdowns: bool = True) -> DataFrame:
    """horizon, direction, n, win_rate, expectancy, pnl, drawdown, positive sessions, and the largest shares of pnl."""
    by = ["horizon", "direction"]
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("pnl").alias("expectancy"), F.sum("pnl").alias("pnl"))
    for group in ("session", "asset"):
        each = rows.groupBy(*by, group).agg(F.sum("pnl").alias("p"), F.avg("pnl").alias("e")).groupBy(*by).agg(F.count("*").alias(f"{group}s"), F.count(F.when(F.col("e") > 0, 1)).alias(f"positive_{group}s"), F.max("p").alias("_best"))
        out = out.join(each, by).withColumn(f"largest_{group}_share", F.when(F.col("pnl") > 0, F.col("_best") / F.col("pnl"))).drop("_best")
    if drawdowns:
        deep = deepest(rows.withColumn("_cell", F.struct(*by)), "_cell", ["t", "signal"], "pnl")
        out = out.join(deep.select("_cell.*", F.col("drawdown_absolute").alias("max_drawdown")), by)
    return out


def group_expectancy(rows: DataFrame, dimensions: Sequence[str], pnl: str = "pnl") -> DataFrame:
    """dimension, value, n, total, expectancy: overall and by each dimension, in one pass."""
    return by_grouping_sets(rows, list(dimensions), F.count("*").alias("n"), F.sum(pnl).alias("total"), F.avg(pnl).alias("expectancy"))


def random_timing(signals: DataFrame, quotes: DataFrame, horizon: int, direction: str, trials: int) -> DataFrame:
    """trial, expectancy: each signal of one horizon and direction enters at a quote of its market that a hash draws.

    Candidates are all quotes of the market with an exit at the horizon less the entry delay. They are numbered within
    (market, side) by range partitions, so a draw is an equi-join on the number. Without candidates for every signal
    there is no result.
    """
    side = F.when(F.lit(direction == "continuation"), F.col("side")).when(F.col("side") == "YES", "NO").otherwise("YES")
    asked = signals.select("signal", "market", "t", side.alias("traded"))
    ahead = int((horizon - ENTRY_DELAY) * 1_000_000)
    sides = asked.select("market", F.col("traded")).distinct()
    pool = quotes.select("market", "t", "bid", "ask").join(sides, "market")
    path = quotes.select("market", F.col("t").alias("at"), "bid", "ask")
    met = future(pool, path, "market", "t", ahead + int(MOST_LAG * 1_000_000), "at", "p_").filter(F.col("p_at") >= F.col("t") + ahead)
    exits = met.groupBy("market", "t", "traded", "bid", "ask").agg(F.min(F.struct("p_at", "p_bid", "p_ask")).alias("leave"))
    pnl = sound(executable_price("traded", "leave.p_bid", "leave.p_ask", False)) - sound(executable_price("traded", "bid", "ask", True)) - TRANSACTION
    candidates = exits.select("market", "traded", "t", pnl.alias("pnl")).filter("pnl is not null")
    placed = ordinal(candidates, ["market", "traded", "t"], "_place")
    bounds = placed.groupBy("market", "traded").agg(F.min("_place").alias("_low"), F.count("*").alias("_n"))
    drawn = asked.join(bounds, ["market", "traded"])
    if drawn.count() < asked.count():
        return placed.sparkSession.createDataFrame([], "trial int, expectancy double")
    drawn = drawn.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ("trial", "t", "market")], F.lit(direction), F.lit(str(horizon)))
    index = F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)"), F.col("_n").cast("decimal(20,0)")).cast("long")
    counted = drawn.groupBy("trial", (F.col("_low") + index).alias("_place")).agg(F.count("*").alias("_times"))
    return counted.join(placed.select("_place", "pnl"), "_place").groupBy("trial").agg((F.sum(F.col("pnl") * F.col("_times")) / F.sum("_times")).alias("expectancy"))


def horizon_gates(summary: DataFrame) -> DataFrame:
    """summary (with low, the adjusted interval's lower bound, and holm, the adjusted p-value) with `passes`."""
    gate = (F.col("n") > 0) & (F.col("expectancy") > 0) & (F.col("low") > 0) & (F.col("holm") <= 0.05) & (F.col("positive_sessions") == F.col("sessions")) & (F.col("largest_session_share") <= 0.40) & (F.col("largest_asset_share") <= 0.40)
    return summary.withColumn("passes", F.coalesce(gate, F.lit(False)))


# Cost scenarios


def low_medium_high(x: Column, low: float, high: float) -> Column:
    return F.when(x <= low, "low").when(x <= high, "medium").otherwise("high")


def stressed(rows: DataFrame, scenarios: Sequence[dict]) -> DataFrame:
    """Each signal under each cost scenario: the costs, the fill and the stressed pnl, with three regimes.

    rows has identity (text), side, velocity, acceleration, age, spread, ask_size, bid_size, external_move and base_pnl;
    numbers that are missing count as 0. Scenarios have scenario, delay, age_multiplier, spread_multiplier, cost,
    miss_rate, order_size and max_fill. A signal is missed if its identity's hash falls under the miss rate.
    """
    out = with_scenarios(rows, scenarios)
    x = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    sign = F.when(F.col("side") == "YES", 1.0).otherwise(-1.0)
    delay = F.col("delay")
    size = F.when(F.col("side") == "YES", x("ask_size")).otherwise(x("bid_size"))
    liquid = F.when(F.col("order_size") <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(size, F.nullif(F.col("order_size"), F.lit(0.0)))))
    out = out.withColumns(
        {
            "delay_cost": F.greatest(F.lit(0.0), sign * (x("velocity") * delay + 0.5 * x("acceleration") * delay * delay)),
            "age_cost": F.abs(x("velocity")) * F.least(x("age"), F.lit(10.0)) * F.col("age_multiplier"),
            "spread_cost": x("spread") * F.col("spread_multiplier"),
            "missed": hash_uniform("identity") < F.col("miss_rate"),
            "_liquid": liquid,
            "external_regime": low_medium_high(F.abs(x("external_move")), 0.001, 0.002),
            "spread_regime": low_medium_high(x("spread"), 0.01, 0.03),
            "age_regime": low_medium_high(x("age"), 2.0, 5.0),
        }
    )
    fill = F.when(F.col("missed"), 0.0).otherwise(F.least("max_fill", "_liquid"))
    unit = x("base_pnl") - F.col("spread_cost") - F.col("delay_cost") - F.col("age_cost") - F.col("cost")
    return out.withColumns({"fill": fill, "stressed_pnl": fill * unit}).drop("_liquid")


def scenario_summary(rows: DataFrame, groups: Sequence[str] = ("session", "asset")) -> DataFrame:
    """scenario, attempted, executed, missed, fill, win rate, expectancy with its interval, pnl, positive sessions, shares.

    top_share is that of the ten greatest results, which are drawn from each scenario's ten greatest of every task.
    """
    p = F.col("stressed_pnl")
    done = F.col("fill") > 0
    out = rows.groupBy("scenario").agg(
        F.count("*").alias("attempted"),
        F.count(F.when(done, 1)).alias("executed"),
        F.count(F.when(~done, 1)).alias("missed"),
        F.avg("fill").alias("mean_fill"),
        F.coalesce(F.try_divide(F.count(F.when(done & (p > 0), 1)), F.count(F.when(done, 1))), F.lit(0.0)).alias("win_rate"),
        F.avg(p).alias("expectancy"),
        F.sum(p).alias("pnl"),
        F.stddev_samp(p).alias("_d"),
    )
    half = F.when(F.col("attempted") < 2, 0.0).otherwise(1.96 * F.col("_d") / F.sqrt("attempted"))
    out = out.withColumns({"low": F.col("expectancy") - half, "high": F.col("expectancy") + half}).drop("_d")
    for group in groups:
        each = rows.groupBy("scenario", group).agg(F.sum(p).alias("p"), F.avg(p).alias("e")).groupBy("scenario").agg(F.count(F.when(F.col("e") > 0, 1)).alias(f"positive_{group}s"), F.max("p").alias("_best"))
        out = out.join(each, "scenario").withColumn(f"largest_{group}_share", F.when(F.col("pnl") > 0, F.col("_best") / F.col("pnl"))).drop("_best")
    best = rows.filter(p > 0).select("scenario", "stressed_pnl").withColumn("_n", F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc("stressed_pnl")))).filter("_n <= 10")
    top = best.groupBy("scenario").agg(F.sum("stressed_pnl").alias("_top"))
    out = out.join(top, "scenario", "left")
    return out.withColumn("top_share", F.when(F.col("pnl") > 0, F.coalesce("_top", F.lit(0.0)) / F.col("pnl"))).drop("_top")


def segment_stability(rows: DataFrame, dimensions: Sequence[str] = ("session", "asset", "side", "external_regime", "spread_regime", "age_regime")) -> DataFrame:
    """scenario, dimension, segment, n, pnl, expectancy: the scenarios by each dimension, in one pass."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment")) for d in dimensions])
    return rows.withColumn("_d", F.explode(pairs)).groupBy("scenario", "_d.dimension", "_d.segment").agg(F.count("*").alias("n"), F.sum("stressed_pnl").alias("pnl"), F.avg("stressed_pnl").alias("expectancy"))


def replayed(signals: DataFrame, quotes: DataFrame, scenarios: Sequence[dict]) -> DataFrame:
    """signal, scenario, missed, fill, pnl on the quotes that came: entry at the first one after the delay, exit at 0.03 or 180 s.

    Scenarios have scenario, delay, order_size and cost. The exit is the first later quote whose move from the entry
    reaches 0.03 either way, else the last one within 180 s of the time of entry (the delayed one, not the quote's), else
    the entry itself. Fills are bounded by the sizes at entry and exit.
    """
    rows = with_scenarios(signals, scenarios).withColumn("due", F.col("t") + (F.col("delay") * 1_000_000).cast("long"))
    longest = int((max(s["delay"] for s in scenarios) + LONGEST) * 1_000_000)
    path = quotes.select("market", F.col("t").alias("at"), "bid", "ask", "bid_size", "ask_size")
    # A quote at the very time of a signal counts, hence the microsecond.
    met = future(rows.withColumn("_t", F.col("t") - 1), path, "market", "_t", longest + 1, "at", "p_").filter(F.col("p_at") >= F.col("due"))
    both = [executable(F.col("side"), F.col("p_bid"), F.col("p_ask"), F.col("p_bid_size"), F.col("p_ask_size"), e) for e in (True, False)]
    step = F.struct(F.col("p_at").alias("at"), both[0].alias("enter"), both[1].alias("leave"))
    ids = ["signal", "scenario", "delay", "order_size", "cost", "due", "market", "side"]
    entries = met.groupBy(*ids).agg(F.min(step).alias("first"))
    later = met.select("signal", "scenario", step.alias("step")).join(entries, ["signal", "scenario"])
    deadline = F.col("due") + int(LONGEST * 1_000_000)
    later = later.filter((F.col("step.at") > F.col("first.at")) & (F.col("step.at") <= deadline))
    move = F.col("step.leave.price") - F.col("first.enter.price")
    exits = later.groupBy("signal", "scenario").agg(F.min(F.when(F.abs(move) >= MOVE - 1e-12, F.col("step"))).alias("hit"), F.max("step").alias("last"))
    out = rows.select("signal", "scenario", "order_size", "cost").join(entries.select("signal", "scenario", "first"), ["signal", "scenario"], "left").join(exits, ["signal", "scenario"], "left")
    exit_ = F.coalesce("hit", "last")
    price, size = F.coalesce(exit_["leave"]["price"], F.col("first.enter.price")), F.coalesce(exit_["leave"]["size"], F.col("first.enter.size"))
    part = lambda s: F.when(F.col("order_size") > 0, F.least(F.lit(1.0), F.try_divide(s, F.nullif(F.col("order_size"), F.lit(0.0))))).otherwise(1.0)
    fill = F.when(F.col("first").isNull(), 0.0).otherwise(F.least(part(F.col("first.enter.size")), part(size)))
    pnl = F.when(F.col("first").isNull(), 0.0).otherwise(fill * (price - F.col("first.enter.price") - F.col("cost")))
    return out.select("signal", "scenario", F.col("first").isNull().alias("missed"), fill.alias("fill"), pnl.alias("pnl"))
