"""Short-market experiments: edges of a model over the market's price, what trading them costs, snapshots before the end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import drawdowns
from .stats import with_scenarios

DEAREST = 0.99
# Fixed add-ons of an execution price: points, and a share of the probability.
COSTS = {"base": (0.01, 0.05), "stress": (0.02, 0.10), "ultra": (0.03, 0.15)}
#: Seconds before the end at which markets are looked at, and how far off a row may be.
SNAPSHOTS, TOLERANCE = (240, 180, 120, 60), 45


def execution_price(p: Column, mode: str, edge: Column | None = None) -> Column:
    """What a contract of probability p costs: base, stress, ultra, or consume_<share of the edge>; any other mode adds nothing."""
    if mode.startswith("consume_"):
        return F.least(F.lit(DEAREST), p + float(mode.split("_")[1]) * edge)
    if mode not in COSTS:
        return p
    points, share = COSTS[mode]
    return F.least(F.lit(DEAREST), p + points + share * p)


def edge_side(model: Column, market: Column, threshold: Column) -> Column:
    """UP or DOWN where the model differs from the market by the threshold, else NULL."""
    return F.when(model - market >= threshold, "UP").when(market - model >= threshold, "DOWN")


def edge_trades(rows: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """A row for each row and threshold with an edge: side, contract price, win, and pnl gross and at each of COSTS.

    rows has model, market (probabilities of up) and outcome (1 for up).
    """
    out = with_scenarios(rows, [{"threshold": float(t)} for t in thresholds])
    out = out.withColumn("side", edge_side(F.col("model"), F.col("market"), F.col("threshold"))).filter("side is not null")
    up = F.col("side") == "UP"
    out = out.withColumns({"contract": F.when(up, F.col("market")).otherwise(1 - F.col("market")), "win": F.when(up, F.col("outcome") == 1).otherwise(F.col("outcome") == 0)})
    paid = F.col("win").cast("double")
    return out.withColumns({"gross_pnl": paid - F.col("contract"), **{f"{m}_pnl": paid - execution_price(F.col("contract"), m) for m in COSTS}})


def ask_trades(rows: DataFrame, threshold: float) -> DataFrame:
    """rows with an edge at their captured asks: side, ask, skipped (no ask between 0 and 1), win, pnl."""
    out = rows.withColumn("side", edge_side(F.col("model"), F.col("market"), F.lit(threshold))).filter("side is not null")
    ask = F.when(F.col("side") == "UP", F.col("ask_yes")).otherwise(F.col("ask_no"))
    out = out.withColumns({"ask": ask, "skipped": ~F.coalesce((ask > 0) & (ask < 1), F.lit(False))})
    win = F.when(F.col("side") == "UP", F.col("outcome") == 1).otherwise(F.col("outcome") == 0)
    return out.withColumns({"win": F.when(~F.col("skipped"), win), "pnl": F.when(~F.col("skipped"), win.cast("double") - F.col("ask"))})


def trading_summary(trades: DataFrame, by: Sequence[str], cost: str, pnl: str, order: Sequence[str]) -> DataFrame:
    """by, n, wins, win_rate, cost, pnl, roi, drawdown (negative), up and down trades."""
    n = lambda c: F.count(F.when(c, 1))
    out = trades.groupBy(*by).agg(F.count("*").alias("n"), n(F.col("win")).alias("wins"), F.sum(cost).alias("cost"), F.sum(pnl).alias("pnl"), n(F.col("side") == "UP").alias("up"), n(F.col("side") == "DOWN").alias("down"))
    deep = drawdowns(trades.withColumn("_cell", F.struct(*by)), "_cell", list(order), pnl).select("_cell.*", F.least(F.lit(0.0), -F.col("drawdown_absolute")).alias("max_drawdown"))
    return out.join(deep, list(by)).withColumns({"win_rate": F.try_divide("wins", "n"), "roi": F.try_divide("pnl", F.nullif(F.col("cost"), F.lit(0.0)))})


def snapshot_rows(rows: DataFrame, market: str, left: str, tie: str, targets: Sequence[int] = SNAPSHOTS, tolerance: int = TOLERANCE) -> DataFrame:
    """The row of each market nearest to each target of seconds left, within the tolerance; ties to the lesser `tie`."""
    away = lambda t: F.abs(F.col(left) - t)
    near = F.array_compact(F.array(*[F.when(away(t) <= tolerance, F.struct(F.lit(t).alias("target"), away(t).alias("away"))) for t in targets]))
    out = rows.withColumn("_t", F.explode(near))
    rest = [c for c in rows.columns if c != market]
    return out.groupBy(market, F.col("_t.target").alias("target")).agg(F.min_by(F.struct(*rest), F.struct("_t.away", tie)).alias("_r")).select(market, "target", "_r.*")


def snapshot_before(points: DataFrame, markets: DataFrame, market: str, at: str, value: str, end: str, before: int) -> DataFrame:
    """market, at, value: the last point at or before `before` seconds of the market's end, else the one nearest to that time.

    Of points of one time the last is the one of the greatest value, the nearest that of the least.
    """
    rows = points.join(markets.select(market, (F.col(end) - before).alias("_target")), market)
    early = F.max(F.when(F.col(at) <= F.col("_target"), F.struct(at, value)))
    nearest = F.min_by(F.struct(at, value), F.struct(F.abs(F.col(at) - F.col("_target")), at, value))
    return rows.groupBy(market).agg(F.coalesce(early, nearest).alias("r")).select(market, f"r.{at}", f"r.{value}")


def snapshots_before(points: DataFrame, markets: DataFrame, market: str, at: str, value: str, end: str, horizons: dict[str, int]) -> DataFrame:
    """dataset, market, at, value: `snapshot_before` for each named horizon (seconds before the end), in one pass over the points."""
    targets = F.explode(F.array(*[F.struct(F.lit(n).alias("dataset"), (F.col(end) - s).alias("target")) for n, s in horizons.items()]))
    rows = points.join(markets.select(market, targets.alias("_h")), market)
    early = F.max(F.when(F.col(at) <= F.col("_h.target"), F.struct(at, value)))
    nearest = F.min_by(F.struct(at, value), F.struct(F.abs(F.col(at) - F.col("_h.target")), at, value))
    return rows.groupBy(F.col("_h.dataset").alias("dataset"), market).agg(F.coalesce(early, nearest).alias("r")).select("dataset", market, f"r.{at}", f"r.{value}")


def minute_close(closes: DataFrame, asked: DataFrame, key: str, minute: str, value: str, at: str, back: int = 10, name: str = "close") -> DataFrame:
    """asked with the close of its minute, or of the latest of the nine minutes before that has one.

    Minutes are numbers (seconds over 60); a close is dealt to the minutes that it may serve, so the join is an equi-join.
    """
    served = closes.select(key, F.col(value).alias("_v"), F.col(minute).alias("_m"), F.explode(F.sequence(F.col(minute), F.col(minute) + back - 1)).alias("_minute"))
    latest = served.groupBy(key, "_minute").agg(F.max_by("_v", "_m").alias(name))
    return asked.withColumn("_minute", F.floor(F.col(at) / 60)).join(latest, [key, "_minute"], "left").drop("_minute")


def minute_return(closes: DataFrame, asked: DataFrame, key: str, minute: str, value: str, at: str, minutes: int, name: str = "minute_return") -> DataFrame:
    """asked with the close at its time over that `minutes` earlier, less one; NULL without both, or if the earlier one is 0."""
    now = minute_close(closes, asked, key, minute, value, at, name="_now")
    then = minute_close(closes, now.withColumn("_then_at", F.col(at) - 60 * minutes), key, minute, value, "_then_at", name="_then")
    return then.withColumn(name, F.try_divide("_now", F.nullif(F.col("_then"), F.lit(0.0))) - 1).drop("_now", "_then", "_then_at")


def close_features(closes: Column) -> Column:
    """price, returns over 1, 5 and 15 steps, and the population deviation of the last 14 simple returns, of an array of closes."""
    n = F.size(closes)
    at = lambda k: F.try_element_at(closes, n - k)
    price = at(0)
    back = lambda k: F.when(n > k, F.try_divide(price, F.nullif(at(k), F.lit(0.0))) - 1)
    steps = F.transform(F.sequence(F.greatest(F.lit(2), n - 13), n), lambda i: F.try_divide(F.element_at(closes, i), F.element_at(closes, i - 1)) - 1)
    mean = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.size(steps)
    variance = F.aggregate(steps, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(steps)
    return F.struct(price.alias("price"), back(1).alias("return_1"), back(5).alias("return_5"), back(15).alias("return_15"), F.when(n >= 2, F.sqrt(variance)).alias("volatility"))


def winner_by_flag(closed: Column, tokens: Column, ids: Column, names: Column) -> Column:
    """1 if the token flagged as winner is that of Up, 0 if Down; NULL if the market isn't closed or no such token wins.

    tokens is an array of (token_id, winner) structs; ids and names are the market's own tokens and outcomes.
    """
    won = F.transform(F.filter(tokens, lambda t: F.coalesce(t["winner"], F.lit(False))), lambda t: t["token_id"])
    name = F.try_element_at(F.filter(F.arrays_zip(ids.alias("id"), names.alias("name")), lambda z: F.array_contains(won, z["id"])), F.lit(1))["name"]
    return F.when(closed & (name == "Up"), 1).when(closed & (name == "Down"), 0)


def filled_outcomes(rows: DataFrame, cache: DataFrame, market: str, outcome: str) -> DataFrame:
    """rows whose missing outcomes are those of the cache (one row a market), with `resolved` telling whether there is one."""
    out = rows.join(cache.select(market, F.col(outcome).alias("_cached")), market, "left")
    return out.withColumn(outcome, F.coalesce(outcome, "_cached")).drop("_cached").withColumn("resolved", F.col(outcome).isNotNull())


# Markets as they are discovered


def parsed_market(slug: Column, question: Column, start: Column, end: Column, outcomes: Column, tokens: Column, active: Column, closed: Column, asset: Column) -> Column:
    """reason (blank if the market is taken), start and end (seconds), yes and no token, as a struct.

    The window is that of a five-minute slug, else the given one, which must last 240 to 360 s. outcomes and tokens are
    JSON arrays in text. asset is NULL where it isn't known or is ambiguous. The first reason in order counts.
    """
    text = F.concat_ws(" ", F.coalesce(question, F.lit("")), F.coalesce(slug, F.lit("")))
    epoch = F.nullif(F.regexp_extract(slug, r"updown-5m-(\d+)", 1), F.lit("")).try_cast("long")
    a, z = F.coalesce(epoch, start), F.coalesce(epoch + 300, end)
    names, ids = (F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")) for c in (outcomes, tokens))
    pairs = F.transform(F.arrays_zip(names.alias("name"), ids.alias("id")), lambda p: F.struct(F.lower(F.trim(p["name"])).alias("name"), p["id"].alias("id")))
    named = lambda name: F.try_element_at(F.filter(pairs, lambda p: p["name"] == F.lit(name)), F.lit(1))["id"]
    yes, no = F.coalesce(named("up"), named("yes")), F.coalesce(named("down"), named("no"))
    long = F.concat(F.lit("not_five_minute_window:"), F.format_string("%.0f", (z - a).cast("double")), F.lit("s"))
    reason = (
        F.when(asset.isNull(), "unsupported_or_ambiguous_asset").when(a.isNull() | z.isNull(), "missing_window").when(~(z - a).between(240, 360), long).when(~F.lower(text).rlike(r"\b(up|down|higher|lower)\b|updown-5m"), "not_up_down_market")
        .when((F.size(names) != 2) | (F.size(ids) != 2), "missing_binary_token_mapping").when(yes.isNull() | no.isNull(), "unrecognized_outcomes").when(~F.coalesce(active, F.lit(False)) | F.coalesce(closed, F.lit(False)), "inactive_or_closed").otherwise("")
    )
    return F.struct(reason.alias("reason"), a.alias("start"), z.alias("end"), yes.alias("yes_token"), no.alias("no_token"))


def rotation_state(now: Column, start: Column, end: Column, skipped: Column, near: float = 30.0) -> Column:
    """DISCOVERED, ACTIVE, NEAR_EXPIRY or CLOSED; a market once skipped stays SKIPPED."""
    return F.when(F.coalesce(skipped, F.lit(False)), "SKIPPED").when(now >= end, "CLOSED").when(now < start, "DISCOVERED").when(end - now <= near, "NEAR_EXPIRY").otherwise("ACTIVE")


def book_ticks(events: DataFrame, key: str = "asset_id") -> DataFrame:
    """event, key, t, kind, bid, ask, trade, size: ticks of polymorphic book events, with the book carried along.

    events has event (an order within equal times), t, kind and payload, an event of any kind in JSON. A book gives its best prices; best_bid_ask its own; each
    price_change its own if 0 <= bid < ask <= 1; a trade the book so far, and no tick before there is one.
    """
    level = "array<struct<price:double,size:double>>"
    payload = F.from_json("payload", f"struct<asset_id:string,bids:{level},asks:{level},best_bid:double,best_ask:double,price:double,size:double,price_changes:array<struct<asset_id:string,best_bid:double,best_ask:double>>>")
    rows = events.withColumn("_p", payload)
    prices = lambda c, f: f(F.transform(F.col(c), lambda x: x["price"]))
    single = F.struct(F.col("_p.asset_id").alias(key), F.when(F.col("kind") == "book", prices("_p.bids", F.array_max)).when(F.col("kind") == "best_bid_ask", F.col("_p.best_bid")).alias("bid"), F.when(F.col("kind") == "book", prices("_p.asks", F.array_min)).when(F.col("kind") == "best_bid_ask", F.col("_p.best_ask")).alias("ask"))
    changes = F.transform(F.coalesce("_p.price_changes", F.array().cast("array<struct<asset_id:string,best_bid:double,best_ask:double>>")), lambda c: F.struct(c["asset_id"].alias(key), c["best_bid"].alias("bid"), c["best_ask"].alias("ask")))
    sound = F.filter(changes, lambda c: (c["bid"] >= 0) & (c["bid"] < c["ask"]) & (c["ask"] <= 1))
    rows = rows.select("event", "t", "kind", F.col("_p.price").alias("price"), F.coalesce("_p.size", F.lit(0.0)).alias("traded"), F.posexplode(F.when(F.col("kind") == "price_change", sound).otherwise(F.array(single))).alias("place", "x"))
    rows = rows.select("event", "t", "kind", "place", "price", "traded", "x.*")
    w = Window.partitionBy(key).orderBy("t", "event", "place").rowsBetween(Window.unboundedPreceding, 0)
    book = F.last(F.when(F.col("bid").isNotNull() & F.col("ask").isNotNull(), F.struct("bid", "ask")), ignorenulls=True).over(w)
    trade = F.col("kind") == "last_trade_price"
    out = rows.withColumn("_book", book).filter(F.when(trade, F.col("_book").isNotNull()).otherwise(F.col("bid").isNotNull() & F.col("ask").isNotNull()))
    return out.select("event", key, "t", "kind", F.col("_book.bid").alias("bid"), F.col("_book.ask").alias("ask"), F.when(trade, F.col("price")).alias("trade"), F.when(trade, F.col("traded")).alias("size"))
