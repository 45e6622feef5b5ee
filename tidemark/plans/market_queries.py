"""Queries over `events` as quotes of markets and over lines of orders as public trades, with their SQL.

user_id is the market; times are drawn together by 10,000, so that a market has a quote every few seconds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import behaviour as B
from ..operators import outcomes as O
from ..operators import replay as R
from ..operators import specialist as S
from ..operators import structural as Q
from ..operators import trades as D
from .tables import table
from .time_queries import _r

HOURS = 12.0


def quotes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", X.micros("ts").alias("m"))
    cents = F.pmod(F.floor("value").cast("long"), F.lit(90)).cast("double")
    n = F.col("event_id")
    return e.select(
        n.alias("quote"),
        (F.col("user_id") % 4).alias("session"),
        F.col("user_id").alias("market"),
        F.element_at(F.array(*map(F.lit, ("BTC", "ETH", "SOL"))), (F.col("user_id") % 3 + 1).cast("int")).alias("asset"),
        F.floor(F.col("m") / 10_000).alias("t"),
        (F.floor(F.col("m") / 10_000) - (n % 8) * 1_000_000).alias("quote_t"),
        (cents / 100).alias("bid"),
        F.when(n % 41 > 0, (cents + n % 7 - 1) / 100).alias("ask"),
        (n % 300).cast("double").alias("bid_size"),
        (n * 7 % 400).cast("double").alias("ask_size"),
        (n * 13 % 150).cast("double").alias("seconds_to_expiry"),
    )


QUOTES = """q0 AS (SELECT event_id AS quote, user_id % 4 AS session, user_id AS market, (['BTC', 'ETH', 'SOL'])[user_id % 3 + 1] AS asset, epoch_us(ts) // 10000 AS t, event_id % 8 AS age, floor(value)::BIGINT % 90 AS c, event_id AS n FROM events),
qs AS (SELECT *, c::DOUBLE / 100 AS bid, CASE WHEN n % 41 > 0 THEN (c + n % 7 - 1)::DOUBLE / 100 END AS ask, (n % 300)::DOUBLE AS bid_size, (n * 7 % 400)::DOUBLE AS ask_size, (n * 13 % 150)::DOUBLE AS seconds_to_expiry FROM q0),
st0 AS (SELECT *, coalesce(bid BETWEEN 0 AND 1 AND ask BETWEEN 0 AND 1 AND bid_size > 0 AND ask_size > 0, false) AS valid, age > 5 AS stale FROM qs),
st AS (SELECT *, CASE WHEN valid THEN ask - bid END AS spread, valid AND bid > ask AS crossed, valid AND bid = ask AS locked, valid AND ask - bid > 0.03 AS wide, valid AND seconds_to_expiry BETWEEN 0 AND 30 AS near_expiry, CASE WHEN valid THEN least(bid_size, ask_size, 125.0) ELSE 0 END AS capacity, CASE WHEN valid THEN bid - ask - 0.01 END AS margin FROM st0),
ek AS (SELECT 'crossed' AS kind, st.*, valid AND NOT stale AND crossed AS h FROM st UNION ALL SELECT 'locked', st.*, valid AND NOT stale AND locked FROM st UNION ALL SELECT 'wide', st.*, valid AND NOT stale AND wide FROM st),
ep0 AS (SELECT *, h AND NOT coalesce(lag(h) OVER w AND t - lag(t) OVER w <= 5000000, false) AS o FROM ek WINDOW w AS (PARTITION BY kind, session, market ORDER BY t)),
ep1 AS (SELECT *, sum(o::INTEGER) OVER (PARTITION BY kind, session, market ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM ep0),
ep AS (SELECT kind, session, market, g, min(asset) AS asset, min(t) AS start, max(t) AS "end", count(*) AS states, max(capacity) AS capacity, max(margin) AS margin, (max(t) - min(t)) / 1e6 AS seconds FROM ep1 WHERE h GROUP BY 1, 2, 3, 4)"""


def _states(spark, sf_dir):
    return Q.quote_states(quotes(spark, sf_dir))


def quote_states(spark, sf_dir):
    return _states(spark, sf_dir).select("quote", "valid", "stale", "crossed", "locked", "wide", "near_expiry", *_r("spread", "capacity", "margin"))


def state_episodes(spark, sf_dir):
    return Q.state_episodes(_states(spark, sf_dir)).select("kind", "session", "market", "asset", "start", "end", "states", "persists_2", "persists_5", *_r("capacity", "margin", "seconds"))


def structural_candidates(spark, sf_dir):
    s = _states(spark, sf_dir)
    return Q.structural_candidates(s, Q.state_episodes(s), HOURS).select("rank", "candidate", "states", "markets", "assets", "episodes", "persist_2", "persist_5", *_r("best_margin", "mean_margin", "capacity", "median_seconds", "states_per_hour", "episodes_per_hour"))


def _attempts(spark, sf_dir):
    s = _states(spark, sf_dir)
    starts = Q.state_episodes(s).filter("kind = 'wide'").select("session", "market", "first.*")
    return Q.passive_attempts(starts, Q.histories(s))


def passive_attempts(spark, sf_dir):
    return _attempts(spark, sf_dir).select("session", "market", "asset", "t", "policy", *_r("bid_shares", "ask_shares", "matched", "long", "short", "spread_pnl", "long_pnl", "short_pnl", "pnl"))


def passive_policies(spark, sf_dir):
    attempts = _attempts(spark, sf_dir)
    # The interval of the mean by markets.
    each = attempts.groupBy("policy", "market").agg(F.avg("pnl").alias("m"))
    low = each.groupBy("policy").agg((F.avg("m") - 1.96 * F.coalesce(F.stddev_samp("m"), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("low"))
    p = Q.passive_summary(attempts, HOURS, low)
    return p.select("policy", "attempts", "any_fill", "two_sided", "one_sided", "assets", "positive_assets", "sessions", "positive_sessions", "passes", *_r("cluster_low", "max_drawdown", "attempts_per_hour", "filled", "capacity_per_hour", "pnl", "expectancy", "win_rate", "one_sided_share", "two_sided_probability", "pnl_per_share", "largest_asset_share", "largest_session_share"))


def _signals(spark, sf_dir):
    q = quotes(spark, sf_dir)
    return q.filter("ask - bid >= 0.035").select(F.col("quote").alias("signal"), "market", "session", "asset", F.when(F.col("quote") % 2 == 0, "YES").otherwise("NO").alias("side"), (F.col("t") - 500_000).alias("t"), F.col("seconds_to_expiry"))


def _path(spark, sf_dir):
    return quotes(spark, sf_dir).filter("ask is not null").select("market", "t", "bid", "ask", "bid_size", "ask_size")


def slower_horizons(spark, sf_dir):
    r = R.slower_horizons(_signals(spark, sf_dir), _path(spark, sf_dir))
    return r.select("signal", "horizon", "direction", "traded_side", "entry_at", "exit_at", *_r("entry_price", "exit_price", "pnl"))


def horizon_summary(spark, sf_dir):
    s = R.horizon_summary(R.slower_horizons(_signals(spark, sf_dir), _path(spark, sf_dir)))
    return s.select("horizon", "direction", "n", "sessions", "positive_sessions", "assets", "positive_assets", *_r("win_rate", "expectancy", "pnl", "largest_session_share", "largest_asset_share", "max_drawdown"))


SCENARIOS = [
    {"scenario": "base", "delay": 0.0, "age_multiplier": 0.0, "spread_multiplier": 0.0, "cost": 0.0, "miss_rate": 0.0, "order_size": 0.0, "max_fill": 1.0},
    {"scenario": "moderate", "delay": 1.0, "age_multiplier": 0.25, "spread_multiplier": 0.5, "cost": 0.005, "miss_rate": 0.1, "order_size": 100.0, "max_fill": 0.75},
    {"scenario": "severe", "delay": 2.0, "age_multiplier": 0.5, "spread_multiplier": 1.0, "cost": 0.01, "miss_rate": 0.25, "order_size": 250.0, "max_fill": 0.5},
]


def _stressed(spark, sf_dir):
    q = quotes(spark, sf_dir).withColumns({"identity": F.concat_ws("|", "session", "market", "quote"), "side": F.when(F.col("quote") % 2 == 0, "YES").otherwise("NO"), "velocity": (F.col("quote") % 11 - 5) / 500, "acceleration": (F.col("quote") % 5 - 2) / 1000, "age": (F.col("quote") % 13).cast("double"), "spread": F.col("ask") - F.col("bid"), "external_move": (F.col("quote") % 9 - 4) / 1500, "base_pnl": (F.col("quote") % 17 - 6) / 100})
    return R.stressed(q, SCENARIOS)


def stress_scenarios(spark, sf_dir):
    s = R.scenario_summary(_stressed(spark, sf_dir))
    return s.select("scenario", "attempted", "executed", "missed", "positive_sessions", "positive_assets", *_r("mean_fill", "win_rate", "expectancy", "pnl", "low", "high", "largest_session_share", "largest_asset_share", "top_share"))


def segment_stability(spark, sf_dir):
    return R.segment_stability(_stressed(spark, sf_dir)).select("scenario", "dimension", "segment", "n", *_r("pnl", "expectancy"))


REPLAYS = [{"scenario": "now", "delay": 0.0, "order_size": 0.0, "cost": 0.0}, {"scenario": "late", "delay": 2.0, "order_size": 250.0, "cost": 0.005}]


def quote_replay(spark, sf_dir):
    r = R.replayed(_signals(spark, sf_dir), _path(spark, sf_dir), REPLAYS)
    return r.select("signal", "scenario", "missed", *_r("fill", "pnl"))


def random_timing(spark, sf_dir):
    s = _signals(spark, sf_dir).filter("seconds_to_expiry >= 60")
    q = _path(spark, sf_dir)
    # Signals of markets that have a candidate on either side.
    return R.random_timing(s, q, 30, "continuation", 20).select("trial", F.round("expectancy", 9).alias("expectancy"))


# Specialists


def _trades(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    market = F.col("l_partkey") % 400
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.concat(F.lit("0xW"), F.col("o_custkey") % 40).alias("wallet"),
        F.concat(F.lit("C"), market).alias("condition"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.when(F.col("l_linestatus") == "F", "Up").otherwise("Down").alias("outcome"),
        F.element_at(F.array(*map(F.lit, ("BTC", "ETH", "SOL"))), (market % 3 + 1).cast("int")).alias("asset_class"),
        (market % 11 != 0).alias("up_down"),
        (1_700_000_000 + market * 300 + F.col("l_orderkey") % 280).alias("t"),
        (F.col("l_quantity") / 60).alias("price"),
        F.round(F.col("l_extendedprice"), 2).alias("notional"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade"),
    )


def _market_outcomes(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") % 400).alias("m")).distinct()
    n = F.explode(F.sequence(F.lit(0), F.when(F.col("m") % 13 == 0, 1).otherwise(0)))
    rows = parts.select("m", n.alias("k"))
    asset = F.element_at(F.array(*map(F.lit, ("btc", "eth", "sol"))), (F.col("m") % 3 + 1).cast("int"))
    return rows.filter("m % 17 > 0").select(
        F.concat(F.lit("c"), "m").alias("condition"),
        F.when((F.col("m") + F.col("k")) % 2 == 0, "up").otherwise("down").alias("winner"),
        (1_700_000_300 + F.col("m") * 300).alias("expiry"),
        F.concat(asset, F.when(F.col("m") % 19 == 0, "-updown-15m-").otherwise("-updown-5m-"), 1_700_000_000 + F.col("m") * 300).alias("slug"),
        F.upper(asset).alias("asset_class"),
    )


def _specialties(spark):
    return spark.createDataFrame([(f"0xw{i}", a) for i in range(0, 40, 2) for a in ("BTC", "ETH", "SOL")[: 1 + i % 3]], "wallet string, asset_class string")


SPECIAL = """tr AS (SELECT '0xw' || (o_custkey % 40) AS wallet, l_partkey % 400 AS m, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, CASE WHEN l_linestatus = 'F' THEN 'Up' ELSE 'Down' END AS outcome, 1700000000 + l_partkey % 400 * 300 + l_orderkey % 280 AS t, l_quantity / 60 AS price, round(l_extendedprice, 2) AS notional, l_orderkey * 10 + l_linenumber AS trade, o_custkey % 40 AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sm AS (SELECT DISTINCT p_partkey % 400 AS m FROM part),
sx AS (SELECT tr.*, sm.m IS NULL OR tr.m % 17 = 0 OR tr.m % 13 = 0 AS nomarket FROM tr LEFT JOIN sm USING (m) WHERE w % 2 = 0),
se AS (SELECT *, CASE WHEN side <> 'BUY' THEN 'non_buy' WHEN m % 11 = 0 OR m % 3 > w % 3 THEN 'outside_frozen_specialty' WHEN nomarket THEN 'missing_or_conflicting_resolution' WHEN m % 19 = 0 THEN 'non_five_minute_market' END AS x FROM sx),
sf AS (SELECT *, row_number() OVER (PARTITION BY wallet, m ORDER BY t, notional DESC, outcome DESC, trade) AS rn FROM se WHERE x IS NULL),
sg0 AS (SELECT wallet, 'c' || m AS condition, m, t, outcome, price, 1700000300 + m * 300 - t AS raw_window, lower(outcome) = CASE WHEN m % 2 = 0 THEN 'up' ELSE 'down' END AS matched, CASE WHEN m % 2 = 0 THEN 'up' ELSE 'down' END AS winner FROM sf WHERE rn = 1),
sg1 AS (SELECT *, least(0.99, price + 0.05) AS modelled_entry, matched::INTEGER - least(0.99, price + 0.05) AS v FROM sg0 WHERE raw_window - 30 >= 60),
sk AS (SELECT condition, (row_number() OVER (ORDER BY f, condition) - 1) * 3 // count(*) OVER () + 1 AS fold FROM (SELECT condition, min(t) AS f FROM sg1 GROUP BY 1)),
sg AS (SELECT * FROM sg1 JOIN sk USING (condition))"""


def _candidates(spark, sf_dir):
    return S.candidates(_trades(spark, sf_dir), _market_outcomes(spark, sf_dir), _specialties(spark))


def specialist_signals(spark, sf_dir):
    s = S.signals(_candidates(spark, sf_dir))
    return s.select("wallet", "condition", "t", "outcome", "matched", "fold", *_r("raw_window", "modelled_window", "price", "modelled_entry", "conservative_value"))


def specialist_exclusions(spark, sf_dir):
    return S.exclusion_counts(_candidates(spark, sf_dir))


def specialist_wallets(spark, sf_dir):
    w = S.wallet_summary(S.signals(_candidates(spark, sf_dir)))
    return w.select("wallet", "n", "wins", "folds", "positive_folds", "robustness", *_r("win_rate", "win_low", "win_high", "expectancy", "low", "high", "max_drawdown", "stability", "busiest_day_share"))


def specialist_folds(spark, sf_dir):
    return S.signal_metrics(S.signals(_candidates(spark, sf_dir)), ["fold"]).select("fold", "n", "wins", "first", "last", "markets", *_r("win_rate", "expectancy", "low", "high", "max_drawdown"))


def specialist_consensus(spark, sf_dir):
    weights = _specialties(spark).select("wallet").distinct().withColumn("weight", F.substring("wallet", 4, 9).cast("double") + 10)
    c = S.consensus_rows(S.signals(_candidates(spark, sf_dir)), weights)
    return c.select("condition", "wallets", "status", "equal_side", "equal_matched", "weighted_side", "weighted_matched", *_r("equal_value", "weighted_value"))


def specialist_stress(spark, sf_dir):
    return S.stress(S.signals(_candidates(spark, sf_dir)), [30, 60, 90], [0.0, 0.05, 0.1]).select("delay", "cost", "n", *_r("expectancy"))


# Trade pages


def _pages(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    # Lines of one number stay as they stand in the table, as where the first of duplicates is kept they may differ in the rest.
    # What is shuffled is a line's own columns; the texts of a page are made of them after that.
    stood = F.struct("l_linenumber", F.col("_metadata.file_name"), F.col("_metadata.row_index"), "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_returnflag", "l_linestatus")
    page = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(stood)).alias("rows"))

    def row(line):
        return F.struct(
            F.when(line["l_partkey"] % 5 == 0, "Rain in Rome").otherwise("Bitcoin Up or Down").alias("title"),
            F.when(line["l_partkey"] % 5 == 1, F.lit("sol-updown-5m-1")).when(line["l_partkey"] % 5 == 2, "eth-close-up").otherwise("x").alias("slug"),
            F.when(line["l_linenumber"] > 1, "event").alias("eventSlug"),
            F.when(line["l_linestatus"] == "F", "trade").otherwise("redeem").alias("type"),
            (F.col("l_orderkey") + 1_700_000_000).alias("timestamp"),
            F.concat(F.lit("T"), line["l_partkey"] % 50).alias("asset"),
            F.concat(F.lit("0xC"), line["l_partkey"] % 50).alias("conditionId"),
            F.when(line["l_returnflag"] == "R", "sell").otherwise("buy").alias("side"),
            F.format_string("%.2f", line["l_tax"] + 0.1).alias("price"),
            F.format_string("%.1f", line["l_quantity"]).alias("size"),
            F.when(line["l_linenumber"] == 2, "7.50").alias("usdcSize"),
            F.concat(F.lit("0xH"), line["l_suppkey"] % 3).alias("transactionHash"),
            F.lit("Up").alias("outcome"),
        )

    return page.select(F.to_json(F.struct(F.concat(F.lit("0xW"), F.col("l_orderkey") % 10).alias("wallet_id"), F.lit("2024").alias("fetched_at"), F.lit("url").alias("url"), F.struct(F.transform("rows", row).alias("value")).alias("payload"))).alias("value"))


PAGES = """pg AS (SELECT '0xw' || (l_orderkey % 10) AS wallet_id, l_orderkey + 1700000000 AS ts, l_linenumber AS place, CASE WHEN l_partkey % 5 = 0 THEN 'weather' WHEN l_partkey % 5 = 2 THEN 'fast_crypto_up_down' ELSE 'fast_crypto_up_down' END AS market_type, CASE WHEN l_partkey % 5 = 0 THEN 'other' ELSE 'BTC' END AS asset_class,
 CASE WHEN l_linestatus = 'F' THEN 'TRADE' ELSE 'REDEEM' END AS activity_type, 'T' || (l_partkey % 50) AS token_id, '0xc' || (l_partkey % 50) AS condition_id, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, round(l_tax + 0.1, 2) AS price, l_quantity AS size, CASE WHEN l_linenumber = 2 THEN 7.5 ELSE round(l_tax + 0.1, 2) * l_quantity END AS notional, l_linenumber = 2 AS own,
 '0xh' || (l_suppkey % 3) AS tx FROM lineitem),
pn AS (SELECT *, CASE WHEN activity_type = 'REDEEM' THEN 'resolution_candidate' WHEN side = 'BUY' THEN 'entry_candidate' ELSE 'exit_candidate' END AS kind, coalesce(nullif(concat_ws(';', CASE WHEN place = 1 THEN 'missing_event_slug' END, CASE WHEN NOT own THEN 'computed_notional' END), ''), 'none') AS quality FROM pg),
pd AS (SELECT *, row_number() OVER (PARTITION BY wallet_id, tx, condition_id, token_id, ts, side, price, size ORDER BY place) AS k FROM pn)"""


def trade_pages(spark, sf_dir):
    kinds = ("wallet_id", "market_type", "asset_class", "activity_type", "side", "entry_or_exit", "quality", "notional_source")
    t = D.normalised(_pages(spark, sf_dir)).select(*kinds, "notional", "dedupe_key", "source_fetch_timestamp", "place")
    t = D.deduplicated(t, ("source_fetch_timestamp", "place"))
    return t.groupBy(*kinds).agg(F.count("*").alias("n"), F.round(F.sum("notional").cast("double"), 4).alias("notional"))


def ingestion_gates(spark, sf_dir):
    t = D.normalised(_pages(spark, sf_dir)).select(*D.GATED)
    unique = D.deduplicated(t, ("source_fetch_timestamp", "place"))
    return D.ingestion_gates(unique, 0).select("gate", *_r("value"), "passed")


def trade_summary(spark, sf_dir):
    return D.trade_summary(D.normalised(_pages(spark, sf_dir))).select("dimension", "value", "n", F.round("notional", 4).alias("notional"))


def limit_violations(spark, sf_dir):
    return D.limit_violations(_pages(spark, sf_dir), limits={"wallets": 6, "rows_each": 300, "pages_each": 160, "rows": 1800})


# Behaviour


def _visible(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        (F.col("o_custkey") % 60).alias("wallet"),
        F.when(k % 5 == 0, "weather").when(F.col("o_custkey") % 3 == 0, "fast_crypto").when(k % 2 == 0, "fast_crypto").otherwise("other").alias("market_type"),
        F.element_at(F.array(*map(F.lit, ("BTC", "ETH", "SOL", "OTHER"))), (k % 4 + 1).cast("int")).alias("exposure"),
        F.element_at(F.array(*map(F.lit, ("Yes", "down", "maybe", " UP "))), (F.floor(k / 4) % 4 + 1).cast("int")).alias("outcome"),
        F.when(k % 9 > 0, (k % 100) / 100).alias("avg_price"),
        B.position_size(F.when(k % 7 == 0, 0.0).otherwise(F.round(F.col("o_totalprice") / 100, 2)), F.lit(0.0), F.lit(5.0)).alias("size"),
        F.when(F.col("o_orderstatus") == "F", "closed").otherwise("active").alias("status"),
        ((k % 3) / 2).alias("cur_price"),
        F.when(k % 2 == 0, "btc-updown-5m-1").otherwise("x-15m").alias("slug"),
        F.lit("t").alias("title"),
        F.when(k % 1000 == 1, "list TRUNCATED").alias("notes"),
    )


VISIBLE = """vo AS (SELECT o_custkey % 60 AS wallet, o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'weather' WHEN o_custkey % 3 = 0 OR o_orderkey % 2 = 0 THEN 'fast_crypto' ELSE 'other' END AS market_type, (['BTC', 'ETH', 'SOL', 'OTHER'])[o_orderkey % 4 + 1] AS exposure, (['YES', 'NO', 'OTHER', 'YES'])[o_orderkey // 4 % 4 + 1] AS side, CASE WHEN o_orderkey % 9 > 0 THEN (o_orderkey % 100) / 100 END AS p,
 CASE WHEN o_orderkey % 7 = 0 THEN 5.0 ELSE round(o_totalprice / 100, 2) END AS size, o_orderstatus = 'F' AS closed, o_orderkey % 3 / 2 AS cur FROM orders),
bh0 AS (SELECT wallet, count(*) AS positions, count(*) FILTER (market_type = 'fast_crypto') AS fast, count(*) FILTER (market_type = 'weather') AS weather, count(*) FILTER (exposure = 'OTHER') AS non_crypto, count(*) FILTER (market_type = 'fast_crypto') / count(*) AS fast_share, count(*) FILTER (market_type = 'weather') / count(*) AS weather_share, count(*) FILTER (side = 'YES') AS yes, count(*) FILTER (side = 'NO') AS no,
 count(*) FILTER (p <= 0.20) AS cheap, count(*) FILTER (p <= 0.20) / count(p) AS cheap_share, count(*) FILTER (p >= 0.60) / count(p) AS favourite_share, avg(p) AS mean_entry, quantile_cont(p, 0.5) AS median_entry, count(*) FILTER (p >= 0.1 AND p < 0.2) AS bucket_10_20c, count(*) FILTER (p >= 0.8) AS bucket_80_100c, max(size) AS largest, max(size) / sum(size) AS concentration,
 count(*) FILTER (closed AND cur IN (0, 1)) / nullif(count(*) FILTER (closed), 0) AS resolution_like_share, bool_or(k % 1000 = 1) AS cut FROM vo GROUP BY 1),
bh1 AS (SELECT *, 1 - abs(yes - no) / nullif(yes + no, 0) AS yes_no_balance, CASE WHEN positions < 10 THEN 'inactive_or_insufficient_data' WHEN fast_share >= 0.60 THEN 'fast_crypto_focused' WHEN weather_share >= 0.60 THEN 'weather_focused' ELSE 'mixed' END AS wallet_class, CASE WHEN cut OR positions >= 50 THEN 'partial_truncated_snapshot' ELSE 'partial_public_snapshot' END AS completeness FROM bh0),
bh2 AS (SELECT *, CASE WHEN wallet_class = 'fast_crypto_focused' OR fast_share >= 0.5 THEN 'high' WHEN wallet_class = 'weather_focused' THEN 'medium' ELSE 'medium_high' END AS delay_risk, CASE WHEN largest >= 10000 OR concentration >= 0.5 THEN 'high' WHEN largest >= 1000 THEN 'medium_high' ELSE 'medium' END AS fill_uncertainty FROM bh1),
bh AS (SELECT *, greatest(0, least(60, 10 + CASE WHEN wallet_class = 'fast_crypto_focused' THEN 15 ELSE 0 END + CASE WHEN yes_no_balance >= 0.7 THEN 5 ELSE 0 END + CASE WHEN cheap_share >= 0.2 THEN 5 ELSE 0 END - CASE WHEN completeness = 'partial_truncated_snapshot' THEN 10 ELSE 0 END - CASE WHEN delay_risk = 'high' THEN 10 ELSE 0 END - CASE WHEN fill_uncertainty = 'high' THEN 5 ELSE 0 END)) AS score,
 coalesce(nullif(concat_ws('|', CASE WHEN wallet_class = 'fast_crypto_focused' THEN 'fast_crypto_directional' END, CASE WHEN cheap_share >= 0.2 THEN 'cheap_side_buyer' END, CASE WHEN positions >= 75 AND fast_share >= 0.5 THEN 'high_volume_repeated_pattern' END, CASE WHEN wallet_class = 'weather_focused' THEN 'weather_other' END), ''), 'mixed_or_insufficient') AS clusters FROM bh2)"""

_BEHAVIOUR = ("positions", "fast", "weather", "non_crypto", "yes", "no", "cheap", "bucket_10_20c", "bucket_80_100c", "wallet_class", "completeness", "delay_risk", "fill_uncertainty", "score")
_BEHAVIOUR_RATES = ("fast_share", "cheap_share", "favourite_share", "mean_entry", "median_entry", "concentration", "resolution_like_share", "yes_no_balance")


def wallet_behaviour(spark, sf_dir):
    b = B.behaviour(_visible(spark, sf_dir), notes="notes")
    return b.select("wallet", *_BEHAVIOUR, F.array_join(B.clusters(), "|").alias("clusters"), *_r(*_BEHAVIOUR_RATES))


def similar_wallets(spark, sf_dir):
    b = B.behaviour(_visible(spark, sf_dir), notes="notes").select("wallet", B.feature_vector().alias("v"))
    return B.similar_to(b, b.filter("wallet % 10 = 0"), "wallet", "v", 5).select("asked", "wallet", "place", *_r("similarity"))


def repeated_patterns(spark, sf_dir):
    return B.repeated_patterns(_visible(spark, sf_dir)).select("wallet", "pattern", *_r("share"))


# Outcomes


def outcome_joins(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    c = F.col("o_custkey") % 90
    positions = o.select(k.alias("position"), F.concat(F.lit("0xC"), c).alias("condition_id"), F.concat(F.lit("t"), k % 3).alias("token_id"), F.when(k % 2 == 0, "Up").otherwise(" down").alias("outcome"), O.metadata_key(F.concat(F.lit("0xC"), c), F.lit("s"), F.lit(None).cast("string")).alias("metadata_key"))
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 90).alias("m")).distinct().filter("m % 7 > 0")
    m = F.col("m")
    token = F.array(*[F.struct(F.lit(f"t{i}").alias("token_id"), F.lit(n).alias("outcome")) for i, n in enumerate(("up", "Down"))])
    prices = F.when(m % 5 == 0, '["0.5","0.5"]').when(m % 5 == 1, '["1","0"]').when(m % 5 == 2, '["0.0005","0.9995"]').when(m % 5 == 3, '["x","1"]').otherwise('["1"]')
    market = F.struct(F.when(m % 11 == 0, "0xother").otherwise(F.concat(F.lit("0xc"), m)).alias("condition_id"), (m % 6 > 0).alias("closed"), F.when(m % 4 == 0, "proposed").when(m % 4 == 1, "resolved").alias("status"), (m % 8 == 0).alias("automatic"), F.lit('["Up","Down"]').alias("outcomes"), prices.alias("prices"), F.when(m % 3 > 0, token).alias("tokens"))
    meta = customers.select(O.metadata_key(F.concat(F.lit("0xC"), m), F.lit("s"), F.lit(None).cast("string")).alias("metadata_key"), market.alias("market"))
    return O.outcome_joins(positions, meta).select("position", "lifecycle_status", "confidence", "join_status", "join_reason", "token_status", "winner")


def expiries(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    r = O.resolved_expiry(F.when(k % 4 == 0, "2024-01-01T00:05:00Z"), F.when(k % 3 == 0, F.concat(F.lit("btc-updown-5m-"), 1_700_000_000 + k)).otherwise("other"), F.when(k % 10 == 1, F.timestamp_seconds(F.lit(1_700_000_000))))
    return o.select("o_orderkey", F.unix_seconds(r["expiry"]).alias("expiry"), r["source"].alias("source"), r["confidence"].alias("confidence"))


PASSIVE = f"""{QUOTES}, po(policy, lifetime, only_, regime) AS (VALUES ('all_assets_2s', 2, 'ALL', 's'), ('all_assets_5s', 5, 'ALL', 's'), ('all_assets_15s', 15, 'ALL', 's'), ('all_assets_30s', 30, 'ALL', 's'), ('btc_15s', 15, 'BTC', 's'), ('eth_15s', 15, 'ETH', 's'), ('sol_15s', 15, 'SOL', 's'), ('near_expiry_5s', 5, 'ALL', 'n')),
hs AS (SELECT * FROM st WHERE valid AND NOT stale),
pa AS (SELECT s.session, s.market, s.asset, s.t, policy, s.bid, s.ask, s.bid_size, s.ask_size, s.t + (lifetime + 2) * 1000000 AS dl FROM ep1 s, po WHERE s.kind = 'wide' AND s.h AND s.o AND only_ IN ('ALL', s.asset) AND s.age <= 2 AND CASE WHEN regime = 's' THEN seconds_to_expiry > lifetime + 32 ELSE seconds_to_expiry > lifetime + 2 AND seconds_to_expiry <= 30 END),
pe AS (SELECT pa.*, e.t AS et, e.bid AS eb, e.ask AS ea FROM pa ASOF JOIN hs e ON pa.session = e.session AND pa.market = e.market AND e.t >= pa.dl WHERE e.t - dl <= 5000000),
pf AS (SELECT pe.*, CASE WHEN EXISTS (FROM hs WHERE hs.session = pe.session AND hs.market = pe.market AND hs.t > pe.t AND hs.t <= pe.et AND hs.bid < pe.bid) THEN least(bid_size, 125.0) * 0.375 ELSE 0 END AS bs, CASE WHEN EXISTS (FROM hs WHERE hs.session = pe.session AND hs.market = pe.market AND hs.t > pe.t AND hs.t <= pe.et AND hs.ask > pe.ask) THEN least(ask_size, 125.0) * 0.375 ELSE 0 END AS ks FROM pe),
pp AS (SELECT *, least(bs, ks) * (ask - bid - 0.01) AS sp, (bs - least(bs, ks)) * (eb - bid - 0.005) AS lp, (ks - least(bs, ks)) * (ask - ea - 0.005) AS kp FROM pf), pq AS (SELECT *, sp + lp + kp AS pnl FROM pp)"""

SLOW = f"""{QUOTES}, sg AS (SELECT quote AS signal, market, session, asset, CASE WHEN quote % 2 = 0 THEN 'YES' ELSE 'NO' END AS side, t - 500000 AS t, seconds_to_expiry AS x FROM qs WHERE ask - bid >= 0.035), pt AS (SELECT market, t, bid, ask, bid_size, ask_size FROM qs WHERE ask IS NOT NULL),
gr AS (SELECT sg.*, h, d, t + 2000000 AS en, t + h * 1000000 AS ex, CASE WHEN d = 'continuation' THEN side WHEN side = 'YES' THEN 'NO' ELSE 'YES' END AS ts FROM sg, (VALUES (30), (60), (120), (180)) a(h), (VALUES ('continuation'), ('mean_reversion')) b(d) WHERE x >= h),
g1 AS (SELECT gr.*, e.t AS et, CASE WHEN ts = 'YES' THEN e.ask ELSE 1 - e.bid END AS ep FROM gr ASOF JOIN pt e ON gr.market = e.market AND e.t >= gr.en WHERE e.t - en <= 5000000),
g2 AS (SELECT g1.*, l.t AS lt, CASE WHEN ts = 'YES' THEN l.bid ELSE 1 - l.ask END AS lp FROM g1 ASOF JOIN pt l ON g1.market = l.market AND l.t >= g1.ex WHERE l.t - ex <= 5000000 AND l.t > et),
sr AS (SELECT *, lp - ep - 0.005 AS pnl FROM g2 WHERE ep BETWEEN 0 AND 1 AND lp BETWEEN 0 AND 1)"""

STRESS = f"""{QUOTES}, sc(scenario, delay, am, sm, cost, mr, os, mf) AS (VALUES ('base', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE), ('moderate', 1.0, 0.25, 0.5, 0.005, 0.1, 100.0, 0.75), ('severe', 2.0, 0.5, 1.0, 0.01, 0.25, 250.0, 0.5)),
sv AS (SELECT *, CASE WHEN n % 2 = 0 THEN 1.0 ELSE -1.0 END AS sg, (n % 11 - 5) / 500 AS ve, (n % 5 - 2) / 1000 AS ac, n % 13 AS ag, coalesce(ask - bid, 0) AS sp, abs((n % 9 - 4) / 1500) AS em, (n % 17 - 6) / 100 AS bp, ('0x' || substr(sha256(session || '|' || market || '|' || quote), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u FROM qs, sc),
sw AS (SELECT *, CASE WHEN u < mr THEN 0 ELSE least(mf, CASE WHEN os <= 0 THEN 1.0 ELSE least(1.0, CASE WHEN n % 2 = 0 THEN ask_size ELSE bid_size END / nullif(os, 0)) END) END AS fill, greatest(0.0, sg * (ve * delay + 0.5 * ac * delay * delay)) AS dc, abs(ve) * least(ag, 10.0) * am AS qc FROM sv),
sz AS (SELECT *, fill * (bp - sp * sm - dc - qc - cost) AS p, CASE WHEN em <= 0.001 THEN 'low' WHEN em <= 0.002 THEN 'medium' ELSE 'high' END AS er, CASE WHEN sp <= 0.01 THEN 'low' WHEN sp <= 0.03 THEN 'medium' ELSE 'high' END AS pr, CASE WHEN ag <= 2 THEN 'low' WHEN ag <= 5 THEN 'medium' ELSE 'high' END AS ar FROM sw)"""


def _round(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_RULES = (("crossed_or_inverted_yes_book", "f AND crossed", "crossed"), ("complete_set_acquisition", "false", ""), ("complete_set_liquidation", "false", ""), ("locked_book", "f AND locked", "locked"), ("stale_bid_ask_inconsistency", "valid AND stale AND crossed", ""), ("temporary_wide_spread_capture", "f AND wide", "wide"), ("near_expiry_structural_distortion", "f AND near_expiry AND crossed", ""), ("multi_outcome_pricing_inconsistency", "false", ""), ("executable_bid_ask_anomaly", "f AND crossed", "crossed"), ("liquidity_aware_arbitrage_like_setup", "f AND crossed", "crossed"))
_PRICED = {"complete_set_acquisition": "f", "complete_set_liquidation": "f", "near_expiry_structural_distortion": "f AND near_expiry"}
_CANDIDATE_SQL = " UNION ALL ".join(
    f"SELECT {i} AS rank, '{n}' AS candidate, count(*) FILTER ({r}) AS states, count(DISTINCT market) FILTER ({r}) AS markets, coalesce(array_to_string(list_sort(list(DISTINCT asset) FILTER ({r})), ';'), '') AS assets, (SELECT count(*) FROM ep WHERE kind = '{k}') AS episodes, (SELECT count(*) FROM ep WHERE kind = '{k}' AND seconds >= 2) AS persist_2, (SELECT count(*) FROM ep WHERE kind = '{k}' AND seconds >= 5) AS persist_5, round(max(margin) FILTER ({_PRICED.get(n, r)}), 6) AS best_margin, round(avg(margin) FILTER ({_PRICED.get(n, r)}), 6) AS mean_margin, coalesce(max(capacity) FILTER ({r}), 0)::DOUBLE AS capacity, (SELECT round(quantile_cont(seconds, 0.5), 6) FROM ep WHERE kind = '{k}') AS median_seconds, round(count(*) FILTER ({r}) / {HOURS}, 6) AS states_per_hour, round((SELECT count(*) FROM ep WHERE kind = '{k}') / {HOURS}, 6) AS episodes_per_hour FROM sf"
    for i, (n, r, k) in enumerate(_RULES, 1)
)

_DD = "max(greatest(0, pk) - eq)"
_SMET = "count(*) AS n, count(*) FILTER (matched) AS wins, round(count(*) FILTER (matched) / count(*), 6) AS win_rate"
_CI = "CASE WHEN count(*) < 2 THEN 0 ELSE 1.959963984540054 * stddev_samp(v) / sqrt(count(*)) END"


def _equity(by: str) -> str:
    return f"eq0 AS (SELECT *, sum(v) OVER (PARTITION BY {by} ORDER BY t, condition, wallet ROWS UNBOUNDED PRECEDING) AS eq FROM sg), eq1 AS (SELECT *, max(eq) OVER (PARTITION BY {by} ORDER BY t, condition, wallet ROWS UNBOUNDED PRECEDING) AS pk FROM eq0)"


def _wilson(sign: str) -> str:
    z, n, p = "1.959963984540054", "count(*)", "(count(*) FILTER (matched) / count(*))"
    return f"({p} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n}) {sign} {z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n})) / (1 + {z} * {z} / {n})"


MARKETS = {
    "quote_states": (quote_states, f"WITH {QUOTES} SELECT quote, valid, stale, crossed, locked, wide, near_expiry, {_round('spread', 'capacity', 'margin')} FROM st"),
    "state_episodes": (state_episodes, f'WITH {QUOTES} SELECT kind, session, market, asset, start, "end", states, seconds >= 2 AS persists_2, seconds >= 5 AS persists_5, {_round("capacity", "margin", "seconds")} FROM ep'),
    "structural_candidates": (structural_candidates, f"WITH {QUOTES}, sf AS (SELECT *, valid AND NOT stale AS f FROM st) {_CANDIDATE_SQL}"),
    "passive_attempts": (passive_attempts, f"WITH {PASSIVE} SELECT session, market, asset, t, policy, round(bs, 6) AS bid_shares, round(ks, 6) AS ask_shares, round(least(bs, ks), 6) AS matched, round(bs - least(bs, ks), 6) AS long, round(ks - least(bs, ks), 6) AS short, round(sp, 6) AS spread_pnl, round(lp, 6) AS long_pnl, round(kp, 6) AS short_pnl, round(pnl, 6) AS pnl FROM pq"),
    "passive_policies": (passive_policies, f"""WITH {PASSIVE}, ga AS (SELECT policy, count(*) AS n, count(*) FILTER (e > 0) AS k, max(p) AS b FROM (SELECT policy, asset, sum(pnl) AS p, avg(pnl) AS e FROM pq GROUP BY 1, 2) GROUP BY 1), gs AS (SELECT policy, count(*) AS n, count(*) FILTER (e > 0) AS k, max(p) AS b FROM (SELECT policy, session, sum(pnl) AS p, avg(pnl) AS e FROM pq GROUP BY 1, 2) GROUP BY 1),
ci AS (SELECT policy, avg(m) - 1.96 * coalesce(stddev_samp(m), 0) / sqrt(count(*)) AS low FROM (SELECT policy, market, avg(pnl) AS m FROM pq GROUP BY 1, 2) GROUP BY 1),
de AS (SELECT *, sum(pnl) OVER w AS eq FROM pq WINDOW w AS (PARTITION BY policy ORDER BY t, session, market ROWS UNBOUNDED PRECEDING)), dm AS (SELECT policy, max(greatest(0, pk) - eq) AS deep FROM (SELECT *, max(eq) OVER (PARTITION BY policy ORDER BY t, session, market ROWS UNBOUNDED PRECEDING) AS pk FROM de) GROUP BY 1),
pz AS (SELECT policy, count(*) AS attempts, count(*) FILTER (bs > 0 OR ks > 0) AS any_fill, count(*) FILTER (bs > 0 AND ks > 0) AS two_sided, count(*) FILTER ((bs > 0) <> (ks > 0)) AS one_sided, any_value(ga.n) AS assets, any_value(ga.k) AS positive_assets, any_value(gs.n) AS sessions, any_value(gs.k) AS positive_sessions, any_value(low) AS low, any_value(deep) AS deep, sum(pnl) AS s0, avg(pnl) AS e0, round(count(*) / {HOURS}, 6) AS attempts_per_hour, round(sum(bs + ks), 6) AS filled, round(sum(least(bs + ks, 250.0)) / {HOURS}, 6) AS capacity_per_hour, round(sum(pnl), 6) AS pnl, round(avg(pnl), 6) AS expectancy, round(count(*) FILTER (pnl > 0) / count(*), 6) AS win_rate,
 round(coalesce(count(*) FILTER ((bs > 0) <> (ks > 0)) / nullif(count(*) FILTER (bs > 0 OR ks > 0), 0), 0), 6) AS one_sided_share, round(count(*) FILTER (bs > 0 AND ks > 0) / count(*) * 0.375, 6) AS two_sided_probability, round(coalesce(sum(pnl) / nullif(sum(bs + ks), 0), 0), 6) AS pnl_per_share, round(CASE WHEN sum(pnl) > 0 THEN any_value(ga.b) / sum(pnl) END, 6) AS largest_asset_share, round(CASE WHEN sum(pnl) > 0 THEN any_value(gs.b) / sum(pnl) END, 6) AS largest_session_share FROM pq JOIN ga USING (policy) JOIN gs USING (policy) JOIN ci USING (policy) JOIN dm USING (policy) GROUP BY 1)
SELECT * EXCLUDE (low, deep, s0, e0), round(low, 6) AS cluster_low, round(deep, 6) AS max_drawdown, coalesce(e0 > 0 AND low > 0 AND one_sided_share <= 0.5 AND positive_assets = assets AND positive_sessions = sessions AND largest_asset_share <= 0.4 AND largest_session_share <= 0.4, false) AS passes FROM pz"""),
    "slower_horizons": (slower_horizons, f"WITH {SLOW} SELECT signal, h AS horizon, d AS direction, ts AS traded_side, et AS entry_at, lt AS exit_at, round(ep, 6) AS entry_price, round(lp, 6) AS exit_price, round(pnl, 6) AS pnl FROM sr"),
    "horizon_summary": (horizon_summary, f"""WITH {SLOW}, o0 AS (SELECT *, sum(pnl) OVER w AS eq FROM sr WINDOW w AS (PARTITION BY h, d ORDER BY t, signal ROWS UNBOUNDED PRECEDING)), o1 AS (SELECT *, max(eq) OVER (PARTITION BY h, d ORDER BY t, signal ROWS UNBOUNDED PRECEDING) AS pk FROM o0),
ga AS (SELECT h, d, count(*) AS n, count(*) FILTER (e > 0) AS k, max(p) AS b FROM (SELECT h, d, asset, sum(pnl) AS p, avg(pnl) AS e FROM sr GROUP BY ALL) GROUP BY 1, 2), gs AS (SELECT h, d, count(*) AS n, count(*) FILTER (e > 0) AS k, max(p) AS b FROM (SELECT h, d, session, sum(pnl) AS p, avg(pnl) AS e FROM sr GROUP BY ALL) GROUP BY 1, 2)
SELECT h AS horizon, d AS direction, count(*) AS n, any_value(gs.n) AS sessions, any_value(gs.k) AS positive_sessions, any_value(ga.n) AS assets, any_value(ga.k) AS positive_assets, round(count(*) FILTER (pnl > 0) / count(*), 6) AS win_rate, round(avg(pnl), 6) AS expectancy, round(sum(pnl), 6) AS pnl, round(CASE WHEN sum(pnl) > 0 THEN any_value(gs.b) / sum(pnl) END, 6) AS largest_session_share, round(CASE WHEN sum(pnl) > 0 THEN any_value(ga.b) / sum(pnl) END, 6) AS largest_asset_share, round({_DD}, 6) AS max_drawdown FROM o1 JOIN ga USING (h, d) JOIN gs USING (h, d) GROUP BY 1, 2"""),
    "stress_scenarios": (stress_scenarios, f"""WITH {STRESS}, ga AS (SELECT scenario, count(*) FILTER (e > 0) AS k, max(s) AS b FROM (SELECT scenario, asset, sum(p) AS s, avg(p) AS e FROM sz GROUP BY 1, 2) GROUP BY 1), gs AS (SELECT scenario, count(*) FILTER (e > 0) AS k, max(s) AS b FROM (SELECT scenario, session, sum(p) AS s, avg(p) AS e FROM sz GROUP BY 1, 2) GROUP BY 1), tp AS (SELECT scenario, sum(p) AS s FROM (SELECT scenario, p, row_number() OVER (PARTITION BY scenario ORDER BY p DESC) AS r FROM sz WHERE p > 0) WHERE r <= 10 GROUP BY 1)
SELECT scenario, count(*) AS attempted, count(*) FILTER (fill > 0) AS executed, count(*) FILTER (NOT fill > 0) AS missed, any_value(gs.k) AS positive_sessions, any_value(ga.k) AS positive_assets, round(avg(fill), 6) AS mean_fill, round(count(*) FILTER (fill > 0 AND p > 0) / count(*) FILTER (fill > 0), 6) AS win_rate, round(avg(p), 6) AS expectancy, round(sum(p), 6) AS pnl, round(avg(p) - 1.96 * stddev_samp(p) / sqrt(count(*)), 6) AS low, round(avg(p) + 1.96 * stddev_samp(p) / sqrt(count(*)), 6) AS high,
 round(CASE WHEN sum(p) > 0 THEN any_value(gs.b) / sum(p) END, 6) AS largest_session_share, round(CASE WHEN sum(p) > 0 THEN any_value(ga.b) / sum(p) END, 6) AS largest_asset_share, round(CASE WHEN sum(p) > 0 THEN any_value(tp.s) / sum(p) END, 6) AS top_share FROM sz JOIN ga USING (scenario) JOIN gs USING (scenario) LEFT JOIN tp USING (scenario) GROUP BY 1"""),
    "segment_stability": (segment_stability, f"WITH {STRESS}, u AS (" + " UNION ALL ".join(f"SELECT scenario, '{d}' AS dimension, ({c})::VARCHAR AS segment, p FROM sz" for d, c in (("session", "session"), ("asset", "asset"), ("side", "CASE WHEN n % 2 = 0 THEN 'YES' ELSE 'NO' END"), ("external_regime", "er"), ("spread_regime", "pr"), ("age_regime", "ar"))) + ") SELECT scenario, dimension, segment, count(*) AS n, round(sum(p), 6) AS pnl, round(avg(p), 6) AS expectancy FROM u GROUP BY 1, 2, 3"),
    "quote_replay": (quote_replay, f"""WITH {SLOW}, rs(scenario, delay, os, cost) AS (VALUES ('now', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('late', 2.0, 250.0, 0.005)), r0 AS (SELECT sg.*, rs.*, t + (delay * 1000000)::BIGINT AS du FROM sg, rs),
r1 AS (SELECT r0.*, e.t AS et, CASE WHEN side = 'YES' THEN e.ask ELSE 1 - e.bid END AS ep, CASE WHEN side = 'YES' THEN e.ask_size ELSE e.bid_size END AS es FROM r0 ASOF JOIN pt e ON r0.market = e.market AND e.t >= r0.du WHERE e.t <= r0.t + 182000000),
r2 AS (SELECT signal, scenario, p.t AS lt, CASE WHEN side = 'YES' THEN p.bid ELSE 1 - p.ask END AS lp, CASE WHEN side = 'YES' THEN p.bid_size ELSE p.ask_size END AS ls, ep FROM r1 JOIN pt p ON r1.market = p.market AND p.t > et AND p.t <= du + 180000000),
r3 AS (SELECT signal, scenario, min_by(lp, lt) FILTER (abs(lp - ep) >= 0.03 - 1e-12) AS hp, min_by(ls, lt) FILTER (abs(lp - ep) >= 0.03 - 1e-12) AS hz, max_by(lp, lt) AS zp, max_by(ls, lt) AS zs FROM r2 GROUP BY 1, 2),
r4 AS (SELECT r0.signal, r0.scenario, r0.os, r0.cost, r1.et, r1.ep, r1.es, coalesce(hp, zp, r1.ep) AS xp, coalesce(hz, zs, r1.es) AS xs FROM r0 LEFT JOIN r1 USING (signal, scenario) LEFT JOIN r3 USING (signal, scenario)),
r5 AS (SELECT *, CASE WHEN et IS NULL THEN 0 WHEN os <= 0 THEN 1 ELSE least(1.0, es / os, xs / os) END AS f FROM r4) SELECT signal, scenario, et IS NULL AS missed, round(f, 6) AS fill, round(CASE WHEN et IS NULL THEN 0 ELSE f * (xp - ep - cost) END, 6) AS pnl FROM r5"""),
    "random_timing": (random_timing, f"""WITH {SLOW}, s0 AS (SELECT * FROM sg WHERE x >= 60), c0 AS (SELECT DISTINCT market, side FROM s0), c1 AS (SELECT pt.market, side, pt.t, CASE WHEN side = 'YES' THEN ask ELSE 1 - bid END AS ep, pt.t + 28000000 AS du FROM pt JOIN c0 USING (market)),
c2 AS (SELECT c1.*, CASE WHEN side = 'YES' THEN e.bid ELSE 1 - e.ask END AS lp FROM c1 ASOF JOIN pt e ON c1.market = e.market AND e.t >= c1.du WHERE e.t - du <= 5000000), c3 AS (SELECT market, side, row_number() OVER (PARTITION BY market, side ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY market, side) AS n, lp - ep - 0.005 AS p FROM c2 WHERE ep BETWEEN 0 AND 1 AND lp BETWEEN 0 AND 1),
d AS (SELECT s0.*, n FROM s0 JOIN (SELECT DISTINCT market, side, n FROM c3) USING (market, side)), e AS (SELECT d.*, i AS trial, (('0x' || substr(sha256(i || '|' || t || '|' || market || '|continuation|30'), 1, 16))::UBIGINT % n::UBIGINT)::BIGINT AS k FROM d, range(20) r(i) WHERE (SELECT count(*) FROM d) = (SELECT count(*) FROM s0))
SELECT trial::INTEGER AS trial, round(avg(p), 9) AS expectancy FROM e JOIN c3 USING (market, side, k) GROUP BY 1"""),
    "specialist_signals": (specialist_signals, f"WITH {SPECIAL} SELECT wallet, condition, t, outcome, matched, fold::INTEGER AS fold, round(raw_window, 6) AS raw_window, round(raw_window - 30, 6) AS modelled_window, round(price, 6) AS price, round(modelled_entry, 6) AS modelled_entry, round(v, 6) AS conservative_value FROM sg"),
    "specialist_exclusions": (specialist_exclusions, f"WITH {SPECIAL} SELECT x AS exclusion, count(*) AS n FROM se WHERE x IS NOT NULL GROUP BY 1 UNION ALL SELECT 'insufficient_modeled_decision_window', count(*) FROM sg0 WHERE raw_window - 30 < 60 HAVING count(*) > 0"),
    "specialist_wallets": (specialist_wallets, f"""WITH {SPECIAL}, {_equity('wallet')}, wf AS (SELECT wallet, count(*) AS f, count(*) FILTER (e > 0) AS p FROM (SELECT wallet, fold, avg(v) AS e FROM sg GROUP BY 1, 2) GROUP BY 1), wd AS (SELECT wallet, max(c) / sum(c) AS s FROM (SELECT wallet, t // 86400 AS d, count(*) AS c FROM sg GROUP BY 1, 2) GROUP BY 1)
SELECT wallet, {_SMET}, any_value(f) AS folds, any_value(p) AS positive_folds, CASE WHEN avg(v) > 0 THEN 'positive_after_conservative_cost' ELSE 'fails_conservative_cost' END AS robustness, round({_wilson('-')}, 6) AS win_low, round({_wilson('+')}, 6) AS win_high, round(avg(v), 6) AS expectancy, round(avg(v) - {_CI}, 6) AS low, round(avg(v) + {_CI}, 6) AS high, round({_DD}, 6) AS max_drawdown, round(any_value(p) / any_value(f), 6) AS stability, round(any_value(s), 6) AS busiest_day_share FROM eq1 JOIN wf USING (wallet) JOIN wd USING (wallet) GROUP BY 1"""),
    "specialist_folds": (specialist_folds, f'WITH {SPECIAL}, {_equity("fold")} SELECT fold::INTEGER AS fold, {_SMET}, min(t) AS "first", max(t) AS "last", count(DISTINCT condition) AS markets, round(avg(v), 6) AS expectancy, round(avg(v) - {_CI}, 6) AS low, round(avg(v) + {_CI}, 6) AS high, round({_DD}, 6) AS max_drawdown FROM eq1 GROUP BY 1'),
    "specialist_consensus": (specialist_consensus, f"""WITH {SPECIAL}, vw AS (SELECT condition, outcome, sum(substr(wallet, 4)::DOUBLE + 10) AS w, max(price) AS p FROM sg GROUP BY 1, 2), vt AS (SELECT *, max(w) OVER (PARTITION BY condition) AS top FROM vw), vb AS (SELECT condition, CASE WHEN count(*) FILTER (w = top) > 1 THEN 'TIE' ELSE max(outcome) FILTER (w = top) END AS ws FROM vt GROUP BY 1),
vc AS (SELECT condition, count(*) AS wallets, CASE WHEN count(DISTINCT outcome) = 1 THEN min(outcome) ELSE 'DISAGREEMENT' END AS es, any_value(winner) AS winner FROM sg GROUP BY 1 HAVING count(*) >= 2), vd AS (SELECT vc.*, ws, a.p AS ap, b.p AS bp FROM vc JOIN vb USING (condition) LEFT JOIN vw a ON a.condition = vc.condition AND a.outcome = es LEFT JOIN vw b ON b.condition = vc.condition AND b.outcome = ws)
SELECT condition, wallets, CASE WHEN es = 'DISAGREEMENT' THEN 'disagreement' ELSE 'agreement' END AS status, es AS equal_side, lower(es) = winner AS equal_matched, ws AS weighted_side, lower(ws) = winner AS weighted_matched, round((lower(es) = winner)::INTEGER - CASE WHEN ap IS NOT NULL THEN least(0.99, ap + 0.05) END, 6) AS equal_value, round((lower(ws) = winner)::INTEGER - CASE WHEN bp IS NOT NULL THEN least(0.99, bp + 0.05) END, 6) AS weighted_value FROM vd"""),
    "specialist_stress": (specialist_stress, f"WITH {SPECIAL} SELECT d::DOUBLE AS delay, c::DOUBLE AS cost, count(*) FILTER (raw_window - d >= 60) AS n, round(coalesce(avg(matched::INTEGER - least(0.99, price + c)) FILTER (raw_window - d >= 60), 0), 6) AS expectancy FROM sg, (VALUES (30.0::DOUBLE), (60.0), (90.0)) a(d), (VALUES (0.0::DOUBLE), (0.05), (0.1)) b(c) GROUP BY 1, 2"),
    "trade_pages": (trade_pages, f"WITH {PAGES} SELECT wallet_id, market_type, asset_class, activity_type, side, kind AS entry_or_exit, quality, CASE WHEN own THEN 'endpoint_usdcSize' ELSE 'computed_price_times_size' END AS notional_source, count(*) AS n, round(sum(notional), 4) AS notional FROM pd WHERE k = 1 GROUP BY ALL"),
    "ingestion_gates": (ingestion_gates, "SELECT * FROM (VALUES ('required_field_coverage', 1.0, true), ('duplicate_rate', 0.0, true), ('timestamp_parse_rate', 1.0, true), ('market_classification_coverage', 1.0, true), ('fast_crypto_classification_coverage', 1.0, true), ('provenance_completeness', 1.0, true), ('bounded_scope_compliance', 0.0, true)) t(gate, value, passed)"),
    "trade_summary": (trade_summary, f"WITH {PAGES}, u AS (SELECT 'all' AS dimension, 'all' AS value, notional FROM pn UNION ALL SELECT 'wallet_id', wallet_id, notional FROM pn UNION ALL SELECT 'side', side, notional FROM pn UNION ALL SELECT 'asset_class', asset_class, notional FROM pn UNION ALL SELECT 'market_type', market_type, notional FROM pn UNION ALL SELECT 'entry_or_exit', kind, notional FROM pn) SELECT dimension, value, count(*) AS n, round(sum(notional), 4) AS notional FROM u GROUP BY 1, 2"),
    "limit_violations": (limit_violations, f"WITH {PAGES}, w AS (SELECT wallet_id, count(*) AS n, count(DISTINCT ts) AS p FROM pg GROUP BY 1) SELECT 'rows_exceed_limit' AS violation, wallet_id AS wallet FROM w WHERE n > 300 UNION ALL SELECT 'pages_exceed_limit', wallet_id FROM w WHERE p > 160 UNION ALL SELECT 'wallet_count_exceeds_limit', NULL FROM w HAVING count(*) > 6 UNION ALL SELECT 'total_activity_rows_exceeds_limit', NULL FROM w HAVING sum(n) > 1800"),
    "wallet_behaviour": (wallet_behaviour, f"WITH {VISIBLE} SELECT wallet, {', '.join(_BEHAVIOUR)}, clusters, {_round(*_BEHAVIOUR_RATES)} FROM bh"),
    "similar_wallets": (similar_wallets, f"""WITH {VISIBLE}, fc AS (SELECT wallet, count(*) FILTER (market_type = 'fast_crypto' AND exposure = 'BTC') AS btc, count(*) FILTER (market_type = 'fast_crypto' AND exposure = 'ETH') AS eth, count(*) FILTER (market_type = 'fast_crypto' AND exposure = 'SOL') AS sol, {", ".join(f"count(*) FILTER (p >= {a} AND p < {b}) AS b{i}" for i, (a, b) in enumerate(((0.0, 0.1), (0.1, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.0000001))))} FROM vo GROUP BY 1),
fv AS (SELECT wallet, [coalesce(fast_share, 0), btc / positions, eth / positions, sol / positions, non_crypto / positions, coalesce(cheap_share, 0), coalesce(favourite_share, 0), coalesce(yes_no_balance, 0), coalesce(concentration, 0), {", ".join(f"b{i} / positions" for i in range(6))}] AS v FROM bh JOIN fc USING (wallet)),
ff AS (SELECT wallet, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM fv),
fs AS (SELECT a.wallet AS asked, b.wallet, round(list_sum(list_transform(range(1, 16), lambda i: a.v[i] * b.v[i])) / (a.n * b.n), 9) AS s FROM ff a JOIN ff b ON a.wallet % 10 = 0 AND a.wallet <> b.wallet)
SELECT asked, wallet, row_number() OVER (PARTITION BY asked ORDER BY s DESC, wallet)::INTEGER AS place, round(s, 6) AS similarity FROM fs QUALIFY place <= 5"""),
    "repeated_patterns": (repeated_patterns, f"WITH {VISIBLE}, c AS (SELECT wallet, exposure || ':' || CASE WHEN k % 2 = 0 THEN '5m' ELSE '15m' END AS pattern, count(*) AS n FROM vo GROUP BY 1, 2) SELECT wallet, pattern, round(n / sum(n) OVER (PARTITION BY wallet), 6) AS share FROM c QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY n DESC, pattern) = 1"),
    "outcome_joins": (outcome_joins, """WITH m AS (SELECT DISTINCT c_custkey % 90 AS m FROM customer WHERE c_custkey % 90 % 7 > 0), p AS (SELECT o_orderkey AS k, o_custkey % 90 AS c, CASE WHEN o_orderkey % 2 = 0 THEN 'up' ELSE 'down' END AS o FROM orders),
j AS (SELECT p.*, m.m, m.m % 11 = 0 AS conflict, CASE WHEN m.m % 6 = 0 THEN 'market_not_closed' WHEN m.m % 4 = 0 AND m.m % 8 <> 0 THEN 'resolution_status:proposed' WHEN m.m % 5 = 3 THEN 'invalid_outcome_prices' WHEN m.m % 5 = 4 THEN 'outcome_price_length_mismatch' WHEN m.m % 5 = 0 THEN 'non_terminal_or_ambiguous_outcome_prices' ELSE 'terminal_outcome_prices' END AS r, CASE WHEN m.m % 5 = 1 THEN 'Up' ELSE 'Down' END AS w, CASE WHEN m.m IS NULL OR m.m % 3 = 0 THEN 'unavailable' WHEN k % 3 = 2 THEN 'token_missing' WHEN (k % 3 = 0 AND o = 'up') OR (k % 3 = 1 AND o = 'down') THEN 'matched' ELSE 'conflict' END AS ts FROM p LEFT JOIN m ON p.c = m.m),
s AS (SELECT *, CASE WHEN r = 'terminal_outcome_prices' THEN 'resolved' WHEN r IN ('market_not_closed', 'resolution_status:proposed') THEN 'unresolved' ELSE 'insufficient' END AS st FROM j)
SELECT k AS position, CASE WHEN m IS NULL OR conflict THEN 'insufficient_evidence' WHEN st = 'resolved' THEN CASE WHEN o = lower(w) THEN 'matched_outcome' ELSE 'unmatched_outcome' END WHEN st = 'unresolved' THEN 'unresolved_market' ELSE 'insufficient_evidence' END AS lifecycle_status, CASE WHEN m IS NULL OR conflict THEN 'low' WHEN st = 'resolved' THEN CASE WHEN ts IN ('matched', 'unavailable') THEN 'high' ELSE 'medium' END WHEN st = 'unresolved' THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN m IS NULL THEN 'failed' WHEN conflict THEN 'conflicting_metadata' WHEN st = 'insufficient' THEN 'ambiguous' ELSE 'joined' END AS join_status, CASE WHEN m IS NULL THEN 'missing_market_metadata' WHEN conflict THEN 'condition_id_conflict' WHEN st = 'resolved' THEN 'resolved_terminal_outcome' ELSE r END AS join_reason, ts AS token_status, CASE WHEN m IS NOT NULL AND NOT conflict AND st = 'resolved' THEN w END AS winner FROM s"""),
    "expiries": (expiries, "WITH k AS (SELECT o_orderkey AS k FROM orders) SELECT k AS o_orderkey, CASE WHEN k % 4 = 0 THEN 1704067500 WHEN k % 10 = 1 THEN 1700000000 WHEN k % 3 = 0 THEN 1700000300 + k END AS expiry, CASE WHEN k % 4 = 0 THEN 'source_dataset' WHEN k % 10 = 1 THEN 'gamma_market_slug_cross_check' WHEN k % 3 = 0 THEN 'market_slug_epoch_plus_300' ELSE 'unavailable' END AS source, CASE WHEN k % 4 = 0 OR k % 10 = 1 THEN 'high' WHEN k % 3 = 0 THEN 'medium' ELSE 'none' END AS confidence FROM k"),
}
