"""Queries of quote features, rules, decision windows and evaluation helpers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import metrics as M
from ..operators import outcomes as O
from ..operators import tables as T
from ..operators import trading as R
from .table_queries import SCORED, _days, _scored
from .tables import table
from .time_queries import BUCKET, HOUR, E, _r, events


def microstructure(spark, sf_dir):
    k = F.col("event_id")
    e = events(spark, sf_dir).withColumns({"yes": F.floor(F.col("value") / 20), "session": F.col("user_id") % 4, "asset": F.concat(F.lit("a"), F.col("user_id") % 3), "bids": k % 2, "asks": k % 3, "quoted": F.col("t") - (k % 50 - 3) * 1_000_000})
    e = e.withColumns({"bid": F.col("yes") - (F.col("bids") + 1) / 100, "ask": F.col("yes") + (F.col("asks") + 1) / 100})
    m = R.microstructure(e, "user_id", "t", "yes", "bid", "ask", "bids", "asks", "session", "asset", ["a0", "a1", "a2"], "quoted", 48 * HOUR, 6 * HOUR, BUCKET)
    return m.select("event_id", "consecutive_quote_stability", F.round(F.col("yes_change_frequency") * 48 * 3600).cast("long").alias("changes"), *_r("repricing_velocity", "time_since_quote_update", "spread_change", "spread_compression", "quote_age", "book_imbalance", "cross_asset_dispersion", "cross_asset_relative"))


def rule_candidates(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("margin", F.col("l_discount") - F.col("l_tax"))
    rules = {"crossed": F.col("margin") > 0.05, "wide": F.col("l_tax") >= 0.08, "large": F.col("l_quantity") >= 45, "returned": F.col("l_returnflag") == "R"}
    return R.rule_candidates(lines, rules, "l_partkey", "margin").select("rule", "states", "markets", *_r("best_margin", "mean_margin"))


def _observed(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    seen = F.when(F.col("l_linenumber") < 7, (F.col("l_quantity") * 1_000_000).cast("long"))
    return R.decision_windows(lines, F.col("l_returnflag") != "A", F.col("l_discount") <= 0.09, seen, F.when(F.col("l_tax") > 0, F.pmod("l_partkey", F.lit(300)) * 1_000_000))


def decision_windows(spark, sf_dir):
    return _observed(spark, sf_dir).groupBy(F.coalesce("exclusion", "window_class").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("window_seconds"), 2).alias("seconds"))


def window_distribution(spark, sf_dir):
    return R.window_distribution(_observed(spark, sf_dir), "window_seconds").select("n", *_r("least", "median", "mean", "most"), "under_30", "from_30_to_60", "from_60_to_120", "from_120_to_180", "from_180", *_r("share_60", "share_120", "share_180"))


def group_priors(spark, sf_dir):
    s = _scored(spark, sf_dir)
    out = R.with_priors(s, R.group_priors(s.filter("lang <> 'es'"), "lang", "y"), "lang")
    return out.select("doc_id", *_r("prior"))


def regime_segments(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return R.regimes(s, s.filter("doc_id % 2 = 0"), "n_chars").groupBy("regime").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


def perturbation(spark, sf_dir):
    return R.perturbed(events(spark, sf_dir), "value", "event_id", 0.1, 0.2, 3).select("event_id", *_r("perturbed"))


def daily_runtime(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("count", F.pmod(F.col("event_id"), F.lit(997)))
    return R.daily_deltas(e, "user_id", "t", ["count"], F.floor(F.col("t") / (24 * HOUR))).select("user_id", "day", "count")


def period_buckets(spark, sf_dir):
    return R.periods(_days(spark, sf_dir).select("day", "o_totalprice"), "day", 12).groupBy("period").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


def histogram_json(spark, sf_dir):
    return R.histogram_json(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


def session_states(spark, sf_dir):
    now = F.pmod("o_orderkey", F.lit(400)).cast("double")
    guard = O.entry_guard(F.col("o_orderstatus") == "F", F.lit("measured"), 320 - now)
    return table(spark, sf_dir, "orders").select("o_orderkey", O.window_state(now, F.lit(20.0), F.lit(320.0)).alias("state"), guard["qualified"].alias("qualified"), guard["reason"].alias("guard"))


def _measured(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        O.lag_measurement(1 + (F.col("l_discount") - 0.05) / 25, F.lit(1.0), F.lit(0.5) + F.col("l_tax") / 2, F.lit(0.52), F.col("l_quantity") / 10, F.col("l_extendedprice") / 10, F.col("l_quantity") * 5, F.lit(0.5), 0.5 + F.col("l_tax")).alias("m"),
    )


def lag_measurements(spark, sf_dir):
    m = _measured(spark, sf_dir)
    return m.select("l_orderkey", "l_linenumber", "m.direction", "m.qualified", "m.reason", *[F.round(f"m.{c}", 5).alias(c) for c in ("external_change", "market_change", "lag_score", "confidence")])


def first_opportunity(spark, sf_dir):
    e = events(spark, sf_dir, "event_type").select("user_id", "event_type", "event_id", "t")
    return T.keep_first(e, ["user_id", "event_type"], ["t", "event_id"]).select("user_id", "event_type", "event_id", "copies")


def dedupe_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(X.dedupe_key("o_orderstatus", "o_orderpriority").alias("key")).agg(F.count("*").alias("n"))


def five_bins(spark, sf_dir):
    return M.calibration(_scored(spark, sf_dir), "y", "p", 5).filter("n > 0").select("bin", "n", *_r("mean_p", "rate"))


SEEN = """o0 AS (SELECT *, CASE WHEN l_linenumber < 7 THEN l_quantity END AS se, CASE WHEN l_tax > 0 THEN l_partkey % 300 END AS ex FROM lineitem),
o1 AS (SELECT *, CASE WHEN l_returnflag = 'A' THEN 'non_prospective_or_page_churn' WHEN NOT l_discount <= 0.09 THEN 'non_five_minute_market' WHEN se IS NULL THEN 'missing_first_seen_timestamp' WHEN ex IS NULL THEN 'missing_expiry' WHEN ex < se THEN 'first_seen_after_expiry' END AS x FROM o0), dw AS (SELECT *, CASE WHEN x IS NULL THEN ex - se END AS w FROM o1)"""
KIND = "CASE WHEN w >= 60 THEN 'sufficient_decision_window' WHEN w >= 30 THEN 'marginal_decision_window' ELSE 'insufficient_decision_window' END"

TRADING = {
    "microstructure": (microstructure, f"""WITH {E}, y AS (SELECT *, floor(value / 20) AS yes, event_id % 2 AS bd, event_id % 3 AS ad, user_id % 4 AS session, 'a' || user_id % 3 AS asset, greatest(0.0, (event_id % 50 - 3)::DOUBLE) AS age FROM e), q AS (SELECT *, yes - (bd + 1) / 100 AS bid, yes + (ad + 1) / 100 AS ask FROM y),
l AS (SELECT *, ask - bid AS spread, lag(t) OVER w AS pt, lag(yes) OVER w AS py, lag(ask - bid) OVER w AS ps, coalesce((yes, bid, ask, bd, ad) <> lag((yes, bid, ask, bd, ad)) OVER w, true) AS c, coalesce(yes <> lag(yes) OVER w, false) AS cy FROM q WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT *, sum(c::INTEGER) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g, sum(cy::INTEGER) OVER f - first_value(cy::INTEGER) OVER f AS changes, {", ".join(f"last_value(CASE WHEN asset = 'a{i}' THEN t END IGNORE NULLS) OVER s AS t{i}, last_value(CASE WHEN asset = 'a{i}' THEN yes END IGNORE NULLS) OVER s AS v{i}" for i in range(3))}
  FROM l WINDOW f AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {48 * HOUR} PRECEDING AND CURRENT ROW), s AS (PARTITION BY session ORDER BY t, asset ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, list_filter([{", ".join(f"CASE WHEN t - t{i} <= {6 * HOUR} THEN v{i} END" for i in range(3))}], lambda x: x IS NOT NULL) AS f FROM g)
SELECT event_id, row_number() OVER (PARTITION BY user_id, g ORDER BY t) AS consecutive_quote_stability, changes::BIGINT AS changes, round(CASE WHEN t > pt THEN (yes - py) / ((t - pt) / 1e6) END, 6) AS repricing_velocity,
 round((t - min(t) OVER (PARTITION BY user_id, g)) / 1e6, 6) AS time_since_quote_update, round(spread - ps, 6) + 0.0 AS spread_change, round(ps - spread, 6) + 0.0 AS spread_compression, round(age, 6) AS quote_age, round((bd - ad) / nullif(bd + ad, 0), 6) AS book_imbalance,
 round(CASE WHEN len(f) >= 2 THEN list_max(f) - list_min(f) END, 6) AS cross_asset_dispersion, round(CASE WHEN len(f) >= 2 THEN yes - list_sum(f) / len(f) END, 6) AS cross_asset_relative FROM d"""),
    "rule_candidates": (rule_candidates, """WITH m AS (SELECT *, l_discount - l_tax AS margin FROM lineitem), r AS (SELECT 'crossed' AS rule, l_partkey, margin FROM m WHERE margin > 0.05 UNION ALL SELECT 'wide', l_partkey, margin FROM m WHERE l_tax >= 0.08 UNION ALL SELECT 'large', l_partkey, margin FROM m WHERE l_quantity >= 45 UNION ALL SELECT 'returned', l_partkey, margin FROM m WHERE l_returnflag = 'R')
SELECT rule, count(*) AS states, count(DISTINCT l_partkey) AS markets, round(max(margin), 6) AS best_margin, round(avg(margin), 6) AS mean_margin FROM r GROUP BY 1"""),
    "decision_windows": (decision_windows, f"WITH {SEEN} SELECT coalesce(x, {KIND}) AS kind, count(*) AS n, round(sum(w), 2) AS seconds FROM dw GROUP BY 1"),
    "window_distribution": (window_distribution, f"WITH {SEEN} SELECT count(w) AS n, round(min(w), 6) AS least, round(quantile_cont(w, 0.5), 6) AS median, round(avg(w), 6) AS mean, round(max(w), 6) AS most, count(*) FILTER (w < 30) AS under_30, count(*) FILTER (w >= 30 AND w < 60) AS from_30_to_60, count(*) FILTER (w >= 60 AND w < 120) AS from_60_to_120, count(*) FILTER (w >= 120 AND w < 180) AS from_120_to_180, count(*) FILTER (w >= 180) AS from_180, " + ", ".join(f"round(count(*) FILTER (w >= {g}) / count(w), 6) AS share_{g}" for g in (60, 120, 180)) + " FROM dw"),
    "group_priors": (group_priors, f"WITH {SCORED}, g AS (SELECT lang, avg(y) AS prior FROM s WHERE lang <> 'es' GROUP BY 1) SELECT doc_id, round(coalesce(g.prior, (SELECT avg(y) FROM s WHERE lang <> 'es')), 6) AS prior FROM s LEFT JOIN g USING (lang)"),
    "regime_segments": (regime_segments, f"WITH {SCORED}, q AS (SELECT quantile_cont(n_chars, 1.0 / 3) AS a, quantile_cont(n_chars, 2.0 / 3) AS b FROM s WHERE doc_id % 2 = 0) SELECT CASE WHEN n_chars <= a THEN 'low' WHEN n_chars <= b THEN 'medium' ELSE 'high' END AS regime, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM s, q GROUP BY 1"),
    "perturbation": (perturbation, f"WITH {E}, u AS (SELECT event_id, value, ('0x' || substr(sha256('3|noise|' || event_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS n, ('0x' || substr(sha256('3|dropout|' || event_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS d FROM e) SELECT event_id, round(CASE WHEN d >= 0.2 THEN value * (1 + 0.1 * (2 * n - 1)) END, 6) AS perturbed FROM u"),
    "daily_runtime": (daily_runtime, f"""WITH {E}, d AS (SELECT user_id, t // {24 * HOUR} AS day, greatest(0, event_id % 997 - coalesce(lag(event_id % 997) OVER (PARTITION BY user_id ORDER BY t), event_id % 997)) AS c FROM e) SELECT user_id, day, sum(c)::BIGINT AS "count" FROM d GROUP BY 1, 2"""),
    "period_buckets": (period_buckets, "WITH d AS (SELECT date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS day FROM orders), b AS (SELECT min(day) AS a, max(day) AS z FROM d) SELECT least(11, floor((day - a) * 12.0::DOUBLE / greatest(1, z - a)))::INTEGER AS period, count(*) AS n, min(day)::INTEGER AS first, max(day)::INTEGER AS last FROM d, b GROUP BY 1"),
    "histogram_json": (histogram_json, """WITH c AS (SELECT o_orderstatus, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_orderstatus, '{' || string_agg('"' || p || '":' || n, ',' ORDER BY p) || '}' AS histogram FROM c GROUP BY 1"""),
    "session_states": (session_states, "WITH o AS (SELECT o_orderkey, o_orderstatus = 'F' AS q, o_orderkey % 400 AS n FROM orders) SELECT o_orderkey, CASE WHEN n < 20 THEN 'WAITING_FOR_NEXT_WINDOW' WHEN n >= 320 THEN 'CLOSED' WHEN n - 20 <= 30 THEN 'NEWLY_OPENED' WHEN 320 - n <= 60 THEN 'NEAR_EXPIRY' ELSE 'ACTIVE' END AS state, q AND 320 - n >= 30 AS qualified, CASE WHEN q AND 320 - n < 30 THEN 'late_entry_window' ELSE 'measured' END AS guard FROM o"),
    "lag_measurements": (lag_measurements, """WITH a AS (SELECT l_orderkey, l_linenumber, 1 + (l_discount - 0.05) / 25 - 1 AS c, (0.5 + l_tax / 2) - 0.52 AS m, l_extendedprice / 10 AS liq, l_quantity * 5 AS s, 0.5 + l_tax - 0.5 AS sp FROM lineitem),
b AS (SELECT *, c * 10000 AS bps, least(0.30, abs(c * 10000) / 1000) AS x FROM a), d AS (SELECT *, CASE WHEN bps >= 4 THEN 'UP' WHEN bps <= -4 THEN 'DOWN' ELSE 'NONE' END AS direction FROM b),
r AS (SELECT *, CASE WHEN x > 0 THEN greatest(0.0, CASE WHEN direction = 'UP' THEN m ELSE -m END) / nullif(x, 0.0) ELSE 1.0 END AS r, least(1.0, abs(bps) / 16) AS st FROM d), k AS (SELECT *, greatest(0.0, 1 - r) * st AS score FROM r),
q AS (SELECT *, greatest(0.0, least(1.0, 0.70 * score + 0.20 * st + 0.10 * (1 - least(1.0, sp / 0.10)))) AS conf FROM k),
f AS (SELECT *, CASE WHEN liq < 500 THEN 'liquidity_below_minimum' WHEN s < 20 THEN 'near_expiry_insufficient_time' WHEN direction = 'NONE' THEN 'external_move_below_threshold' WHEN r >= 0.65 THEN 'polymarket_already_repriced' WHEN conf < 0.55 THEN 'confidence_below_threshold' ELSE 'qualified_external_move_not_repriced' END AS reason FROM q)
SELECT l_orderkey, l_linenumber, direction, reason = 'qualified_external_move_not_repriced' AS qualified, reason, round(round(c, 8), 5) AS external_change, round(round(m, 8), 5) AS market_change, round(round(score, 6), 5) AS lag_score, round(round(conf, 6), 5) AS confidence FROM f"""),
    "first_opportunity": (first_opportunity, f"WITH {E} SELECT user_id, event_type, min_by(event_id, t) AS event_id, count(*) AS copies FROM e GROUP BY 1, 2"),
    "dedupe_keys": (dedupe_keys, "SELECT lower(trim(o_orderstatus) || '|' || trim(o_orderpriority)) AS key, count(*) AS n FROM orders GROUP BY 1"),
    "five_bins": (five_bins, f"WITH {SCORED} SELECT least(floor(p * 5), 4)::INTEGER AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM s GROUP BY 1"),
}
