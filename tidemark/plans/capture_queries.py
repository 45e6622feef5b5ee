"""Queries of baselines, latencies, visibility, signal labels and random candidates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import capture as C
from ..operators import redraws as D
from .market_queries import QUOTES, quotes
from .tables import table
from .time_queries import E, _r, events


def baselines(spark, sf_dir):
    return C.baselines(events(spark, sf_dir), "user_id", "t", "value").select("event_id", *_r("from_baseline"))


def rollover_baselines(spark, sf_dir):
    e = events(spark, sf_dir).withColumns({"asset": F.col("user_id") % 3, "market": F.floor(F.col("t") / 86_400_000_000)})
    return C.rollover_baselines(e, "asset", "market", "t", "value").select("event_id", *_r("from_baseline"))


def sessions_until(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("session", F.floor(F.col("t") / 86_400_000_000))
    return C.sessions_until(e, "session", "t", 1_705_000_000_000_000).groupBy("session").agg(F.count("*").alias("n"))


def _messages(spark, sf_dir):
    n = F.col("event_id")
    return events(spark, sf_dir).select(F.concat(F.lit("s"), F.col("user_id") % 4).alias("source"), (F.col("user_id") % 3).alias("asset"), (F.col("t") * 1000).alias("receive"), (F.col("t") * 1000 - n % 900 * 1_000_000).alias("server"), (F.col("t") * 1000 + n % 77 * 10_000).alias("processed"), (F.col("t") * 1000 + n % 77 * 10_000 + n % 13 * 1_000).alias("decided"), F.floor(n / 3).alias("sequence"))


def message_latencies(spark, sf_dir):
    m = C.latencies(_messages(spark, sf_dir), "source", "asset", "receive", ["server", "receive", "processed", "decided"], "sequence", 500.0)
    return m.groupBy("source").agg(F.count("*").alias("n"), F.count(F.when(F.col("stale"), 1)).alias("stale"), F.sum("sequence_gap").alias("skipped"), F.round(F.max("gap_ms"), 3).alias("max_gap"), F.round(F.avg("processed_ms"), 6).alias("queue"))


def latency_by_source(spark, sf_dir):
    m = C.latencies(_messages(spark, sf_dir), "source", "asset", "receive", ["server", "receive", "processed", "decided"], "sequence", 500.0)
    return C.latency_by_source(m, "source", ["receive_ms", "processed_ms", "decided_ms"]).select("source", "metric", "n", *_r("least", "mean", "p50", "p90", "p95", "p99", "most"))


def _published(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    t = k * 1_000_000
    return o.select(F.concat(F.lit("W"), F.col("o_custkey") % 30).alias("wallet"), F.when(k % 11 > 0, t).alias("t"), F.when(k % 3 > 0, t + (k % 50 - 5) * 1_000_000).alias("published"), (t + 60_000_000).alias("fetched"), F.concat(F.lit("x"), k).alias("tx"), F.lit("k").alias("key"))


def _visible(spark, sf_dir):
    groups = spark.createDataFrame([(f"w{i}", "above" if i % 2 else "below") for i in range(0, 30, 3)], "wallet string, grp string")
    return C.visibility(_published(spark, sf_dir), groups)


def visibility(spark, sf_dir):
    return _visible(spark, sf_dir).select("wallet", "grp", "tx", "sequence", "delay_status", "completeness", *_r("delay", "retrieval_lag"))


def timing_summary(spark, sf_dir):
    return C.timing_summary(_visible(spark, sf_dir), ["grp"], "delay").select("grp", "n", *_r("least", "median", "mean", "most"))


def _priced(spark, sf_dir):
    return quotes(spark, sf_dir).select("quote", "session", "market", "asset", "t", F.col("bid").alias("price"), "seconds_to_expiry")


def candidate_pool(spark, sf_dir):
    p = C.candidate_pool(_priced(spark, sf_dir), order="quote")
    return p.groupBy("session", "asset", "side", "bucket").agg(F.count("*").alias("n"), F.count(F.when(F.col("won"), 1)).alias("wins"), F.round(F.sum("pnl_after"), 6).alias("pnl_after"))


def trial_metrics(spark, sf_dir):
    p = C.candidate_pool(_priced(spark, sf_dir), order="quote").withColumn("trial", F.pmod(F.floor(F.col("t") / 1000), F.lit(5)))
    return C.trial_metrics(p, 10.0).select("trial", "n", "wins", *_r("pnl", "pnl_after", "expectancy", "win_rate", "per_hour"))


def _drawn(spark, sf_dir):
    pool = C.candidate_pool(_priced(spark, sf_dir), order="quote").withColumn("bucket", F.floor(F.col("bucket") / 120))
    entries = pool.filter("t % 97 = 0").select(F.concat_ws("|", "t", "market", "side").alias("entry"), "session", "asset", "side", "bucket")
    return D.redrawn(entries, pool, "entry", ["session", "asset", "side", "bucket"], ["market", "side"], "t", "exit_at", 4)


def random_baseline(spark, sf_dir):
    return D.baseline_metrics(_drawn(spark, sf_dir), "trial", ["t", "market", "side"], 10.0).select("trial", "n", "wins", *_r("pnl", "pnl_after", "expectancy", "win_rate", "per_hour", "max_drawdown"))


def signal_labels(spark, sf_dir):
    q = _priced(spark, sf_dir)
    signals = q.filter("price < 0.205").select(F.col("quote").alias("signal"), "market", F.when(F.col("quote") % 2 == 0, "UP").otherwise("DOWN").alias("direction"), "t", "seconds_to_expiry", "price")
    rows = C.label_rows(signals, q)
    return rows.select("signal", "market", "side", "observations", "reason", "won", *_r("entry", "mfe", "mae", "pnl", "pnl_after"))


def wallet_manifest(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("W"), F.col("c_custkey")).alias("wallet"), (F.col("c_custkey") % 17).alias("priority"))
    return C.wallet_manifest(c.filter("priority = 5"), c, 60)


def chronological_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return C.chronological_split(o, ["o_orderdate", "o_orderkey"]).groupBy("part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def _raw_positions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select((F.col("o_custkey") % 50).alias("wallet"), k.alias("position"), F.when(k % 2 == 0, "Bitcoin").otherwise("Rain").alias("title"), F.when(k % 3 == 0, "").otherwise("x-5m").alias("slug"), F.lit("eth-5m").alias("event_slug"), F.when(k % 7 == 0, "n/a").otherwise((k % 100 / 100).cast("string")).alias("avg_price"), F.when(k % 2 == 0, "1").otherwise("0.5").alias("cur_price"), F.when(k % 5 == 0, "0").otherwise((k % 90).cast("string")).alias("total_bought"), F.lit("0").alias("size"), F.lit("3").alias("initial_value"), (k % 9 - 4).cast("string").alias("realized_pnl"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("active").alias("status"), F.when(k % 4 == 0, "Yes").otherwise("down").alias("outcome"))


def normalised_positions(spark, sf_dir):
    return C.normalised_positions(_raw_positions(spark, sf_dir)).select("position", "market_type", "exposure", "cheap", *_r("avg_price", "visible_size"))


def wallet_snapshot(spark, sf_dir):
    w = C.wallet_snapshot(C.normalised_positions(_raw_positions(spark, sf_dir)))
    return w.select("wallet", "active", "closed", "btc", "eth", "fast", "other", "yes", "no", "cheap", "resolution_like", *_r("total_pnl", "biggest_win", "mean_entry", "mean_exit"))


def text_helpers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", X.fixed(k / 3, 3).alias("fixed"), X.epoch_iso(k * 1000).alias("iso"), X.five_minute_market(F.when(k % 5 == 0, "TRUE").when(k % 5 == 1, "no"), F.when(k % 2 == 0, "a-5m-1").otherwise("b")).alias("five"), X.canonical_json("o_orderstatus", "o_orderkey").alias("json"))


def score_decisions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    d = X.decision(F.when(F.col("l_linenumber") > 3, "YES"), F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_linenumber") + 5)
    return lines.groupBy(d["action"].alias("action"), d["side"].alias("side"), d["reason"].alias("reason")).agg(F.count("*").alias("n"))


MESSAGES = f"{E}, ms AS (SELECT 's' || (user_id % 4) AS source, user_id % 3 AS asset, t, t * 1000 AS receive, event_id % 900 AS a, event_id % 77 * 10000 / 1e6 AS b, event_id % 13 * 1000 / 1e6 AS c, event_id // 3 AS sq FROM e)"
POOL = f"""{QUOTES}, pr AS (SELECT quote, session, market, asset, t, bid AS p, seconds_to_expiry AS x FROM qs), pe AS (SELECT pr.*, side, t + least(180, floor(x) - 1)::BIGINT * 1000000 AS z FROM pr, (VALUES ('YES'), ('NO')) s(side) WHERE x >= 20),
pm AS (SELECT pe.quote, pe.session, pe.market, pe.asset, pe.side, pe.t, pe.x, q.t AS tt, CASE WHEN side = 'YES' THEN q.p - pe.p ELSE pe.p - q.p END AS mv FROM pe JOIN pr q ON pe.market = q.market AND q.t > pe.t AND q.t <= z),
ph AS (SELECT quote, session, market, asset, side, t, x, min(tt) FILTER (mv >= 0.03 - 1e-12) AS h, min_by(mv, tt) FILTER (mv >= 0.03 - 1e-12) AS hm, min(tt) FILTER (mv <= -0.03 + 1e-12) AS l, min_by(mv, tt) FILTER (mv <= -0.03 + 1e-12) AS lm, max(tt) AS z, max_by(mv, tt) AS zm, count(*) AS n, max(mv) AS up, min(mv) AS dn FROM pm GROUP BY ALL),
po AS (SELECT *, h IS NOT NULL AND (l IS NULL OR h <= l) AS won, CASE WHEN h IS NOT NULL AND (l IS NULL OR h <= l) THEN hm WHEN l IS NOT NULL THEN lm ELSE zm END AS pnl FROM ph)"""
VISIBLE = "pv AS (SELECT 'w' || (o_custkey % 30) AS wallet, CASE WHEN o_custkey % 30 % 2 = 1 THEN 'above' ELSE 'below' END AS grp, o_orderkey AS k, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey END AS t, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey + o_orderkey % 50 - 5 END AS p, o_orderkey + 60 AS f FROM orders WHERE o_custkey % 30 % 3 = 0), vv AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY t NULLS LAST, 'x' || k) AS sequence, CASE WHEN p >= t THEN p - t END AS delay FROM pv)"


def _redraw_sql(rounds: int = 14) -> str:
    """The rounds of `redrawn` one after the other; the last find nothing left to draw."""
    stratum = "session, asset, side, bucket"
    steps = [
        "pool AS (SELECT session, asset, side, floor(floor(x / 60) * 60 / 120)::BIGINT AS bucket, market, t, CASE WHEN won THEN h WHEN l IS NOT NULL THEN l ELSE z END AS z, pnl, won FROM po)",
        f"pl AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {stratum}, market, t, z) - 1 AS place FROM pool)",
        f"bo AS (SELECT {stratum}, min(place) AS low, count(*) AS n FROM pl GROUP BY ALL)",
        f"p0 AS MATERIALIZED (SELECT trial, t || '|' || market || '|' || side AS entry, low, n FROM pool JOIN bo USING ({stratum}), range(1, 5) g(trial) WHERE t % 97 = 0)",
        "t0 AS MATERIALIZED (SELECT trial, entry, low, n, market, side, t, z, pnl, won FROM p0, pl WHERE false)",
    ]
    for i in range(rounds):
        steps += [
            f"d{i} AS MATERIALIZED (SELECT trial, entry, low, n, market, side, t, z, pnl, won FROM p{i} JOIN pl ON place = low + floor(('0x' || substr(sha256('1|' || trial || '|' || entry || '|{i}'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 * n)::BIGINT)",
            f"r{i} AS (SELECT *, false AS had FROM d{i} UNION ALL SELECT *, true FROM t{i})",
            f"w{i} AS (SELECT *, max(CASE WHEN had THEN z END) OVER e AS until, max(CASE WHEN had THEN t END) OVER e AS since, min(CASE WHEN had THEN t END) OVER (PARTITION BY trial, market, side ORDER BY t RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM r{i} WINDOW e AS (PARTITION BY trial, market, side ORDER BY t RANGE UNBOUNDED PRECEDING))",
            f"c{i} AS (SELECT *, coalesce(until > t, false) OR coalesce(since = t, false) OR coalesce(following < z, false) AS clash FROM w{i} WHERE NOT had)",
            f"o{i} AS (SELECT *, coalesce(t >= max(z) OVER f AND t > max(t) OVER f, true)::INTEGER AS opens FROM c{i} WINDOW f AS (PARTITION BY trial, market, side, clash ORDER BY t, z, entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
            f"k{i} AS (SELECT *, sum(opens) OVER (PARTITION BY trial, market, side, clash ORDER BY t, z, entry ROWS UNBOUNDED PRECEDING) AS cluster FROM o{i})",
            f"f{i} AS MATERIALIZED (SELECT *, NOT clash AND entry = min(entry) OVER (PARTITION BY trial, market, side, clash, cluster) AS taken FROM k{i})",
            f"t{i + 1} AS MATERIALIZED (SELECT * FROM t{i} UNION ALL SELECT trial, entry, low, n, market, side, t, z, pnl, won FROM f{i} WHERE taken)",
            f"p{i + 1} AS MATERIALIZED (SELECT trial, entry, low, n FROM f{i} WHERE NOT taken)",
        ]
    return "WITH " + POOL + ",\n" + ",\n".join(steps) + f""",
eq AS (SELECT *, sum(pnl - 0.01) OVER (PARTITION BY trial ORDER BY t, market, side) AS e FROM t{rounds}), dd AS (SELECT *, greatest(0, max(e) OVER (PARTITION BY trial ORDER BY t, market, side)) - e AS d FROM eq)
SELECT trial::INTEGER AS trial, count(*) AS n, count(*) FILTER (won) AS wins, round(sum(pnl), 6) AS pnl, round(sum(pnl - 0.01), 6) AS pnl_after, round(avg(pnl - 0.01), 6) AS expectancy, round(count(*) FILTER (won) / count(*), 6) AS win_rate, round(count(*) / 10.0, 6) AS per_hour, round(max(d), 6) AS max_drawdown FROM dd GROUP BY 1"""


CAPTURE = {
    "random_baseline": (random_baseline, _redraw_sql()),
    "baselines": (baselines, f"WITH {E} SELECT event_id, round(value - first_value(value) OVER (PARTITION BY user_id ORDER BY t), 6) AS from_baseline FROM e"),
    "rollover_baselines": (rollover_baselines, f"WITH {E}, r AS (SELECT *, user_id % 3 AS a, t // 86400000000 AS m FROM e) SELECT event_id, round(value - first_value(value) OVER (PARTITION BY a, m ORDER BY t), 6) AS from_baseline FROM r"),
    "sessions_until": (sessions_until, f"WITH {E} SELECT t // 86400000000 AS session, count(*) AS n FROM e GROUP BY 1 HAVING max(t) <= 1705000000000000"),
    "message_latencies": (message_latencies, f"WITH {MESSAGES}, g AS (SELECT *, (receive - lag(receive) OVER (PARTITION BY source ORDER BY receive)) / 1e6 AS gap, greatest(0, coalesce(sq - lag(sq) OVER (PARTITION BY source, asset ORDER BY receive) - 1, 0)) AS sk FROM ms) SELECT source, count(*) AS n, count(*) FILTER (a > 500) AS stale, sum(sk)::BIGINT AS skipped, round(max(gap), 3) AS max_gap, round(avg(b), 6) AS queue FROM g GROUP BY 1"),
    "latency_by_source": (latency_by_source, f"WITH {MESSAGES}, u AS (SELECT source, 'receive_ms' AS metric, a::DOUBLE AS x FROM ms UNION ALL SELECT source, 'processed_ms', b FROM ms UNION ALL SELECT source, 'decided_ms', c FROM ms) SELECT source, metric, count(*) AS n, round(min(x), 6) AS least, round(avg(x), 6) AS mean, round(quantile_disc(x, 0.5), 6) AS p50, round(quantile_disc(x, 0.9), 6) AS p90, round(quantile_disc(x, 0.95), 6) AS p95, round(quantile_disc(x, 0.99), 6) AS p99, round(max(x), 6) AS most FROM u GROUP BY 1, 2"),
    "visibility": (visibility, f"WITH {VISIBLE} SELECT wallet, grp, 'x' || k AS tx, sequence, CASE WHEN p IS NULL OR t IS NULL THEN 'unknown_missing_publication_timestamp' WHEN p < t THEN 'invalid_publication_precedes_trade' ELSE 'measured_trade_to_publication' END AS delay_status, (t IS NOT NULL)::INTEGER + (p IS NOT NULL)::INTEGER + 1 AS completeness, round(delay, 6) AS delay, round(f - t, 6) AS retrieval_lag FROM vv"),
    "timing_summary": (timing_summary, f"WITH {VISIBLE} SELECT grp, count(delay) AS n, round(min(delay), 6) AS least, round(quantile_cont(delay, 0.5), 6) AS median, round(avg(delay), 6) AS mean, round(max(delay), 6) AS most FROM vv GROUP BY 1"),
    "candidate_pool": (candidate_pool, f"WITH {POOL} SELECT session, asset, side, (floor(x / 60) * 60)::INTEGER AS bucket, count(*) AS n, count(*) FILTER (won) AS wins, round(sum(pnl - 0.01), 6) AS pnl_after FROM po GROUP BY 1, 2, 3, 4"),
    "trial_metrics": (trial_metrics, f"WITH {POOL} SELECT t // 1000 % 5 AS trial, count(*) AS n, count(*) FILTER (won) AS wins, round(sum(pnl), 6) AS pnl, round(sum(pnl - 0.01), 6) AS pnl_after, round(avg(pnl - 0.01), 6) AS expectancy, round(count(*) FILTER (won) / count(*), 6) AS win_rate, round(count(*) / 10.0, 6) AS per_hour FROM po GROUP BY 1"),
    "signal_labels": (signal_labels, f"""WITH RECURSIVE {POOL}, sl AS (SELECT po.*, CASE WHEN won THEN h WHEN l IS NOT NULL THEN l ELSE z END AS ea, pr.p FROM po JOIN pr USING (quote) WHERE pr.p < 0.205 AND (side = 'YES') = (quote % 2 = 0)), so AS (SELECT *, row_number() OVER (PARTITION BY market, side ORDER BY t, quote) AS i FROM sl),
sa AS (SELECT market, side, i, ea AS over, true AS taken FROM so WHERE i = 1 UNION ALL SELECT so.market, so.side, so.i, CASE WHEN so.t >= sa.over THEN so.ea ELSE sa.over END, so.t >= sa.over FROM sa JOIN so ON so.market = sa.market AND so.side = sa.side AND so.i = sa.i + 1)
SELECT quote AS signal, market, side, n AS observations, CASE WHEN won THEN 'repricing_target' WHEN l IS NOT NULL THEN 'stop_loss' ELSE 'timeout' END AS reason, won, round(CASE WHEN side = 'YES' THEN p ELSE 1 - p END, 6) AS entry, round(greatest(0, up), 6) AS mfe, round(least(0, dn), 6) AS mae, round(pnl, 6) AS pnl, round(pnl - 0.01, 6) AS pnl_after FROM so JOIN sa USING (market, side, i) WHERE taken"""),
    "wallet_manifest": (wallet_manifest, "WITH c AS (SELECT 'w' || c_custkey AS wallet, c_custkey % 17 AS p FROM customer), r AS (SELECT wallet, CASE WHEN p = 5 THEN 0 ELSE 1 END AS o, p FROM c) SELECT row_number() OVER (ORDER BY o, p, wallet) - 1 AS place, wallet, CASE o WHEN 0 THEN 'seed' ELSE 'discovered' END AS origin FROM r QUALIFY place < 60"),
    "chronological_split": (chronological_split, "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT CASE WHEN i < floor(n * 0.7) THEN 'train' ELSE 'test' END AS part, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM o GROUP BY 1"),
    "normalised_positions": (normalised_positions, "SELECT o_orderkey AS position, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 'fast_crypto' ELSE 'weather' END AS market_type, CASE WHEN o_orderkey % 2 = 0 THEN 'BTC' WHEN o_orderkey % 3 = 0 THEN 'ETH' ELSE 'OTHER' END AS exposure, o_orderkey % 7 > 0 AND o_orderkey % 100 / 100 <= 0.2 AS cheap, CASE WHEN o_orderkey % 7 > 0 THEN round(o_orderkey % 100 / 100, 6) END AS avg_price, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 90 = 0 THEN 3.0 ELSE (o_orderkey % 90)::DOUBLE END AS visible_size FROM orders"),
    "wallet_snapshot": (wallet_snapshot, "WITH o AS (SELECT o_custkey % 50 AS wallet, o_orderkey AS k, o_orderstatus = 'F' AS c FROM orders) SELECT wallet, count(*) FILTER (NOT c) AS active, count(*) FILTER (c) AS closed, count(*) FILTER (k % 2 = 0) AS btc, count(*) FILTER (k % 2 = 1 AND k % 3 = 0) AS eth, count(*) FILTER (k % 2 = 0 OR k % 3 = 0) AS fast, count(*) FILTER (k % 2 = 1 AND k % 3 > 0) AS other, count(*) FILTER (k % 4 = 0) AS yes, count(*) FILTER (k % 4 > 0) AS no, count(*) FILTER (k % 7 > 0 AND k % 100 <= 20) AS cheap, count(*) FILTER (c AND k % 2 = 0) AS resolution_like, round(sum(k % 9 - 4), 6) AS total_pnl, round(max(k % 9 - 4), 6) AS biggest_win, round(avg(k % 100 / 100) FILTER (k % 7 > 0), 6) AS mean_entry, round(avg(CASE WHEN k % 2 = 0 THEN 1 ELSE 0.5 END) FILTER (c), 6) AS mean_exit FROM o GROUP BY 1"),
    "text_helpers": (text_helpers, "SELECT o_orderkey, printf('%.3f', o_orderkey / 3) AS fixed, strftime(make_timestamp(o_orderkey * 1000 * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS iso, CASE WHEN o_orderkey % 5 = 0 THEN true WHEN o_orderkey % 5 = 1 THEN false ELSE o_orderkey % 2 = 0 END AS five, '{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}' AS json FROM orders"),
    "score_decisions": (score_decisions, """WITH l AS (SELECT CASE WHEN l_linenumber > 3 THEN 'YES' END AS o, l_quantity / 50 AS s, l_discount * 10 AS r, l_tax * 10 AS p, l_linenumber + 5 AS h FROM lineitem), d AS (SELECT *, CASE WHEN o IS NULL AND s > 0.7 THEN 'edge_score_above_threshold' WHEN o IS NULL THEN 'no_entry' WHEN s < 0.4 THEN 'score_below_exit' WHEN abs(r - p) <= 0.02 THEN 'convergence' WHEN h >= 10 THEN 'timeout' ELSE 'position_open' END AS reason FROM l),
a AS (SELECT *, CASE WHEN reason = 'edge_score_above_threshold' THEN 'OPEN' WHEN reason IN ('no_entry', 'position_open') THEN 'HOLD' ELSE 'CLOSE' END AS action FROM d) SELECT action, CASE WHEN action = 'OPEN' THEN CASE WHEN r > p THEN 'YES' ELSE 'NO' END ELSE o END AS side, reason, count(*) AS n FROM a GROUP BY 1, 2, 3"""),
}
