"""Replays of sessions made of `events`: a session, asset and market from the user, a day as the time of a poll."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import replays as R
from ..storage import shared_path
from ..streaming import positions as P
from ..streaming import replay as S
from .stream_queries import replayed
from .time_queries import HOUR, events

DAY = 24 * HOUR


def _session_events(e: DataFrame) -> DataFrame:
    """EVENT rows of event_id, user_id, t, value, event_type: within a day, references and market descriptions come first."""
    k, kind = F.col("event_id"), F.col("event_type")
    day = F.floor(F.col("t") / DAY).cast("long")
    first = kind.isin("view", "signup")
    snapshot = kind.isin("click", "purchase")
    yes = F.lit(0.5) + (k % 41 - 20) / F.lit(1000)
    columns = {
        "session": F.concat(F.lit("s"), F.col("user_id") % 5),
        "n": (day * 2 + F.when(first, 0).otherwise(1)) * F.lit(10**12) + k,
        "t": day * DAY,
        "kind": F.when(kind == "view", R.REFERENCE).when(kind == "signup", R.LIFECYCLE).when(snapshot, R.SNAPSHOT).otherwise(R.SKIP),
        "asset": F.concat(F.lit("a"), F.col("user_id") % 3),
        "market": F.when(kind != "view", F.concat(F.lit("m"), F.col("user_id"))),
        "question": F.when(kind == "signup", F.concat(F.lit("q"), F.col("user_id"))),
        "current": F.when(kind == "signup", F.when(k % 4 == 0, "closed").otherwise("active")),
        "source": F.when(kind == "view", F.when(k % 50 == 0, "mock").otherwise("live")),
        "price": F.when(kind == "view", F.lit(1000.0) + F.col("value") / 100),
        "yes": F.when(snapshot, yes),
        "bid": F.when(snapshot, yes - 0.01),
        "ask": F.when(snapshot, yes + 0.01),
        "liquidity": F.when(snapshot, (300 + k % 2000).cast("double")),
        "seconds_left": F.when(snapshot, (k % 301).cast("double")),
        "reason": F.when(kind == "error", F.when(k % 3 == 0, "polymarket_quote_error").otherwise("confidence_below_threshold")),
        "mode": F.lit("public"),
    }
    return e.select(*[columns.get(c.split()[0], F.lit(None)).cast(c.split()[1]).alias(c.split()[0]) for c in R.EVENT.split(", ")])


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session_events(events(spark, sf_dir, "event_type"))


def _shown(out: DataFrame) -> DataFrame:
    return out.select("session", "n", "market", "question", "kind", "reason", "direction", "external_change", "market_change", "lag_score", "confidence")


def session_replay(spark, sf_dir):
    # A market's events are sorted by stretches of about ten days.
    return _shown(R.replay(_recorded(spark, sf_dir), bucket=20 * 10**12))


def bundle_replay(spark, sf_dir):
    return _shown(R.replay_bundle(_recorded(spark, sf_dir)))


def session_report(spark, sf_dir):
    e = _recorded(spark, sf_dir)
    out = R.replay_report(e, R.replay(e, bucket=20 * 10**12), 3)
    return out.select("session", *R.COUNTERS, "mode", "fallback", "markets", "completed", "opportunities", "skipped", "opportunity_rate", "reference_coverage", "data_gap")


def stream_replay(spark, sf_dir):
    S.with_maps(spark)
    e = _session_events(replayed(spark, sf_dir, "event_type"))
    out = P.run_to_table(S.stream_replay(e, keep=40 * DAY), shared_path(spark, "replay"), shared_path(spark, "replay-state"))
    return _shown(out)


_EVENTS = f"""x AS (SELECT 's' || user_id % 5 AS session, 'a' || user_id % 3 AS asset, 'm' || user_id AS market, 'q' || user_id AS question, event_id, event_type AS kind, value,
    epoch_us(ts) // {DAY} AS d, epoch_us(ts) // {DAY} * {DAY} AS t, 0.5 + (event_id % 41 - 20) / 1000 AS yes, (300 + event_id % 2000)::DOUBLE AS liq, (event_id % 301)::DOUBLE AS s FROM events),
e AS (SELECT *, (d * 2 + CASE WHEN kind IN ('view', 'signup') THEN 0 ELSE 1 END) * 1000000000000 + event_id AS n FROM x),
rf AS (SELECT session, asset, t, max_by(1000.0 + value / 100, n) AS price, max_by(CASE WHEN event_id % 50 = 0 THEN 'mock' ELSE 'live' END, n) AS source FROM e WHERE kind = 'view' GROUP BY 1, 2, 3),
rg AS (SELECT session, market, min(n) AS reg, min_by(t, n) AS discovered FROM e WHERE kind = 'signup' GROUP BY 1, 2),
sn AS (SELECT e.session, e.n, e.t, e.market, e.asset, e.yes, e.liq, e.s, rf.price, rf.source, coalesce(rg.reg < e.n, false) AS known, e.question AS q FROM e LEFT JOIN rf USING (session, asset, t) LEFT JOIN rg USING (session, market) WHERE e.kind IN ('click', 'purchase'))"""


def _measure_sql(rows: str) -> str:
    """`f`, the rows with their measurement: price, price0, yes, yes0, liq, s."""
    return f"""m0 AS (SELECT *, price / price0 - 1 AS c, yes - yes0 AS m, (yes + 0.01) - (yes - 0.01) AS sp FROM {rows}), m1 AS (SELECT *, c * 10000 AS bps, least(0.30, abs(c * 10000) / 1000) AS xp FROM m0),
m2 AS (SELECT *, CASE WHEN bps >= 4 THEN 'UP' WHEN bps <= -4 THEN 'DOWN' ELSE 'NONE' END AS direction FROM m1),
m3 AS (SELECT *, CASE WHEN xp > 0 THEN greatest(0.0, CASE WHEN direction = 'UP' THEN m ELSE -m END) / nullif(xp, 0.0) ELSE 1.0 END AS r, least(1.0, abs(bps) / 16) AS st FROM m2), m4 AS (SELECT *, greatest(0.0, 1 - r) * st AS score FROM m3),
m5 AS (SELECT *, greatest(0.0, least(1.0, 0.70 * score + 0.20 * st + 0.10 * (1 - least(1.0, sp / 0.10)))) AS conf FROM m4),
f AS (SELECT *, CASE WHEN liq < 500 THEN 'liquidity_below_minimum' WHEN s < 20 THEN 'near_expiry_insufficient_time' WHEN direction = 'NONE' THEN 'external_move_below_threshold' WHEN r >= 0.65 THEN 'polymarket_already_repriced' WHEN conf < 0.55 THEN 'confidence_below_threshold' ELSE 'qualified_external_move_not_repriced' END AS reason0 FROM m5)"""


_FIELDS = "round(c, 8) + 0.0 AS external_change, round(m, 8) + 0.0 AS market_change, round(score, 6) + 0.0 AS lag_score, round(conf, 6) + 0.0 AS confidence"
_NONE = "NULL::VARCHAR AS direction, NULL::DOUBLE AS external_change, NULL::DOUBLE AS market_change, NULL::DOUBLE AS lag_score, NULL::DOUBLE AS confidence"
_REPLAY = f"""{_EVENTS},
mt AS (SELECT *, lag(source) OVER w AS was FROM sn WHERE known AND price IS NOT NULL WINDOW w AS (PARTITION BY session, market ORDER BY n)),
bs AS (SELECT *, last_value(CASE WHEN was IS NULL OR was <> source THEN struct_pack(price := price, yes := yes) END IGNORE NULLS) OVER (PARTITION BY session, market ORDER BY n) AS b FROM mt),
bb AS (SELECT *, b.price AS price0, b.yes AS yes0 FROM bs), {_measure_sql("bb")},
g AS (SELECT *, coalesce(was <> source, false) AS changed, CASE WHEN reason0 = 'qualified_external_move_not_repriced' AND s < 60 THEN 'late_entry_window' ELSE reason0 END AS reason1 FROM f),
h AS (SELECT *, NOT changed AND reason1 = 'qualified_external_move_not_repriced' AS good FROM g), i AS (SELECT *, good AND n = min(CASE WHEN good THEN n END) OVER (PARTITION BY session, market) AS first FROM h),
rp AS (SELECT session, n, market, q AS question, CASE WHEN first THEN 'opportunity' ELSE 'skipped' END AS kind, CASE WHEN changed THEN 'reference_source_changed:' || was || '->' || source WHEN good AND NOT first THEN 'duplicate_opportunity_suppressed' ELSE reason1 END AS reason,
    CASE WHEN NOT changed THEN direction END AS direction, CASE WHEN NOT changed THEN round(c, 8) + 0.0 END AS external_change, CASE WHEN NOT changed THEN round(m, 8) + 0.0 END AS market_change, CASE WHEN NOT changed THEN round(score, 6) + 0.0 END AS lag_score, CASE WHEN NOT changed THEN round(conf, 6) + 0.0 END AS confidence FROM i
  UNION ALL SELECT session, n, market, CASE WHEN known THEN q END, 'skipped', CASE WHEN known THEN 'missing_reference_price' ELSE 'market_not_registered' END, {_NONE} FROM sn WHERE NOT known OR price IS NULL
  UNION ALL SELECT session, n, market, NULL, 'skipped', 'polymarket_quote_error', {_NONE} FROM e WHERE kind = 'error' AND event_id % 3 = 0)"""
_SESSION_REPLAY = f"WITH {_REPLAY} SELECT * FROM rp"

REPLAYS = {
    "session_replay": (session_replay, _SESSION_REPLAY),
    "stream_replay": (stream_replay, _SESSION_REPLAY),
    "bundle_replay": (
        bundle_replay,
        f"""WITH {_EVENTS}, mt AS (SELECT * FROM sn WHERE price IS NOT NULL),
fa AS (SELECT session, asset, arg_min(price, (t, market, n)) AS price0 FROM mt GROUP BY 1, 2), fm AS (SELECT session, market, arg_min(yes, (t, market, n)) AS yes0 FROM mt GROUP BY 1, 2),
bb AS (SELECT * FROM mt JOIN fa USING (session, asset) JOIN fm USING (session, market)), {_measure_sql("bb")}
SELECT session, n, market, CASE WHEN EXISTS (SELECT 1 FROM rg WHERE rg.session = f.session AND rg.market = f.market) THEN q END AS question, CASE WHEN reason0 = 'qualified_external_move_not_repriced' THEN 'opportunity' ELSE 'skipped' END AS kind, reason0 AS reason, direction, {_FIELDS} FROM f
UNION ALL SELECT session, n, market, CASE WHEN EXISTS (SELECT 1 FROM rg WHERE rg.session = sn.session AND rg.market = sn.market) THEN q END, 'skipped', 'missing_reference_price', {_NONE} FROM sn WHERE price IS NULL""",
    ),
    "session_report": (
        session_report,
        f"""WITH {_REPLAY},
st AS (SELECT e.session, e.market, max_by(CASE WHEN event_id % 4 = 0 THEN 'closed' ELSE 'active' END, n) AS state FROM e JOIN rg USING (session, market) WHERE kind = 'signup' AND n >= reg GROUP BY 1, 2),
se AS (SELECT session, market, count(*) AS snapshots FROM sn WHERE known GROUP BY 1, 2),
mk AS (SELECT session, count(*) AS markets, count(*) FILTER (state = 'closed' AND snapshots > 0) AS completed FROM rg LEFT JOIN st USING (session, market) LEFT JOIN se USING (session, market) GROUP BY 1),
fo AS (SELECT session, count(*) FILTER (kind = 'opportunity') AS opportunities, count(*) FILTER (kind = 'skipped') AS skipped FROM rp GROUP BY 1),
ct AS (SELECT session, 3 * count(DISTINCT CASE WHEN kind IN ('view', 'click', 'purchase') OR (kind = 'error' AND event_id % 3 = 0) THEN t END) AS a, count(*) FILTER (kind = 'view') AS b, count(*) FILTER (kind IN ('click', 'purchase') OR (kind = 'error' AND event_id % 3 = 0)) AS c, count(*) FILTER (kind IN ('click', 'purchase')) AS d,
  count(*) FILTER (kind = 'view' AND event_id % 50 = 0) AS mock FROM e GROUP BY 1)
SELECT session, a AS expected_reference_points, b AS successful_reference_points, c AS expected_market_points, d AS successful_market_points, NULL::VARCHAR AS mode, 'inferred_counters_missing_session_completed' AS fallback,
  coalesce(markets, 0) AS markets, coalesce(completed, 0) AS completed, coalesce(opportunities, 0) AS opportunities, coalesce(skipped, 0) AS skipped, CASE WHEN completed > 0 THEN round(opportunities / completed, 6) ELSE 0.0 END AS opportunity_rate,
  CASE WHEN a > 0 THEN round(100 * (b / a), 4) ELSE 0.0 END AS reference_coverage, round(100 * (1 - CASE WHEN c > 0 THEN d / c ELSE 0.0 END), 4) AS data_gap
FROM ct LEFT JOIN mk USING (session) LEFT JOIN fo USING (session)""",
    ),
}
