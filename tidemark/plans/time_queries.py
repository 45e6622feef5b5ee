"""Queries over `events` as a price series: user_id is the market, ts the time, value the price.

Times are microseconds and floats are rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import quantiles as Q
from ..operators import asof, paths, ranks, series

HOUR = 3_600_000_000
#: The stretch of time that a hot key's history is sorted in.
BUCKET = 7 * 24 * HOUR


def events(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", X.micros("ts").alias("t"), "value", *more)


def _r(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


E = "e AS (SELECT event_id, user_id, epoch_us(ts) AS t, value, event_type, props FROM events)"


def _asof(direction: str, tolerance: int | None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = events(spark, sf_dir, "event_type")
        left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "t")
        right = e.filter("event_type = 'view'").select("user_id", "t", "value")
        return asof.asof_join(left, right, "user_id", "t", direction=direction, tolerance=tolerance, bucket=BUCKET).select("event_id", "right_t", *_r("right_value"))

    return query


def _asof_sql(direction: str, tolerance: int | None) -> str:
    near = f" AND abs(p.t - v.t) <= {tolerance}" if tolerance else ""
    rank = {"backward": "v.t DESC", "forward": "v.t", "nearest": "abs(p.t - v.t), v.t"}[direction]
    side = {"backward": " AND v.t <= p.t", "forward": " AND v.t >= p.t", "nearest": ""}[direction]
    return f"""WITH {E}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), v AS (SELECT * FROM e WHERE event_type = 'view'),
j AS (SELECT p.event_id, v.t AS right_t, v.value AS right_value, row_number() OVER (PARTITION BY p.event_id ORDER BY {rank}) AS n
      FROM p JOIN v ON p.user_id = v.user_id{side}{near})
SELECT p.event_id, j.right_t, round(j.right_value, 6) AS right_value FROM p LEFT JOIN j ON p.event_id = j.event_id AND j.n = 1"""


#: Views reach the series up to two days after their time, so it isn't sorted by time.
_ARRIVAL = f"t + (event_id * 7919) % 48 * {HOUR}"


def _arrived(tolerance: int | None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = events(spark, sf_dir, "event_type")
        left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "t")
        right = e.filter("event_type = 'view'").select("user_id", "t", "value", F.expr(_ARRIVAL).alias("arrival"))
        return asof.last_arrived(left, right, "user_id", "t", "arrival", tolerance=tolerance, bucket=BUCKET).select("event_id", "right_t", "right_arrival", *_r("right_value"))

    return query


def _arrived_sql(tolerance: int | None) -> str:
    fresh = f" AND j.t - j.right_t <= {tolerance}" if tolerance else ""
    return f"""WITH {E}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), v AS (SELECT *, {_ARRIVAL} AS arrival FROM e WHERE event_type = 'view'),
j AS (SELECT p.event_id, p.t, v.t AS right_t, v.arrival AS right_arrival, v.value AS right_value, row_number() OVER (PARTITION BY p.event_id ORDER BY v.arrival DESC, v.t DESC, v.value DESC) AS n
      FROM p JOIN v ON p.user_id = v.user_id AND v.t <= p.t)
SELECT p.event_id, j.right_t, j.right_arrival, round(j.right_value, 6) AS right_value FROM p LEFT JOIN j ON p.event_id = j.event_id AND j.n = 1{fresh}"""


def k_return(spark, sf_dir):
    return asof.k_return(events(spark, sf_dir), "user_id", "t", "value", 6 * HOUR, 48 * HOUR, bucket=BUCKET).select("event_id", *_r("k_return"))


def level_change(spark, sf_dir):
    return asof.level_change(events(spark, sf_dir), "user_id", "t", "value", 6 * HOUR, bucket=BUCKET).select("event_id", *_r("level_change"))


def momentum(spark, sf_dir):
    return asof.momentum(events(spark, sf_dir), "user_id", "t", "value", 6 * HOUR, 24 * HOUR, bucket=BUCKET).select("event_id", *_r("momentum"))


def _past(ago: int, name: str) -> str:
    return f"{name} AS (SELECT a.event_id, max_by(b.value, b.t) AS past, max(b.t) AS past_t FROM e a JOIN e b ON a.user_id = b.user_id AND b.t <= a.t - {ago} GROUP BY 1)"


def realized_vol_range(spark, sf_dir):
    return series.realized_volatility(events(spark, sf_dir), "user_id", "t", "value", 24 * HOUR, bucket=BUCKET).select("event_id", *_r("volatility"))


def velocity_accel(spark, sf_dir):
    e = series.velocity(events(spark, sf_dir), "user_id", "t", "value", bucket=BUCKET)
    return series.acceleration(e, "user_id", "t", "value", bucket=BUCKET).select("event_id", *_r("velocity", "acceleration"))


def run_length(spark, sf_dir):
    return series.run_length(events(spark, sf_dir, "event_type"), "user_id", "t", "event_type", bucket=BUCKET).select("event_id", "run_length")


def time_since_change(spark, sf_dir):
    return series.time_since_change(events(spark, sf_dir, "event_type"), "user_id", "t", "event_type", bucket=BUCKET).select("event_id", *_r("since_change"))


def change_freq(spark, sf_dir):
    return series.change_frequency(events(spark, sf_dir, "event_type"), "user_id", "t", "event_type", 48 * HOUR, bucket=BUCKET).select("event_id", F.round(F.col("change_frequency") * 48 * 3600).cast("long").alias("changes"))


def resample_first(spark, sf_dir):
    return series.resampled(events(spark, sf_dir), "user_id", "t", 24 * HOUR).select("user_id", "bucket", "event_id")


def consecutive_dedupe(spark, sf_dir):
    return series.without_repeats(events(spark, sf_dir, "event_type"), "user_id", "t", "event_type", BUCKET).select("event_id")


def episodes(spark, sf_dir):
    return series.episodes(events(spark, sf_dir), "user_id", "t", F.col("value") > 10, 24 * HOUR, BUCKET).select("user_id", "start", "end", "observations", *_r("seconds"))


def gap_stats(spark, sf_dir):
    g = series.gaps(events(spark, sf_dir), "user_id", "t", bucket=BUCKET).filter("gap is not null")
    return g.groupBy("user_id").agg(F.count("*").alias("n"), *[F.round(f("gap"), 6).alias(k) for k, f in (("least", F.min), ("mean", F.avg), ("most", F.max))], F.round(Q.nearest_rank("gap", 0.95), 6).alias("p95"))


def sequence_numbers(spark, sf_dir):
    return series.numbered(events(spark, sf_dir), "user_id", "t", bucket=BUCKET).select("event_id", "number")


def drawdowns(spark, sf_dir):
    e = events(spark, sf_dir, "event_type").withColumn("pnl", F.when(F.col("event_type").isin("purchase", "signup"), F.col("value")).otherwise(-F.col("value")))
    return series.drawdowns(e, "user_id", "t", "pnl").select("user_id", *_r("drawdown_absolute", "drawdown_fraction", "drawdown_negative"))


def cross_asset_dispersion(spark, sf_dir):
    kinds = ["click", "error", "purchase", "signup", "view"]
    e = series.dispersion(events(spark, sf_dir, "event_type"), "user_id", "t", "event_type", "value", kinds, 48 * HOUR, BUCKET)
    return e.select("event_id", *_r("dispersion", "relative"))


def _kind_sql() -> str:
    kinds = ["click", "error", "purchase", "signup", "view"]
    last = ", ".join(f"last_value(CASE WHEN event_type = '{k}' THEN t END IGNORE NULLS) OVER w AS t{i}, last_value(CASE WHEN event_type = '{k}' THEN value END IGNORE NULLS) OVER w AS v{i}" for i, k in enumerate(kinds))
    fresh = ", ".join(f"CASE WHEN t - t{i} <= {48 * HOUR} THEN v{i} END" for i in range(len(kinds)))
    return f"""WITH {E}, l AS (SELECT event_id, t, value, {last} FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_type ROWS UNBOUNDED PRECEDING)),
f AS (SELECT event_id, value, list_filter([{fresh}], lambda x: x IS NOT NULL) AS f FROM l)
SELECT event_id, round(CASE WHEN len(f) >= 2 THEN list_max(f) - list_min(f) END, 6) AS dispersion, round(CASE WHEN len(f) >= 2 THEN value - list_sum(f) / len(f) END, 6) AS relative FROM f"""


def _entries(spark, sf_dir):
    e = events(spark, sf_dir, "event_type")
    return e.filter("event_type = 'purchase'").drop("event_type"), e.drop("event_type")


def mfe_mae(spark, sf_dir):
    entries, path = _entries(spark, sf_dir)
    return paths.excursions(entries, path, "user_id", "event_id", "t", "value", 24 * HOUR).select("event_id", "observations", *_r("mfe", "mae"))


def first_hit_exit(spark, sf_dir):
    entries, path = _entries(spark, sf_dir)
    return paths.first_hits(entries, path, "user_id", "event_id", "t", "value", 48 * HOUR, 20.0, 20.0).select("event_id", "exit_ts", *_r("exit_value"), "reason")


def horizon_move(spark, sf_dir):
    entries, path = _entries(spark, sf_dir)
    return paths.horizon_moves(entries, path, "user_id", "event_id", "t", "value", 12 * HOUR, 48 * HOUR).select("event_id", *_r("move"))


def passive_fill(spark, sf_dir):
    entries, path = _entries(spark, sf_dir)
    return paths.passive_fills(entries.withColumn("posted", F.col("value")), path, "user_id", "event_id", "t", "posted", "value", 24 * HOUR)


FUTURE = "f AS (SELECT p.event_id, p.t AS t0, p.value AS v0, x.t, x.value FROM e p JOIN e x ON p.event_type = 'purchase' AND p.user_id = x.user_id AND x.t > p.t AND x.t <= p.t + {h})"


def greedy_non_overlap(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("until", F.col("t") + 24 * HOUR)
    return paths.admitted(e, "user_id", "t", "until", "event_id").select("event_id", "user_id")


def ewma(spark, sf_dir):
    return series.ewma(events(spark, sf_dir), "user_id", "t", "value", 0.12).select("user_id", "t", *_r("ewma"))


def rolling_mean(spark, sf_dir):
    return series.rolling_mean(events(spark, sf_dir), "user_id", "t", "value", 12).select("event_id", *_r("rolling_mean"))


def percentile_rules(spark, sf_dir):
    e = events(spark, sf_dir, "event_type")
    q = ranks.quantiles(e, ["event_type"], "value", {"linear": ("linear", 0.95), "nearest": ("nearest_rank", 0.95), "truncated": ("truncated", 0.95)})
    return q.select("event_type", *_r("linear", "nearest", "truncated"))


def latency_distribution(spark, sf_dir):
    g = series.gaps(events(spark, sf_dir), "user_id", "t", "x", BUCKET).filter("x is not null")
    places = {f"p{int(100 * p)}": ("nearest_rank", p) for p in (0.5, 0.9, 0.95, 0.99)}
    plain = g.agg(F.count("*").alias("n"), F.round(F.min("x"), 6).alias("least"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.max("x"), 6).alias("most"))
    return plain.crossJoin(F.broadcast(ranks.quantiles(g, [], "x", places).select(*_r(*places))))  # two single rows


def json_extract_props(spark, sf_dir):
    e = events(spark, sf_dir, "event_type", "props").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def state_changes(spark, sf_dir):
    return series.state_changes(events(spark, sf_dir, "event_type"), "user_id", "t", "event_type").select("event_id", "previous", "event_type")


def early_late_decay(spark, sf_dir):
    return series.halves(events(spark, sf_dir), "user_id", "t", "value").select("user_id", *_r("early", "late", "decay"))


def lagged_signal(spark, sf_dir):
    return series.lagged_signal(events(spark, sf_dir), "user_id", "t", "value", 3).select("event_id", *_r("lagged"))


def simultaneous_best(spark, sf_dir):
    return paths.simultaneous_best(events(spark, sf_dir), "user_id", "t", "value", "event_id").select("user_id", "event_id")


def equal_count_windows(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / (24 * HOUR)))
    return series.equal_count_windows(e, "day", 7).groupBy("window").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


def hash_uniform(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.round(X.hash_uniform("event_id", "user_id"), 6).alias("u"))


def sequence_gaps(spark, sf_dir):
    e = events(spark, sf_dir).filter("value > 5")
    return series.sequence_gaps(e.withColumn("all", F.lit(0)).select(F.floor(F.col("event_id") / 1000).alias("block"), "event_id"), "block", "event_id")


W = "WINDOW w AS (PARTITION BY user_id ORDER BY t)"
BATCH = {
    "asof_backward": (_asof("backward", None), _asof_sql("backward", None)),
    "asof_tolerance": (_asof("backward", 12 * HOUR), _asof_sql("backward", 12 * HOUR)),
    "asof_forward": (_asof("forward", 24 * HOUR), _asof_sql("forward", 24 * HOUR)),
    "asof_nearest": (_asof("nearest", 20 * HOUR), _asof_sql("nearest", 20 * HOUR)),
    "asof_arrival": (_arrived(None), _arrived_sql(None)),
    "asof_arrival_fresh": (_arrived(12 * HOUR), _arrived_sql(12 * HOUR)),
    "k_return": (k_return, f"WITH {E}, {_past(6 * HOUR, 'p')} SELECT e.event_id, round(CASE WHEN past > 0 AND (e.t - {6 * HOUR}) - past_t <= {48 * HOUR} THEN value / past - 1 END, 6) AS k_return FROM e LEFT JOIN p USING (event_id)"),
    "level_change": (level_change, f"WITH {E}, {_past(6 * HOUR, 'p')} SELECT e.event_id, round(value - past, 6) AS level_change FROM e LEFT JOIN p USING (event_id)"),
    "momentum": (momentum, f"WITH {E}, {_past(6 * HOUR, 'p')}, {_past(24 * HOUR, 'q')} SELECT e.event_id, round(CASE WHEN p.past > 0 THEN value / p.past - 1 END - CASE WHEN q.past > 0 THEN value / q.past - 1 END, 6) AS momentum FROM e LEFT JOIN p USING (event_id) LEFT JOIN q USING (event_id)"),
    "realized_vol_range": (realized_vol_range, f"""WITH {E}, r AS (SELECT a.event_id, b.t, CASE WHEN b.value > 0 THEN b.value END AS price, row_number() OVER (PARTITION BY a.event_id ORDER BY b.t) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND b.t BETWEEN a.t - {24 * HOUR} AND a.t),
g AS (SELECT event_id, price, CASE WHEN price > 0 AND lag(price) OVER (PARTITION BY event_id ORDER BY t) > 0 THEN ln(price / lag(price) OVER (PARTITION BY event_id ORDER BY t)) END AS g FROM r)
SELECT event_id, round(CASE WHEN count(price) >= 3 AND count(g) >= 2 THEN stddev_pop(g) END, 6) AS volatility FROM g GROUP BY 1"""),
    "velocity_accel": (velocity_accel, f"""WITH {E}, v AS (SELECT *, (t - lag(t) OVER w) / 1e6 AS d, CASE WHEN (t - lag(t) OVER w) > 0 THEN (value - lag(value) OVER w) / ((t - lag(t) OVER w) / 1e6) END AS v FROM e {W})
SELECT event_id, round(v, 6) AS velocity, round((v - lag(v) OVER w) / greatest(1e-9, d), 6) AS acceleration FROM v {W}"""),
    "run_length": (run_length, f"""WITH {E}, c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS c FROM e {W}), g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM c)
SELECT event_id, row_number() OVER (PARTITION BY user_id, g ORDER BY t) AS run_length FROM g"""),
    "time_since_change": (time_since_change, f"""WITH {E}, c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN t END AS c FROM e {W})
SELECT event_id, round((t - last_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)) / 1e6, 6) AS since_change FROM c"""),
    "change_freq": (change_freq, f"""WITH {E}, r AS (SELECT a.event_id, b.t, b.event_type, lag(b.event_type) OVER (PARTITION BY a.event_id ORDER BY b.t) AS p, row_number() OVER (PARTITION BY a.event_id ORDER BY b.t) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND b.t BETWEEN a.t - {48 * HOUR} AND a.t)
SELECT event_id, count(*) FILTER (n > 1 AND p <> event_type) AS changes FROM r GROUP BY 1"""),
    "resample_first": (resample_first, f"WITH {E} SELECT user_id, t // {24 * HOUR} * {24 * HOUR} AS bucket, min_by(event_id, t) AS event_id FROM e GROUP BY 1, 2"),
    "consecutive_dedupe": (consecutive_dedupe, f"WITH {E} SELECT event_id FROM e QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY t) IS DISTINCT FROM event_type"),
    "episodes": (episodes, f"""WITH {E}, h AS (SELECT *, value > 10 AS h, coalesce(lag(value > 10) OVER w AND t - lag(t) OVER w <= {24 * HOUR}, false) AS g FROM e {W}), o AS (SELECT *, sum(CASE WHEN h AND NOT g THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM h)
SELECT user_id, min(t) AS "start", max(t) AS "end", count(*) AS observations, round((max(t) - min(t)) / 1e6, 6) AS seconds FROM o WHERE h GROUP BY user_id, k"""),
    "gap_stats": (gap_stats, f"WITH {E}, g AS (SELECT user_id, (t - lag(t) OVER w) / 1e6 AS gap FROM e {W}) SELECT user_id, count(gap) AS n, round(min(gap), 6) AS least, round(avg(gap), 6) AS mean, round(max(gap), 6) AS most, round(quantile_disc(gap, 0.95), 6) AS p95 FROM g WHERE gap IS NOT NULL GROUP BY 1"),
    "sequence_numbers": (sequence_numbers, f"WITH {E} SELECT event_id, row_number() OVER w AS number FROM e {W}"),
    "drawdowns": (drawdowns, f"""WITH {E}, q AS (SELECT user_id, t, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE -value END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS q FROM e), p AS (SELECT *, max(q) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS p FROM q)
SELECT user_id, round(max(greatest(0, p) - q), 6) AS drawdown_absolute, round(coalesce(max(CASE WHEN p > 0 THEN (p - q) / p END), 0), 6) AS drawdown_fraction, round(min(q - p), 6) AS drawdown_negative FROM p GROUP BY 1"""),
    "cross_asset_dispersion": (cross_asset_dispersion, _kind_sql()),
    "mfe_mae": (mfe_mae, f"WITH {E}, {FUTURE.format(h=24 * HOUR)} SELECT event_id, count(*) AS observations, round(max(value - v0), 6) AS mfe, round(min(value - v0), 6) AS mae FROM f GROUP BY 1"),
    "first_hit_exit": (first_hit_exit, f"""WITH {E}, {FUTURE.format(h=48 * HOUR)}, h AS (SELECT event_id, min(CASE WHEN value - v0 >= 20 THEN t END) AS a, min(CASE WHEN value - v0 <= -20 THEN t END) AS b, max(t) AS z FROM f GROUP BY 1),
c AS (SELECT *, CASE WHEN a IS NOT NULL AND (b IS NULL OR a <= b) THEN a WHEN b IS NOT NULL THEN b ELSE z END AS x, CASE WHEN a IS NOT NULL AND (b IS NULL OR a <= b) THEN 'target' WHEN b IS NOT NULL THEN 'stop' ELSE 'timeout' END AS reason FROM h)
SELECT c.event_id, x AS exit_ts, round(f.value, 6) AS exit_value, reason FROM c JOIN f ON c.event_id = f.event_id AND f.t = c.x"""),
    "horizon_move": (horizon_move, f"WITH {E}, {FUTURE.format(h=48 * HOUR)} SELECT event_id, round(min_by(value - v0, t) FILTER (t >= t0 + {12 * HOUR}), 6) AS move FROM f GROUP BY 1"),
    "passive_fill": (passive_fill, f"WITH {E}, {FUTURE.format(h=24 * HOUR)} SELECT event_id, min(t) FILTER (value < v0) AS bid_fill_ts, min(t) FILTER (value > v0) AS ask_fill_ts FROM f GROUP BY 1"),
    "greedy_non_overlap": (greedy_non_overlap, f"""WITH RECURSIVE {E}, g AS (SELECT min_by(event_id, t) AS event_id, user_id, min(t) AS t FROM e GROUP BY user_id UNION ALL
SELECT n.event_id, n.user_id, n.t FROM (SELECT e.event_id, e.user_id, e.t, row_number() OVER (PARTITION BY e.user_id ORDER BY e.t) AS k FROM g JOIN e ON g.user_id = e.user_id AND e.t >= g.t + {24 * HOUR}) n WHERE k = 1)
SELECT event_id, user_id FROM g"""),
    "ewma": (ewma, f"""WITH RECURSIVE {E}, n AS (SELECT *, row_number() OVER w AS k FROM e {W}), r AS (SELECT user_id, t, k, value AS m FROM n WHERE k = 1 UNION ALL SELECT n.user_id, n.t, n.k, 0.12 * n.value + 0.88 * r.m FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1)
SELECT user_id, t, round(m, 6) AS ewma FROM r"""),
    "rolling_mean": (rolling_mean, f"WITH {E} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS rolling_mean FROM e"),
    "percentile_rules": (percentile_rules, f"WITH {E} SELECT event_type, round(quantile_cont(value, 0.95), 6) AS linear, round(quantile_disc(value, 0.95), 6) AS nearest, round(list_sort(list(value))[least(count(*), floor(0.95 * count(*))::BIGINT + 1)], 6) AS truncated FROM e GROUP BY 1"),
    "latency_distribution": (latency_distribution, f"WITH {E}, g AS (SELECT (t - lag(t) OVER w) / 1e6 AS x FROM e {W}) SELECT count(x) AS n, round(min(x), 6) AS least, round(avg(x), 4) AS mean, round(quantile_disc(x, 0.5), 6) AS p50, round(quantile_disc(x, 0.9), 6) AS p90, round(quantile_disc(x, 0.95), 6) AS p95, round(quantile_disc(x, 0.99), 6) AS p99, round(max(x), 6) AS most FROM g WHERE x IS NOT NULL"),
    "json_extract_props": (json_extract_props, f"WITH {E}, j AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM e) SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS most FROM j GROUP BY 1"),
    "state_changes": (state_changes, f"WITH {E}, c AS (SELECT event_id, event_type, lag(event_type) OVER w AS previous FROM e {W}) SELECT event_id, previous, event_type FROM c WHERE previous IS DISTINCT FROM event_type"),
    "early_late_decay": (early_late_decay, f"WITH {E}, h AS (SELECT user_id, value, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS c FROM e {W}), a AS (SELECT user_id, avg(value) FILTER (n <= c // 2) AS early, avg(value) FILTER (n > c // 2) AS late FROM h GROUP BY 1) SELECT user_id, round(early, 6) AS early, round(late, 6) AS late, round(late - early, 6) AS decay FROM a"),
    "lagged_signal": (lagged_signal, f"WITH {E} SELECT event_id, round(lag(value, 3) OVER w, 6) AS lagged FROM e {W}"),
    "simultaneous_best": (simultaneous_best, f"WITH {E} SELECT user_id, event_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t, value DESC, event_id) = 1"),
    "equal_count_windows": (equal_count_windows, f"""WITH {E}, d AS (SELECT *, t // {24 * HOUR} AS day FROM e), r AS (SELECT day, ((row_number() OVER (ORDER BY day) - 1) * 7) // (SELECT count(DISTINCT day) FROM d) AS k FROM (SELECT DISTINCT day FROM d))
SELECT k::INTEGER AS "window", count(*) AS n, min(d.day) AS first, max(d.day) AS last FROM d JOIN r USING (day) GROUP BY 1"""),
    "hash_uniform": (hash_uniform, f"""WITH {E} SELECT event_id, round(('0x' || substr(sha256(event_id || '|' || user_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0, 6) AS u FROM e"""),
    "sequence_gaps": (sequence_gaps, f"""WITH {E}, g AS (SELECT event_id // 1000 AS block, lag(event_id) OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS "after", event_id AS "next" FROM e WHERE value > 5) SELECT block, "after", "next", "next" - "after" - 1 AS missing FROM g WHERE "next" > "after" + 1"""),
}
