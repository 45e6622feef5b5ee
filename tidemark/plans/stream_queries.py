"""Streams over `events` as files, run over all there is now; the SQL gives what their batch twins give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import micros
from ..storage import shared_path
from ..streaming import positions as P
from .time_queries import HOUR, E


def replayed(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    # A stream reads folders; of a table of one file, it reads the folder that holds it.
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory()
    rows = stream.parquet(path) if whole else stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    if more:
        return rows.select("event_id", "user_id", micros("ts").alias("t"), "value", *more)
    return rows.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), micros("ts").alias("t"), "value", (F.col("event_type") == "purchase").alias("signal"), F.col("ts").cast("timestamp").alias("at"))


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    return P.run_to_table(stream, shared_path(spark, name), shared_path(spark, f"{name}-state"))


def stream_positions(spark, sf_dir):
    out = _run(spark, P.stream_positions(replayed(spark, sf_dir)), "positions")
    return out.select("key", "entry_id", "exit_id", F.round("exit_value", 6).alias("exit_value"), "reason")


def batch_positions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), micros("ts").alias("t"), "value", (F.col("event_type") == "purchase").alias("signal"))
    return P.batch_positions(e).select("key", "entry_id", "exit_id", F.round("exit_value", 6).alias("exit_value"), "reason")


def stream_throttle(spark, sf_dir):
    return _run(spark, P.stream_throttled(replayed(spark, sf_dir), 24 * HOUR), "throttled").select("key", "id")


def stream_first_seen(spark, sf_dir):
    rows = replayed(spark, sf_dir).select("key", F.col("signal").cast("string").alias("kind"), "at")
    return _run(spark, P.first_seen(rows, ["key", "kind"], "at", "60 days"), "seen").select("key", "kind")


POSITIONS = f"""WITH RECURSIVE {E}, x AS (SELECT p.event_id AS id, p.user_id AS key, p.t, min_by(struct_pack(id := e.event_id, t := e.t, value := e.value,
   reason := CASE WHEN e.value - p.value >= 20 THEN 'target' WHEN e.value - p.value <= -20 THEN 'stop' ELSE 'timeout' END), e.t) AS o
  FROM e p JOIN e ON p.event_type = 'purchase' AND p.user_id = e.user_id AND e.t > p.t AND (abs(e.value - p.value) >= 20 OR e.t >= p.t + {48 * HOUR}) GROUP BY 1, 2, 3),
f AS (SELECT user_id AS key, min(t) AS t FROM e WHERE event_type = 'purchase' GROUP BY 1),
g AS (SELECT x.key, x.id, x.o FROM x JOIN f ON x.key = f.key AND x.t = f.t UNION ALL
  SELECT n.key, n.id, n.o FROM (SELECT x.*, row_number() OVER (PARTITION BY x.key ORDER BY x.t) AS k FROM g JOIN x ON g.key = x.key AND x.t >= g.o.t) n WHERE k = 1)
SELECT key, id AS entry_id, o.id AS exit_id, round(o.value, 6) AS exit_value, o.reason AS reason FROM g"""

STREAMS = {
    "stream_positions": (stream_positions, POSITIONS),
    "batch_positions": (batch_positions, POSITIONS),
    "stream_throttle": (
        stream_throttle,
        f"""WITH RECURSIVE {E}, g AS (SELECT min_by(event_id, t) AS id, user_id AS key, min(t) AS t FROM e GROUP BY user_id UNION ALL
SELECT n.event_id, n.user_id, n.t FROM (SELECT e.event_id, e.user_id, e.t, row_number() OVER (PARTITION BY e.user_id ORDER BY e.t) AS k FROM g JOIN e ON g.key = e.user_id AND e.t >= g.t + {24 * HOUR}) n WHERE k = 1) SELECT key, id FROM g""",
    ),
    "stream_first_seen": (stream_first_seen, f"WITH {E} SELECT DISTINCT user_id AS key, CASE WHEN event_type = 'purchase' THEN 'true' ELSE 'false' END AS kind FROM e"),
}
