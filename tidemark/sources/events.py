"""Append-only JSON event logs as typed DataFrames, and the sinks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import iso_timestamp

MARKET = "struct<market_id:string,question:string,asset:string,window_start:string,window_end:string,yes_token_id:string,no_token_id:string,liquidity:double,volume:double,active:boolean,closed:boolean>"
#: Payloads by kind of event.
KINDS = {
    "market_lifecycle": f"market_id string, previous string, current string, market {MARKET}",
    "reference_price": "asset string, price double, source string, timestamp string",
    "market_snapshot": "market_id string, asset string, timestamp string, yes_price double, no_price double, yes_bid double, yes_ask double, liquidity double, seconds_to_expiry double, quote_timestamp string, yes_bid_size double, yes_ask_size double, total_bid_depth double, total_ask_depth double, source_latency_seconds double",
    "microstructure_snapshot": "market_id string, asset string, schema_version int, quote_age_seconds double, repricing_velocity double, repricing_acceleration double, bid_ask_spread double, book_imbalance double, cross_asset_yes_dispersion double",
    "lag_measurement": "market_id string, measurement struct<external_price_change:double,lag_seconds:double,lag_score:double,direction:string,confidence:double,qualified:boolean,reason:string>",
    "lifecycle_tracking": "event string, market_id string, seconds_after_open_when_detected double",
}


def _indexed(df: DataFrame) -> DataFrame:
    """df with source_session (the folder of a file) and event_index (the place of a line in it)."""
    df = df.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    df = df.withColumn("source_session", F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1))
    return df.withColumn("event_index", (F.row_number().over(Window.partitionBy("_file").orderBy("_block", "_line")) - 1).cast("long"))


def read_sessions(spark: SparkSession, path: str, strict: bool = False, names: dict[str, str] | None = None) -> DataFrame:
    """event, timestamp, payload (JSON text), source_session, event_index, malformed, of every line of the logs at `path`.

    A line that is no JSON object with an event and a time with offset is malformed: its columns are NULL; strict: the
    read fails on it. `names` gives kinds that a log calls otherwise the names of KINDS. Blank lines are skipped. Folders named `latest` are left out, as they repeat others.
    """
    rows = _indexed(spark.read.text(path)).filter((F.trim("value") != "") & (F.col("source_session") != "latest"))
    fields = F.from_json("value", "event string, timestamp string")
    payload = F.get_json_object("value", "$.payload")
    rows = rows.withColumn("_e", fields).withColumn("_t", iso_timestamp(F.col("_e.timestamp")))
    bad = F.col("_e.event").isNull() | F.col("_t").isNull()
    if strict:
        rows = rows.withColumn("_e", F.when(~bad, F.col("_e")).otherwise(F.raise_error(F.concat(F.lit("malformed event in "), F.col("_file"), F.lit(", line "), F.col("event_index").cast("string"))).cast(rows.schema["_e"].dataType)))
    event = F.col("_e.event")
    for old, new in (names or {}).items():
        event = F.when(F.col("_e.event") == old, new).otherwise(event)
    return rows.select(
        F.when(~bad, event).alias("event"),
        F.when(~bad, F.col("_t")).alias("timestamp"),
        F.when(~bad, payload).alias("payload"),
        "source_session",
        "event_index",
        bad.alias("malformed"),
    )


def of_kind(events: DataFrame, kind: str, schema: str | None = None) -> DataFrame:
    """The events of a kind with the fields of their payload; the envelope's time is `event_time`."""
    rows = events.filter((F.col("event") == kind) & ~F.col("malformed"))
    return rows.select(F.col("timestamp").alias("event_time"), "source_session", "event_index", F.from_json("payload", schema or KINDS[kind]).alias("_p")).select("event_time", "source_session", "event_index", "_p.*")


def malformed_counts(events: DataFrame) -> DataFrame:
    """source_session, events, malformed."""
    return events.groupBy("source_session").agg(F.count("*").alias("events"), F.count(F.when(F.col("malformed"), 1)).alias("malformed"))


def instruments(events: DataFrame) -> DataFrame:
    """One row for each market of the lifecycle events: the last description of it, with its window as timestamps."""
    rows = of_kind(events, "market_lifecycle").filter("market.market_id is not null")
    rows = rows.select("source_session", F.struct("event_time", "event_index").alias("_at"), "market.*")
    names = [c for c in rows.columns if c not in ("market_id", "_at")]
    out = rows.groupBy("market_id").agg(F.max_by(F.struct(*names), "_at").alias("_m")).select("market_id", "_m.*")
    return out.withColumn("window_start", iso_timestamp("window_start")).withColumn("window_end", iso_timestamp("window_end"))


def latest_resolutions(events: DataFrame, kind: str = "market_resolution") -> DataFrame:
    """market_id and the payload of its last resolution event."""
    rows = events.filter((F.col("event") == kind) & ~F.col("malformed")).withColumn("market_id", F.get_json_object("payload", "$.market_id"))
    return rows.groupBy("market_id").agg(F.max_by("payload", F.struct("timestamp", "event_index")).alias("payload"))


def write_jsonl(df: DataFrame, path: str, kind: str, ts: str, payload: Column | None = None) -> None:
    """Append rows as events of a kind; the payload is all columns unless given."""
    body = payload if payload is not None else F.struct(*df.columns)
    line = F.to_json(F.struct(F.lit(kind).alias("event"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), body.alias("payload")))
    df.select(line.alias("value")).write.mode("append").text(path)


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str] | None = None) -> None:
    """The columns in this order, with a header; nulls as empty fields; rows in the given order over the files."""
    rows = df.select(*columns)
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, keys: list[str] | None = None) -> DataFrame:
    """CSV files with a header, blanks as NULL; with keys, one row of each combination (the least of them)."""
    rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    if keys:
        rest = [c for c in rows.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")
    return rows
