"""Joins in time: the latest, next or nearest row of another series.

A plain as-of join is a union of both series and one window by key and time. With `bucket`, a key's history is cut into
stretches of time that are sorted apart, and each stretch starts from the last row of the ones before it (one small row
a stretch), so a key that holds much of the data is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stretch import carried


def _latest(left: DataFrame, right: DataFrame, key: str, ts: str, right_ts: str, payload: str, backward: bool, bucket: int | None, tie: str | None) -> DataFrame:
    """left with `payload`, the struct of the latest right row at or before ts (or the first at or after it)."""
    sign = 1 if backward else -1
    fields = [c for c in right.columns if c != key]
    side = right.select(F.col(key), F.col(right_ts).alias("_at"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(0)).alias("_tie"), F.struct(*fields).alias("_row"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left"))
    mine = left.select(F.col(key), F.col(ts).alias("_at"), F.lit(1).alias("_side"), F.lit(0).cast(side.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(side.schema["_row"].dataType).alias("_row"), F.struct("*").alias("_left"))
    rows = side.unionByName(mine).withColumn("_order", F.col("_at") * sign)
    keys = [key]
    if bucket:
        rows = rows.withColumn("_stretch", F.floor(F.col("_order") / F.lit(bucket)))
        keys.append("_stretch")
    # Of right rows of one time, the greatest tie value counts as the last.
    window = Window.partitionBy(*keys).orderBy("_order", "_side", F.col("_tie") * sign if tie else "_tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_found", F.last("_row", ignorenulls=True).over(window))
    out = rows.filter("_side = 1")
    if bucket:
        order = F.struct("_order", F.col("_tie") * sign if tie else F.col("_tie"))
        ends = rows.filter("_side = 0").groupBy(*keys).agg(F.max_by("_row", order).alias("_row"))
        marks = ends.unionByName(out.select(*keys).distinct(), allowMissingColumns=True).groupBy(*keys).agg(F.first("_row", ignorenulls=True).alias("_row"))
        before = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        carried = marks.withColumn("_carried", F.last("_row", ignorenulls=True).over(before)).select(*keys, "_carried")
        out = out.join(carried, keys, "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return out.select("_left.*", F.col("_found").alias(payload))


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, right_ts: str | None = None, direction: str = "backward", tolerance: int | None = None, prefix: str = "right_", bucket: int | None = None, tie: str | None = None) -> DataFrame:
    """left with the columns of one right row, named with `prefix`; NULLs where there is none within the tolerance.

    ts and right_ts are numbers (microseconds). direction: backward (latest at or before), forward (first at or after)
    or nearest (the earlier one of two equally near). bucket: the stretch of time that is sorted at once, for hot keys.
    Rows with a null key find nothing. Right rows of equal time are told apart by `tie` (greatest last), else any.
    """
    right_ts = right_ts or ts
    fields = [c for c in right.columns if c != key]
    within = lambda row: row.isNotNull() if tolerance is None else F.abs(F.col(ts) - row[right_ts]) <= F.lit(tolerance)

    def found(df: DataFrame, backward: bool, name: str) -> DataFrame:
        return _latest(df, right.filter(F.col(key).isNotNull() & F.col(right_ts).isNotNull()), key, ts, right_ts, name, backward, bucket, tie)

    columns = [F.col(c) for c in left.columns]
    if direction == "nearest":
        out = found(found(left, True, "_before"), False, "_after")
        gap = lambda n: F.abs(F.col(ts) - F.col(n)[right_ts])
        row: Column = F.when(F.col("_after").isNull() | (gap("_before") <= gap("_after")), F.col("_before")).otherwise(F.col("_after"))
    else:
        out = found(left, direction == "backward", "_before")
        row = F.col("_before")
    out = out.withColumn("_row", row)
    return out.withColumn("_row", F.when(within(F.col("_row")), F.col("_row"))).select(*columns, *[F.col("_row")[f].alias(prefix + f) for f in fields])


def last_arrived(left: DataFrame, right: DataFrame, key: str, ts: str, arrival: str, right_ts: str | None = None, tolerance: int | None = None, prefix: str = "right_", bucket: int | None = None) -> DataFrame:
    """left with the columns of the right row that arrived last among all those at or before ts, named with `prefix`.

    A series that isn't sorted by time is read like that: a late row of an earlier time hides those before it in the series.
    tolerance: the row found so may be no older than that; no other one takes its place. Of equal arrivals the greatest time
    wins, then the greatest columns. Right rows without key, time or arrival are left out; left rows without key or time find
    nothing. bucket: the stretch of time that is sorted at once, for hot keys; the greatest arrival is carried over stretches.
    """
    right_ts = right_ts or ts
    fields = [c for c in right.columns if c != key]
    side = right.dropna(subset=[key, right_ts, arrival]).select(key, F.col(right_ts).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(arrival).alias("arrival"), F.col(right_ts).alias("at"), F.struct(*fields).alias("row")).alias("_row"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left"))
    mine = left.select(key, F.col(ts).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(side.schema["_row"].dataType).alias("_row"), F.struct("*").alias("_left"))
    out = carried(side.unionByName(mine), key, ["_at", "_side"], {"_found": ("greatest", F.col("_row"))}, bucket).filter("_side = 1")
    fresh = F.lit(True) if tolerance is None else F.col("_at") - F.col("_found.at") <= F.lit(tolerance)
    out = out.select("_left", F.when(fresh, F.col("_found.row")).alias("_row"))
    return out.select(*[F.col("_left")[c].alias(c) for c in left.columns], *[F.col("_row")[f].alias(prefix + f) for f in fields])


def value_at(series: DataFrame, key: str, ts: str, value: str, ago: int, tolerance: int | None = None, name: str = "past", bucket: int | None = None) -> DataFrame:
    """series with the value that was current `ago` before each row."""
    past = series.select(key, F.col(ts).alias("_then"), F.col(value).alias("_value"))
    asked = series.withColumn("_asked", F.col(ts) - F.lit(ago))
    out = asof_join(asked, past, key, "_asked", "_then", "backward", tolerance, "_p", bucket)
    return out.select(*series.columns, F.col("_p_value").alias(name))


def k_return(series: DataFrame, key: str, ts: str, value: str, ago: int, tolerance: int | None = None, name: str = "k_return", bucket: int | None = None) -> DataFrame:
    """value over the value `ago` before, less one; NULL without one, or if it isn't positive. bucket: as in `asof_join`."""
    out = value_at(series, key, ts, value, ago, tolerance, "_past", bucket)
    return out.withColumn(name, F.when(F.col("_past") > 0, F.try_divide(value, "_past") - 1)).drop("_past")


def level_change(series: DataFrame, key: str, ts: str, value: str, ago: int, tolerance: int | None = None, name: str = "level_change", bucket: int | None = None) -> DataFrame:
    out = value_at(series, key, ts, value, ago, tolerance, "_past", bucket)
    return out.withColumn(name, F.col(value) - F.col("_past")).drop("_past")


def momentum(series: DataFrame, key: str, ts: str, value: str, short: int, long: int, name: str = "momentum", bucket: int | None = None) -> DataFrame:
    """The return over the short stretch less that over the long one."""
    out = k_return(series, key, ts, value, short, name="_short", bucket=bucket)
    out = k_return(out, key, ts, value, long, name="_long", bucket=bucket)
    return out.withColumn(name, F.col("_short") - F.col("_long")).drop("_short", "_long")
