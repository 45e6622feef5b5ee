"""Windows over one key's rows in order, without sorting them all in one task.

With `bucket`, rows are cut into stretches, each sorted by itself; what a stretch needs of those before it (the last row,
the last known value, a sum, a maximum) comes from one small row a stretch, carried over the stretches of the key.
bucket is a length, of the first order column (a number), or the name of a column with the stretches' numbers, as
`ranged` writes them. Without it there is one plain window. Null keys are a key of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

Bucket = int | str | None
_WORK = ("_s_key", "_s_at", "_s_to", "_s_value", "_s_own", "_s_carried")


def names(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def ranged(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], name: str = "_part") -> DataFrame:
    """df, written by ranges of (key, order), with the range's number: stretches of like size, whatever the keys' sizes."""
    return written(df.repartitionByRange(*names(key), *names(order)).withColumn(name, F.spark_partition_id()), "ranged")


def _cut(df: DataFrame, key: str | Sequence[str], by: list[str], bucket: int | str) -> DataFrame:
    number = F.col(bucket).cast("long") if isinstance(bucket, str) else F.floor(F.col(by[0]) / F.lit(bucket))
    return df.withColumn("_s_key", F.struct(*[F.col(k) for k in names(key)], F.lit(0))).withColumn("_s_at", F.struct("_s_key", number.alias("stretch")))


def _up_to(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def _before(stretches):
    return stretches.rowsBetween(Window.unboundedPreceding, -1)


#: For each kind: over a window's rows, the end of a stretch in order `by`, over the ends of the stretches before.
_KINDS: dict[str, tuple[Callable, Callable, Callable]] = {
    "prior": (lambda v, w: F.lag(v).over(w), lambda v, by: F.max_by(v, by), lambda e, s: F.lag(e).over(s)),
    "latest": (lambda v, w: F.last(v, ignorenulls=True).over(_up_to(w)), lambda v, by: F.max_by(v, F.when(v.isNotNull(), by)), lambda e, s: F.last(e, ignorenulls=True).over(_before(s))),
    "total": (lambda v, w: F.sum(v).over(_up_to(w)), lambda v, by: F.sum(v), lambda e, s: F.sum(e).over(_before(s))),
    "greatest": (lambda v, w: F.max(v).over(_up_to(w)), lambda v, by: F.max(v), lambda e, s: F.max(e).over(_before(s))),
}


def carried(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], values: dict[str, tuple[str, Column]], bucket: Bucket = None) -> DataFrame:
    """df with each name's (kind, value), all in one pass over the key's rows.

    prior is the value of the row before (wrap one that may be null in a struct, to tell it from no row); latest the last
    value that isn't null, total the sum and greatest the maximum, each up to this row and with it.
    """
    by = names(order)
    if not bucket:
        w = Window.partitionBy(*names(key)).orderBy(*by)
        return df.withColumns({n: _KINDS[kind][0](v, w) for n, (kind, v) in values.items()})
    # The row before may hold a null, so it is kept in a struct.
    wrapped = F.struct(*[(F.struct(v.alias("value")) if kind == "prior" else v).alias(n) for n, (kind, v) in values.items()])
    out = _cut(df, key, by, bucket).withColumn("_s_value", wrapped)
    each = lambda i, column, over: F.struct(*[_KINDS[kind][i](F.col(f"{column}.{n}"), over).alias(n) for n, (kind, _) in values.items()])
    ends = out.groupBy("_s_at").agg(each(1, "_s_value", F.struct(*by)).alias("_s_end"))
    stretches = Window.partitionBy("_s_at._s_key").orderBy("_s_at.stretch")
    starts = ends.withColumn("_s_carried", each(2, "_s_end", stretches)).select(F.col("_s_at").alias("_s_to"), "_s_carried")
    out = out.withColumn("_s_own", each(0, "_s_value", Window.partitionBy("_s_at").orderBy(*by)))
    out = out.join(starts, F.col("_s_at") == F.col("_s_to"), "left")
    found = {}
    for n, (kind, _) in values.items():
        own, earlier = F.col(f"_s_own.{n}"), F.col(f"_s_carried.{n}")
        found[n] = {"prior": F.coalesce(own, earlier)["value"] if kind == "prior" else None, "latest": F.coalesce(own, earlier), "total": F.when(own.isNull(), earlier).otherwise(own + F.coalesce(earlier, F.lit(0))) if kind == "total" else None, "greatest": F.greatest(own, earlier)}[kind]
    return out.withColumns(found).drop(*_WORK)


def prior(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], value: Column, name: str, bucket: Bucket = None) -> DataFrame:
    return carried(df, key, order, {name: ("prior", value)}, bucket)


def latest(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], value: Column, name: str, bucket: Bucket = None) -> DataFrame:
    return carried(df, key, order, {name: ("latest", value)}, bucket)


def total(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], value: Column, name: str, bucket: Bucket = None) -> DataFrame:
    return carried(df, key, order, {name: ("total", value)}, bucket)


def greatest(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], value: Column, name: str, bucket: Bucket = None) -> DataFrame:
    return carried(df, key, order, {name: ("greatest", value)}, bucket)


def peaked(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], value: Column, equity: str, peak: str, bucket: int | str, start: float = 0.0) -> DataFrame:
    """The keys of df, the running sum of value from `start` on, and the greatest of these sums up to each row.

    As `total` and `greatest` one after the other, but a stretch's rows are sorted once, for its sum and its greatest prefix.
    """
    by = names(order)
    inside = _up_to(Window.partitionBy("_s_at").orderBy(*by))
    # The keys are shuffled once, in the stretch's own.
    out = _cut(df, key, by, bucket).select("_s_at", *by, value.alias("_s_value")).withColumn("_s_own", F.sum("_s_value").over(inside)).withColumn("_s_high", F.max("_s_own").over(inside))
    ends = out.groupBy("_s_at").agg(F.sum("_s_value").alias("sum"), F.max("_s_own").alias("high"))
    before = _before(Window.partitionBy("_s_at._s_key").orderBy("_s_at.stretch"))
    ends = ends.withColumn("_s_sum", F.coalesce(F.sum("sum").over(before), F.lit(0)) + F.lit(start))
    starts = ends.withColumn("_s_peak", F.max(F.col("_s_sum") + F.col("high")).over(before)).select(F.col("_s_at").alias("_s_to"), "_s_sum", "_s_peak")
    out = out.join(starts, F.col("_s_at") == F.col("_s_to"), "left")
    # Nulls at a key's start have no sum of their own, but one of the stretches before.
    known = F.when(F.col("_s_own").isNotNull() | F.col("_s_peak").isNotNull(), F.col("_s_sum") + F.coalesce("_s_own", F.lit(0)))
    return out.select(*[F.col("_s_at._s_key")[k].alias(k) for k in names(key)], known.alias(equity), F.greatest(F.col("_s_peak"), F.col("_s_sum") + F.col("_s_high")).alias(peak))


def framed(df: DataFrame, key: str | Sequence[str], ts: str, span: int, values: dict[str, Callable], bucket: int | None = None) -> DataFrame:
    """df with functions of a window over the trailing span of ts (inclusive).

    With `bucket` a row is copied to the stretch after its own where it can be in a frame there; stretches are of the
    span's length at least, so once is enough.
    """
    frame = lambda keys: Window.partitionBy(*keys).orderBy(ts).rangeBetween(-span, 0)
    if not bucket:
        return df.withColumns({n: f(frame(names(key))) for n, f in values.items()})
    length = max(bucket, span + 1)
    own = F.floor(F.col(ts) / F.lit(length))
    out = df.withColumn("_s_own", own).withColumn("_s_to", F.explode(F.sequence(F.coalesce(own, F.lit(0)), F.coalesce(F.floor((F.col(ts) + span) / F.lit(length)), F.lit(0)))))
    out = out.withColumns({n: f(frame([*names(key), "_s_to"])) for n, f in values.items()})
    return out.filter(F.coalesce("_s_own", F.lit(0)) == F.col("_s_to")).drop("_s_own", "_s_to")
