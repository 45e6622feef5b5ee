"""What happens after an entry: excursions, first hits, horizons, fills, and entries that don't overlap.

An entry meets the later rows of its key through a range join. Both sides carry a stretch of time of the horizon's
length, and an entry meets only its own stretch and the next, so the join is an equi-join on (key, stretch): a busy key
is dealt over its stretches and no row meets the whole history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def future(entries: DataFrame, path: DataFrame, key: str, ts: str, horizon: int, path_ts: str | None = None, prefix: str = "path_") -> DataFrame:
    """entries joined with the rows of `path` of the same key, later than the entry by up to `horizon`; inner."""
    path_ts = path_ts or ts
    names = [c for c in path.columns if c != key]
    right = path.select(F.col(key).alias("_key"), F.floor(F.col(path_ts) / F.lit(horizon)).alias("_stretch"), *[F.col(c).alias(prefix + c) for c in names])
    own = F.floor(F.col(ts) / F.lit(horizon))
    left = entries.withColumn("_stretch", F.explode(F.array(own, own + 1)))
    at = F.col(prefix + path_ts)
    return left.join(right, (left[key] == right["_key"]) & (left["_stretch"] == right["_stretch"]) & (at > F.col(ts)) & (at <= F.col(ts) + horizon)).drop("_key", left["_stretch"]).drop("_stretch")


def excursions(entries: DataFrame, path: DataFrame, key: str, entry: str, ts: str, value: str, horizon: int) -> DataFrame:
    """entry, observations, mfe, mae: the greatest and least move of the value within the horizon; entries without path are left out."""
    met = future(entries, path, key, ts, horizon)
    move = F.col("path_" + value) - F.col(value)
    return met.groupBy(entry).agg(F.count("*").alias("observations"), F.max(move).alias("mfe"), F.min(move).alias("mae"))


def first_hits(entries: DataFrame, path: DataFrame, key: str, entry: str, ts: str, value: str, horizon: int, target: float, stop: float) -> DataFrame:
    """entry, exit_ts, exit_value, reason: target, stop or timeout, whichever comes first; target if both come at once.

    A timeout leaves at the last row of the path. Entries without path are left out.
    """
    met = future(entries, path, key, ts, horizon)
    move, at, price = F.col("path_" + value) - F.col(value), F.col("path_" + ts), F.col("path_" + value)
    out = met.groupBy(entry).agg(
        F.min(F.when(move >= target, F.struct(at.alias("at"), price.alias("price")))).alias("hit"),
        F.min(F.when(move <= -stop, F.struct(at.alias("at"), price.alias("price")))).alias("lost"),
        F.max(F.struct(at.alias("at"), price.alias("price"))).alias("last"),
    )
    won = F.col("hit").isNotNull() & (F.col("lost").isNull() | (F.col("hit.at") <= F.col("lost.at")))
    row = F.when(won, F.col("hit")).when(F.col("lost").isNotNull(), F.col("lost")).otherwise(F.col("last"))
    reason = F.when(won, "target").when(F.col("lost").isNotNull(), "stop").otherwise("timeout")
    return out.select(entry, row["at"].alias("exit_ts"), row["price"].alias("exit_value"), reason.alias("reason"))


def horizon_moves(entries: DataFrame, path: DataFrame, key: str, entry: str, ts: str, value: str, after: int, horizon: int) -> DataFrame:
    """entry, move: the value's move at the first row `after` or later within the horizon; NULL without one."""
    met = future(entries, path, key, ts, horizon)
    at = F.col("path_" + ts)
    late = F.when(at >= F.col(ts) + after, F.struct(at.alias("at"), (F.col("path_" + value) - F.col(value)).alias("move")))
    return met.groupBy(entry).agg(F.min(late)["move"].alias("move"))


def passive_fills(entries: DataFrame, path: DataFrame, key: str, entry: str, ts: str, posted: str, value: str, horizon: int) -> DataFrame:
    """entry, bid_fill_ts, ask_fill_ts: when the value first falls under, or rises over, what was posted."""
    met = future(entries, path, key, ts, horizon)
    at, price = F.col("path_" + ts), F.col("path_" + value)
    return met.groupBy(entry).agg(F.min(F.when(price < F.col(posted), at)).alias("bid_fill_ts"), F.min(F.when(price > F.col(posted), at)).alias("ask_fill_ts"))


def admitted(df: DataFrame, key: str, ts: str, until: str, tie: str) -> DataFrame:
    """The rows that open when the key's last admitted row is over: each starts at or after the `until` of the one before.

    Which row is next depends on the last one, so a key's rows are walked in order, batch by batch, holding one number.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, over = None, None
        for x in batches:
            keep = []
            for k, a, b in zip(x[key].tolist(), x[ts].tolist(), x[until].tolist(), strict=True):
                if k != now:
                    now, over = k, None
                keep.append(over is None or a >= over)
                if keep[-1]:
                    over = b
            yield x[keep]

    rows = df.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, ts, tie)
    return rows.mapInPandas(run, rows.schema)


def simultaneous_best(df: DataFrame, key: str, ts: str, size: str, tie: str) -> DataFrame:
    """The row of each key's earliest time that has the greatest size, ties to the smaller `tie`."""
    w = Window.partitionBy(key).orderBy(F.col(ts), F.col(size).desc(), F.col(tie))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
