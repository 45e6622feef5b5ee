"""Metrics of probabilities, calibration, rank statistics and segments, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip_probability
from .order import running_total


def probability_metrics(df: DataFrame, outcome: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """n, log_loss, brier, accuracy, balanced_accuracy, precision, recall for each group; a rate without cases is NULL."""
    y, q = F.col(outcome).cast("double"), clip_probability(p)
    hit = F.col(p) >= 0.5
    count = lambda c: F.count(F.when(c, 1))
    tp, fp, fn, tn = count(hit & (y == 1)), count(hit & (y == 0)), count(~hit & (y == 1)), count(~hit & (y == 0))
    return df.filter(F.col(outcome).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"),
        F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"),
        F.try_divide(tp + tn, F.count("*")).alias("accuracy"),
        ((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
    )


def calibration(df: DataFrame, outcome: str, p: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_p, rate for all bins of equal width, empty ones too; p = 1 is in the last."""
    own = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    found = df.withColumn("bin", own).groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(outcome).cast("double")).alias("rate"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def expected_calibration_error(table: DataFrame) -> DataFrame:
    """One row: the mean gap of rate and mean_p over a calibration table, weighted by n."""
    return table.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean_p"))), F.sum("n")).alias("ece"))


def auc(df: DataFrame, outcome: str, p: str) -> DataFrame:
    """One row: the area under the ROC curve by average ranks; NULL without both classes.

    Rows are counted by score first; ranks are running sums over range partitions of the distinct scores.
    """
    y = F.col(outcome).cast("long")
    scores = df.filter(F.col(outcome).isNotNull() & F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    ranked = running_total(scores, [p], "n", "_before").withColumn("_rank", F.col("_before") + (F.col("n") + 1) / 2)
    one = ranked.agg(F.sum(F.col("_rank") * F.col("pos")).alias("s"), F.sum("pos").alias("a"), F.sum(F.col("n") - F.col("pos")).alias("b"))
    return one.select(F.try_divide(F.col("s") - F.col("a") * (F.col("a") + 1) / 2, F.col("a") * F.col("b")).alias("auc"))


def segment_metrics(df: DataFrame, outcome: str, p: str, segments: Sequence[tuple[str, Column]]) -> DataFrame:
    """probability_metrics by segment, where a row belongs to every segment whose condition holds."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in segments]))
    return probability_metrics(df.withColumn("segment", F.explode(names)), outcome, p, ["segment"])


def by_grouping_sets(df: DataFrame, dimensions: Sequence[str], *aggregates: Column) -> DataFrame:
    """dimension, value and the aggregates: overall, and by each dimension alone, in one pass.

    Each row is expanded once for every dimension before the map-side aggregation, as GROUPING SETS do.
    """
    pairs = [F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]]
    return df.withColumn("_d", F.explode(F.array(*pairs))).groupBy("_d.dimension", "_d.value").agg(*aggregates)


def dominant(df: DataFrame, key: str, value: str, weight: Column | None = None) -> DataFrame:
    """key, value, share: the key's heaviest value and its share, ties to the lesser value. Nothing is collected."""
    parts = df.groupBy(key, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("w"))
    top = F.min(F.struct((-F.col("w")).alias("w"), F.col(value))).alias("top")
    return parts.groupBy(key).agg(top, F.sum("w").alias("total")).select(key, F.col(f"top.{value}").alias(value), F.try_divide(-F.col("top.w"), "total").alias("share"))


def consensus(df: DataFrame, key: str, side: str, weight: Column) -> DataFrame:
    """key, sides, winner, agreement: the side of the greatest weight, TIE if two share it."""
    parts = df.groupBy(key, side).agg(F.sum(weight).alias("w"))
    top = lambda f: f(F.struct((-F.col("w")).alias("w"), F.col(side)))
    # The least and the greatest side of the greatest weight; they differ if it is shared.
    out = parts.groupBy(key).agg(F.count("*").alias("sides"), top(F.min).alias("least"), F.max(F.struct("w", side)).alias("greatest"), F.sum("w").alias("total"))
    winner = F.when(F.col(f"least.{side}").eqNullSafe(F.col(f"greatest.{side}")), F.col(f"least.{side}")).otherwise("TIE")
    return out.select(key, "sides", winner.alias("winner"), F.try_divide("greatest.w", "total").alias("agreement"))


def top_share(df: DataFrame, value: str, k: int = 10) -> DataFrame:
    """One row: the sum of the k greatest positive values over the sum of all values; NULL unless that is positive."""
    top = df.filter(F.col(value) > 0).orderBy(F.desc(value)).limit(k).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("top"))
    return top.crossJoin(F.broadcast(df.agg(F.sum(value).alias("total")))).select("top", "total", F.when(F.col("total") > 0, F.try_divide("top", "total")).alias("share"))  # two single rows


def largest_group_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: the greatest sum of a group, the total, and their ratio; NULL unless the total is positive."""
    out = df.groupBy(group).agg(F.sum(value).alias("v")).agg(F.max("v").alias("largest"), F.sum("v").alias("total"))
    return out.withColumn("share", F.when(F.col("total") > 0, F.try_divide("largest", "total")))
