"""Places and running sums over a total order, by range partitions: no task sorts all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def running_total(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the sum of `value` over all rows before each one in the total order.

    Rows are range-partitioned and written, as the partitions must be the same in the sums and in the result; each is
    summed by itself and offset by the totals of those before it, one small row each.
    """
    rows = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum(value).over(before), F.lit(0)))
    sizes = rows.groupBy("_part").agg(F.sum(value).alias("_size"))
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(offsets.select("_part", "_offset")), "_part").withColumn(name, F.col("_own") + F.col("_offset")).drop("_part", "_own", "_offset")


def ordinal(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with each row's place (from 0) in the total order."""
    return running_total(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", name).drop("_one")
