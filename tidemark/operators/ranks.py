"""Exact order statistics, global or by group, by counting range partitions: no task holds a group's values.

Equal values of a group are counted first. The counted values are numbered over (group, value) by range partitions, so
that a value's places in its group are a range of numbers, and those that a quantile asks for are picked by comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import running_total

#: A rule gives the place (from 0) of the value in a group of n, as a fraction of the way between two neighbours.
RULES = {
    "linear": lambda n, p: (n - 1) * F.lit(float(p)),
    "nearest_rank": lambda n, p: F.greatest(F.lit(0.0), F.ceil(n * F.lit(float(p))) - 1).cast("double"),
    "truncated": lambda n, p: F.least(n - 1, F.floor(n * F.lit(float(p)))).cast("double"),
}


def quantiles(df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """by and a column for each wanted name: (rule, p), of the values that aren't null (doubles); groups without any give no row.

    linear interpolates at (n - 1) * p; nearest_rank is the value at ceil(n * p) - 1; truncated that at floor(n * p), the
    last at most.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("_v")).filter("_v is not null")
    counted = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    placed = running_total(counted, [*keys, "_v"], "_n", "_before")
    # A group's first number and its size, then each value's own places from the group's start.
    bounds = placed.groupBy(*keys).agg(F.min("_before").alias("_first"), F.sum("_n").alias("_all"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = placed.alias("p").join(bounds.alias("b"), same) if keys else placed.alias("p").crossJoin(F.broadcast(bounds.alias("b")))  # a single row
    local = F.col("_before") - F.col("_first")

    def at(place: Column) -> Column:
        return F.max(F.when((local <= place) & (place < local + F.col("_n")), F.col("_v")))

    picked = []
    for i, (rule, p) in enumerate(wanted.values()):
        place = RULES[rule](F.col("_all"), p)
        picked += [at(F.floor(place)).alias(f"_low{i}"), at(F.ceil(place)).alias(f"_high{i}"), F.max(place - F.floor(place)).alias(f"_part{i}")]
    found = joined.groupBy(*[F.col(f"p.{k}").alias(b) for k, b in zip(keys, by, strict=True)]).agg(*picked)
    values = [F.when(F.col(f"_part{i}") == 0, F.col(f"_low{i}")).otherwise((1 - F.col(f"_part{i}")) * F.col(f"_low{i}") + F.col(f"_part{i}") * F.col(f"_high{i}")).alias(n) for i, n in enumerate(wanted)]
    return found.select(*by, *values)


def of_columns(df: DataFrame, columns: Sequence[str], wanted: dict[str, tuple[str, float]]) -> dict[str, dict[str, float | None]]:
    """The wanted statistics of each column over all rows, of all columns in one pass; None for a column without values."""
    entries = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])
    rows = quantiles(df.select(F.explode(entries).alias("e")).select("e.*"), ["c"], "v", wanted)
    found = {r["c"]: {n: r[n] for n in wanted} for r in rows.collect()}  # a row a column
    return {c: found.get(c, dict.fromkeys(wanted)) for c in columns}
