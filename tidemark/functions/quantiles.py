"""The three quantile rules, as aggregates for groups that fit into a task; `operators.ranks` has them for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(x: str, p: float) -> Column:
    """Interpolated at (n - 1) * p."""
    return F.percentile(x, F.lit(p))


def nearest_rank(x: str, p: float) -> Column:
    """The value at ceil(p * n) - 1 in order."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})")


def truncated(x: str, p: float) -> Column:
    """The value at floor(p * n) in order, the last at most; for groups that fit into one array."""
    ordered = F.array_sort(F.collect_list(x))
    return F.element_at(ordered, F.least(F.size(ordered), F.floor(F.lit(p) * F.size(ordered)).cast("int") + 1))
