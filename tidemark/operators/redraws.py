"""Matched random baselines: draws from each entry's stratum, redrawn in rounds until none overlaps another.

In a round every entry that has no draw yet draws, by a hash, a candidate of its stratum, in all trials at once. Within a
(trial, position) windows find the draws that overlap one that was taken before, or one another; of draws that run into
each other the one of the first entry is taken, the others are drawn again. No task holds a trial.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import hash_uniform
from ..storage import written
from .order import ordinal
from .series import drawdowns


def redrawn(entries: DataFrame, pool: DataFrame, entry: str, stratum: Sequence[str], position: Sequence[str], start: str, end: str, trials: int, seed: int = 1, rounds: int = 100) -> DataFrame:
    """trial (from 1), entry and the columns of the candidate that it drew: one row for each entry and trial.

    entries has `entry` (a number of its own for each, which also ranks them) and the stratum's columns; pool has those,
    the position's, start and end. Within a trial and position no two candidates share a start, or overlap: a start lies
    under another's end only if it isn't later than its start. An entry whose stratum has no candidate, or that has none
    after so many rounds, is an error.
    """
    named = [c for c in pool.columns if c not in stratum]
    placed = ordinal(pool, list(dict.fromkeys([*stratum, *position, start, end])), "_place").select("_place", *pool.columns)
    bounds = placed.groupBy(*stratum).agg(F.min("_place").alias("_low"), F.count("*").alias("_n"))
    asked = written(entries.select(F.col(entry).alias("_entry"), *stratum).join(bounds, list(stratum), "left"), "asked")
    missing = asked.filter("_n is null").select(*stratum).distinct().limit(5).collect()
    if missing:
        raise ValueError(f"no random candidates for matched strata {[tuple(r) for r in missing]}")
    pending = asked.select("_entry", *stratum, "_low", "_n", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    taken: DataFrame | None = None
    own = ["trial", *position]
    fields = ["trial", "_entry", *stratum, "_low", "_n", *named]
    candidates = placed.drop(*stratum)
    for i in range(rounds):
        draw = F.floor(hash_uniform(F.lit(seed), "trial", "_entry", F.lit(i)) * F.col("_n")) + F.col("_low")
        fresh = pending.withColumn("_place", draw).join(candidates, "_place").select(*fields, F.lit(False).alias("_taken"))
        rows = fresh
        if taken is not None:
            # Only the positions that are drawn for again.
            rows = rows.unionByName(taken.join(written(fresh.select(*own).distinct(), "drawn"), own, "left_semi").select(*fields, F.lit(True).alias("_taken")))
        at = Window.partitionBy(*own).orderBy(start)
        held = F.when(F.col("_taken"), F.struct(F.col(end).alias("end"), F.col(start).alias("start")))
        earlier = at.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumns({"_until": F.max(held["end"]).over(earlier), "_from": F.max(held["start"]).over(earlier), "_next": F.min(held["start"]).over(at.rangeBetween(1, Window.unboundedFollowing))})
        clash = F.coalesce(F.col("_until") > F.col(start), F.lit(False)) | F.coalesce(F.col("_from") == F.col(start), F.lit(False)) | F.coalesce(F.col("_next") < F.col(end), F.lit(False))
        rows = rows.withColumn("_clash", clash).filter(~F.col("_taken"))
        # Draws that run into each other are one cluster.
        free = Window.partitionBy(*own, "_clash").orderBy(start, end, "_entry")
        before = free.rowsBetween(Window.unboundedPreceding, -1)
        opens = F.coalesce((F.col(start) >= F.max(end).over(before)) & (F.col(start) > F.max(start).over(before)), F.lit(True))
        rows = rows.withColumn("_opens", opens.cast("int")).withColumn("_cluster", F.sum("_opens").over(free.rowsBetween(Window.unboundedPreceding, 0)))
        first = F.min("_entry").over(Window.partitionBy(*own, "_clash", "_cluster"))
        rows = written(rows.withColumn("_taken", ~F.col("_clash") & (F.col("_entry") == first)).select(*fields, "_taken"), "round")
        got = rows.filter("_taken").select(*fields)
        taken = got if taken is None else taken.unionByName(got)
        pending = rows.filter(~F.col("_taken")).select("_entry", *stratum, "_low", "_n", "trial")
        if pending.isEmpty():
            return taken.select("trial", F.col("_entry").alias(entry), *stratum, *named)
    short = pending.select(*stratum).distinct().limit(5).collect()
    raise ValueError(f"no candidates without overlap after {rounds} rounds for strata {[tuple(r) for r in short]}")


def baseline_metrics(drawn: DataFrame, trial: str, order: Sequence[str], hours: float) -> DataFrame:
    """trial, n, wins, pnl, pnl_after, expectancy, win_rate, per_hour and max_drawdown of won, pnl and pnl_after; 8 decimals of sums."""
    out = drawn.groupBy(trial).agg(F.count("*").alias("n"), F.count(F.when(F.col("won"), 1)).alias("wins"), F.round(F.sum("pnl"), 8).alias("pnl"), F.round(F.sum("pnl_after"), 8).alias("pnl_after"), F.avg("pnl_after").alias("expectancy"))
    deep = drawdowns(drawn, trial, order, "pnl_after").select(trial, F.round("drawdown_absolute", 8).alias("max_drawdown"))
    return out.join(deep, trial).withColumns({"win_rate": F.try_divide("wins", "n"), "per_hour": F.col("n") / hours})
