"""Positions that open on a signal and close on target, stop or timeout, one at a time for each key; and throttling.

The same step is used by the stream, whose state is one open position a key, and by the batch twin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRADE = "key long, entry_id long, entry_t long, entry_value double, exit_id long, exit_t long, exit_value double, reason string"


@dataclass(frozen=True)
class Rules:
    target: float = 20.0
    stop: float = 20.0
    timeout: int = 48 * 3_600_000_000


def step(position: tuple | None, row: tuple, rules: Rules) -> tuple[tuple | None, tuple | None]:
    """The position after an event (id, t, value, signal), and the trade that it closes. An event closes, then may open."""
    event, t, value, signal = row
    closed = None
    if position is not None:
        move = value - position[2]
        reason = "target" if move >= rules.target else "stop" if move <= -rules.stop else "timeout" if t >= position[1] + rules.timeout else None
        if reason:
            closed, position = (*position, event, t, value, reason), None
    if position is None and signal:
        position = (event, t, value)
    return position, closed


def _frame(key: int, trades: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in TRADE.split(", ")]
    return pd.DataFrame([(key, *t) for t in trades], columns=names)


def stream_positions(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The closed trades of a stream with key, id, t, value, signal.

    Within a micro-batch a key's events are taken in order of (t, id); an event that isn't later than the last one
    handled, as when a source repeats itself or brings it late, is left out, so each counts once and none is taken out of
    order. Events without a key are left out, as in `batch_positions`. State survives restarts in the checkpoint.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_t, last_id, *held = state.get if state.exists else (-(2**63), -(2**63), None, None, None)
        position = None if held[0] is None else tuple(held)
        trades = []
        rows = pd.concat(list(frames)).sort_values(["t", "id"])
        for row in zip(rows.id.tolist(), rows.t.tolist(), rows.value.tolist(), rows.signal.tolist(), strict=True):
            if (row[1], row[0]) <= (last_t, last_id):
                continue
            last_t, last_id = row[1], row[0]
            position, closed = step(position, row, rules)
            if closed:
                trades.append(closed)
        state.update((last_t, last_id, *(position or (None, None, None))))
        yield _frame(key[0], trades)

    kept = "last_t long, last_id long, entry_id long, entry_t long, entry_value double"
    return events.select("key", "id", "t", "value", "signal").filter("key is not null").groupBy("key").applyInPandasWithState(run, TRADE, kept, "append", GroupStateTimeout.NoTimeout)


def batch_positions(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The same trades from a table: each key's rows are walked in order, batch by batch, holding one position."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, position = None, None
        for x in frames:
            found = []
            for key, *row in zip(x.key.tolist(), x.id.tolist(), x.t.tolist(), x.value.tolist(), x.signal.tolist(), strict=True):
                if key != now:
                    now, position = key, None
                position, closed = step(position, tuple(row), rules)
                if closed:
                    found.append((key, *closed))
            yield pd.DataFrame(found, columns=[c.split()[0] for c in TRADE.split(", ")])

    rows = events.select("key", "id", "t", "value", "signal").filter("key is not null").dropDuplicates(["key", "id"])
    return rows.repartition("key").sortWithinPartitions("key", "t", "id").mapInPandas(run, TRADE)


def stream_throttled(events: DataFrame, interval: int) -> DataFrame:
    """The events of a stream with key, id, t that come `interval` or more after the key's last one that was let through."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["t", "id"])
        keep = []
        for t in rows.t.tolist():
            keep.append(last is None or t >= last + interval)
            if keep[-1]:
                last = t
        state.update((last,))
        yield rows[["key", "id", "t"]][keep]

    return events.select("key", "id", "t").filter("key is not null").groupBy("key").applyInPandasWithState(run, "key long, id long, t long", "last long", "append", GroupStateTimeout.NoTimeout)


def first_seen(events: DataFrame, identity: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """Each identity once, of a stream or a table; in a stream, repeats are forgotten when they come over `delay` later.

    ts is a timestamp column of the stream's event time. Of a table, the earliest row of each identity is kept.
    """
    if events.isStreaming:
        return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(identity)
    rest = [c for c in events.columns if c not in identity]
    return events.groupBy(*identity).agg(F.min_by(F.struct(*rest), ts).alias("_r")).select(*identity, "_r.*")


def polls(seen: DataFrame, wallet: str, poll: str, identity: str) -> DataFrame:
    """wallet, identity, first_poll, last_poll, polls, kind: baseline (in the wallet's first poll) or new, and gaps = polls missed between."""
    every = seen.select(wallet, poll).distinct()
    from pyspark.sql import Window

    numbered = every.withColumn("_n", F.row_number().over(Window.partitionBy(wallet).orderBy(poll)))
    rows = seen.select(wallet, poll, identity).distinct().join(numbered, [wallet, poll])
    out = rows.groupBy(wallet, identity).agg(F.min(poll).alias("first_poll"), F.max(poll).alias("last_poll"), F.count("*").alias("polls"), F.min("_n").alias("_a"), F.max("_n").alias("_b"))
    return out.withColumn("kind", F.when(F.col("_a") == 1, "baseline").otherwise("new")).withColumn("gaps", F.col("_b") - F.col("_a") + 1 - F.col("polls")).drop("_a", "_b")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all there is now, append its rows to Parquet at `path`, and return that table."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
