"""Replays as a stream: one keyed state for each session and asset, fed by references, market descriptions, snapshots and skips.

The rows are those of `tidemark.operators.replays.replay`. State is kept in maps, so that a batch reads and writes only
the markets and times that it touches, each once.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import replays as R
from ..operators.outcomes import LAG, QUALIFIED

FOUND = "session string, n long, t long, market string, asset string, question string, kind string, reason string, external_change double, market_change double, lag_seconds double, lag_score double, direction string, confidence double"
_COLUMNS = [c.split()[0] for c in FOUND.split(", ")]
#: Rows of a key that are Python objects at once.
ROWS = 1 << 16
NEEDED = ("n", "t", "kind", "market", "question", "source", "price", "yes", "bid", "ask", "liquidity", "seconds_left", "reason")


def _rounded(x: float, digits: int) -> float:
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def measured(price: float, before: float, yes: float, yes_before: float, seconds: float, liquidity: float, left: float, bid: float, ask: float, bounds: dict[str, float]) -> tuple[bool, str, tuple]:
    """`lag_measurement` of one snapshot: whether it qualifies, the reason, and the fields that are reported."""
    least = bounds["threshold_bps"]
    change = price / before - 1 if before else 0.0
    bps, moved = change * 10_000, yes - yes_before
    expected = min(0.30, abs(bps) / 1000)
    direction = "UP" if bps >= least else "DOWN" if bps <= -least else "NONE"
    ratio = max(0.0, moved if direction == "UP" else -moved) / expected if expected > 0 else 1.0
    strength = min(1.0, abs(bps) / max(4 * least, 1.0))
    score = max(0.0, 1 - ratio) * strength
    confidence = max(0.0, min(1.0, 0.70 * score + 0.20 * strength + 0.10 * (1 - min(1.0, (ask - bid) / 0.10))))
    checks = (
        (liquidity < bounds["min_liquidity"], "liquidity_below_minimum"),
        (left < bounds["min_seconds"], "near_expiry_insufficient_time"),
        (direction == "NONE", "external_move_below_threshold"),
        (ratio >= bounds["repricing_ratio"], "polymarket_already_repriced"),
        (confidence < bounds["min_confidence"], "confidence_below_threshold"),
    )
    reason = next((r for failed, r in checks if failed), QUALIFIED)
    return reason == QUALIFIED, reason, (_rounded(change, 8), _rounded(moved, 8), _rounded(max(0.0, seconds), 3), _rounded(score, 6), direction, _rounded(confidence, 6))


class _Kept:
    """A map state's values during one batch of a key: each is read once and, if it changed, written once."""

    def __init__(self, state):
        self.state, self.values, self.changed = state, {}, set()

    def get(self, key) -> tuple | None:
        if key not in self.values:
            self.values[key] = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
        return self.values[key]

    def put(self, key, value: tuple) -> None:
        self.values[key] = value
        self.changed.add(key)

    def write(self) -> None:
        for key in self.changed:
            self.state.updateValue((key,), self.values[key])


class Replayer(StatefulProcessor):
    """The state of one session's asset: the last place handled, references by time, and markets with their baselines."""

    def __init__(self, bounds: dict[str, float], least_left: float, keep: int):
        self.bounds, self.least_left, self.keep = bounds, least_left, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n long, t long")
        self.references = handle.getMapState("references", "t long", "price double, source string")
        self.markets = handle.getMapState("markets", "market string", "question string, t long, price double, source string, yes double, reported boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One batch of a key is sorted at once; the trigger's size bounds it.
        frame = pd.concat(list(rows)).sort_values("n")
        place, newest = self.last.get() if self.last.exists() else (-1, -(2**63))
        markets, references = _Kept(self.markets), _Kept(self.references)
        for i in range(0, len(frame), ROWS):
            part, found = frame[list(NEEDED)].iloc[i : i + ROWS], []
            for row in part.astype(object).where(part.notna(), None).itertuples(index=False):
                if row.n <= place:
                    continue
                place, newest = row.n, max(newest, row.t)
                if row.kind == R.LIFECYCLE:
                    if row.question is not None and row.market is not None and markets.get(row.market) is None:
                        markets.put(row.market, (row.question, None, None, None, None, False))
                elif row.kind == R.REFERENCE:
                    references.put(row.t, (row.price, row.source))
                elif row.kind == R.SNAPSHOT:
                    found.append(self._snapshot(key, row, markets, references))
                elif row.kind == R.SKIP and row.reason not in R.RECOMPUTED and not (row.reason or "").startswith(R.SOURCE_CHANGED):
                    found.append((key[0], row.n, row.t, row.market, key[1], row.question, "skipped", row.reason, *[None] * 6))
            yield pd.DataFrame(found, columns=_COLUMNS)
        markets.write()
        references.write()
        self.last.update((place, newest))
        for (t,) in [k for k in self.references.keys() if k[0] < newest - self.keep]:
            self.references.removeKey((t,))

    def _snapshot(self, key, row, markets: _Kept, references: _Kept) -> tuple:
        def told(question, kind, reason, fields=(None,) * 6):
            return (key[0], row.n, row.t, row.market, key[1], question, kind, reason, *fields)

        if row.market is None or markets.get(row.market) is None:
            return told(None, "skipped", R.UNKNOWN)
        question, t, price, source, yes, reported = markets.get(row.market)
        if references.get(row.t) is None:
            return told(question, "skipped", R.MISSING)
        now, origin = references.get(row.t)
        if t is not None and source != origin:
            markets.put(row.market, (question, row.t, now, origin, row.yes, reported))
            return told(question, "skipped", f"{R.SOURCE_CHANGED}{source}->{origin}")
        if t is None:
            t, price, source, yes = row.t, now, origin, row.yes
        good, reason, fields = measured(now, price, row.yes, yes, (row.t - t) / 1e6, row.liquidity, row.seconds_left, row.bid, row.ask, self.bounds)
        if good and row.seconds_left < self.least_left:
            good, reason = False, "late_entry_window"
        kind = "opportunity" if good and not reported else "skipped"
        markets.put(row.market, (question, t, price, source, yes, reported or good))
        return told(question, kind, R.DUPLICATE if good and reported else reason, fields)

    def close(self) -> None:
        pass


#: The state store that keyed maps need; set it before the first stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_maps(spark: SparkSession) -> SparkSession:
    """The session, with streams that it starts from now on keeping their state in the store that maps need."""
    spark.conf.set(*STORE)
    return spark


def stream_replay(events: DataFrame, bounds: dict[str, float] = LAG, least_left: float = 60.0, keep: int = 3_600_000_000) -> DataFrame:
    """What `replay` gives, from a stream of the same events in order of n.

    Events of a session's asset that come again, or after a later one, are left out. Every event must name its asset;
    references are kept until `keep` microseconds of event time have passed. State survives restarts in the checkpoint.
    """
    rows = events.select("session", "asset", *NEEDED).filter("session is not null and asset is not null")
    return rows.groupBy("session", "asset").transformWithStateInPandas(Replayer(bounds, least_left, keep), FOUND, "Append", "None")
