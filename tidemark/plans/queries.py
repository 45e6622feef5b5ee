"""All queries of the library, outside of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import capture_queries, lab_queries, market_queries, replay_queries, stream_queries, table_queries, time_queries, trading_queries, wallet_queries

_ALL = time_queries.BATCH | table_queries.TABLES | stream_queries.STREAMS | trading_queries.TRADING | wallet_queries.WALLETS | market_queries.MARKETS | lab_queries.LAB | capture_queries.CAPTURE | replay_queries.REPLAYS
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v[0] for k, v in _ALL.items()}
ORACLES: dict[str, str] = {k: v[1] for k, v in _ALL.items() if v[1]}
