"""Streams over tables of one file and of several."""

from __future__ import annotations

import pytest

from tidemark.plans import stream_queries as Q


@pytest.mark.parametrize("files", [1, 4])
def test_streams_read_tables_of_part_files(spark, tmp_path, files):
    rows = spark.range(400).selectExpr("id AS event_id", "id % 7 AS user_id", "timestamp_seconds(1700000000 + id * 3600) AS ts", "double(id % 50) AS value", "IF(id % 3 = 0, 'purchase', 'view') AS event_type")
    rows.repartition(files).write.parquet(str(tmp_path / "events.parquet"))
    want = sorted(map(tuple, Q.batch_positions(spark, str(tmp_path)).collect()))
    assert want and sorted(map(tuple, Q.stream_positions(spark, str(tmp_path)).collect())) == want
    assert Q.stream_throttle(spark, str(tmp_path)).count() > 0
    assert Q.stream_first_seen(spark, str(tmp_path)).count() == 14
