from __future__ import annotations

import __spark_entry__ as entry


def test_names_agree(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 60
    assert entry.entry(spark).columns == ["event_id", "k_return"]
