from __future__ import annotations

import __spark_entry__


def test_entry_has_the_queries_of_the_engine():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert "heuristic_leads" in found and set(sql) <= set(found)
    assert all(isinstance(s, str) for s in sql.values())


def test_flagship(spark):
    assert __spark_entry__.entry(spark).columns
