"""The driver's three functions."""

import re

import __spark_entry__ as entry


def test_names_and_flagship(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 140
    assert entry.entry(spark).count() == 10
    ops = {m[0] for n in queries if (m := re.match(r"op\d+(?=_)", n))}
    assert not ops or ops == {f"op{k}" for k in range(1, 14)} and "pipeline" in queries
