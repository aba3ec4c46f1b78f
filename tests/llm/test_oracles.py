"""The text operators that SQL can express, against their SQL."""

import duckdb
import pytest

from gridloom.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    names = sorted(c[0] for c in found.description)
    at = [[c[0] for c in found.description].index(n) for n in names]
    want = sorted(str(tuple(r[k] for k in at)) for r in found.fetchall())
    got = sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, SF).select(*names).collect())
    assert len(got) == len(want) and [(a, b) for a, b in zip(got, want, strict=True) if a != b][:3] == []
