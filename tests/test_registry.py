"""Every registered query against its SQL on the smallest tables, and all others by their rows."""

import math

import duckdb
import pytest

from gridloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    clean = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 5) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted((tuple(clean(row[k]) for k in order) for row in values), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    assert got and len(set(df.columns)) == len(df.columns)
    if name in registry.ORACLE_SQL:
        found = duck.execute(registry.ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        want = rows(names, found.fetchall())
        have = rows(df.columns, [tuple(r) for r in got])
        assert len(have) == len(want)
        for a, b in zip(have, want, strict=True):
            assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, float) for x in b) else a == b
