"""Every query that has SQL, side by side with DuckDB on sf0.001."""

import math

import duckdb
import pytest
from lectern.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    sql = registry.oracle_sql().get(name)
    if sql:
        found = duck.execute(sql)
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns)
        wanted = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in found.fetchall())
        assert sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in rows) == wanted


def test_entry(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.columns == ["chunk_id", "rank", "snippet"] and found.count() == registry.queries()["keyword_scan"](spark, SF).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
