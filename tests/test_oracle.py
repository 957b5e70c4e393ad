"""Every query against its SQL in DuckDB at a small scale."""

import math

import duckdb
import pytest

from ferrule.plans import acquisition, catalogue, evidence, identity, oracle, pages, shown

SF = "/root/testdata/sf0.001"
queries = lambda: catalogue.queries() | evidence.queries() | shown.queries() | acquisition.queries() | pages.queries() | identity.queries()
oracle_sql = lambda: oracle.oracle_sql() | evidence.oracle_sql() | shown.oracle_sql() | acquisition.oracle_sql() | pages.oracle_sql() | identity.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return f"{x:.9g}" if isinstance(x, int) and not isinstance(x, bool) and abs(x) < 10**8 else str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    out = duck.execute(oracle_sql()[name])
    want = table([d[0] for d in out.description], out.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_query_but_the_frontier_has_sql():
    assert set(queries()) - set(oracle_sql()) == {"crawl_frontier"}
