"""Every query outside the optional subpackage against its SQL, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from driftquarry.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 7) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    got = registry.queries()[name](spark, sf_dir)
    want = oracle.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    expected = rows(columns, want.fetchall())
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == expected
    assert expected


def test_every_query_without_sql_runs(spark, sf_dir):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, sf_dir).count() > 0, name
