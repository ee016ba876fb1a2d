"""Every query against its SQL on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from fringelake.queries import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    flat = lambda v: tuple(v) if isinstance(v, list) else v + 0.0 if isinstance(v, float) else float(v) if isinstance(v, Decimal) else v
    return sorted((tuple(flat(r[k]) for k in order) for r in found), key=repr), [columns[k] for k in order]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sql, name):
    df = registry.queries()[name](spark, SF)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    rel = sql.execute(registry.oracle_sql()[name])
    want = rows(rel.fetchall(), [c[0] for c in rel.description])
    assert got[1] == want[1]
    assert len(got[0]) == len(want[0]) > 0
    for a, b in zip(got[0], want[0]):
        assert a == b or all(x == y or (isinstance(x, float) and abs(x - y) <= 2e-6 * max(1, abs(y))) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
