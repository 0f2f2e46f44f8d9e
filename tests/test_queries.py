"""Every query of the library against its SQL, at the smallest scale."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from annalist import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((plain(k), plain(x)) for k, x in v.items()))
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v) if not isinstance(v, bool) else repr(v)


def number(v):
    """Whole floats and integers alike."""
    return v[:-2] if isinstance(v, str) and v.endswith(".0") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(catalog.ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(cols)
    order = sorted(cols)
    rows = sorted(tuple(number(plain(r[c])) for c in order) for r in got.collect())
    want = sorted(tuple(number(plain(r[cols.index(c)])) for c in order) for r in cur.fetchall())
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).columns
