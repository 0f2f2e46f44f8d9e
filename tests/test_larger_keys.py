"""Queries on tables whose keys and spans go beyond those of the test tables, against their SQL."""

import duckdb
import pytest

from annalist import catalog
from annalist.operators import asof


def both(spark, tmp_path, query, name, select):
    at = tmp_path / f"{name}.parquet"
    con = duckdb.connect()
    con.execute(f"copy ({select}) to '{at}' (format parquet)")
    con.execute(f"create view {name} as select * from '{at}'")
    cur = con.execute(catalog.ORACLE[query])
    cols = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    return sorted(map(tuple, catalog.QUERIES[query](spark, str(tmp_path)).select(cols).collect())), want


def test_base36_of_numbers_of_four_digits(spark, tmp_path):
    keys = [0, 9, 35, 36, 1295, 1296, 46655, 46656, 46657, 46691, 46692, 47952, 3 * 46656, 10**9]
    got, want = both(spark, tmp_path, "q_base36", "part", f"select unnest({keys}::bigint[]) as p_partkey")
    assert got == want and len(got) == len(keys)


EVENTS = {
    "gaps": [(1, "a", 0), (1, "a", 150), (2, "a", 100), (2, "b", 101), (2, "b", 199), (3, "a", 900), (3, "a", 1234), (4, "c", 1300)],
    "below 0": [(1, "a", -350), (1, "a", 200), (2, "a", -200), (2, "a", -100), (3, "a", None)],
    "none above 0": [(1, "a", -350)],
    "blocks": [(1, "a", 0), (1, "a", 999_999), (2, "a", 409_600), (2, "a", 819_200), (3, "a", 409_599), (3, "b", 500_000), (3, "b", 500_099)],
    "nulls": [(None, None, 5), (None, None, 205), (None, "a", None)],
}


@pytest.mark.parametrize("name", EVENTS)
def test_running_by_where_spans_begin_and_end(spark, tmp_path, name):
    rows = ", ".join(f"({u if u is not None else 'null'}::bigint, {repr(t) if t else 'null'}::varchar, {i if i is not None else 'null'}::bigint)" for u, t, i in EVENTS[name])
    got, want = both(spark, tmp_path, "q_interval_running", "events", f"select * from (values {rows}) v(user_id, event_type, event_id)")
    assert got == want


def test_running_of_no_events(spark, tmp_path):
    got, want = both(spark, tmp_path, "q_interval_running", "events", "select 1::bigint as user_id, 'a' as event_type, 1::bigint as event_id where false")
    assert got == want == []


def test_running_of_as_many_long_spans_as_dates(spark):
    """Spans over nearly all dates: their pairs would be 400 million rows."""
    n = 20_000
    spans = spark.range(n).selectExpr("id as first", f"{n} * 100 - id as last")
    got = asof.running(spans, "first", "last", spark.range(1).selectExpr(f"{n} * 100L as now"), 100)
    assert got.selectExpr("count(*)", "max(running)", "sum(running)").head()[:] == (n + 1, n, sum((n * 100 - i) // 100 - -(-i // 100) + 1 for i in range(n)))
