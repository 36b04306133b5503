"""The driver contract: names, shapes and SQL of every query on the smallest data."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float) and not isinstance(v, bool):
        return "nan" if math.isnan(v) else int(v) if v == int(v) and abs(v) < 1e15 else float(f"{v:.9g}")
    return v


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, db, name):
    df = entry.queries()[name](spark, str(DATA))
    r = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    want = sorted(repr(tuple(plain(x[i]) for i in order)) for x in r.fetchall())
    assert sorted(repr(tuple(plain(x) for x in row)) for row in df.collect()) == want


def test_whole_event_queries_hold_every_user(spark, db):
    users = {x[0] for x in db.execute("select distinct user_id from events").fetchall()}
    for name in ("stream_sessions", "prev_nonnull_compare"):
        assert {r["user_id"] for r in entry.queries()[name](spark, str(DATA)).select("user_id").distinct().collect()} == users


BRUTE = {
    "candidate_join": """
with l as (select l_orderkey * 10 + l_linenumber line, o_custkey, l_shipdate::date s from lineitem join orders on l_orderkey = o_orderkey),
j as (select line, o_orderkey cand, abs(date_diff('day', o_orderdate::date, s))::int gap from l join orders using (o_custkey)),
r as (select *, min(gap) over (partition by line) <= 60 strict, row_number() over (partition by line order by gap, cand) rk from j)
select line, cand, gap, case when strict then 'strict' else 'fallback' end stage, rk::int as rank from r where rk <= 30 and (gap <= 60 or not strict)""",
    "tolerance_join": """
select o_orderkey, l_orderkey * 10 + l_linenumber line, round(o_totalprice)::bigint - round(l_extendedprice)::bigint diff from orders join lineitem on abs(round(o_totalprice)::bigint - round(l_extendedprice)::bigint) <= 3""",
}


@pytest.mark.parametrize("name", sorted(BRUTE))
def test_whole_joins_equal_nested_loops(spark, db, name):
    df = entry.queries()[name](spark, str(DATA))
    r = db.execute(BRUTE[name])
    order = [[d[0] for d in r.description].index(c) for c in df.columns]
    want = sorted(repr(tuple(plain(x[i]) for i in order)) for x in r.fetchall())
    assert want and sorted(repr(tuple(plain(x) for x in row)) for row in df.collect()) == want


def test_whole_equal_groups_brute_force(spark):
    folder = DATA.parent / "sf0.01"  # the smallest scale at which groups pair
    groups = {}
    for k, b, c, z, v in duckdb.execute(f"select p_partkey, p_brand, p_type, p_size, p_retailprice from '{folder}/part.parquet'").fetchall():
        groups.setdefault((b, c, z), ([], []))[k % 2].append((v, k))
    pairs = [list(zip(sorted(a), sorted(b), strict=True)) for a, b in groups.values() if len(a) == len(b) == len({v for v, _ in a}) == len({v for v, _ in b})]
    want = sorted((a[1], b[1]) for g in pairs for a, b in g)
    assert want and sorted((r["l"], r["r"]) for r in entry.queries()["equal_groups"](spark, str(folder)).collect()) == want
