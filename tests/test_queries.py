"""Every query of the library itself against its SQL, on small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.01"
PLANS = {name: (f, plan.SQL.get(name)) for plan in entry.PLANS for name, f in plan.QUERIES.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def tables():
    held = duckdb.connect()
    for name in os.listdir(FOLDER):
        held.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return held


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query_equals_its_sql(spark, tables, name):
    query, sql = PLANS[name]
    assert sql, "every query of the library has SQL"
    found = query(spark, FOLDER)
    wanted = tables.sql(sql)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(wanted.columns, wanted.fetchall())


def test_names_are_told_apart():
    assert sum(len(plan.QUERIES) for plan in entry.PLANS) == len(PLANS)
    assert set(PLANS) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
