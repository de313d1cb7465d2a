"""Every registered query with SQL gives DuckDB's rows, on whole tables of the smallest data."""

import math
import os

import duckdb
import pytest

from korvid.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


#: Conditions of these are Python functions, which is what they are for.
CALLBACKS = {"u_key_callback"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    """The rows are DuckDB's, and no plan runs Python or a Cartesian product."""
    df = QUERIES[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert name in CALLBACKS or "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
    own = rows(df.columns, df.collect())
    if name in ORACLES:
        found = duck.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(found.columns)
        assert own == rows(found.columns, found.fetchall())


def test_flagship(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark).collect()
    assert len(got) == 100 and [r["o_totalprice"] for r in got] == sorted((r["o_totalprice"] for r in got), reverse=True)


def test_filters_reach_the_scan(spark, data):
    """And unused columns aren't read."""
    for name in ("p_and", "p_multi_needle", "p_negative"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().toString()
        assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan
    plan = QUERIES["p_and"](spark, data)._jdf.queryExecution().toString()
    assert "o_orderpriority" not in plan.split("Physical Plan")[1].split("ReadSchema")[1]
