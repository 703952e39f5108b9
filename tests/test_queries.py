"""Every registered query of the library against its SQL on the small tables."""

import os

import pytest

import __spark_entry__ as entry
from cadence.plans import catalog
from jobs import registered

D = "/root/testdata/sf0.01"
QUERIES, SQL = catalog.QUERIES | registered.QUERIES, catalog.SQL | registered.SQL


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(D):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{D}/{name}'")
    return con


def show(v):
    return "null" if v is None else f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df, want = QUERIES[name](spark, D), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    rows = df.collect()
    assert sorted(tuple(show(v) for v in r) for r in rows) == sorted(tuple(show(r[i]) for i in at) for r in want.fetchall())
    assert not any(isinstance(v, float) and v != v for r in rows for v in r)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_day_windows_share_one_exchange(spark):
    from cadence.operators.modes import strict_modes
    from cadence.plans import adapters

    shaped, plan = adapters.shaped(spark, D), lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(strict_modes(shaped)).count("Exchange hashpartitioning") - plan(shaped).count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in plan(strict_modes(shaped))


def test_archive_without_joins(spark):
    """The series' own sums, the climatology, and one exchange by cell for checks, fit, errors and flags."""
    plan = QUERIES["c17_quality_flag"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 3


def test_solution_is_not_copied_into_the_shapes(spark):
    sizes = {name: len(QUERIES[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()) for name in ("c9_ridge_fit", "c22_templates", "d6_dynamic")}
    assert sizes["c22_templates"] < 1.5 * sizes["c9_ridge_fit"] and sizes["d6_dynamic"] < 30_000, sizes
