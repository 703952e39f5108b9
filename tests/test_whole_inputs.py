"""Queries that take the whole of their tables."""

import datetime as dt
import random

import pytest

from cadence.operators import grid, modes
from cadence.plans import adapters
from cadence.plans.catalog import QUERIES

D = "/root/testdata/sf0.01"


def test_every_customer_is_a_station(spark):
    customers = spark.read.parquet(f"{D}/customer.parquet").count()
    found = adapters.features(spark, D)
    assert found.count() == customers > 59
    assert found.where("lon < -180 or lon >= 180").count() == 0
    assert QUERIES["f5_nearest_cell"](spark, D).count() == customers


def test_every_day_and_template_is_taken(spark):
    hours = adapters.hourly(spark, D)
    got = QUERIES["f6_as_of_daily"](spark, D)
    # with all days no hour is without a value
    assert got.count() == got.where("value is not null").count() == hours.count()
    joined = {r.station: (r.n, r.with_shape) for r in QUERIES["f1_template_join"](spark, D).collect()}
    assert joined == {r.station: (r["count"], r["count"]) for r in hours.groupBy("station").count().collect()}


def test_units_are_left_to_do(spark):
    assert QUERIES["b20_resume"](spark, D).count() > 0


def test_gaps(spark):
    at = lambda d, h: dt.datetime(2020, 1, d, h)
    times = spark.createDataFrame([("a", at(1, 5)), ("a", at(2, 0)), ("a", at(3, 9)), ("b", at(2, 1))], "station string, time timestamp_ntz")
    daily = spark.createDataFrame([("a", at(2, 0), 7.0)], "station string, time timestamp_ntz, value double")
    assert {(r.station, r.time): r.value for r in grid.as_of(times, daily, ["station"]).collect()} == {("a", at(1, 5)): None, ("a", at(2, 0)): 7.0, ("a", at(3, 9)): 7.0, ("b", at(2, 1)): None}
    hours = spark.createDataFrame([("a", 2020, at(1, 5), 1.0), ("a", 2020, dt.datetime(2020, 2, 1, 5), 1.0), ("b", 2020, at(1, 5), 1.0)], "station string, file_year int, time timestamp_ntz, obs double")
    shapes = spark.createDataFrame([("a", 1, [0.5] * 24, 0.0)], "station string, month int, s array<float>, shape_range float")
    assert {(r.station, r.time.month): r.s for r in modes.with_templates(hours, shapes, ["station"]).collect()} == {("a", 1): 0.5, ("a", 2): None}


@pytest.mark.parametrize("days", [1, 30, 4000])
def test_as_of_against_every_value(spark, days):
    draw = random.Random(days)
    at = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(hours=draw.randint(0, 24 * 400))
    keys = ["a", "a", "a", "b", None]
    times = [(i, draw.choice(keys), at()) for i in range(400)] + [(900, "a", None), (901, "z", at()), (902, "a", dt.datetime(1960, 1, 1))]
    values = [(draw.choice(keys), at(), draw.choice([None, 1.0, 2.0, 3.0])) for _ in range(60)] + [("a", None, 9.0)]
    values += [values[0], ("a", times[0][2], 5.0)]
    asked, known = spark.createDataFrame(times, "id int, k string, time timestamp_ntz"), spark.createDataFrame(values, "k string, time timestamp_ntz, value double")
    got = {r.id: r.value for r in grid.as_of(asked, known, ["k"], block_days=days).collect()}
    last = lambda k, t: max(((u, v) for j, u, v in values if j == k and u is not None and v is not None and u <= t), default=(None, None))[1]
    assert got == {i: None if t is None else last(k, t) for i, k, t in times}


def test_as_of_orders_blocks_and_not_keys(spark):
    rows = spark.createDataFrame([("a", dt.datetime(2020, 1, 1), 1.0)], "k string, time timestamp_ntz, value double")
    plan = grid.as_of(rows.drop("value"), rows, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and all("__block" in line for line in windows)
    assert "UnresolvedHint" not in plan and "Join Inner" not in plan
