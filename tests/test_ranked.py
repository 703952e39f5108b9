"""Places and quantiles by slices of the values, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import inventory, paired, ranks


def test_places_and_quantiles(spark):
    rows = spark.range(5000).select((F.col("id") % 3).cast("string").alias("k"), F.when(F.col("id") % 4 != 0, F.round(F.pow(F.rand(7), 5) * 100, 1)).otherwise(1.5).alias("v"), F.col("id").alias("station"))
    rows = spark.createDataFrame([*rows.collect(), ("0", None, -1)], rows.schema)
    found = paired.ranked(rows, "v", ["k"], ["station"]).collect()
    assert len(found) == 5000
    for k in "012":
        mine = sorted((r for r in found if r.k == k), key=lambda r: (r.v, r.station))
        assert [r.place for r in mine] == list(range(1, len(mine) + 1)) and {r.total for r in mine} == {len(mine)}
    shares = [0.0, 0.01, 0.25, 0.5, 0.995, 1.0]
    got = paired.quantiles(rows, F.col("v"), shares).first()
    assert got.total == 5000 and got.q == pytest.approx(np.quantile([r.v for r in found], shares).tolist())


def test_without_values(spark):
    none = spark.createDataFrame([("a", None)], "k string, v double")
    assert paired.ranked(none, "v", ["k"]).count() == 0
    assert tuple(paired.quantiles(none, F.col("v"), [0.5]).first()) == ([None], 0)
    assert paired.histogram(none, F.col("v")).count() == 0 and paired.plot_limit(none, ["v"]).first().plot_limit == 4


@pytest.mark.parametrize("seed", range(2))
def test_quantiles_of_groups(spark, seed):
    draw = np.random.default_rng(seed)
    wide = np.concatenate([draw.normal(size=300) * 10.0 ** draw.integers(-300, 300, 300), [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308], np.repeat(draw.normal(size=5), 60), 1 + np.arange(60) * 2.0**-40])
    rows = [(None if g == 2 else f"g{g}", int(h), float(v), float(-v) if i % 3 else None) for i, (g, h, v) in enumerate(zip(draw.integers(0, 4, len(wide)), draw.integers(0, 2, len(wide)), wide))]
    rows += [("g0", 0, float("nan"), 1.0), ("g9", 0, None, None), ("g1", 1, None, 2.0)]
    shares = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = ranks.quantiles(spark.createDataFrame(rows, "a string, b int, x double, y double"), ["a", "b"], {"x": F.col("x"), "y": F.col("y")}, shares)
    got = {(r.a, r.b): r for r in found.collect()}
    assert set(got) == {(a, b) for a, b, *_ in rows if a != "g9"}
    for (a, b), r in got.items():
        for c, at in (("x", 2), ("y", 3)):
            mine = [r[at] for r in rows if (r[0], r[1]) == (a, b) and r[at] is not None and r[at] == r[at]]
            assert r[c] == pytest.approx(np.quantile(mine, shares).tolist(), rel=1e-9)


def test_infinite_values_have_places(spark):
    rows = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,)], "v double")
    assert [r.v for r in ranks.ranked(rows, "v", []).orderBy("place").collect()] == [float("-inf"), 1.0, float("inf")]


def test_equal_rows_take_places_in_turn(spark):
    rows = spark.createDataFrame([(1.0, "a")] * 5 + [(1.0, "b")] * 2 + [(0.5, "c"), (None, "d")], "v double, t string")
    assert [(r.v, r.t, r.place, r.total) for r in ranks.ranked(rows, "v", [], ["t"]).orderBy("place").collect()] == [(0.5, "c", 1, 8), *((1.0, "a", p, 8) for p in range(2, 7)), (1.0, "b", 7, 8), (1.0, "b", 8, 8)]


def test_heavy_ties_are_ordered_in_small_windows(spark):
    """19,000 of 20,000 values are equal; what any window orders is a fraction of that."""
    rows = spark.range(20000).select(F.lit("m").alias("k"), F.when(F.col("id") < 19000, 13.0).otherwise(F.col("id") / 7.0).alias("v"), (F.col("id") % 97).cast("string").alias("station"), (F.col("id") / 97).cast("int").alias("month"))
    counted = ranks._sliced(rows.groupBy(*rows.columns).agg(F.count("*").alias("__n")).withColumnRenamed("v", "__v"), "__v")
    within, largest = ["k"], []
    for by in ("__step", "__float", "__v", "station"):
        largest.append(ranks._summed(counted, within, by).groupBy(*within).count().agg(F.max("count")).first()[0])
        within.append(by)
    largest.append(counted.groupBy(*within).count().agg(F.max("count")).first()[0])
    assert max(largest) <= 400
    got = paired.ecdf(rows, "v", ["k"])
    assert got.agg(F.count("*"), F.count_distinct("fraction"), F.max("fraction")).first()[:] == (20000, 20000, 1.0)


def test_no_quantile_of_a_group_in_one_task(spark):
    from cadence.plans import catalog

    medians = spark.createDataFrame([("m", 1.0)], "mode string, station_median_rmse_c double")
    found = {name: catalog.QUERIES[name](spark, "/root/testdata/sf0.001") for name in ("c20_archive_summary", "e14_paired_summary", "e17_thresholds", "e19_tz_qa", "e29_distribution", "e31_by_continent", "m1_histogram", "m7_own_paired", "m8_plot_limit")}
    for name, df in (found | {"e34": inventory.map_stats(medians)}).items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile" not in plan and "median(" not in plan, name


def test_places_of_stations_with_the_same_orders(spark, tmp_path):
    """m2_ecdf: the last bits of a sum, which the order of rows decides, are no reason to rank one of them before another."""
    import random

    from cadence.plans import adapters

    rng = random.Random(5)
    prices = [round(rng.uniform(1000, 500_000), 2) for _ in range(60)]
    rows = [(s, p, "F", "1997-03-04") for s in range(60) for p in rng.sample(prices, 60)]
    frame = spark.createDataFrame(rows, "o_custkey long, o_totalprice double, o_orderstatus string, day string")
    frame.withColumn("o_orderdate", F.to_timestamp_ntz("day")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    found = paired.ecdf(adapters.order_months(spark, str(tmp_path)), "rmse", ["mode"]).orderBy("fraction").collect()
    assert len({r.rmse for r in found}) == 1 and found[0].rmse == pytest.approx(np.std(prices) / 9973)
    assert [r.station for r in found] == sorted(str(s) for s in range(60))


def test_deviation_of_any_numbers(spark):
    from cadence.functions.scoring import deviation

    groups = {"cents": [1.25, 3.5, 2.75], "more digits": [1 / 3, 2 / 3, 5.0], "large": [1e300 / 1e150, 3e150, 2e150], "one": [7.77] * 9, "null": [None, None], "some null": [1.0, None, 2.0], "below": [-99_999_999.99, 99_999_999.98]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    found = {r.k: r.d for r in rows.groupBy("k").agg(deviation(F.col("v")).alias("d")).collect()}
    assert found["null"] is None and found["one"] == 0
    for k, vs in groups.items():
        if k != "null":
            assert found[k] == pytest.approx(np.std([v for v in vs if v is not None]))
    odd = spark.createDataFrame([(float("nan"),), (1.0,)], "v double").agg(deviation(F.col("v")).alias("d")).first().d
    assert odd != odd
