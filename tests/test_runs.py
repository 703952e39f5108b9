"""Runs that stop and are taken up, what they log, and the cache of templates."""

import pytest
from pyspark.sql import functions as F

from cadence.operators import modes
from cadence.sources import cache, runlog, sinks, tables, units

KEYS = ["k"]


def square(left):
    return left.where("k <> 7").select("k", F.explode(F.sequence(F.lit(1), F.col("k") % 3 + 1)).alias("x"), (F.col("k") * F.col("k")).alias("v"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_run_stopped_half_way_and_taken_up(spark, tmp_path):
    todo, path = spark.range(20).withColumnRenamed("id", "k"), str(tmp_path / "parts")
    whole = rows(square(todo))
    assert units.run_units(spark, todo, square, path, KEYS, limit=8) == 8 and rows(units.read_units(spark, path, KEYS)) == rows(square(todo.where("k < 8")))

    def stops(left):
        return square(left).where(F.when(F.col("k") == 15, F.raise_error(F.lit("stopped")).cast("boolean")).otherwise(True))

    with pytest.raises(Exception, match="stopped"):
        units.run_units(spark, todo, stops, path, KEYS)
    seen = []
    assert units.run_units(spark, todo, lambda left: seen.append(left.count()) or square(left), path, KEYS) == 12 and seen == [12]
    assert rows(units.read_units(spark, path, KEYS)) == whole
    assert units.run_units(spark, todo, lambda left: 1 / 0, path, KEYS) == 0
    assert {r.k: r["rows"] for r in units.manifest(spark, path).collect()} == {k: 0 if k == 7 else k % 3 + 1 for k in range(20)}
    assert units.damaged(spark, path, KEYS).count() == 0


def test_parts_without_a_manifest_do_not_count(spark, tmp_path, monkeypatch):
    todo, path = spark.range(5).withColumnRenamed("id", "k"), str(tmp_path / "parts")
    with monkeypatch.context() as m:
        m.setattr(units, "_sums", lambda c: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            units.run_units(spark, todo, square, path, KEYS)
    with pytest.raises(ValueError, match="no unit is done"):
        units.read_units(spark, path, KEYS)
    assert units.run_units(spark, todo, square, path, KEYS) == 5 and rows(units.read_units(spark, path, KEYS)) == rows(square(todo))


def test_other_algorithms_and_damage(spark, tmp_path):
    todo, path = spark.range(5).withColumnRenamed("id", "k"), str(tmp_path / "parts")
    units.run_units(spark, todo, square, path, KEYS, algorithm="old-1")
    with pytest.raises(Exception, match="parts of another algorithm: old-1"):
        units.run_units(spark, todo, square, path, KEYS)
    with pytest.raises(Exception, match="another algorithm"):
        units.read_units(spark, path, KEYS).collect()
    part = units.read_units(spark, path, KEYS, "old-1")
    folder = next((tmp_path / "parts" / "parts").glob("run=*"))
    part.where("k <> 3").union(part.where("k = 2").limit(1)).repartition(1).write.parquet(str(tmp_path / "other"))
    for p in folder.glob("*.parquet"):
        p.unlink()
    next((tmp_path / "other").glob("*.parquet")).rename(folder / "part-0.parquet")
    assert {r.k for r in units.damaged(spark, path, KEYS, "old-1").collect()} == {2, 3}


def test_json_and_csv_parts_of_another_algorithm_are_refused(spark, tmp_path):
    for algorithm in (sinks.ALGORITHM, "old-1"):
        given = spark.createDataFrame([("a", 1, algorithm)], "station string, n int, algorithm string")
        sinks.write_json(given, str(tmp_path / algorithm / "parts"))
        sinks.write_csv(given, str(tmp_path / algorithm / "parts.csv"), gzip=True)
        for path in ("parts", "parts.csv"):
            read = lambda: [tuple(r) for r in tables.parts(spark, str(tmp_path / algorithm / path), given.schema, ["station"]).collect()]  # noqa: E731, B023
            if algorithm == sinks.ALGORITHM:
                assert read() == [("a", 1)]
            else:
                with pytest.raises(Exception, match="another algorithm"):
                    read()


def test_counts_settings_and_errors_of_a_run(spark):
    log = runlog.RunLog(spark, delta=0.5, zone="UTC")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    found = log.watch(log.watch(spark.range(10), "read", top=F.max("id")).where("id > 6"), "kept")
    with pytest.raises(ValueError):
        log.watch(found, "kept")
    found.write.format("noop").mode("overwrite").save()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == jobs + 1
    got = {(r.kind, r.stage, r.name): r.value for r in log.table().collect()}
    assert got == {("setting", None, "algorithm"): sinks.ALGORITHM, ("setting", None, "delta"): "0.5", ("setting", None, "zone"): "UTC", ("count", "read", "rows"): "10", ("count", "read", "top"): "9", ("count", "kept", "rows"): "3"}
    log = runlog.RunLog(spark)
    log.watch(spark.range(3), "read")
    log.failed("read", ValueError("no such file"))
    assert [(r.kind, r.value) for r in log.table().collect()] == [("setting", sinks.ALGORITHM), ("error", "ValueError: no such file")]


def test_cached_templates_are_not_shuffled(spark, tmp_path):
    shapes = spark.createDataFrame([(f"s{i}", m, [float(i + m + h) for h in range(24)], 23.0) for i in range(40) for m in (1, 2)], "station string, month int, s array<double>, shape_range double")
    hours = spark.createDataFrame([(f"s{i}", 2024, i) for i in range(50)], "station string, file_year int, n int").select("station", "file_year", F.expr("timestampadd(HOUR, n, timestamp_ntz'2024-01-31 00:00:00')").alias("time"), F.lit(1.0).alias("obs"))
    path = str(tmp_path / "templates")
    cache.write_templates(shapes, path, ["station"], 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = modes.with_templates(hours, cache.read_templates(spark, path, ["station"], 8), ["station"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # that of the hours
        assert rows(joined.select("station", "s")) == rows(modes.with_templates(hours, shapes, ["station"]).select("station", "s"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with pytest.raises(ValueError, match="whole numbers"):
        cache.write_templates(shapes.withColumn("lat", F.lit(1.0)), path, ["lat"])


def test_digits_of_reports(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("a", 1.23456, None, 7), ("null", -0.0004, 2.0, None)], "k string, x double, y double, n int"), str(tmp_path / "r.csv"), single=True, digits=3)
    text = next((tmp_path / "r.csv").glob("*.csv")).read_text().splitlines()
    assert text == ["k,x,y,n", "a,1.235,,7", "null,-0.000,2.000,"]
