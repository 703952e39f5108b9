"""Gridded series in chunks and over many files."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cadence.sources import gridded

SERIES = "time timestamp_ntz, lat double, lon double, t double, flag int, at string"


def cells(months=(1, 2), gap=7):
    rows = []
    for m in months:
        for day in (1, 2, 3, 11):
            for h in (0, 5, 23):
                for lat in (-12.5, -0.25, 0.0, 3.75, 41.0):
                    for lon in (-179.5, -3.0, 2.0, 2.25):
                        if (day + h + int(4 * lat) + int(4 * lon)) % gap:
                            rows.append((dt.datetime(2024, m, day, h), lat, lon, lat + lon / 7 + h, (day + h) % 3, "x"))
    return rows


def found(df):
    return sorted((r.time, r.lat, r.lon, pytest.approx(r.t, rel=1e-6) if r.t is not None else None, r.flag) for r in df.collect())


def given(rows):
    return sorted((r[0], r[1], r[2], r[3] if r[3] is None or r[3] == r[3] else None, r[4]) for r in rows)


@pytest.mark.parametrize("chunk", [gridded.Chunk(), gridded.Chunk(3, 50.0, 2.2), gridded.Chunk(31, 180.0, 360.0)])
def test_round_trip(spark, tmp_path, chunk):
    rows = cells() + [(dt.datetime(2023, 12, 31, 23), 0.0, 0.0, None, None, "x"), (dt.datetime(2023, 12, 31, 22), 0.0, 0.0, float("nan"), 1, "x")]
    lost = [(None, 1.0, 1.0, 1.0, 1, "x"), (dt.datetime(2024, 1, 1), None, 1.0, 1.0, 1, "x")]
    path = str(tmp_path / "grid")
    gridded.write_grid(spark.createDataFrame(rows + lost, SERIES), path, {"t": "float", "flag": "tinyint"}, chunk)
    assert found(gridded.read_grid(spark, path, ["t", "flag"])) == given(rows)
    some = gridded.read_grid(spark, path, ["t", "flag"], [2024], [2], (-0.25, 3.75), (2.0, 10.0))
    assert found(some) == given([r for r in rows if r[0].month == 2 and r[0].year == 2024 and -0.25 <= r[1] <= 3.75 and 2.0 <= r[2] <= 10.0])
    types = dict(spark.read.parquet(path).dtypes)
    assert types["t"] == "array<float>" and types["flag"] == "array<tinyint>"


def test_months_are_replaced_alone(spark, tmp_path):
    path, fields = str(tmp_path / "grid"), {"t": "float", "flag": "tinyint"}
    gridded.write_grid(spark.createDataFrame(cells(), SERIES), path, fields)
    fresh = [(dt.datetime(2024, 2, 9, 4), 1.0, 1.0, 5.0, 0, "x")]
    for _ in range(2):
        gridded.write_grid(spark.createDataFrame(fresh, SERIES), path, fields)
    assert found(gridded.read_grid(spark, path, ["t", "flag"])) == given(cells((1,)) + fresh)


def test_plan_prunes_folders_columns_and_row_groups(spark, tmp_path):
    path = str(tmp_path / "grid")
    gridded.write_grid(spark.createDataFrame(cells(), SERIES), path, {"t": "float", "flag": "tinyint"})
    plan = gridded.read_grid(spark, path, ["t"], [2024], [2], lat=(0.0, 5.0))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(lat_high,0.0)" in plan and "flag" not in plan.split("ReadSchema")[1]
    assert "month=1" not in " ".join(gridded.read_chunks(spark, path, months=[2]).select("month", "_metadata.file_path").where("file_path is not null").distinct().toPandas()["file_path"])


def test_repeated_cells_raise(spark, tmp_path):
    twice = cells((1,)) + cells((1,))[:1]
    with pytest.raises(Exception, match="a time and cell repeats"):
        gridded.write_grid(spark.createDataFrame(twice, SERIES), str(tmp_path / "grid"), {"t": "float"})


def test_files_of_different_names(spark, tmp_path):
    t = dt.datetime(2020, 1, 1)
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "raw" / name))
    put("a", [(t, 1.0, 2.0, 280.15, "K")], "time timestamp_ntz, latitude double, longitude double, t2m double, units string")
    put("b", [(t.replace(month=2), 3.0, 4.0, 7.5), (t.replace(month=2), 3.0, 5.0, float("nan"))], "valid_time timestamp_ntz, lat double, lon double, temperature double")
    (tmp_path / "in").mkdir()
    for folder, name in (("a", "hourly_2020_01.parquet"), ("b", "hourly_2020_02.parquet")):
        next((tmp_path / "raw" / folder).glob("*.parquet")).rename(tmp_path / "in" / name)
    next((tmp_path / "raw" / "a").glob("_SUCCESS")).rename(tmp_path / "in" / "notes_2020_01.txt")
    root = str(tmp_path / "in")
    rows = {(r.time.month, r.lat, r.lon, None if r.t2m is None else round(r.t2m, 6), r.file) for r in gridded.grid_files(spark, root, "hourly_*.parquet").collect()}
    assert rows == {(1, 1.0, 2.0, 7.0, "hourly_2020_01.parquet"), (2, 3.0, 4.0, 7.5, "hourly_2020_02.parquet"), (2, 3.0, 5.0, None, "hourly_2020_02.parquet")}
    assert [r.file for r in gridded.grid_files(spark, root, year=2020, month=1).collect()] == ["hourly_2020_01.parquet"] and gridded.grid_files(spark, root, year=2021).count() == 0
    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "odd"))
    with pytest.raises(ValueError, match="no column for"):
        gridded.grid_files(spark, str(tmp_path / "odd"))
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        gridded.grid_files(spark, root, "other_*.parquet")


def test_chunks_count_through_hours_and_cells(spark):
    rows = [(dt.datetime(2024, 1, 1, h), lat, lon, 1.0, 0, "x") for h in (3, 7) for lat in (1.0, 2.0) for lon in (3.0, 4.0)]
    [r] = gridded.chunked(spark.createDataFrame(rows[:-2], SERIES), {"t": "float"}).collect()
    assert r["at"] == [0, 1, 2, 3, 4, 5] and (r.lats, r.lons, r.lat_low, r.lat_high) == ([1.0, 2.0], [3.0, 4.0], 1.0, 2.0)
    assert gridded.chunked(spark.createDataFrame([], SERIES), {"t": "float"}).where(F.lit(True)).count() == 0 and not math.isnan(r.t[0])
