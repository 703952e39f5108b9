"""Report files in one reading, queries whose rows can fail, and tables of metrics."""

import gzip

import pytest

from cadence.operators import inventory, qc, strata
from cadence.plans import adapters
from cadence.plans.catalog import QUERIES
from cadence.sources import tables

D = "/root/testdata/sf0.001"


def put(root, texts):
    for (year, name), text in texts.items():
        (root / str(year)).mkdir(exist_ok=True)
        (root / str(year) / f"{name}.csv").write_bytes(text.encode())


def test_rows_and_errors_from_one_reading(spark, tmp_path):
    texts = {
        (2015, "a"): "STATION,DATE,TMP\r\n1,2015-01-01,\"+0123,1\"\r\n\r\n2,2015-01-02,\n",
        (2015, "b"): '﻿"TMP" ,"X", STATION ,DATE\n"say ""hi"", you","a,b",3,"2015"\n,,,\n"open,4,5,6\n""\n',
        (2016, "c"): "STATION,DATE\n1,2\n", (2016, "d"): "", (2016, "e"): "STATION,DATE,TMP\n", (2016, "f"): "\n\n",
    }
    put(tmp_path, texts)
    columns = ("STATION", "DATE", "TMP")
    rows = tables.scan_reports(spark, str(tmp_path), columns)
    got = {(r.file_year, r.file_station, r.row_no): (r.error, r.STATION, r.DATE, r.TMP) for r in rows.collect()}
    assert got == {
        (2015, "a", 0): (None, "1", "2015-01-01", "+0123,1"), (2015, "a", 1): (None, "2", "2015-01-02", None),
        (2015, "b", 0): (None, "3", "2015", 'say "hi", you'), (2015, "b", 1): (None, None, None, None), (2015, "b", 2): (None, "5", "6", '"open'), (2015, "b", 3): (None, None, None, ""),
        (2016, "c", None): ("read: columns are missing: TMP", None, None, None), (2016, "e", None): ("empty", None, None, None), (2016, "f", None): ("empty", None, None, None),
    }
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("regexp_extract_all") == 2 and "Exchange" not in plan and "Join" not in plan


def test_files_that_are_too_large_raise(spark, tmp_path):
    put(tmp_path, {(2015, "a"): "STATION,DATE,TMP\n1,2,3\n"})
    with pytest.raises(Exception, match="too large"):
        tables.scan_reports(spark, str(tmp_path), ("STATION",), largest=5).collect()


def test_status_of_each_file(spark, tmp_path):
    head = "STATION,DATE,LATITUDE,LONGITUDE,ELEVATION,TMP\n"
    put(tmp_path, {(2015, "a"): head + '1,2015-01-01T00:10:00,,2,3,"+0123,1"\n', (2015, "b"): "STATION\n1\n", (2016, "c"): head})
    files = inventory.file_stats(qc.scheme_readings(tables.scan_reports(spark, str(tmp_path))), ["file_year", "file_station"])
    assert {(r.file_station, r.ok, r.n_rows, r.n_valid, r.n_na_input, r.station_id) for r in files.collect()} == {("a", True, 1, 1, 0, "1"), ("b", False, 0, 0, 0, None), ("c", False, 0, 0, 0, None)}
    assert {r.file_year: (r.n_files, r.n_read_errors, r.n_rows) for r in inventory.year_funnel(files).collect()} == {2015: (2, 1, 1), 2016: (1, 1, 0)}


def test_written_files_have_three_headers_and_one_is_broken(spark):
    root = adapters.report_files(spark, D)
    heads = {r.value for r in spark.read.text(f"{root}/*/*/part-*").collect() if "STATION" in r.value}
    assert len(heads) == 4
    got = tables.reports(spark, root, layout=tables.FOLDERS)
    want = adapters.reports(spark, D).where("not (file_station = 'view' and file_year = 2024)")
    keys = ["file_year", "file_station", "STATION", "DATE", "LATITUDE", "LONGITUDE", "ELEVATION", "TMP"]
    assert got.select(keys).exceptAll(want.select(keys)).count() == want.select(keys).exceptAll(got.select(keys)).count() == 0


def test_rows_that_can_fail_do(spark):
    count = lambda name, where: QUERIES[name](spark, "/root/testdata/sf0.01").where(where).count()
    assert count("e27_report_files_funnel", "n_read_errors > 0") == 1 and count("e26_report_files", "not ok") == 1
    assert count("f6_as_of_gaps", "value is null") > 0 and count("f6_as_of_gaps", "value is not null") > 0
    assert count("f1_cells_without_template", "with_template = 0") > 0 and count("f1_cells_without_template", "with_shape > 0") > 0
    assert count("f3_missing_features", "rate < 0.9 and joined_rows > 0") == 1 and count("e31_missing_features", "continent is null") > 0


def test_metrics_in_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "m.csv.gz", "wt") as f:
        f.write("station,n,rmse,other\n00017,3,0.5,x\n00018,many,,y\n")
    found = tables.metrics(spark, str(tmp_path / "m.csv.gz"), {"station": "string", "rmse": "double", "n": "long"})
    assert [tuple(r) for r in found.orderBy("station").collect()] == [("00017", 0.5, 3), ("00018", None, None)]
    assert "other" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    with pytest.raises(ValueError, match="missing"):
        tables.metrics(spark, str(tmp_path / "m.csv.gz"), {"r2": "double"})


def test_gate_and_modes_of_months(spark):
    months = spark.createDataFrame([("a", 2020, 1, 30, 1.0, 0.5), ("b", 2020, 1, 30, 2.0, 0.5)], "station string, year int, month int, n_heldout_x long, rmse_heldout_x double, r2_heldout_x double")
    features = spark.createDataFrame([("a", 1.0, 1.0, True, 5.0, "E", "k")], "station string, lat double, lon double, coastal_30km boolean, abs_elev_diff_m double, continent string, koppen string")
    joined = strata.with_features(months, features)
    with pytest.raises(ValueError, match="only 50.00%"):
        strata.gated(joined)
    assert {(r.station, r.mode, r.n, r.continent) for r in strata.mode_months(strata.gated(joined, 0.5), ("x",)).collect()} == {("a", "x", 30, "E"), ("b", "x", 30, None)}
