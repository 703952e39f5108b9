"""The jobs: growing input, repeated and interrupted runs, odd rows, the command line."""

import datetime as dt
import math
import os
import subprocess
import sys

import pytest

from jobs import hourly_ingest, text_inventory
from jobs.command import settings

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
READINGS = "event_type string, ts timestamp_ntz, value double, batch int"
D = "/root/testdata/sf0.001"


def expected(rows, config=hourly_ingest.Config()):
    hours = {}
    for station, ts, value, *_ in rows:
        if station is not None and ts is not None and value is not None and not math.isnan(value) and config.low <= value * config.scale <= config.high:
            hours.setdefault((station, ts.replace(minute=0, second=0, microsecond=0)), []).append(value * config.scale)
    return {k: (len(v), pytest.approx(sum(v) / len(v)), min(v), max(v)) for k, v in hours.items()}


def put(spark, rows, path):
    spark.createDataFrame(rows, READINGS).coalesce(1).write.mode("append").parquet(str(path))


def state(spark, out):
    return {(r.station, r.time): (r.n, r.obs, r.low, r.high) for r in hourly_ingest.hourly(spark, out).collect()}


def files(folder):
    return sorted((str(p), p.stat().st_mtime_ns) for p in folder.rglob("*.parquet"))


def some(n, month, seed):
    return [(f"s{(i * seed) % 3}", dt.datetime(2024, month, 1 + i % 5, i % 24, i % 60), float((i * 37 * seed) % 331) - 20, 0) for i in range(n)]


ODD = [(None, dt.datetime(2024, 3, 1), 1.0, 0), ("s0", None, 1.0, 0), ("s0", dt.datetime(2024, 3, 1), None, 0), ("s0", dt.datetime(2024, 3, 1), float("nan"), 0), ("s0", dt.datetime(2024, 3, 1), 1e9, 0), ("s0", dt.datetime(2024, 3, 1), float("inf"), 0)]


def test_ingest_of_growing_input(spark, tmp_path):
    source, out, marks = tmp_path / "in", tmp_path / "out", str(tmp_path / "marks")
    run = lambda: hourly_ingest.run(spark, str(source), str(out), marks)
    first, second = some(200, 3, 1) + ODD, some(150, 3, 2) + some(80, 4, 3)
    put(spark, first, source)
    assert run() == {"rows": 206, "valid": 200 - sum(r[2] * 0.2 > 60 for r in first[:200]), "missing": 2, "phys_reject": 2 + sum(r[2] * 0.2 > 60 for r in first[:200]), "no_time": 1, "no_station": 1, "months": 1}
    assert state(spark, str(out)) == expected(first)
    april = [f for f in files(out) if "month=4" in f[0]]
    put(spark, second, source)
    got = run()
    assert got["rows"] == 230 and got["months"] == 2 and not april
    assert state(spark, str(out)) == expected(first + second)
    before = files(out)
    assert run() == {"months": 0} and files(out) == before
    put(spark, some(30, 4, 5), source)
    march = [f for f in before if "hourly" in f[0] and "month=3" in f[0]]
    assert run()["months"] == 1 and march == [f for f in files(out) if "hourly" in f[0] and "month=3" in f[0]]
    assert state(spark, str(out)) == expected(first + second + some(30, 4, 5))
    assert {r.row_class: r.n for r in hourly_ingest.funnel(spark, str(out)).collect()}["no_station"] == 1


def test_ingest_taken_up_after_failures(spark, tmp_path, monkeypatch):
    source, out, marks = tmp_path / "in", tmp_path / "out", tmp_path / "marks"
    run = lambda: hourly_ingest.run(spark, str(source), str(out), str(marks), hourly_ingest.Config(files_per_batch=1))
    rows = some(100, 5, 1)
    put(spark, rows[:50], source)
    put(spark, rows[50:], source)
    with monkeypatch.context() as m:  # parts are there, months are not
        m.setattr(hourly_ingest, "_put_months_together", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run()
    assert state(spark, str(out)) == {} and run()["months"] == 1 and state(spark, str(out)) == expected(rows)
    commits = sorted((p for p in (marks / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    assert len(commits) == 2
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):  # the last batch's end was never noted: it is taken again
        p.unlink(missing_ok=True)
    assert run()["rows"] == 50 and state(spark, str(out)) == expected(rows)


def test_ingest_of_report_files(spark, tmp_path):
    """Raw reports of two years; a third file and one that cannot be read come before the second run."""
    head, source, out = "DATE,TMP,STATION,X\n", tmp_path / "in", str(tmp_path / "out")
    config = settings(hourly_ingest.Config, f"{ROOT}/jobs/report_ingest.json")
    run = lambda: hourly_ingest.run(spark, str(source), out, str(tmp_path / "marks"), config)

    def put_file(year, name, text):
        (source / str(year)).mkdir(parents=True, exist_ok=True)
        (source / str(year) / f"{name}.csv").write_text(text)

    put_file(2015, "00017", head + '2015-01-01T00:10:00,"+0123,1",a,\n2015-01-01T00:50:00,"+0143,5",a,\n2015-01-01T01:00:00,"+9999,9",a,\nbad,"+0100,1",a,\n')
    put_file(2016, "00017", '"TMP","DATE","STATION"\n"-0050,C","2016-02-01T05:00:00","a"\n"+0100,3","2016-02-01T06:00:00","a"\n,,\n')
    assert run() == {"rows": 7, "valid": 3, "missing": 1, "no_time": 1, "qc_reject": 1, "na_input": 1, "months": 2}
    first = {("00017", dt.datetime(2015, 1, 1)): (2, pytest.approx(13.3), 12.3, 14.3), ("00017", dt.datetime(2016, 2, 1, 5)): (1, -5.0, -5.0, -5.0)}
    assert state(spark, out) == first
    put_file(2015, "00099", head + '2015-01-01T00:30:00,"+0010,1",b,\n')
    put_file(2015, "00100", "DATE,STATION\n2015-01-01,c\n")
    assert run() == {"rows": 2, "valid": 1, "read_error": 1, "months": 1}
    assert state(spark, out) == first | {("00099", dt.datetime(2015, 1, 1)): (1, 1.0, 1.0, 1.0)} and run() == {"months": 0}
    with pytest.raises(ValueError, match="table or reports"):
        hourly_ingest.run(spark, str(source), out, str(tmp_path / "marks"), hourly_ingest.Config(format="orc"))


def test_ingest_of_no_rows_and_of_one_file(spark, tmp_path):
    put(spark, [], tmp_path / "none")
    assert hourly_ingest.run(spark, str(tmp_path / "none"), str(tmp_path / "a"), str(tmp_path / "b"))["months"] == 0 and state(spark, str(tmp_path / "a")) == {}
    assert hourly_ingest.run(spark, f"{D}/events.parquet", str(tmp_path / "c"), str(tmp_path / "d"))["rows"] == 1000


TEXTS = [
    (1, "One line.\nOne line.\n\n12 !?\n" + "x" * 2001, "en", "a"), (2, None, "en", "a"), (3, "", "en", "a"), (4, "Zwei\nDrei", "01", "b"), (5, "a\n" * 100, None, None), (5, "a\n" * 100, None, None), (6, "é\r\n \nÉ " * 3, "01", None),
]


def test_inventory_of_odd_texts(spark, tmp_path):
    spark.createDataFrame([(*r, 1, 2) for r in TEXTS], "doc_id long, text string, lang string, source string, n_rows int, lines int").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        assert text_inventory.run(spark, str(tmp_path / "in"), str(tmp_path / "out")) == {"documents": 7, "groups": 4}
    got = {(r.lang, r.source): r for r in text_inventory.groups(spark, str(tmp_path / "out")).collect()}
    assert set(got) == {("en", "a"), ("01", "b"), (None, None), ("01", None)}
    a = got["en", "a"]
    assert (a.n_files, a.n_read_errors, a.n_rows, a.n_na_input, a.n_malformed, a.n_phys_reject, a.n_valid, a.n_repeats, a.n_longest) == (3, 1, 6, 2, 1, 1, 2, 1, 2001)
    assert (a.min, a.median, a.max, a.mean) == (0, 0.0, 1, pytest.approx(1 / 3)) and a.pct_na_input == pytest.approx(100 * 2 / 6)
    assert (got[None, None].n_files, got[None, None].n_rows, got[None, None].n_repeats) == (2, 202, 198)


def test_inventory_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "in"))
    assert text_inventory.run(spark, str(tmp_path / "in"), str(tmp_path / "out")) == {"documents": 0, "groups": 0}


def test_command_lines(tmp_path):
    env = os.environ | {"PYTHONPATH": ROOT}
    for job, args in (("text_inventory", []), ("hourly_ingest", ["--checkpoint", str(tmp_path / "marks")])):
        source = f"{D}/{'documents' if job == 'text_inventory' else 'events'}.parquet"
        done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--source", source, "--output", str(tmp_path / job), *args, "--config", f"{ROOT}/jobs/{job}.json"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "wrote" in done.stderr and list((tmp_path / job).rglob("*.parquet"))


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"scale": 0.1}')
    assert settings(hourly_ingest.Config, str(tmp_path / "c.json")).scale == 0.1 and settings(text_inventory.Config, None) == text_inventory.Config()
    (tmp_path / "c.json").write_text('{"scales": 0.1}')
    with pytest.raises(TypeError):
        settings(hourly_ingest.Config, str(tmp_path / "c.json"))


def test_jobs_import_nothing_of_training_data():
    for name in os.listdir(f"{ROOT}/jobs"):
        if name.endswith(".py"):
            text = open(f"{ROOT}/jobs/{name}").read()
            assert "llm" not in text and "corpus_pipeline" not in text
