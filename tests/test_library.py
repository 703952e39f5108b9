"""Operators of the library on small frames."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadence.functions import clock, harmonics, nulls
from cadence.operators import checks, civil, climatology, fit, grid, inventory, modes, paired, qc, scores, sensitivity, strata
from cadence.sources import sinks, tables
from cadence.streaming.hourly import hourly_stream, merge_statistics

W = 2 * math.pi / 24


#: Fixed values of the smoke test: two amplitudes, two phases, and further down a mean of 18.5 and a slope of 1.25.
def curve(h, a1=4.0, p1=0.7, a2=1.1, p2=-0.2):
    return a1 * math.sin(W * h - p1) + a2 * math.sin(2 * W * h - p2)


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first().x if values else spark.range(1).select(expr.alias("x")).first().x


@pytest.fixture(scope="module")
def smoke(spark):
    """Three days of a curve that the template explains, one of them with gaps."""
    rows = [("s", 2024, dt.datetime(2024, 1, d, h), 18.5 + 1.25 * curve(h)) for d in (1, 2, 3) for h in range(24) if d < 3 or h in (3, 9, 14)]
    hours = spark.createDataFrame(rows, "station string, file_year int, time timestamp_ntz, obs double")
    shapes = spark.createDataFrame([("s", 1, [float(curve(h)) for h in range(24)])], "station string, month int, s array<double>")
    return modes.with_templates(hours, shapes, ["station"])


def test_nulls(spark):
    assert one(spark, nulls.clip(F.lit(None).cast("double"), 0, 1)) is None and one(spark, nulls.clip(F.lit(7.0), 0, 1)) == 1
    assert one(spark, nulls.clean(F.lit(float("nan")))) is None and one(spark, nulls.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert str(one(spark, nulls.tidy(F.lit(-1e-9)))) == "0.0"


def test_clock(spark):
    got = spark.createDataFrame([(0, 23), (11, 21), (0, 12)], "a int, b int").select(clock.separation(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [1, 10, 12]
    ts = F.lit("2024-01-01 10:59:59").cast("timestamp_ntz")
    assert one(spark, clock.hour_floor(ts)) == dt.datetime(2024, 1, 1, 10)
    assert one(spark, clock.civil_time(ts, F.lit("Asia/Kathmandu"))) == dt.datetime(2024, 1, 1, 16, 44, 59) and one(spark, clock.civil_time(ts, F.lit(None).cast("string"))).hour == 10


def test_shape_values(spark):
    s = [one(spark, harmonics.shape(F.lit(h), F.lit(4.0), F.lit(0.7), F.lit(1.1), F.lit(-0.2))) for h in (0, 12)]
    assert s == pytest.approx([-2.358335, 2.795407], abs=1e-6)


REPORTS = [
    ("+0123,1", "2015-01-01T00:10:00", "valid", 12.3), ("-0050,C", "2015-01-01T01:00:00", "valid", -5.0), (None, "2015-01-01", "na_input", None), ("", "2015-01-01", "na_input", None), ("0123", "2015-01-01", "malformed", None),
    ("+0123,1,X", "2015-01-01", "malformed", None), ("+01a3,1", "2015-01-01", "malformed", None), ("+9999,9", "2015-01-01", "missing", None), ("+0123,3", "2015-01-01", "qc_reject", None), ("+0601,1", "2015-01-01", "phys_reject", None),
    ("-0601,1", "2015-01-01", "phys_reject", None), ("+0600,1", "2015-01-01", "valid", 60.0), ("-0600,1", "2015-01-01", "valid", -60.0), ("12d,1", "2015-01-01", "malformed", None), ("inf,1", "2015-01-01", "malformed", None),
    ("nan,1", "2015-01-01", "malformed", None), ('"+0123,1"', "2015-01-01", "valid", 12.3), ("+0123,1", "bad", "valid", 12.3), ("+0123,1", "12:30", "valid", 12.3), ("+0123, 5 ", "2015-01-01T00:51:00+02:00", "valid", 12.3), ("1e2,1", "2015-01-01", "valid", 10.0),
]


def test_row_classes(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(REPORTS)], "i int, TMP string, DATE string, kind string, v double")
    rows = qc.scheme_readings(df).orderBy("i").collect()
    assert [(r.row_class, r.value) for r in rows] == [(r.kind, r.v) for r in rows]
    assert [r.time for r in rows[17:20]] == [None, None, dt.datetime(2015, 1, 1, 0, 51)]
    strict = {r.i: r for r in qc.strict_readings(df).where("accepted").collect()}
    assert strict[19].time == dt.datetime(2014, 12, 31, 22, 51) and 5 not in strict and 16 not in strict and 17 not in strict
    hourly = qc.hourly_mean(df.where("i < 2").select(F.lit("s").alias("k"), F.lit(dt.datetime(2015, 1, 1, 5, 20)).cast("timestamp_ntz").alias("time"), F.col("v").alias("value")), ["k"])
    assert hourly.first().obs == pytest.approx(3.65)


def test_smoke_reconstruction(spark, smoke):
    rows = modes.strict_modes(smoke, modes.AnchorPolicy()).where("day < '2024-01-03'").collect()
    for r in rows:
        assert r["2pt_fixed_00_12_clip"] == pytest.approx(r.obs, abs=1e-9) and r["2pt_fixed_00_12_literal"] == pytest.approx(r.obs, abs=1e-9)
        assert r["2pt_dynamic_strict"] == pytest.approx(r.obs, abs=1e-9)
        if r.hour == 12:
            assert r["1pt_fixed12"] == pytest.approx(r.obs) and not r["held_1pt_fixed12"]
    gaps = modes.strict_modes(smoke).where("day = '2024-01-03'").collect()
    assert all(r["1pt_fixed12"] is None and r["2pt_fixed_00_12_clip"] is None and r["2pt_dynamic_strict"] == pytest.approx(r.obs) for r in gaps)
    daily = modes.daily_modes(smoke).where("day = '2024-01-01'").collect()
    assert all(r.baseline == pytest.approx(r.day_mean + r.s) and r.scaled is not None for r in daily)


def ta(spark, t1, t2, s1, s2, s, **policy):
    return one(spark, modes.two_anchor(*(F.lit(x).cast("double") for x in (t1, t2, s1, s2, s)), modes.AnchorPolicy(**policy)))


def test_two_anchor_rules(spark):
    assert ta(spark, 10, 12, 0, 0.5, 0) == pytest.approx(10.75)
    assert ta(spark, 0, 10, 0, 1, 0) == pytest.approx(5) and ta(spark, 0, 10, 0, 1, 0, alpha_rule="mean") == pytest.approx(2.5)
    assert ta(spark, 10, 9, 0, 1, 0) == pytest.approx(8.9) and ta(spark, 10, 9, 0, 1, 0, alpha_rule="mean") == pytest.approx(9.45)
    assert ta(spark, 0, 10, 0, 1, 0, clipped=False) == pytest.approx(0) and ta(spark, None, 1, 0, 1, 0) is None and ta(spark, 0, 10, 0, 1, None) is None
    assert one(spark, modes.one_anchor(F.lit(20.0), F.lit(2.0), F.lit(-1.0))) == 17
    flat = [one(spark, modes.scaled(F.lit(1.0), F.lit(0.0), F.lit(3.0), F.lit(2.0), F.lit(1e-5), F.lit(0.1), guard)) for guard in ("eps", "unit", "spec")]
    assert flat == [3.0, 7.0, 3.0]


def test_dynamic_ties_and_single(spark):
    shapes = spark.createDataFrame([("s", 1, [1.0 if h == 14 else 0.0 if h in (3, 5) else 0.5 for h in range(24)])], "station string, month int, s array<double>")
    rows = [("s", 2024, dt.datetime(2024, 1, 1, h), float(h)) for h in (3, 5, 14)] + [("s", 2024, dt.datetime(2024, 1, 2, 7), 1.0)]
    shaped = modes.with_templates(spark.createDataFrame(rows, "station string, file_year int, time timestamp_ntz, obs double"), shapes, ["station"])
    got = {(r.day.day, r.hour): r for r in modes.strict_modes(shaped).collect()}
    assert got[1, 3].lo.hour == 3 and got[1, 3].hi.hour == 14 and not got[1, 3]["held_2pt_dynamic_strict"] and got[1, 5]["held_2pt_dynamic_strict"]
    assert got[2, 7]["2pt_dynamic_strict"] is None
    none = shaped.withColumn("s", F.lit(None).cast("double")).withColumn("s_day", F.lit(None).cast("array<double>"))
    assert all(r[m] is None for r in modes.strict_modes(none).collect() for m in modes.STRICT_MODES)


@settings(max_examples=6, deadline=None)
@given(st.sets(st.integers(0, 23), min_size=12), st.integers(0, 10**6))
def test_ridge_fit_solves_the_normal_equations(spark, hours, seed):
    rng = np.random.default_rng(seed)
    hours = sorted(hours)
    y = rng.normal(size=len(hours))
    got = fit.ridge_fit(spark.createDataFrame([("c", 1, h, float(v)) for h, v in zip(hours, y)], "cell string, month int, hour int, y double"), ["cell"]).first()
    w = W * np.array(hours)
    x = np.stack([np.sin(w), -np.cos(w), np.sin(2 * w), -np.cos(2 * w)], 1)
    assert [got.c1, got.c2, got.c3, got.c4] == pytest.approx(np.linalg.solve(x.T @ x + 1e-8 * np.eye(4), x.T @ y).tolist(), abs=1e-6)


@pytest.mark.parametrize("joined", [True, False])
def test_archive(spark, joined):
    full = [("good", m, h, 10 + curve(h)) for m in range(1, 13) for h in range(24)] + [("half", m, h, 10 + curve(h)) for m in range(1, 7) for h in range(24)] + [("few", 1, h, float(h % 5)) for h in range(11)]
    clim = spark.createDataFrame(full, "cell string, month int, hour int, t double")
    mask = {r.cell: r.is_valid for r in climatology.valid_cells(clim, ["cell"]).collect()}
    assert mask == {"good": True, "half": False, "few": False}
    checked = climatology.precheck(clim, ["cell"], climatology.valid_cells(clim, ["cell"]))
    det = climatology.masked(climatology.detrended(clim, ["cell"]), checked, ["cell"])
    assert {r.cell: (r.y, r.t_mean) for r in det.groupBy("cell").agg(F.count("y").alias("y"), F.count("t_mean").alias("t_mean")).collect()} == {"good": (288, 288), "half": (0, 0), "few": (0, 0)}
    params = fit.parameters(fit.ridge_fit(det, ["cell"]), ["cell"])
    at_once = climatology.checked(clim, ["cell"])
    if not joined:
        assert at_once.select(det.columns).exceptAll(det).count() == det.exceptAll(at_once.select(det.columns)).count() == 0
    archive = fit.quality(params, fit.fit_metrics(det, params, ["cell"]), checked, ["cell"]) if joined else fit.archive(at_once, ["cell"])
    rows = {(r.cell, r.month): r for r in archive.collect()}
    r = rows["good", 3]
    assert (r.a1, r.phi1, r.a2, r.phi2) == pytest.approx((4, 0.7, 1.1, -0.2), abs=1e-5) and r.quality_flag == 1 and r.skipped == 0 and r.r_squared == pytest.approx(1)
    fine = [curve(i * 0.1) for i in range(240)]
    assert r.dtr_fitted == pytest.approx(max(fine) - min(fine), abs=1e-4) and r.tmax_hour == pytest.approx(np.argmax(fine) * 0.1, abs=0.11)
    for name in ("half", "few"):
        assert (rows[name, 1].skipped, rows[name, 1].a1, rows[name, 1].r_squared, rows[name, 1].dtr_observed, rows[name, 1].quality_flag) == (1, None, None, None, 0)
    summary = fit.archive_summary(archive).first()
    assert (summary.total, summary.good, summary.fitted, summary.skipped) == (19, 12, 12, 7)
    assert {r.cell: r.s is None for r in fit.templates(params.where("month = 1"), ["cell"]).collect()} == {"good": False, "half": True, "few": True}
    curve24 = grid.point_curve(archive.where("cell = 'good'").withColumns({"lat": F.lit(1.0), "lon": F.lit(2.0), "t_mean": F.lit(10.0)}), 1.2, 2.2, 3).orderBy("hour").collect()
    assert [r.t for r in curve24] == pytest.approx([10 + curve(h) for h in range(24)], abs=1e-5)


def test_sweeps_equal_direct_errors(spark, smoke):
    noisy = smoke.withColumn("obs", F.col("obs") + F.sin(F.col("hour") * 7.0 + F.dayofmonth("time")))
    days = sensitivity.day_matrix(noisy)
    single = {r.anchor_hour_utc: r for r in sensitivity.single_anchors(days).collect()}
    rows = noisy.collect()
    by_day = {}
    for r in rows:
        by_day.setdefault(r.day, {})[r.hour] = (r.obs, r.s)
    for a in (0, 9, 14):
        errors = [(y - (s + d[a][0] - d[a][1])) ** 2 for d in by_day.values() if a in d for h, (y, s) in d.items() if h != a]
        assert single[a].n_heldout == len(errors) and single[a].rmse_heldout == pytest.approx(math.sqrt(np.mean(errors)))
    pairs = sensitivity.anchor_pairs(days).collect()
    assert len(pairs) == 276
    score = scores.pooled(scores.mode_long(modes.strict_modes(noisy)).where("mode = '2pt_fixed_00_12_clip' and scope = 'heldout'"), ["mode"]).first()
    own = next(p for p in pairs if (p.h1_utc, p.h2_utc) == (0, 12))
    assert own.n_heldout == score.n and own.rmse_heldout == pytest.approx(score.rmse) and own.circular_separation_h == 12 and own.fallback_days == 0


def test_identities_of_scores(spark, smoke):
    noisy = smoke.withColumn("obs", F.col("obs") + F.cos(F.col("hour") * 3.0))
    rec = modes.strict_modes(noisy)
    pooled = {(r["mode"], r.scope): r for r in scores.pooled_by_scope(scores.mode_long(rec)).collect()}
    diagnostics = scores.day_diagnostics(rec).first()
    clip = "2pt_fixed_00_12_clip"
    assert pooled[clip, "all"].n - pooled[clip, "heldout"].n == 2 * diagnostics.anchor_days == 4
    assert diagnostics.fit_days + diagnostics.fallback_days == diagnostics.anchor_days
    delta = {r.delta: r for r in scores.delta_sensitivity(noisy).collect()}
    assert len({r.n for r in delta.values()}) == 1 and delta[0.5].rmse == pytest.approx(pooled[clip, "heldout"].rmse)
    assert len({pooled[m, "heldout_common"].n for m in modes.STRICT_MODES}) == 1
    wide = scores.station_months(rec).first()
    assert wide[f"n_heldout_{clip}"] == pooled[clip, "heldout"].n and len(wide) == 29
    assert {r.metric for r in scores.daily_scores(scores.mode_long(rec)).collect()} == set(scores.DAILY_METRICS)
    levels = scores.pooled_levels(scores.mode_long(rec)).where("level = 'pooled'").count()
    assert levels == 8


def test_score_guards(spark):
    rows = [("one", 1.0, 2.0), ("two", 1.0, 2.0), ("two", 3.0, 2.0), ("flat", 5.0, 4.0), ("flat", 5.0, 6.0), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, obs double, rec double").withColumn("use", F.lit(True))
    strict = {r.k: (r.n, r.rmse, r.r2) for r in scores.pooled(df, ["k"]).collect()}
    assert strict["one"] == (1, None, None) and strict["two"] == (2, 1.0, 0.0) and strict["flat"] == (2, 1.0, None) and strict["none"] == (0, None, None)
    six = {r.k: r.rmse for r in scores.pooled(df, ["k"], scores.POOLED_SCHEMES).collect()}
    assert six["two"] is None


def civil_day(spark, zone, start, hours):
    rows = [("s", 2024, start + dt.timedelta(hours=h), 10 + float(h)) for h in range(hours)]
    shapes = spark.createDataFrame([("s", m, [float(curve(h)) for h in range(24)]) for m in range(1, 13)], "station string, month int, s array<double>")
    shaped = modes.with_templates(spark.createDataFrame(rows, "station string, file_year int, time timestamp_ntz, obs double"), shapes, ["station"])
    return civil.six_schemes(civil.with_civil_time(shaped, spark.createDataFrame([("s", zone)], "station string, tz string")))


def test_civil_anchors(spark):
    rec = civil_day(spark, "Asia/Kathmandu", dt.datetime(2024, 1, 1, 18), 48)
    r = rec.where("local_day = '2024-01-02'").first()
    assert r.l00.time == dt.datetime(2024, 1, 2, 18) and r.l12.time == dt.datetime(2024, 1, 2, 6)
    r = civil_day(spark, "Asia/Kolkata", dt.datetime(2024, 1, 1, 18), 60).where("local_day = '2024-01-03'").first()
    assert r.l00.time == dt.datetime(2024, 1, 2, 19) and r.l12.time == dt.datetime(2024, 1, 3, 6)
    dst = civil_day(spark, "America/New_York", dt.datetime(2024, 3, 9), 72).where("local_day = '2024-03-10'")
    assert dst.first().local_rows == 23 == dst.count()
    autumn = civil_day(spark, "America/New_York", dt.datetime(2024, 11, 2), 72).where("local_day = '2024-11-03'")
    assert autumn.first().local_rows == 25
    few = civil_day(spark, None, dt.datetime(2024, 1, 1, 0), 3)
    assert all(r[m] is None for r in few.collect() for m in civil.SCHEMES)
    full = civil_day(spark, None, dt.datetime(2024, 1, 1, 0), 24)
    assert full.where(civil.common_rows(full)).count() == 22 and full.where("`2pt_utc00_12` is null").count() == 0
    long = civil.scheme_long(full)
    assert long.count() == 144 and {r["mode"] for r in scores.scheme_summary(long).collect()} == set(civil.SCHEMES)


def test_strata(spark):
    lat = spark.createDataFrame([(float(x),) for x in (-90, -60, -30, 0, 30, 60, 90)], "x double").select(strata.latitude_bin(F.col("x")).alias("b"))
    assert [r.b for r in lat.collect()] == ["60-90S", "60-90S", "30-60S", "0-30S", "0-30N", "30-60N", "60-90N"]
    up = spark.createDataFrame([(x,) for x in (99.999, 100.0, 250.0, 500.0, None)], "x double").select(strata.elevation_bin(F.col("x")).alias("b"))
    assert [r.b for r in up.collect()] == ["<100 m", "100-250 m", "250-500 m", ">=500 m", None]
    months = spark.createDataFrame([("a", 2020, 1, "m", 30, 1.0, 0.5), ("a", 2020, 2, "m", 60, 2.0, 0.7), ("b", 2020, 1, "m", 5, 9.0, 0.1)], "station string, year int, month int, mode string, n long, rmse double, r2 double")
    features = spark.createDataFrame([("a", 10.0, True, 5.0), ("b", -10.0, None, 5.0)], "station string, lat double, coastal_30km boolean, abs_elev_diff_m double")
    got = {r.coastal_group: r for r in strata.stratum_scores(strata.with_features(months, features), "coastal_group").collect()}
    a, b = got["Coastal (<=30 km)"], got["Inland (>30 km)"]
    assert (a.N_hours, a.n_station_months, a.rmse_pooled) == (90, 2, pytest.approx(math.sqrt((30 + 240) / 90))) and (b.N_hours, b.rmse_pooled, b.n_stations) == (0, None, 0)
    with pytest.raises(Exception, match="two rows of features"):
        strata.with_features(months, features.union(features)).collect()
    assert strata.join_rate(strata.with_features(months, features.where("station = 'a'"))).first().rate == pytest.approx(2 / 3)
    assert strata.gated(strata.with_features(months, features)).count() == 3 and strata.gated(strata.with_features(months.limit(0), features)).count() == 0
    with pytest.raises(ValueError, match="66.67%"):
        strata.gated(strata.with_features(months, features.where("station = 'a'")))


def test_paired_products(spark):
    v = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "v double")
    q = v.agg(F.percentile("v", [0.25, 0.5]).alias("q")).first().q
    assert q == [1.75, 2.5]
    h = paired.histogram(spark.range(1000).select(F.col("id").cast("double").alias("v")), F.col("v"), bins=10, low=0.0, high=1.0).orderBy("bin").collect()
    assert [r.bin for r in h] == list(range(10)) and sum(r.weight for r in h) == pytest.approx(100)
    e = paired.ecdf(spark.createDataFrame([("m", 1.0), ("m", 1.0), ("m", 2.0), ("m", None)], "mode string, rmse double"), "rmse", ["mode"]).orderBy("fraction").collect()
    assert [r.fraction for r in e] == pytest.approx([1 / 3, 2 / 3, 1])
    assert paired.plot_limit(v.withColumn("w", F.col("v")), ["v", "w"]).first().plot_limit > 4


def test_grid(spark):
    points = spark.createDataFrame([(1, 0.5), (2, -9.0), (3, None), (4, 7.9)], "i int, lat double")
    axis = spark.createDataFrame([(0.0,), (1.0,), (5.0,)], "lat double")
    near = {ties: {r.i: r.nearest_lat for r in grid.nearest_on_axis(points, "lat", axis, "lat", ties).collect()} for ties in ("first", "last")}
    assert near["first"] == {1: 0.0, 2: 0.0, 3: None, 4: 5.0} and near["last"][1] == 1.0
    keys = spark.createDataFrame([(0.125,), (10.005,), (-0.001,)], "x double").select(grid.coordinate_key(F.col("x")).alias("k")).collect()
    assert [r.k for r in keys] == [12, 1000 if round(10.005 * 100) == 1000 else 1001, 0]
    assert one(spark, grid.celsius(F.lit(300.0), F.lit("K"))) == pytest.approx(26.85) and one(spark, grid.celsius(F.lit(300.0), F.lit(None).cast("string"))) == 300
    assert one(spark, grid.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * 6371)


def test_sources_and_sinks(spark, tmp_path):
    columns = ("STATION", "DATE", "TMP")
    for year, station, text in ((2015, "00001", '"STATION","DATE","TMP","EXTRA"\n"00001","2015-01-01T00:10:00","+0123,1","x"\n"00001","2015-01-01T00:50:00","+0143,5","x"\n'), (2016, "00001", '"STATION","DATE","TMP","EXTRA"\n"00002","2016-01-01T00:10:00","+9999,9","x"\n')):
        (tmp_path / "raw" / str(year)).mkdir(parents=True)
        (tmp_path / "raw" / str(year) / f"{station}.csv").write_text(text)
    raw = tables.reports(spark, str(tmp_path / "raw"), columns).withColumns({c: F.lit(None).cast("string") for c in ("LATITUDE", "LONGITUDE", "ELEVATION")})
    hourly = qc.hourly_mean(qc.strict_readings(raw).where("accepted"), ["file_station", "file_year"])
    assert [(r.file_station, r.file_year, r.obs) for r in hourly.collect()] == [("00001", 2015, pytest.approx(13.3))]
    files = inventory.file_stats(qc.scheme_readings(raw), ["file_year", "file_station"])
    assert {r.file_year: (r.n_rows, r.n_valid, r.n_missing, r.n_repeats, r.station_id) for r in files.collect()} == {2015: (2, 2, 0, 1, "00001"), 2016: (1, 0, 1, 0, "00002")}
    assert inventory.year_funnel(files).count() == 2 and tables.report_files(spark, str(tmp_path / "raw")).count() == 2
    meta = {r.station_id: r for r in inventory.station_metadata(files).collect()}
    assert meta["00002"].n_years_with_valid_data == 0 and meta["00001"].total_valid_hours == 1
    out = str(tmp_path / "archive")
    sinks.write_archive(spark.createDataFrame([(1, 2.0), (2, 3.0)], "month int, v double"), out)
    sinks.write_parts(spark.createDataFrame([(2, 9.0)], "month int, v double").withColumn("algorithm", F.lit("")), out + "2", ["month"])
    sinks.write_parts(spark.createDataFrame([(3, 9.0)], "month int, v double"), out + "2", ["month"])
    assert spark.read.parquet(out).where("month = 2").first().v == 3.0 and sinks.read_parts(spark.read.parquet(out + "2")).count() == 2
    table = spark.createDataFrame([(1, "x")], "a int, b string")
    sinks.write_csv(table, str(tmp_path / "csv"), gzip=True, single=True)
    sinks.write_json(table, str(tmp_path / "json"))
    assert tables.parts(spark, str(tmp_path / "json"), "a int, b string", ["a"]).count() == 1
    assert sinks.markdown(table).splitlines()[-1] == "| 1 | x |" and '"b": "x"' in sinks.report_json(table)
    (tmp_path / "st.csv").write_text("station,lat,lon\n007,1,2\n008,,3\n")
    assert [r.station for r in tables.stations(spark, str(tmp_path / "st.csv")).collect()] == ["007"]
    grid_rows = spark.createDataFrame([(dt.datetime(2020, 1, 1), 1.0, 2.0, 300.0, "K")], "valid_time timestamp_ntz, latitude double, longitude double, skin double, units string")
    grid_rows.write.parquet(str(tmp_path / "grid"))
    assert tables.grid(spark, str(tmp_path / "grid")).first().t2m == pytest.approx(26.85)
    with pytest.raises(ValueError):
        tables.resolve_aliases(table)


def test_reports_by_each_files_header(spark, tmp_path):
    texts = {
        (2015, "a"): "STATION,DATE,LATITUDE,LONGITUDE,ELEVATION,TMP\n00001,2015-01-01T00:10:00,,2,3,\"+0123,1\"\n00001,2015-01-01T00:50:00,1,9,9,\"+0143,5\"\n",
        (2015, "b"): '"TMP","X","ELEVATION","LONGITUDE","LATITUDE","DATE","STATION"\n"+0050,1","a ""q"", b","7","6","5","2015-01-01T01:00:00","00002"\n\n"-0050,C"\n',
        (2016, "a"): "DATE,TMP,STATION,LATITUDE,LONGITUDE,ELEVATION,SOURCE\n2016-01-01T00:10:00,\"+9999,9\",00001,1,2,3,s\n",
        (2016, "b"): "STATION,DATE\n00003,2016-01-01T00:10:00\n",
        (2016, "c"): "STATION,DATE,LATITUDE,LONGITUDE,ELEVATION,TMP\n",
        (2017, "d"): "\n",
    }
    for (year, name), text in texts.items():
        (tmp_path / str(year)).mkdir(exist_ok=True)
        (tmp_path / str(year) / f"{name}.csv").write_text(text)
    rows = tables.reports(spark, str(tmp_path))
    got = sorted((r.file_year, r.file_station, r.row_no, r.STATION, r.TMP, r.LATITUDE) for r in rows.collect())
    assert [(y, f, s, t, lat) for y, f, _, s, t, lat in got] == [
        (2015, "a", "00001", "+0123,1", None), (2015, "a", "00001", "+0143,5", "1"), (2015, "b", "00002", "+0050,1", "5"), (2015, "b", None, "-0050,C", None), (2016, "a", "00001", "+9999,9", "1"),
    ]
    errors = tables.report_errors(spark, str(tmp_path))
    assert {(r.file_year, r.file_station): r.error for r in errors.collect()} == {(2016, "b"): "read: columns are missing: ELEVATION, LATITUDE, LONGITUDE, TMP", (2016, "c"): "empty", (2017, "d"): "empty"}
    files = inventory.file_stats(qc.scheme_readings(rows), ["file_year", "file_station"])
    assert {(r.file_year, r.file_station): (r.n_valid, r.latitude, r.longitude) for r in files.collect()} == {(2015, "a"): (2, "1", "2"), (2015, "b"): (2, "5", "6"), (2016, "a"): (0, "1", "2")}
    funnel = {r.file_year: (r.n_files, r.n_read_errors, r.n_rows, r.n_unique_stations) for r in inventory.year_funnel(files, errors=errors).collect()}
    assert funnel == {2015: (2, 0, 4, 2), 2016: (3, 2, 1, 1), 2017: (1, 1, 0, 0)}


def test_names_of_grids(spark):
    row = spark.createDataFrame([(dt.datetime(2020, 1, 1), 1.0, 2.0, 3.0, 4.0)], "date timestamp_ntz, time timestamp_ntz, Y double, x double, d double".replace("time timestamp_ntz", "z double"))
    assert tables.resolve_aliases(row).columns == ["time", "t2m", "lat", "lon", "d"]
    known = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0)], "time double, lat double, lon double, skin double, temp double")
    assert tables.resolve_aliases(known).columns == ["time", "lat", "lon", "skin", "t2m"]


def test_checks(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert checks.duplicates(df, ["k"]).collect()[0].copies == 2
    with pytest.raises(ValueError):
        checks.unique(df, ["k"])
    with pytest.raises(ValueError):
        checks.required(df, ["k", "z"])
    assert checks.todo(df, df.where("k = 1"), ["k"]).count() == 1 and checks.todo(df, df.limit(0), ["k"], limit=1).count() == 1 and checks.existing(df, df.where("k = 1"), ["k"]).count() == 2


def test_samples_are_stable(spark):
    rows = [("72530094846", 1.0, 1.0, 24), ("b", 1.0, 1.0, 23), ("c", None, 1.0, 99), ("d", 1.0, 1.0, 99)]
    got = sensitivity.stable_sample(spark.createDataFrame(rows, "station string, lat double, lon double, total_hours long"), 5).collect()
    assert {r.station for r in got} == {"72530094846", "d"} and next(r for r in got if r.station != "d").rank_key == "993ce5fa1b3307e52aab6fba90232b8fe9be282a88938d25e30c4e066d2662be"


def test_streams(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, h, m), float(h + m)) for h in range(5) for m in (10, 40)]
    readings = spark.createDataFrame(rows, "k string, time timestamp_ntz, value double")
    readings.write.parquet(str(tmp_path / "in"))
    stream = hourly_stream(spark.readStream.schema(readings.schema).parquet(str(tmp_path / "in")), ["k"])
    q = stream.writeStream.format("memory").queryName("hourly_test").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.time.hour: r.obs for r in spark.table("hourly_test").collect()}
    want = {r.time.hour: r.obs for r in qc.hourly_mean(readings, ["k"]).collect()}
    assert got and all(want[h] == v for h, v in got.items()) and set(got) <= set(want)
    stats = spark.createDataFrame([("a", 2, 1.0, 2.0, 3.0)], "k string, n long, sum_o double, sum_o2 double, sse double")
    assert merge_statistics(stats, stats, ["k"]).first()[1:] == (4, 2.0, 4.0, 6.0)
