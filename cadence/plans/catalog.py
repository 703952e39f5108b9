"""The registered queries, each beside the statement that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions import scoring
from cadence.functions.nulls import tidy
from cadence.operators import checks, civil, climatology, fit, grid, inventory, modes, paired, qc, ranks, scores, sensitivity, strata, zones
from cadence.plans import adapters as a
from cadence.plans import oracle as o
from cadence.session import new_folder
from cadence.sources import cache, gridded, runlog, sinks, tables, units

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CELL = ["lat", "lon"]


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


def report(df: DataFrame, **renamed: Column) -> DataFrame:
    """Numbers in the types and digits of reports; dates and times as text."""
    out = []
    for f in df.withColumns(renamed).schema.fields if renamed else df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = tidy(c.cast("double"))
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.withColumns(renamed).select(*out) if renamed else df.select(*out)


# Sources, parsing, quality


@query("b6_row_class_counts", o.statement(o.REPORT_CHAIN, f"SELECT row_class, {o.i('count(*)')} AS n FROM acc GROUP BY ALL"))
def _(spark, d):
    return report(qc.scheme_readings(a.reports(spark, d)).groupBy("row_class").agg(F.count("*").alias("n")))


@query("a6_strict_readings", o.statement(o.REPORT_CHAIN, f"SELECT {o.i('row_no')} AS row_no, {o.r('CAST(num AS DOUBLE) / 10')} AS value, strftime(CASE WHEN k = 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS time FROM cls WHERE m IN (9, 11, 12, 13, 14, 15, 16) AND k >= 2"))
def _(spark, d):
    return report(qc.strict_readings(a.reports(spark, d)).where("accepted").select("row_no", "value", "time"))


@query("a7_scheme_readings", o.statement(o.REPORT_CHAIN, f"SELECT {o.i('row_no')} AS row_no, {o.r('value')} AS value, strftime(naive_time, '%Y-%m-%d %H:%M:%S') AS time FROM acc WHERE accepted"))
def _(spark, d):
    return report(qc.scheme_readings(a.reports(spark, d)).where("accepted").select("row_no", "value", "time"))


@query("b7_time_parse", o.statement(o.REPORT_CHAIN, f"SELECT {o.i('row_no')} AS row_no, strftime(naive_time, '%Y-%m-%d %H:%M:%S') AS naive, strftime(CASE WHEN k = 2 THEN naive_time - INTERVAL 2 HOUR ELSE naive_time END, '%Y-%m-%d %H:%M:%S') AS utc FROM cls"))
def _(spark, d):
    return report(a.reports(spark, d).select("row_no", qc.report_time(F.col("DATE"), False).alias("naive"), qc.report_time(F.col("DATE"), True).alias("utc")))


@query("e1_hourly_dedup", o.statement(o.STATION_CHAIN[:2], f"SELECT station, {o.i('file_year')} AS file_year, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, {o.r('obs')} AS obs FROM hourly"))
def _(spark, d):
    return report(a.hourly(spark, d))


_CHUNK = gridded.Chunk(days=5, lat_degrees=20.0, lon_degrees=4.0)


def _written_grid(spark, d):
    path = new_folder(spark, "grid")
    gridded.write_grid(a.grid_series(spark, d).withColumn("warm", F.col("t") > 1.2345), path, {"t": "float", "warm": "tinyint"}, _CHUNK)
    return path


_CELL_HOURS = f"SELECT lat, lon, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, round(CAST(CAST(t AS FLOAT) AS DOUBLE), 3) + 0.0 AS t, {o.i('t > 1.2345')} AS warm, {o.i('year(time)')} AS year, {o.i('month(time)')} AS month FROM grid"


@query("a1_s1_grid_round_trip", o.statement((o.GRID,), _CELL_HOURS))
def _(spark, d):
    found = gridded.read_grid(spark, _written_grid(spark, d), ["t", "warm"])
    return report(found, t=tidy(F.col("t").cast("double"), 3))


@query("a5_grid_month", o.statement((o.GRID,), _CELL_HOURS + " WHERE year(time) = 2024 AND month(time) = 3 AND lat BETWEEN 20 AND 40 AND lon BETWEEN 2 AND 5"))
def _(spark, d):
    found = gridded.read_grid(spark, _written_grid(spark, d), ["t", "warm"], [2024], [3], (20.0, 40.0), (2.0, 5.0))
    return report(found, t=tidy(F.col("t").cast("double"), 3))


@query("f14_zones", o.statement((o.FEATURES, o.ZONED), "SELECT station, zone FROM zoned"))
def _(spark, d):
    return zones.with_zone(a.features(spark, d), a.nation_polygons(spark, d), 2.0).select("station", "zone")


# Climatology and fit


@query("c2_climatology", o.statement(o.STATION_CHAIN[:3], f"SELECT station, {o.i('month')} AS month, {o.i('hour')} AS hour, {o.r('t')} AS t FROM clim"))
def _(spark, d):
    return report(climatology.climatology(a.hourly(spark, d), ["station"]))


@query("c4_valid_cells", o.statement((o.GRID, o.GMASK), f"SELECT lat, lon, {o.r('valid_fraction')} AS valid_fraction, is_valid FROM gmask"))
def _(spark, d):
    return report(climatology.valid_cells(_grid_clim(spark, d), CELL))


def _grid_clim(spark, d):
    """With coordinates as decimals: doubles are normalised for each group and window, which hides from a plan that rows lie together already."""
    return climatology.climatology(a.grid_series(spark, d).withColumns({c: F.col(c).cast("decimal(9,4)") for c in CELL}), CELL, value="t")


def _grid_checked(spark, d):
    return climatology.checked(_grid_clim(spark, d), CELL)


def _grid_params(spark, d):
    return fit.parameters(fit.ridge_fit(_grid_checked(spark, d), CELL), CELL)


def _grid_archive(spark, d):
    return fit.archive(_grid_checked(spark, d), CELL)


@query("c5_detrended", o.statement((o.GRID,), f"SELECT lat, lon, {o.i('month')} AS month, {o.i('hour')} AS hour, {o.r('t')} AS t, {o.r('t_mean')} AS t_mean, {o.r('y')} AS y FROM gdet"))
def _(spark, d):
    return report(climatology.detrended(_grid_clim(spark, d), CELL))


@query("c6_precheck", o.statement(o.GRID_FITTED[:3], f"SELECT lat, lon, {o.i('month')} AS month, {o.i('n_hours')} AS n_hours, {o.r('t_range')} AS t_range, {o.r('t_std')} AS t_std, ok FROM gcheck"))
def _(spark, d):
    clim = _grid_clim(spark, d)
    return report(climatology.precheck(clim, CELL, climatology.valid_cells(clim, CELL)))


@query("c7_masked", o.statement(o.GRID_FITTED[:3], f"SELECT g.lat, g.lon, {o.i('g.month')} AS month, {o.i('hour')} AS hour, {o.r('CASE WHEN ok THEN y END')} AS y, {o.r('CASE WHEN bool_or(ok) OVER (PARTITION BY g.lat, g.lon) THEN t_mean END')} AS t_mean FROM gdet g JOIN gcheck USING (lat, lon, month)"))
def _(spark, d):
    return report(_grid_checked(spark, d).select(*CELL, "month", "hour", "y", "t_mean"))


@query("c9_ridge_fit", o.statement(o.GRID_FITTED[:4], f"SELECT lat, lon, {o.i('month')} AS month, {o.i('n_hours')} AS n_hours, {', '.join(f'{o.r(c)} AS {c}' for c in ('c1', 'c2', 'c3', 'c4'))} FROM gcoef"))
def _(spark, d):
    return report(fit.ridge_fit(_grid_checked(spark, d), CELL))


@query("c9_full_day_fit", o.statement(o.STATION_CHAIN[:5], f"SELECT station, {o.i('month')} AS month, {o.i('n_hours')} AS n_hours, {', '.join(f'{o.r(c)} AS {c}' for c in ('c1', 'c2', 'c3', 'c4'))} FROM coef"))
def _(spark, d):
    return report(fit.ridge_fit(a.station_fit(spark, d)[1], ["station"]))


@query("c10_amplitude_phase", o.statement(o.STATION_CHAIN[:6], f"SELECT station, {o.i('month')} AS month, {', '.join(f'round(CAST({c} AS DOUBLE), 4) + 0.0 AS {c}' for c in fit.PARAMETERS)} FROM params"))
def _(spark, d):
    params = a.station_fit(spark, d)[2]
    return params.select("station", F.col("month").cast("long"), *(tidy(F.col(c).cast("double"), 4).alias(c) for c in fit.PARAMETERS))


@query("c12_fit_metrics", o.statement((*o.GRID_FITTED, o.GFIT), f"SELECT lat, lon, {o.i('month')} AS month, round(CAST(r_squared AS DOUBLE), 4) + 0.0 AS r_squared, round(CAST(rmse AS DOUBLE), 4) + 0.0 AS rmse, round(dtr_observed, 4) + 0.0 AS dtr_observed FROM gmet"))
def _(spark, d):
    return _grid_archive(spark, d).select(*(F.col(c).cast("double") for c in CELL), F.col("month").cast("long"), *(tidy(F.col(c).cast("double"), 4).alias(c) for c in ("r_squared", "rmse", "dtr_observed")))


@query("c14_fine_curve", o.statement((*o.GRID_FITTED, o.GFINE), f"SELECT lat, lon, {o.i('month')} AS month, round(CAST(dtr_fitted AS DOUBLE), 4) + 0.0 AS dtr_fitted, round(CAST(tmax_hour AS DOUBLE), 1) + 0.0 AS tmax_hour, round(CAST(tmin_hour AS DOUBLE), 1) + 0.0 AS tmin_hour FROM gfine"))
def _(spark, d):
    found = fit.fine_curve(_grid_params(spark, d))
    return found.select(*(F.col(c).cast("double") for c in CELL), F.col("month").cast("long"), tidy(F.col("dtr_fitted").cast("double"), 4).alias("dtr_fitted"), *(tidy(F.col(c).cast("double"), 1).alias(c) for c in ("tmax_hour", "tmin_hour")))


@query("c17_quality_flag", o.statement(o.GRID_CHAIN, f"SELECT lat, lon, {o.i('month')} AS month, quality_flag, skipped FROM garchive"))
def _(spark, d):
    return report(_grid_archive(spark, d).select(*CELL, "month", "quality_flag", "skipped"))


@query("c20_archive_summary", o.statement(o.GRID_CHAIN, f"""SELECT {o.i('count(*)')} AS total, {o.i('count(*) FILTER (WHERE skipped = 0)')} AS fitted, {o.i('count(*) FILTER (WHERE quality_flag = 1)')} AS good, {o.i('count(*) FILTER (WHERE skipped = 1)')} AS skipped,
  {o.r('100.0 * count(*) FILTER (WHERE quality_flag = 1) / count(*)')} AS good_percent, {o.r('100.0 * count(*) FILTER (WHERE skipped = 1) / count(*)')} AS skipped_percent, {o.r('median(CAST(r_squared AS DOUBLE))')} AS median_r2, {o.r('100.0 * count(*) FILTER (WHERE r_squared > 0.8) / count(r_squared)')} AS r2_above_08_percent FROM garchive"""))
def _(spark, d):
    return report(fit.archive_summary(_grid_archive(spark, d)))


@query("c22_templates", o.statement(o.STATION_CHAIN[:7], f"SELECT station, {o.i('month')} AS month, {o.i('hour')} AS hour, round(s, 4) + 0.0 AS s FROM shapes"))
def _(spark, d):
    found = fit.templates(a.station_fit(spark, d)[2], ["station"]).select("station", F.col("month").cast("long"), F.posexplode("s").alias("hour", "s"))
    return found.select("station", "month", F.col("hour").cast("long"), tidy(F.col("s").cast("double"), 4).alias("s"))


_PLACES = """places AS (SELECT DISTINCT CAST(round_even(lat * 100, 0) AS BIGINT) AS lat_c, CAST(round_even(lon * 100, 0) AS BIGINT) AS lon_c FROM features),
placed AS (SELECT lat_c, lon_c, (SELECT arg_min(x, (abs(x - lat_c / 100.0), x)) FROM (SELECT DISTINCT lat AS x FROM gparams)) AS lat, (SELECT arg_min(x, (abs(x - lon_c / 100.0), x)) FROM (SELECT DISTINCT lon AS x FROM gparams)) AS lon FROM places)"""


@query("c22_station_templates", o.statement((*o.GRID_FITTED, o.GSHAPES, o.FEATURES, _PLACES), f"SELECT lat_c, lon_c, {o.i('month')} AS month, {o.i('hour')} AS hour, round(s, 4) + 0.0 AS s FROM placed JOIN gshapes USING (lat, lon)"))
def _(spark, d):
    shapes = fit.templates(_grid_params(spark, d), CELL)
    axis = shapes.select(*CELL).distinct()
    found = grid.station_templates(a.features(spark, d), shapes, axis, axis).select("lat_c", "lon_c", "month", F.posexplode_outer("s").alias("hour", "s"))
    # a cell's month without a fit has 24 hours without a shape
    hours = found.select("lat_c", "lon_c", "month", F.explode(F.when(F.col("hour").isNull(), F.sequence(F.lit(0), F.lit(23))).otherwise(F.array("hour"))).alias("hour"), "s")
    return hours.select(*(F.col(c).cast("long") for c in ("lat_c", "lon_c", "month", "hour")), tidy(F.col("s").cast("double"), 4).alias("s"))


@query("f5_nearest_cell", o.statement((*o.GRID_FITTED, o.FEATURES), f"SELECT station, (SELECT arg_min(x, (abs(x - lat), x)) FROM (SELECT DISTINCT lat AS x FROM gparams) g(x)) AS nearest_lat, (SELECT arg_min(x, (abs(x - lon), x)) FROM (SELECT DISTINCT lon AS x FROM gparams) g(x)) AS nearest_lon FROM features"))
def _(spark, d):
    axis = a.grid_series(spark, d).select(*CELL).distinct()
    found = grid.nearest_on_axis(grid.nearest_on_axis(a.features(spark, d), "lat", axis, "lat"), "lon", axis, "lon")
    return report(found.select("station", "nearest_lat", "nearest_lon"))


# Strict modes and their scores


@query("d1_d2_daily_modes", o.statement(o.STATION_CHAIN, f"""SELECT station, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, {o.r('avg(obs) OVER d + s')} AS baseline,
  {o.r('avg(obs) OVER d + CASE WHEN span > 1e-4 THEN (max(obs) OVER d - min(obs) OVER d) / span ELSE 1 END * s')} AS scaled
  FROM shaped JOIN (SELECT station, month, CAST(CAST(max(s) AS FLOAT) - CAST(min(s) AS FLOAT) AS DOUBLE) AS span FROM shapes GROUP BY ALL) USING (station, month) WINDOW d AS (PARTITION BY station, file_year, day)"""))
def _(spark, d):
    return report(modes.daily_modes(a.shaped(spark, d)).select("station", "time", "baseline", "scaled"))


_REC = (*o.STATION_CHAIN, o.ANCHORS, o.REC)
for _name, _mode, _col in (("d3_one_anchor", "1pt_fixed12", "r1"), ("d5_literal", "2pt_fixed_00_12_literal", "r2"), ("d4_two_anchor", "2pt_fixed_00_12_clip", "r3"), ("d6_dynamic", "2pt_dynamic_strict", "r4")):

    @query(_name, o.statement(_REC, f"SELECT station, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, {o.r(_col)} AS rec FROM rec"))
    def _(spark, d, mode=_mode):
        return report(a.reconstructed(spark, d).select("station", "time", F.col(mode).alias("rec")))


@query("d4_two_anchor_heldout", o.statement(o.STRICT_CHAIN, f"SELECT station, {o.columns(o.score('obs', 'r', 'use'))} FROM long WHERE mode = '2pt_fixed_00_12_clip' AND scope = 'heldout' GROUP BY ALL"))
def two_anchor_heldout(spark, d):
    long = scores.mode_long(a.reconstructed(spark, d)).where("mode = '2pt_fixed_00_12_clip' and scope = 'heldout'")
    return report(scores.pooled(long, ["station"]))


@query("b14_heldout_masks", o.statement(o.STRICT_CHAIN[:-1] + (o.LONG,), f"SELECT station, {', '.join(f'{o.i(f"count(*) FILTER (WHERE {k})")} AS {n}' for k, n in (('k1', 'held_1pt'), ('k2', 'held_literal'), ('k3', 'held_clip'), ('k4', 'held_dynamic'), ('kc', 'held_common'), ('ac', 'all_common')))} FROM wide GROUP BY ALL"))
def _(spark, d):
    rec = a.reconstructed(spark, d)
    held = dict(zip(("held_1pt", "held_literal", "held_clip", "held_dynamic"), (F.col(f"held_{m}") for m in modes.STRICT_MODES))) | {"held_common": modes.common_mask(), "all_common": modes.common_mask(held=False)}
    return report(rec.groupBy("station").agg(*(F.count_if(v).alias(k) for k, v in held.items())))


@query("e8_pooled", o.statement(o.STRICT_CHAIN, f"SELECT mode, scope, {o.columns(o.score('obs', 'r', 'use'))} FROM long GROUP BY mode, scope UNION ALL SELECT mode, scope || '_common', {', '.join(o.score('obs', 'r', 'common').values())} FROM long GROUP BY mode, scope"))
def _(spark, d):
    return report(scores.pooled_by_scope(scores.mode_long(a.reconstructed(spark, d))))


@query("e8_pooled_levels", o.statement(o.STRICT_CHAIN, f"SELECT CASE WHEN station IS NULL THEN 'pooled' ELSE 'station' END AS level, station, scope, mode, {o.columns(o.score('obs', 'r', 'use'))} FROM long GROUP BY GROUPING SETS ((scope, mode), (scope, mode, station))"))
def _(spark, d):
    return report(scores.pooled_levels(scores.mode_long(a.reconstructed(spark, d))))


def _wide(sep: str, k: str) -> str:
    picks = []
    for scope, uses in (("all", ("r1 IS NOT NULL", "r2 IS NOT NULL", "r3 IS NOT NULL", "r4 IS NOT NULL")), ("heldout", ("k1", "k2", "k3", "k4"))):
        for m, rec, use in zip(modes.STRICT_MODES, ("r1", "r2", "r3", "r4"), uses):
            picks += [f'{v} AS "{n}_{scope}_{m}"' for n, v in o.score("obs", rec, use).items()]
    return sep.join(picks)


@query("e7_station_month", o.statement(o.STRICT_CHAIN, f"SELECT station, {o.i('year(time)')} AS year, {o.i('month')} AS month, {o.i('count(obs)')} AS n_obs, {_wide(', ', '')}, {o.i('count(*) FILTER (WHERE kc)')} AS n_common_heldout FROM wide GROUP BY station, year(time), month"))
def _(spark, d):
    return report(scores.station_months(a.reconstructed(spark, d)))


@query("e12_eligibility", o.statement(o.STRICT_CHAIN, f"SELECT scope, mode, {o.i('count(*) FILTER (WHERE n >= 24)')} AS station_months, {o.i('count(DISTINCT station) FILTER (WHERE n >= 24)')} AS stations FROM (SELECT scope, mode, station, year(time) AS y, month, count(*) FILTER (WHERE use) AS n FROM long GROUP BY ALL) GROUP BY scope, mode"))
def _(spark, d):
    return report(scores.eligibility(scores.station_months(a.reconstructed(spark, d))))


@query("e9_daily", o.statement((*o.STRICT_CHAIN, """days AS (SELECT station, file_year, day, scope, mode, avg(obs) AS o1, min(obs) AS o2, max(obs) AS o3, avg(r) AS q1, min(r) AS q2, max(r) AS q3 FROM long WHERE use GROUP BY ALL),
dlong AS (SELECT scope, mode, m.metric, m.o, m.q FROM days, LATERAL (VALUES ('tmean', o1, q1), ('tmin', o2, q2), ('tmax', o3, q3), ('dtr', o3 - o2, q3 - q2)) m(metric, o, q))"""), f"SELECT scope, mode, metric, {o.columns(o.score('o', 'q'))} FROM dlong GROUP BY ALL"))
def _(spark, d):
    return report(scores.daily_scores(scores.mode_long(a.reconstructed(spark, d))))


@query("e10_diagnostics", o.statement((*o.STATION_CHAIN, o.ANCHORS, "ad AS (SELECT DISTINCT station, file_year, day, abs(s2 - s1) > 0.5 AS f, CASE WHEN abs(s2 - s1) > 0.5 THEN (t2 - t1) / (s2 - s1) END AS b FROM anch WHERE t1 IS NOT NULL AND t2 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL)"), f"SELECT {', '.join(f'{o.i(f"count(*) FILTER (WHERE {c})")} AS {n}' for n, c in (('anchor_days', 'true'), ('fit_days', 'f'), ('fallback_days', 'NOT f'), ('slope_below_0', 'b < 0'), ('slope_below_01', 'b < 0.1'), ('slope_above_5', 'b > 5')))} FROM ad"))
def _(spark, d):
    return report(scores.day_diagnostics(a.reconstructed(spark, d)))


@query("e11_delta", o.statement((*o.STATION_CHAIN, o.ANCHORS, f"dl AS (SELECT delta, obs, {o.two_anchor('t1', 't2', 's1', 's2', delta='delta')} AS r FROM anch, (VALUES (0.1::DOUBLE), (0.25), (0.5), (1.0), (2.0)) v(delta) WHERE hour NOT IN (0, 12))"), f"SELECT delta, {o.columns(o.score('obs', 'r'))} FROM dl GROUP BY delta"))
def _(spark, d):
    return report(scores.delta_sensitivity(a.shaped(spark, d)))


# Anchor sensitivity

_SWEEP = (*o.STATION_CHAIN, "hh AS (SELECT * FROM shaped WHERE s IS NOT NULL AND obs IS NOT NULL)")


@query("e20_day_matrix", o.statement(_SWEEP, f"SELECT station, strftime(day, '%Y-%m-%d') AS day, {o.i('count(*)')} AS n, {o.r('sum(obs)')} AS sy, {o.r('sum(obs * obs)')} AS sy2, {o.r('sum(s)')} AS ss, {o.r('sum(s * s)')} AS ss2, {o.r('sum(obs * s)')} AS sys, {o.r('max(obs) FILTER (WHERE hour = 12)')} AS y12 FROM hh GROUP BY station, file_year, day"))
def _(spark, d):
    return report(sensitivity.day_matrix(a.shaped(spark, d)).where("n > 0").select("station", "day", *sensitivity.SUMS, F.get("y", F.lit(12)).alias("y12")))


@query("e23_one_anchor_24h", o.statement((*_SWEEP, "sw AS (SELECT x.hour AS h, b.obs, x.obs - x.s + b.s AS r FROM hh x JOIN hh b ON x.station = b.station AND x.file_year = b.file_year AND x.day = b.day AND x.hour <> b.hour)"), f"SELECT {o.i('h')} AS anchor_hour_utc, {o.columns({f'{k}_heldout': v for k, v in o.score('obs', 'r', least=1, above=0).items()})} FROM sw GROUP BY h"))
def _(spark, d):
    return report(sensitivity.single_anchors(sensitivity.day_matrix(a.shaped(spark, d))))


_PAIRS = (*_SWEEP, f"""pd AS (SELECT x.station, x.file_year, x.day, x.hour AS h1, y.hour AS h2, x.obs AS t1, y.obs AS t2, x.s AS z1, y.s AS z2 FROM hh x JOIN hh y ON x.station = y.station AND x.file_year = y.file_year AND x.day = y.day AND x.hour < y.hour),
pr AS (SELECT h1, h2, b.obs, {o.two_anchor('t1', 't2', 'z1', 'z2')} AS r FROM pd JOIN hh b ON pd.station = b.station AND pd.file_year = b.file_year AND pd.day = b.day AND b.hour NOT IN (h1, h2)),
pn AS (SELECT h1, h2, count(*) AS anchor_days, count(*) FILTER (WHERE NOT abs(z2 - z1) > 0.5) AS fallback_days FROM pd GROUP BY ALL),
ps AS (SELECT h1, h2, {o.columns({f'{k}_heldout': v for k, v in o.score('obs', 'r', least=1, above=0).items()})} FROM pr GROUP BY ALL)""")


@query("e24_pairs_276", o.statement(_PAIRS, f"SELECT {o.i('h1')} AS h1_utc, {o.i('h2')} AS h2_utc, coalesce(n_heldout, 0) AS n_heldout, {o.i('anchor_days')} AS anchor_days, {o.i('fallback_days')} AS fallback_days, {o.r('fallback_days / anchor_days')} AS fallback_fraction, rmse_heldout, r2_heldout, {o.i('least(h2 - h1, 24 - (h2 - h1))')} AS circular_separation_h FROM pn LEFT JOIN ps USING (h1, h2)"))
def _(spark, d):
    return report(sensitivity.anchor_pairs(sensitivity.day_matrix(a.shaped(spark, d))))


@query("h3_top_pairs", o.statement(_PAIRS, f"SELECT {o.i('h1')} AS h1_utc, {o.i('h2')} AS h2_utc, rmse_heldout FROM ps WHERE rmse_heldout IS NOT NULL ORDER BY rmse_heldout, h1, h2 LIMIT 10"))
def _(spark, d):
    found = sensitivity.anchor_pairs(sensitivity.day_matrix(a.shaped(spark, d))).where("rmse_heldout is not null")
    return report(found.select("h1_utc", "h2_utc", tidy(F.col("rmse_heldout")).alias("rmse_heldout")).orderBy("rmse_heldout", "h1_utc", "h2_utc").limit(10))


@query("g7_stable_sample", "SELECT CAST(c_custkey AS VARCHAR) AS station, sha256('20260814:' || CAST(c_custkey AS VARCHAR)) AS rank_key FROM customer WHERE c_acctbal >= 24 ORDER BY rank_key LIMIT 200")
def _(spark, d):
    customers = a.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("station"), F.col("c_nationkey").cast("double").alias("lat"), F.lit(0.0).alias("lon"), F.col("c_acctbal").alias("total_hours"))
    return sensitivity.stable_sample(customers, 200).select("station", "rank_key")


# Paired comparison and distributions

_PAIRED = (*o.STRICT_CHAIN, f"""pm AS (SELECT station, year(time) AS year, month, count(*) FILTER (WHERE b) AS n, {', '.join(f'sqrt(avg(({x} - obs) * ({x} - obs)) FILTER (WHERE b)) AS rmse{k}, 1 - sum(({x} - obs) * ({x} - obs)) FILTER (WHERE b) / (sum(obs * obs) FILTER (WHERE b) - sum(obs) FILTER (WHERE b) * sum(obs) FILTER (WHERE b) / count(*) FILTER (WHERE b)) AS r2{k}' for x, k in (('r1', '_1pt'), ('r3', '_2pt')))}
  FROM (SELECT *, r1 IS NOT NULL AND r3 IS NOT NULL AND hour NOT IN (0, 12) AS b FROM wide) GROUP BY ALL HAVING count(*) FILTER (WHERE b) >= 2)""")


def _paired(spark, d):
    return paired.common_hour_months(a.reconstructed(spark, d)).where("n >= 2")


@query("e13_common_hour_months", o.statement(_PAIRED, f"SELECT station, {o.i('year')} AS year, {o.i('month')} AS month, {o.i('n')} AS n, {', '.join(f'{o.r(c)} AS {c}' for c in ('rmse_1pt', 'r2_1pt', 'rmse_2pt', 'r2_2pt'))} FROM pm"))
def _(spark, d):
    return report(_paired(spark, d))


@query("e14_paired_summary", o.statement(_PAIRED, f"SELECT {o.i('count(*)')} AS eligible_station_months, {o.i('count(DISTINCT station)')} AS unique_stations, {o.r('avg(CASE WHEN rmse_2pt < rmse_1pt THEN 100.0 ELSE 0 END)')} AS two_lower_rmse_percent, {o.r('avg(CASE WHEN r2_2pt > r2_1pt THEN 100.0 ELSE 0 END)')} AS two_higher_r2_percent, {o.r('median(rmse_1pt - rmse_2pt)')} AS median_improvement, {o.r('quantile_cont(rmse_1pt - rmse_2pt, 0.25)')} AS q25_improvement, {o.r('quantile_cont(rmse_1pt - rmse_2pt, 0.75)')} AS q75_improvement FROM pm WHERE n >= 24"))
def _(spark, d):
    return report(paired.paired_summary(_paired(spark, d)))


@query("m1_histogram", """WITH v AS (SELECT o_totalprice AS v FROM orders), e AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi, count(*) AS total FROM v),
b AS (SELECT least(CAST(floor((v - lo) / ((hi - lo) / 95)) AS BIGINT), 94) AS bin, lo, hi, total FROM v, e WHERE v BETWEEN lo AND hi)
SELECT bin, round(lo + bin * ((hi - lo) / 95), 4) + 0.0 AS left_edge, round(sum(100.0::DOUBLE / total), 6) + 0.0 AS weight FROM b GROUP BY bin, lo, hi""")
def _(spark, d):
    found = paired.histogram(a.table(spark, d, "orders"), F.col("o_totalprice"))
    return found.select(F.col("bin").cast("long"), tidy(F.col("left_edge"), 4).alias("left_edge"), tidy(F.col("weight")).alias("weight"))


@query("m2_ecdf", o.statement((o.MONTHS,), f"SELECT mode, station, {o.i('year')} AS year, {o.i('month')} AS month, {o.r('rmse')} AS rmse, {o.r('row_number() OVER (PARTITION BY mode ORDER BY rmse, station, year, month) / count(*) OVER (PARTITION BY mode)')} AS fraction FROM months WHERE rmse > 0"))
def _(spark, d):
    found = paired.ecdf(a.order_months(spark, d).where("rmse > 0"), "rmse", ["mode"])
    return report(found.select("mode", "station", "year", "month", "rmse", "fraction"))


@query("m6_bins_2d", "SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS x_bin, CAST(floor(greatest(o_totalprice / 250000 - 1, -0.5) / 0.25) AS BIGINT) AS y_bin, count(*) AS n, round(log10(count(*)), 6) + 0.0 AS log10_n FROM orders GROUP BY 1, 2")
def _(spark, d):
    return report(paired.binned_2d(a.table(spark, d, "orders"), F.col("o_totalprice"), F.col("o_totalprice") / 250000 - 1, 50000, 0.25, -0.5))


@query("m7_own_paired", o.statement(o.STRICT_CHAIN, f"""SELECT {o.i('count(*)')} AS months, {o.r('avg(CASE WHEN b < a THEN 100.0 ELSE 0 END)')} AS two_lower_rmse_percent, {o.r('median(a - b)')} AS median_improvement FROM (
  SELECT station, year(time), month, sqrt(avg((r1 - obs) * (r1 - obs)) FILTER (WHERE k1)) AS a, sqrt(avg((r3 - obs) * (r3 - obs)) FILTER (WHERE k3)) AS b FROM wide GROUP BY ALL HAVING count(*) FILTER (WHERE k1) >= 24 AND count(*) FILTER (WHERE k3) >= 24)"""))
def _(spark, d):
    one, two = paired.ONE, paired.TWO
    months = scores.station_months(a.reconstructed(spark, d)).where((F.col(f"n_heldout_{one}") >= 24) & (F.col(f"n_heldout_{two}") >= 24))
    x, y = F.col(f"rmse_heldout_{one}"), F.col(f"rmse_heldout_{two}")
    found = months.agg(F.count("*").alias("months"), F.avg(F.when(y < x, 100.0).otherwise(0.0)).alias("two_lower_rmse_percent"))
    return report(ranks.beside(found, ranks.quantiles(months, [], {"q": x - y}, [0.5]).select(F.col("q")[0].alias("median_improvement")), []))


@query("m8_plot_limit", o.statement((o.MONTHS,), f"SELECT {o.r('greatest(4.0, quantile_cont(v, 0.995))')} AS plot_limit FROM (SELECT unnest([rmse, r2]) AS v FROM months)"))
def _(spark, d):
    return report(paired.plot_limit(a.order_months(spark, d), ["rmse", "r2"]))


# Civil time


def _six(spark, d):
    return civil.six_schemes(civil.with_civil_time(a.shaped(spark, d), a.zones(spark)))


@query("d9_civil_time", o.statement((*o.CIVIL_CHAIN[:-1], "cv AS (SELECT h.station, h.time, timezone(z.tz, timezone('UTC', h.time)) AS local FROM shaped h JOIN zones z USING (station))"), f"SELECT station, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, strftime(local, '%Y-%m-%d %H:%M:%S') AS local, {o.r('hour(local) + minute(local) / 60.0')} AS local_hour FROM cv"))
def _(spark, d):
    return report(civil.with_civil_time(a.shaped(spark, d), a.zones(spark)).select("station", "time", "local", "local_hour"))


@query("d11_civil_schemes", o.statement(o.CIVIL_CHAIN, f"SELECT station, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, {', '.join(f'{o.r(f"q{k}")} AS "{m}"' for k, m in enumerate(civil.SCHEMES, 1))}, common FROM sixc"))
def _(spark, d):
    rec = _six(spark, d)
    return report(rec.select("station", "time", *civil.SCHEMES, civil.common_rows(rec).alias("common")))


_SIX = {"least": 3, "above": 0}


@query("e15_common_six", o.statement(o.CIVIL_CHAIN, f"SELECT mode, 'own' AS scope, {o.columns(o.score('obs', 'r', 'use', **_SIX))} FROM slong GROUP BY mode UNION ALL SELECT mode, 'common', {', '.join(o.score('obs', 'r', 'common', **_SIX).values())} FROM slong GROUP BY mode"))
def _(spark, d):
    return report(scores.scheme_summary(civil.scheme_long(_six(spark, d))))


@query("e16_station_month_local", o.statement(o.CIVIL_CHAIN, f"SELECT station, mode, {o.i('year')} AS year, {o.i('month')} AS month, {o.columns(o.score('obs', 'r', 'use', least=0, above=1e-9))} FROM slong GROUP BY station, mode, year, month HAVING count(*) FILTER (WHERE use) > 1"))
def _(spark, d):
    return report(scores.scheme_months(civil.scheme_long(_six(spark, d))).where("n > 1"))


@query("e17_thresholds", o.statement((o.MONTHS,), f"SELECT mode, {o.i('k')} AS threshold_h, {o.i('count(*)')} AS n_station_months, {o.r('median(r2)')} AS r2_median, {o.r('quantile_cont(r2, 0.75) - quantile_cont(r2, 0.25)')} AS r2_iqr, {o.r('avg(CAST(r2 < 0 AS INT))')} AS share_r2_lt_0, {o.r('avg(CAST(r2 < 0.2 AS INT))')} AS share_r2_lt_02 FROM months, (VALUES (20), (60), (100)) t(k) WHERE n >= k GROUP BY mode, k"))
def _(spark, d):
    return report(scores.threshold_summary(a.order_months(spark, d), (20, 60, 100)))


@query("e18_scheme_map", o.statement(o.CIVIL_CHAIN, f"SELECT station, {o.i('file_year')} AS file_year, mode, {o.columns(o.score('obs', 'r', 'use', **_SIX))} FROM slong GROUP BY station, file_year, mode HAVING count(*) FILTER (WHERE use) >= 24"))
def _(spark, d):
    return report(scores.scheme_map(civil.scheme_long(_six(spark, d))))


def _qa(clock: str, day: str, p: str, q: str, rows: str) -> str:
    return f"""SELECT '{clock}' AS clock, {o.i('count(*)')} AS days, {o.i('count(*) FILTER (WHERE n = 23)')} AS days_23, {o.i('count(*) FILTER (WHERE n = 25)')} AS days_25, {o.i('count(*) FILTER (WHERE b)')} AS two_anchor_days,
  {o.r('count(*) FILTER (WHERE b AND NOT f) / nullif(count(*) FILTER (WHERE b), 0)')} AS fallback_rate, {o.r('count(*) FILTER (WHERE b AND f AND (k < 0.1 OR k > 5)) / nullif(count(*) FILTER (WHERE b), 0)')} AS clip_rate, {', '.join(f'{o.r(f"max({c})")} AS away_{h}_max, {o.r(f"quantile_cont({c}, 0.95)")} AS away_{h}_p95' for c, h in (('w', '00'), ('v', '12')))}
  FROM (SELECT station, file_year, {day}, max({rows}) AS n, bool_or(coalesce(x_{p} <> x_{q}, false)) AS b, bool_or(abs(s_{q} - s_{p}) > 0.5) AS f, max((o_{q} - o_{p}) / nullif(s_{q} - s_{p}, 0)) AS k, max(away_{p}) * 60 AS w, max(away_{q}) * 60 AS v FROM six GROUP BY ALL)"""


@query("e19_tz_qa", o.statement(o.CIVIL_CHAIN, _qa("utc", "day", "u0", "u12", "utc_rows") + " UNION ALL " + _qa("civil", "local_day", "l0", "l12", "local_rows")))
def _(spark, d):
    return report(scores.scheme_qa(_six(spark, d)))


@query("h4_top_zones", o.statement((*o.STATION_CHAIN[:2], o.ZONES), f"SELECT tz, {o.i('count(*)')} AS n FROM hourly JOIN zones USING (station) GROUP BY tz ORDER BY n DESC, tz LIMIT 20"))
def _(spark, d):
    zoned = a.hourly(spark, d).join(a.zones(spark), "station").groupBy(F.coalesce("tz", F.lit("UTC")).alias("tz")).agg(F.count("*").alias("n"))
    return report(zoned.orderBy(F.desc("n"), "tz").limit(20))


# Strata


def _strata(spark, d):
    joined = strata.with_features(a.order_months(spark, d), a.features(spark, d))
    return joined


def _stratum_sql(group: str) -> str:
    ok = "FILTER (WHERE n >= 24 AND rmse IS NOT NULL)"
    return f"""SELECT {group}, mode, coalesce({o.i(f'sum(n) {ok}')}, 0) AS "N_hours", {o.i(f'count(*) {ok}')} AS n_station_months, {o.i(f'count(DISTINCT station) {ok}')} AS n_stations, {o.r(f'sqrt(sum(n * rmse * rmse) {ok} / sum(n) {ok})')} AS rmse_pooled,
  {', '.join(f'{o.r(f"quantile_cont({c}, {q}) {ok}")} AS {c}_{k}' for c in ('rmse', 'r2') for k, q in (('median', 0.5), ('q25', 0.25), ('q75', 0.75)))} FROM strata GROUP BY {group}, mode"""


for _group in ("continent", "koppen", "coastal_group", "elevdiff_group", "latitude_band", "year", "season", "month"):

    @query(f"e31_by_{_group}", o.statement(o.STRATA_CHAIN, _stratum_sql(_group)))
    def _(spark, d, group=_group):
        return report(strata.stratum_scores(_strata(spark, d), group))


@query("f3_join_rate", o.statement(o.STRATA_CHAIN, f"SELECT {o.i('count(*)')} AS rows, {o.i('count(*) FILTER (WHERE known)')} AS joined_rows, {o.r('count(*) FILTER (WHERE known) / count(*)')} AS rate FROM strata"))
def _(spark, d):
    return report(strata.join_rate(_strata(spark, d)))


_WIDE_MONTHS = ("n", "rmse", "r2")
_STRATUM = ("rmse_pooled", *(f"{c}_{k}" for c in ("rmse", "r2") for k in ("median", "q25", "q75")))


@query("e31_strict_by_continent", o.statement((*o.STRICT_CHAIN, o.CODES, f"""sm AS (SELECT station, year(time) AS year, month, mode, {o.columns(o.score('obs', 'r', 'use'))} FROM long WHERE scope = 'heldout' GROUP BY station, year(time), month, mode),
strata AS (SELECT sm.*, r_name AS continent FROM sm LEFT JOIN codes USING (station) LEFT JOIN region ON code % 5 = r_regionkey)"""), f"""SELECT continent, mode, "N_hours", n_station_months, n_stations, {', '.join(f'round({c}, 3) + 0.0 AS {c}' for c in _STRATUM)} FROM ({_stratum_sql("continent")})"""))
def _(spark, d):
    """Strict station-months written as a table of metrics in gzip, read back, joined behind the gate and taken by mode."""
    path = new_folder(spark, "months")
    sinks.write_csv(scores.station_months(a.reconstructed(spark, d)), path, gzip=True)
    columns = {"station": "string", "year": "int", "month": "int"} | {f"{c}_heldout_{m}": "long" if c == "n" else "double" for m in modes.STRICT_MODES for c in _WIDE_MONTHS}
    joined = strata.gated(strata.with_features(tables.metrics(spark, path, columns), a.station_features(spark, d)))
    return report(strata.stratum_scores(strata.mode_months(joined), "continent"), **{c: tidy(F.col(c), 3) for c in _STRATUM})


_SUPPLIED = (
    "months AS (SELECT CAST(o_custkey AS VARCHAR) AS station, year(o_orderdate) AS year, month(o_orderdate) AS month, 'mode_' || o_orderstatus AS mode, count(*) * 20 AS n, max(o_totalprice) / 9973 AS rmse, avg(o_totalprice) / 499979 AS r2 FROM orders GROUP BY ALL)",
    "strata AS (SELECT m.*, r_name AS continent, s_suppkey IS NOT NULL AS known FROM months m LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = m.station LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)",
)


@query("f3_missing_features", o.statement(_SUPPLIED, f"SELECT {o.i('count(*)')} AS rows, {o.i('count(*) FILTER (WHERE known)')} AS joined_rows, {o.r('count(*) FILTER (WHERE known) / count(*)')} AS rate FROM strata"))
def _(spark, d):
    return report(strata.join_rate(strata.with_features(a.customer_months(spark, d), a.supplier_features(spark, d))))


@query("e31_missing_features", o.statement(_SUPPLIED, _stratum_sql("continent")))
def _(spark, d):
    return report(strata.stratum_scores(strata.with_features(a.customer_months(spark, d), a.supplier_features(spark, d)), "continent"))


@query("m5_ordered_strata", o.statement(o.STRATA_CHAIN, f"SELECT latitude_band, {o.i("list_position(['60-90S', '30-60S', '0-30S', '0-30N', '30-60N', '60-90N'], latitude_band)")} AS place, {o.i('count(*)')} AS n FROM strata WHERE latitude_band IS NOT NULL GROUP BY latitude_band"))
def _(spark, d):
    found = _strata(spark, d).where("latitude_band is not null").groupBy("latitude_band").agg(F.count("*").alias("n"))
    return report(found.select("latitude_band", strata.order_of(F.col("latitude_band"), strata.LATITUDE).alias("place"), "n"))


# Inventory and maps


def _files(spark, d):
    return inventory.file_stats(qc.scheme_readings(a.reports(spark, d)), ["file_year", "file_station"])


_COUNTS = ("n_rows", *(f"n_{c}" for c in inventory.CLASSES), "n_bad_time", "n_valid_records", "n_valid_hours")


@query("e26_file_stats", o.statement(o.REPORT_CHAIN, f"SELECT {o.i('file_year')} AS file_year, file_station, {', '.join(f'{o.i(c)} AS {c}' for c in _COUNTS)}, {o.i('n_valid_records - n_valid_hours')} AS n_repeats, strftime(first_time, '%Y-%m-%d %H:%M:%S') AS first_time, strftime(last_time, '%Y-%m-%d %H:%M:%S') AS last_time, {o.i('n_station_ids')} AS n_station_ids, station_id, latitude, longitude, elevation FROM files"))
def _(spark, d):
    return report(_files(spark, d))


@query("e27_year_funnel", o.statement(o.REPORT_CHAIN, f"""SELECT {o.i('file_year')} AS file_year, {o.i('count(*)')} AS n_files, CAST(0 AS BIGINT) AS n_read_errors, {o.i('count(DISTINCT station_id)')} AS n_unique_stations, {o.i('count(*) FILTER (WHERE n_station_ids > 1)')} AS n_files_multiple_ids, {', '.join(f'{o.i(f"sum({c})")} AS {c}' for c in _COUNTS)}, {o.i('sum(n_valid_records - n_valid_hours)')} AS n_repeats,
  {o.i('count(DISTINCT station_id) FILTER (WHERE n_valid_hours >= 1)')} AS n_stations_retained, {', '.join(f'{o.r(f"100.0 * sum(n_{c}) / sum(n_rows)")} AS pct_{c}' for c in ('missing', 'qc_reject', 'phys_reject', 'valid'))} FROM files GROUP BY file_year"""))
def _(spark, d):
    return report(inventory.year_funnel(_files(spark, d)))


def _read_files(spark, d):
    rows = tables.scan_reports(spark, a.report_files(spark, d), layout=tables.FOLDERS)
    return inventory.file_stats(qc.scheme_readings(rows), ["file_year", "file_station"])


@query("e26_report_files", o.statement(o.FILE_CHAIN, f"SELECT {o.i('file_year')} AS file_year, file_station, error, ok, {', '.join(f'coalesce({o.i(c)}, 0) AS {c}' for c in (*_COUNTS, 'n_station_ids'))}, coalesce({o.i('n_valid_records - n_valid_hours')}, 0) AS n_repeats, strftime(first_time, '%Y-%m-%d %H:%M:%S') AS first_time, strftime(last_time, '%Y-%m-%d %H:%M:%S') AS last_time, station_id, latitude, longitude, elevation FROM every"))
def _(spark, d):
    return report(_read_files(spark, d))


@query("e27_report_files_funnel", o.statement(o.FILE_CHAIN, f"""SELECT {o.i('file_year')} AS file_year, {o.i('count(*)')} AS n_files, {o.i('count(error)')} AS n_read_errors, {o.i('count(DISTINCT station_id)')} AS n_unique_stations, {o.i('count(*) FILTER (WHERE n_station_ids > 1)')} AS n_files_multiple_ids, {', '.join(f'coalesce({o.i(f"sum({c})")}, 0) AS {c}' for c in _COUNTS)}, coalesce({o.i('sum(n_valid_records - n_valid_hours)')}, 0) AS n_repeats,
  {o.i('count(DISTINCT station_id) FILTER (WHERE n_valid_hours >= 1)')} AS n_stations_retained, {', '.join(f'{o.r(f"100.0 * sum(n_{c}) / sum(n_rows)")} AS pct_{c}' for c in ('missing', 'qc_reject', 'phys_reject', 'valid'))} FROM every GROUP BY file_year"""))
def _(spark, d):
    return report(inventory.year_funnel(_read_files(spark, d)))


@query("a6_strict_hours_of_files", o.statement((*o.REPORT_CHAIN[:2], o.READ), f"""SELECT file_station, {o.i('file_year')} AS file_year, strftime(hour, '%Y-%m-%d %H:%M:%S') AS time, {o.r('avg(v)')} AS obs FROM (
  SELECT file_station, file_year, date_trunc('hour', CASE WHEN k = 2 THEN naive_time - INTERVAL 2 HOUR ELSE naive_time END) AS hour, CAST(num AS DOUBLE) / 10 AS v FROM accf WHERE m IN (9, 11, 12, 13, 14, 15, 16) AND k >= 2) GROUP BY ALL"""))
def _(spark, d):
    rows = tables.reports(spark, a.report_files(spark, d), ("STATION", "DATE", "TMP"), tables.FOLDERS)
    return report(qc.hourly_mean(qc.strict_readings(rows).where("accepted"), ["file_station", "file_year"]))


@query("e28_station_years", o.statement(o.REPORT_CHAIN, f"SELECT station_id, {o.i('file_year')} AS file_year, {o.i('sum(n_valid_hours)')} AS valid_hours, {o.i('sum(n_valid_records)')} AS valid_records FROM files GROUP BY station_id, file_year"))
def _(spark, d):
    return report(inventory.station_years(_files(spark, d)))


@query("e29_distribution", o.statement(o.REPORT_CHAIN, f"""SELECT {o.i('count(*)')} AS n, {o.r('avg(h)')} AS mean, {o.r('stddev_samp(h)')} AS std, {o.i('min(h)')} AS min, {', '.join(f'{o.r(f"quantile_cont(h, {q})")} AS {k}' for k, q in (('p5', 0.05), ('p25', 0.25), ('median', 0.5), ('p75', 0.75), ('p95', 0.95)))}, {o.i('max(h)')} AS max, {o.r('avg(CAST(h >= 24 AS INT))')} AS share_ge24 FROM (SELECT CAST(n_valid_hours AS BIGINT) AS h FROM files)"""))
def _(spark, d):
    return report(inventory.hours_distribution(_files(spark, d), "n_valid_hours"))


@query("e30_station_meta", o.statement(o.REPORT_CHAIN, f"""SELECT station_id, {', '.join(f'arg_min({c}, (file_year, file_station)) FILTER (WHERE {c} IS NOT NULL) AS {n}' for c, n in (('latitude', 'lat'), ('longitude', 'lon'), ('elevation', 'elevation_m')))}, {o.i('count(DISTINCT file_year)')} AS n_years_present, {o.i('min(file_year)')} AS first_year, {o.i('max(file_year)')} AS last_year,
  {o.i('sum(n_valid_hours)')} AS total_valid_hours, {o.i('sum(n_valid_records)')} AS total_valid_records, {o.i('count(DISTINCT file_year) FILTER (WHERE n_valid_hours > 0)')} AS n_years_with_valid_data, strftime(min(first_time), '%Y-%m-%d %H:%M:%S') AS first_valid_time, strftime(max(last_time), '%Y-%m-%d %H:%M:%S') AS last_valid_time FROM files GROUP BY station_id"""))
def _(spark, d):
    return report(inventory.station_metadata(_files(spark, d)))


_MEDIANS = "meds AS (SELECT mode, station, median(rmse) FILTER (WHERE n >= 40) AS med, count(*) FILTER (WHERE n >= 40) AS k, coalesce(sum(n) FILTER (WHERE n >= 40), 0) AS h FROM months GROUP BY ALL)"


@query("e32_station_median", o.statement((o.MONTHS, _MEDIANS), f"SELECT mode, station, {o.r('med')} AS station_median_rmse_c, {o.i('k')} AS eligible_station_months, {o.i('h')} AS heldout_hours FROM meds"))
def _(spark, d):
    return report(inventory.station_medians(a.order_months(spark, d), least=40))


@query("e34_map_stats", o.statement((o.MONTHS, _MEDIANS), f"SELECT mode, {o.i('count(med)')} AS n, {o.r('median(med)')} AS median, {o.r('quantile_cont(med, 0.99)')} AS p99, {o.r('max(med)')} AS max, {o.r('(SELECT ceil(quantile_cont(med, 0.99) * 2) / 2 FROM meds)')} AS vmax FROM meds WHERE med IS NOT NULL GROUP BY mode"))
def _(spark, d):
    return report(inventory.map_stats(inventory.station_medians(a.order_months(spark, d), least=40)))


@query("e33_f8_map_table", o.statement((o.MONTHS, _MEDIANS, o.FEATURES), f"SELECT mode, station, {o.r('med')} AS station_median_rmse_c, {o.r('lat')} AS lat, {o.r('lon')} AS lon FROM meds LEFT JOIN (SELECT station, median(lat) AS lat, median(lon) AS lon FROM features GROUP BY station) USING (station)"))
def _(spark, d):
    medians = inventory.station_medians(a.order_months(spark, d), least=40)
    return report(medians.join(inventory.median_coordinates(a.features(spark, d)), "station", "left").select("mode", "station", "station_median_rmse_c", "lat", "lon"))


# Gridded validation


@query("e35_daily_extremes", o.statement((o.GRID,), f"SELECT lat, lon, strftime(CAST(time AS DATE), '%Y-%m-%d') AS day, {o.r('avg(t)')} AS t_mean, {o.r('min(t)')} AS t_min, {o.r('max(t)')} AS t_max FROM grid GROUP BY lat, lon, CAST(time AS DATE)"))
def _(spark, d):
    return report(grid.daily_extremes(a.grid_series(spark, d), CELL))


@query("e6_cell_metrics", o.statement((*o.GRID_FITTED, o.GSHAPES, """gday AS (SELECT lat, lon, time, t, year(time) AS year, month(time) AS month, hour(time) AS hour, avg(t) OVER d AS m, max(t) OVER d - min(t) OVER d AS span_o FROM grid WINDOW d AS (PARTITION BY lat, lon, CAST(time AS DATE))),
gpair AS (SELECT g.lat, g.lon, g.year, g.month, t, m + s AS b, m + span_o / CASE WHEN span > 1e-4 THEN span ELSE 1 END * s AS c FROM gday g JOIN gshapes x ON g.lat = x.lat AND g.lon = x.lon AND g.month = x.month AND g.hour = x.hour JOIN grange y ON g.lat = y.lat AND g.lon = y.lon AND g.month = y.month)"""),
    f"SELECT lat, lon, {o.i('year')} AS year, {o.i('month')} AS month, {o.score('t', 'b')['n']} AS n, {', '.join(f'{v} AS {k}_{n}' for x, n in (('b', 'base'), ('c', 'scaled')) for k, v in o.score('t', x, least=1, above=1e-6, bounds='unit').items() if k != 'n')} FROM gpair GROUP BY lat, lon, year, month"))
def _(spark, d):
    shapes = fit.templates(_grid_params(spark, d), CELL)
    return report(grid.cell_metrics(a.grid_series(spark, d), shapes, CELL))


@query("d12_point_curve", o.statement((*o.GRID_FITTED, "gm AS (SELECT DISTINCT lat, lon, month, t_mean FROM gfit)", "pt AS (SELECT * FROM gparams JOIN gm USING (lat, lon, month) WHERE month = 3 ORDER BY abs(lat - 19.0), lat, abs(lon - 2.2), lon LIMIT 1)"), f"SELECT {o.i('h')} AS hour, {o.r('t_mean + CAST(a1 AS DOUBLE) * sin(2 * pi() * h / 24 - CAST(phi1 AS DOUBLE)) + CAST(a2 AS DOUBLE) * sin(2 * (2 * pi() * h / 24) - CAST(phi2 AS DOUBLE))')} AS t FROM pt, range(24) r(h)"))
def _(spark, d):
    return grid.point_curve(_grid_archive(spark, d), 19.0, 2.2, 3).select(F.col("hour").cast("long"), tidy(F.col("t")).alias("t"))


@query("x29_haversine", o.statement((o.FEATURES,), f"SELECT x.station, {o.r('2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2))))')} AS km FROM features x JOIN features y ON CAST(x.station AS INT) + 1 = CAST(y.station AS INT)"))
def _(spark, d):
    here = a.features(spark, d).select("station", "lat", "lon")
    there = here.select((F.col("station").cast("int") - 1).cast("string").alias("station"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return report(here.join(there, "station").select("station", grid.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("km")))


@query("f6_as_of_daily", o.statement((*o.STATION_CHAIN[:2], "dm AS (SELECT station, date_trunc('day', time) AS time, avg(obs) AS value FROM hourly GROUP BY ALL)"), f"SELECT h.station, strftime(h.time, '%Y-%m-%d %H:%M:%S') AS time, {o.r('value')} AS value FROM hourly h ASOF LEFT JOIN dm ON h.station = dm.station AND h.time >= dm.time"))
def _(spark, d):
    hours = a.hourly(spark, d)
    daily = hours.groupBy("station", F.date_trunc("day", "time").cast("timestamp_ntz").alias("time")).agg(F.avg("obs").alias("value"))
    return report(grid.as_of(hours.select("station", "time"), daily, ["station"]))


@query("f6_as_of_gaps", f"""WITH asked AS (SELECT event_id, user_id, ts AS time FROM events WHERE event_type <> 'purchase'),
dm AS (SELECT user_id, date_trunc('day', ts) AS time, avg(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT event_id, {o.r('value')} AS value FROM asked ASOF LEFT JOIN dm ON asked.user_id = dm.user_id AND asked.time >= dm.time""")
def _(spark, d):
    """The user's last day of purchases for each of their other events; many have none yet."""
    events = a.table(spark, d, "events").withColumnRenamed("ts", "time")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", F.date_trunc("day", "time").cast("timestamp_ntz").alias("time")).agg(F.avg("value").alias("value"))
    return report(grid.as_of(events.where("event_type <> 'purchase'").select("event_id", "user_id", "time"), bought, ["user_id"], block_days=7).select("event_id", "value"))


@query("f1_cells_without_template", o.statement((*o.GRID_FITTED, o.GSHAPES, o.EV, "ch AS (SELECT CAST(ascii(station) % 7 * 10 AS DOUBLE) AS lat, CAST(user_id % 10 AS DOUBLE) AS lon, year(time) AS file_year, date_trunc('hour', time) AS time FROM ev GROUP BY ALL)"),
    f"SELECT ch.lat, ch.lon, {o.i('count(*)')} AS n, {o.i('count(k.lat)')} AS with_template, {o.i('count(s)')} AS with_shape FROM ch LEFT JOIN (SELECT DISTINCT lat, lon FROM gshapes) k ON ch.lat = k.lat AND ch.lon = k.lon LEFT JOIN gshapes x ON ch.lat = x.lat AND ch.lon = x.lon AND x.month = month(time) AND x.hour = hour(time) GROUP BY ch.lat, ch.lon"))
def _(spark, d):
    """Cells that the grid lacks lose their hours; hours of months without a fit stay without shape."""
    hours = a.cell_hours(spark, d)
    shapes = fit.templates(_grid_params(spark, d), CELL).withColumns({c: F.col(c).cast("double") for c in CELL})
    joined = modes.with_templates(hours, shapes, CELL).groupBy(*CELL).agg(F.count("*").alias("with_template"), F.count("s").alias("with_shape"))
    return report(hours.groupBy(*CELL).agg(F.count("*").alias("n")).join(joined, CELL, "left").na.fill(0, ["with_template", "with_shape"]))


_TARGETS = """targets AS (SELECT DISTINCT CAST(ascii(event_type) % 7 * 10 AS DOUBLE) + 5 AS lat, CAST(user_id % 8 AS DOUBLE) + 0.5 AS lon FROM events),
placed AS (SELECT lat, lon, (SELECT arg_min(x, (abs(x - lat), -x)) FROM (SELECT DISTINCT lat AS x FROM gparams) g(x)) AS nearest_lat, (SELECT arg_min(x, (abs(x - lon), -x)) FROM (SELECT DISTINCT lon AS x FROM gparams) g(x)) AS nearest_lon FROM targets)"""


@query("c23_reindexed_shapes", o.statement((*o.GRID_FITTED, o.GSHAPES, _TARGETS), f"SELECT p.lat, p.lon, nearest_lat, nearest_lon, {o.i('month')} AS month, round(s, 4) + 0.0 AS s FROM placed p JOIN gshapes g ON g.lat = nearest_lat AND g.lon = nearest_lon WHERE hour = 15"))
def _(spark, d):
    """Targets half way between the grid's lines, where the larger line is taken; what they get at 15 h."""
    targets = a.table(spark, d, "events").select((F.ascii("event_type") % 7 * 10 + 5).cast("double").alias("lat"), (F.col("user_id") % 8 + 0.5).cast("double").alias("lon"))
    found = grid.reindexed(fit.templates(_grid_params(spark, d), CELL), targets)
    return found.select("lat", "lon", "nearest_lat", "nearest_lon", F.col("month").cast("long"), tidy(F.get("s", F.lit(15)).cast("double"), 4).alias("s"))


@query("s2_mask_checkpoint", o.statement((o.GRID, o.GMASK), "SELECT lat, lon, is_valid FROM gmask"))
def _(spark, d):
    path = new_folder(spark, "mask")
    for _ in range(2):  # the second time it is there
        mask = sinks.checkpointed(climatology.valid_cells(_grid_clim(spark, d), CELL).select(*CELL, "is_valid"), path)
    return report(mask)


_DAILY = f"""dmode AS (SELECT station, obs, avg(obs) OVER d + s AS r1, avg(obs) OVER d + CASE WHEN span > 1e-4 THEN (max(obs) OVER d - min(obs) OVER d) / span ELSE 1 END * s AS r2
  FROM shaped JOIN (SELECT station, month, CAST(CAST(max(s) AS FLOAT) - CAST(min(s) AS FLOAT) AS DOUBLE) AS span FROM shapes GROUP BY ALL) USING (station, month) WINDOW d AS (PARTITION BY station, file_year, day)),
dlong AS (SELECT station, m.mode, obs, m.r FROM dmode, LATERAL (VALUES ('baseline', r1), ('scaled', r2)) m(mode, r))"""


@query("x29_baseline_scaled_scores", o.statement((*o.STATION_CHAIN, _DAILY), f"SELECT station, mode, {o.columns(o.score('obs', 'r'))} FROM dlong GROUP BY station, mode"))
def _(spark, d):
    items = F.array(*(F.struct(F.lit(m).alias("mode"), F.col(m).alias("rec")) for m in ("baseline", "scaled")))
    long = modes.daily_modes(a.shaped(spark, d)).select("station", "obs", F.explode(items).alias("x")).select("station", "obs", "x.*")
    return report(scores.pooled(long, ["station", "mode"], mask=F.lit(True)))


@query("f1_template_join", o.statement(o.STATION_CHAIN[:7], f"SELECT h.station, {o.i('count(*)')} AS n, {o.i('count(s.s)')} AS with_shape FROM hourly h LEFT JOIN shapes s ON s.station = h.station AND s.month = month(h.time) AND s.hour = hour(h.time) GROUP BY h.station"))
def _(spark, d):
    hours, _, params = a.station_fit(spark, d)
    return report(modes.with_templates(hours, fit.templates(params, ["station"]), ["station"]).groupBy("station").agg(F.count("*").alias("n"), F.count("s").alias("with_shape")))


# Checks and resumption


@query("b20_resume", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    orders = a.table(spark, d, "orders")
    return checks.todo(orders.select("o_custkey").distinct(), orders.where("o_orderstatus = 'P'"), ["o_custkey"])


@query("s3_f11_resumed_units", f"SELECT o_custkey, {o.i('year(o_orderdate)')} AS year, {o.i('count(*)')} AS n, {o.r('sum(o_totalprice)')} AS total FROM orders GROUP BY ALL")
def _(spark, d):
    """Years of customers as units: a first run over those with an order under way, one over all that takes up what is left, and a third that finds nothing to do."""
    orders = a.table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    path, keys = new_folder(spark, "units"), ["o_custkey", "year"]
    work = lambda left: orders.join(left.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    for known in (orders.where("o_orderstatus = 'P'"), orders, orders):
        units.run_units(spark, known.select(*keys).distinct(), work, path, keys)
    return report(units.read_units(spark, path, keys))


@query("s3_a13_json_parts", o.statement(o.STRICT_CHAIN, f"SELECT station, mode, {o.columns(o.score('obs', 'r', 'use'))} FROM long WHERE scope = 'heldout' GROUP BY station, mode"))
def _(spark, d):
    """Accumulators as nested JSON, a part for each station, read back by their algorithm and merged."""
    long = scores.mode_long(a.reconstructed(spark, d)).where("scope = 'heldout'")
    sums = long.groupBy("station", "mode").agg(*(v.alias(k) for k, v in scoring.statistics(F.col("obs"), F.col("rec"), F.col("use")).items()))
    path, values = new_folder(spark, "parts"), ["n", "sum_o", "sum_o2", "sse"]
    sinks.write_json(sinks.nested_parts(sums, ["station"], "mode", values), path)
    parts = tables.parts(spark, path, "station string, algorithm string, acc map<string, struct<n: long, sum_o: double, sum_o2: double, sse: double>>", ["station"])
    merged = sinks.flat_parts(parts, ["station"], "mode").groupBy("station", "mode").agg(*(v.alias(k) for k, v in scoring.merged().items()))
    return report(merged.select("station", "mode", "n", *(v.alias(k) for k, v in scoring.scores(scoring.STRICT).items())))


@query("s5_s6_fixed_digits", o.statement((o.MONTHS,), f"SELECT station, {o.i('year')} AS year, {o.i('month')} AS month, mode, {o.i('n')} AS n, round(rmse, 3) + 0.0 AS rmse FROM months"))
def _(spark, d):
    """A report in gzip with three digits, read back."""
    path = new_folder(spark, "report")
    sinks.write_csv(a.order_months(spark, d).select("station", "year", "month", "mode", "n", "rmse"), path, gzip=True, digits=3)
    return report(tables.metrics(spark, path, {"station": "string", "year": "int", "month": "int", "mode": "string", "n": "long", "rmse": "double"}))


@query("a9_station_dimension", o.statement((o.FEATURES,), f"SELECT station, {o.r('lat')} AS lat, {o.r('lon')} AS lon FROM features WHERE coastal_30km IS NOT NULL"))
def _(spark, d):
    """Stations as CSV, those of some nations without latitude, which go."""
    path = new_folder(spark, "stations")
    sinks.write_csv(a.features(spark, d).select("station", F.when(F.col("coastal_30km").isNotNull(), F.col("lat")).alias("lat"), "lon"), path)
    return report(tables.stations(spark, path))


@query("a17_file_counts", o.statement(o.REPORT_CHAIN[:1], f"SELECT {o.i('file_year')} AS file_year, {o.i('count(DISTINCT file_station)')} AS n_files FROM rep GROUP BY file_year"))
def _(spark, d):
    files = tables.report_files(spark, a.report_files(spark, d), tables.FOLDERS).where("length > 0")
    return report(files.groupBy("file_year").agg(F.count("*").alias("n_files")))


@query("b19_trial_units", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY o_custkey LIMIT 25")
def _(spark, d):
    """The first units of a trial run: the limit is what is asked for."""
    orders = a.table(spark, d, "orders")
    return checks.todo(orders.select("o_custkey").distinct(), orders.where("o_orderstatus = 'P'"), ["o_custkey"], limit=25)


@query("i3_left_over", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(spark, d):
    return a.table(spark, d, "customer").select("c_custkey").exceptAll(a.table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")).distinct())


@query("s11_run_log", o.statement(o.STRICT_CHAIN, f"""SELECT stage, name, CAST(value AS VARCHAR) AS value FROM (
  SELECT 'readings' AS stage, 'rows' AS name, count(*) AS value FROM ev UNION ALL SELECT 'hours', 'rows', count(*) FROM hourly UNION ALL SELECT 'hours', 'stations', count(DISTINCT station) FROM hourly
  UNION ALL SELECT 'reconstructed', 'rows', count(*) FROM wide UNION ALL SELECT 'reconstructed', 'heldout', count(*) FILTER (WHERE k3) FROM wide UNION ALL SELECT 'months', 'rows', count(*) FROM (SELECT DISTINCT station, year(time), month FROM wide))"""))
def _(spark, d):
    """The flagship run to a folder, its counts taken while it runs."""
    log = runlog.RunLog(spark, delta=0.5)
    hours = log.watch(qc.hourly_mean(log.watch(a.observations(spark, d), "readings"), ["station", "file_year"]), "hours", stations=F.size(F.collect_set("station")))
    params = fit.parameters(fit.ridge_fit(climatology.detrended(climatology.climatology(hours, ["station"]), ["station"]), ["station"]), ["station"])
    rec = modes.strict_modes(modes.with_templates(hours, fit.templates(params, ["station"]), ["station"]))
    rec = log.watch(rec, "reconstructed", heldout=F.count_if("held_2pt_fixed_00_12_clip"))
    log.watch(scores.station_months(rec), "months").write.parquet(new_folder(spark, "months"))
    return log.table().where("kind = 'count'").select("stage", "name", "value")


@query("s9_a10_cached_templates", o.statement(o.STATION_CHAIN[:7], f"SELECT h.station, {o.i('month(h.time)')} AS month, {o.i('count(*)')} AS n, {o.i('count(s.s)')} AS with_shape, round(sum(s.s), 3) + 0.0 AS total FROM hourly h LEFT JOIN shapes s ON s.station = h.station AND s.month = month(h.time) AND s.hour = hour(h.time) GROUP BY h.station, month(h.time)"))
def _(spark, d):
    hours, _, params = a.station_fit(spark, d)
    path = new_folder(spark, "templates")
    cache.write_templates(fit.templates(params, ["station"]), path, ["station"], 8)
    joined = modes.with_templates(hours, cache.read_templates(spark, path, ["station"], 8), ["station"])
    return report(joined.groupBy("station", "month").agg(F.count("*").alias("n"), F.count("s").alias("with_shape"), F.sum("s").alias("total")), total=tidy(F.col("total"), 3))


@query("f12_existing", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    return checks.existing(a.table(spark, d, "customer").select("c_custkey"), a.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("i4_duplicate_keys", "SELECT l_orderkey, count(*) AS copies FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def _(spark, d):
    return checks.duplicates(a.table(spark, d, "lineitem"), ["l_orderkey"])


@query("e36_status_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _(spark, d):
    return checks.status_counts(a.table(spark, d, "orders"), "o_orderstatus")


@query("i2_distinct_coordinates", o.statement((o.FEATURES,), "SELECT DISTINCT CAST(round_even(lat * 100, 0) AS BIGINT) AS lat_c, CAST(round_even(lon * 100, 0) AS BIGINT) AS lon_c FROM features"))
def _(spark, d):
    return report(a.features(spark, d).select(grid.coordinate_key(F.col("lat")).alias("lat_c"), grid.coordinate_key(F.col("lon")).alias("lon_c")).distinct())
