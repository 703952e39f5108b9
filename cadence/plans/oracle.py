"""DuckDB fragments from which the checking statements are put together; they restate the rules on their own, in windows and plain joins."""

from __future__ import annotations

EV = """ev AS (SELECT event_id, user_id, event_type AS station, ts + to_days(CAST(user_id % 6 * 30 AS INTEGER)) AS time,
  value / 9.7::DOUBLE + 6 * sin(2 * pi() * hour(ts) / 24 - CASE event_type WHEN 'error' THEN pi() / 4 WHEN 'purchase' THEN pi() / 2 WHEN 'signup' THEN -pi() / 3 WHEN 'view' THEN -pi() / 2 ELSE 0 END) AS v FROM events)"""
HOURLY = "hourly AS (SELECT station, year(time) AS file_year, date_trunc('hour', time) AS time, avg(v) AS obs FROM ev GROUP BY ALL)"
CLIM = "clim AS (SELECT station, month(time) AS month, hour(time) AS hour, avg(obs) AS t FROM hourly GROUP BY ALL)"
DET = "det AS (SELECT *, avg(t) OVER m AS t_mean, t - avg(t) OVER m AS y, 2 * pi() * hour / 24 AS w FROM clim WINDOW m AS (PARTITION BY station, month))"
#: With all 24 hours the normal equations are diagonal.
COEF = "coef AS (SELECT station, month, count(y) AS n_hours, sum(y * sin(w)) / (12 + 1e-8) AS c1, sum(-y * cos(w)) / (12 + 1e-8) AS c2, sum(y * sin(2 * w)) / (12 + 1e-8) AS c3, sum(-y * cos(2 * w)) / (12 + 1e-8) AS c4 FROM det GROUP BY ALL)"
PARAMS = "params AS (SELECT station, month, CAST(sqrt(c1 * c1 + c2 * c2) AS FLOAT) AS a1, CAST(atan2(c2, c1) AS FLOAT) AS phi1, CAST(sqrt(c3 * c3 + c4 * c4) AS FLOAT) AS a2, CAST(atan2(c4, c3) AS FLOAT) AS phi2 FROM coef)"
SHAPES = """shapes AS (SELECT station, month, h AS hour, CAST(CAST(CAST(a1 AS DOUBLE) * sin(2 * pi() * h / 24 - CAST(phi1 AS DOUBLE)) + CAST(a2 AS DOUBLE) * sin(2 * (2 * pi() * h / 24) - CAST(phi2 AS DOUBLE)) AS FLOAT) AS DOUBLE) AS s
  FROM params, range(24) r(h))"""
SHAPED = """shaped AS (SELECT h.station, h.file_year, h.time, CAST(h.time AS DATE) AS day, hour(h.time) AS hour, month(h.time) AS month, h.obs, s.s, a.s AS s1, b.s AS s2
  FROM hourly h LEFT JOIN shapes s ON s.station = h.station AND s.month = month(h.time) AND s.hour = hour(h.time)
  LEFT JOIN shapes a ON a.station = h.station AND a.month = month(h.time) AND a.hour = 0 LEFT JOIN shapes b ON b.station = h.station AND b.month = month(h.time) AND b.hour = 12)"""
ANCHORS = """anch0 AS (SELECT *, max(obs) FILTER (WHERE hour = 0) OVER d AS t1, max(obs) FILTER (WHERE hour = 12) OVER d AS t2, min(s) OVER d AS s_lo, max(s) OVER d AS s_hi FROM shaped WINDOW d AS (PARTITION BY station, file_year, day)),
anch1 AS (SELECT *, min(hour) FILTER (WHERE s = s_lo) OVER d AS h_lo, min(hour) FILTER (WHERE s = s_hi) OVER d AS h_hi FROM anch0 WINDOW d AS (PARTITION BY station, file_year, day)),
anch AS (SELECT *, max(obs) FILTER (WHERE hour = h_lo) OVER d AS t_lo, max(obs) FILTER (WHERE hour = h_hi) OVER d AS t_hi FROM anch1 WINDOW d AS (PARTITION BY station, file_year, day))"""


def two_anchor(t1: str, t2: str, s1: str, s2: str, s: str = "s", delta: object = 0.5, clipped: bool = True, mean: bool = False) -> str:
    slope = f"(({t2}) - ({t1})) / (({s2}) - ({s1}))"
    slope = f"greatest(0.1, least(5.0, {slope}))" if clipped else slope
    average = lambda b: f"((({t1}) - ({b}) * ({s1})) + (({t2}) - ({b}) * ({s2}))) / 2"
    alpha = average(slope) if mean else f"({t2}) - ({slope}) * ({s2})"
    known = " AND ".join(f"({x}) IS NOT NULL" for x in (t1, t2, s1, s2, s))
    return f"CASE WHEN NOT ({known}) THEN NULL WHEN abs(({s2}) - ({s1})) > {delta} THEN ({alpha}) + ({slope}) * ({s}) ELSE ({average('1.0')}) + ({s}) END"


REC = f"""rec AS (SELECT *, s + (t2 - s2) AS r1, {two_anchor('t1', 't2', 's1', 's2', clipped=False)} AS r2, {two_anchor('t1', 't2', 's1', 's2')} AS r3,
  CASE WHEN h_lo <> h_hi THEN {two_anchor('t_lo', 't_hi', 's_lo', 's_hi')} END AS r4 FROM anch)"""
LONG = """base AS (SELECT *, r1 IS NOT NULL AND hour <> 12 AS k1, r2 IS NOT NULL AND hour NOT IN (0, 12) AS k2, r3 IS NOT NULL AND hour NOT IN (0, 12) AS k3, r4 IS NOT NULL AND hour <> h_lo AND hour <> h_hi AS k4 FROM rec),
wide AS (SELECT *, k1 AND k2 AND k3 AND k4 AS kc, r1 IS NOT NULL AND r2 IS NOT NULL AND r3 IS NOT NULL AND r4 IS NOT NULL AS ac FROM base),
long AS (SELECT station, file_year, time, day, month, obs, m.mode, m.r, m.scope, m.use, m.common FROM wide, LATERAL (VALUES
  ('1pt_fixed12', r1, 'all', r1 IS NOT NULL, ac), ('1pt_fixed12', r1, 'heldout', k1, kc), ('2pt_fixed_00_12_literal', r2, 'all', r2 IS NOT NULL, ac), ('2pt_fixed_00_12_literal', r2, 'heldout', k2, kc),
  ('2pt_fixed_00_12_clip', r3, 'all', r3 IS NOT NULL, ac), ('2pt_fixed_00_12_clip', r3, 'heldout', k3, kc), ('2pt_dynamic_strict', r4, 'all', r4 IS NOT NULL, ac), ('2pt_dynamic_strict', r4, 'heldout', k4, kc)) m(mode, r, scope, use, common))"""
STATION_CHAIN = (EV, HOURLY, CLIM, DET, COEF, PARAMS, SHAPES, SHAPED)
STRICT_CHAIN = (*STATION_CHAIN, ANCHORS, REC, LONG)

ZONES = "zones AS (SELECT * FROM (VALUES ('click', 'UTC'), ('error', 'America/New_York'), ('purchase', 'Asia/Kolkata'), ('signup', 'Asia/Kathmandu'), ('view', 'Australia/Sydney')) z(station, tz))"
CIVIL = """civ0 AS (SELECT h.*, timezone(z.tz, timezone('UTC', h.time)) AS local FROM shaped h JOIN zones z USING (station)),
civ1 AS (SELECT *, CAST(local AS DATE) AS local_day, hour(local) + minute(local) / 60.0 AS local_hour FROM civ0),
civ2 AS (SELECT *, count(*) OVER u AS utc_rows, count(*) OVER l AS local_rows, CAST(least(hour, 24 - hour) AS DOUBLE) AS du0, CAST(least(abs(hour - 12), 24 - abs(hour - 12)) AS DOUBLE) AS du12, least(local_hour, 24 - local_hour) AS dl0, least(abs(local_hour - 12), 24 - abs(local_hour - 12)) AS dl12
  FROM civ1 WINDOW u AS (PARTITION BY station, file_year, day), l AS (PARTITION BY station, file_year, local_day)),
civ3 AS (SELECT *, row_number() OVER (PARTITION BY station, file_year, day ORDER BY du0, time) AS nu0, row_number() OVER (PARTITION BY station, file_year, day ORDER BY du12, time) AS nu12,
  row_number() OVER (PARTITION BY station, file_year, local_day ORDER BY dl0, time) AS nl0, row_number() OVER (PARTITION BY station, file_year, local_day ORDER BY dl12, time) AS nl12 FROM civ2),
civ4 AS (SELECT *, """ + ", ".join(f"max({c}) FILTER (WHERE n{a} = 1 AND d{a} <= 0.5 + 1e-9 AND {rows} >= 4) OVER {w} AS {c[0] if c != 'time' else 'x'}_{a}" for a, rows, w in (("u0", "utc_rows", "u"), ("u12", "utc_rows", "u"), ("l0", "local_rows", "l"), ("l12", "local_rows", "l")) for c in ("time", "obs", "s")) + """,
  max(du0) FILTER (WHERE nu0 = 1 AND du0 <= 0.5 + 1e-9 AND utc_rows >= 4) OVER u AS away_u0, max(dl0) FILTER (WHERE nl0 = 1 AND dl0 <= 0.5 + 1e-9 AND local_rows >= 4) OVER l AS away_l0,
  max(du12) FILTER (WHERE nu12 = 1 AND du12 <= 0.5 + 1e-9 AND utc_rows >= 4) OVER u AS away_u12, max(dl12) FILTER (WHERE nl12 = 1 AND dl12 <= 0.5 + 1e-9 AND local_rows >= 4) OVER l AS away_l12
  FROM civ3 WINDOW u AS (PARTITION BY station, file_year, day), l AS (PARTITION BY station, file_year, local_day)),
six AS (SELECT *, s + (o_u0 - s_u0) AS q1, s + (o_u12 - s_u12) AS q2, s + (o_l0 - s_l0) AS q3, s + (o_l12 - s_l12) AS q4,
  CASE WHEN x_u0 <> x_u12 THEN """ + two_anchor("o_u0", "o_u12", "s_u0", "s_u12", mean=True) + """ END AS q5, CASE WHEN x_l0 <> x_l12 THEN """ + two_anchor("o_l0", "o_l12", "s_l0", "s_l12", mean=True) + """ END AS q6,
  coalesce(time = x_u0, false) AS a1, coalesce(time = x_u12, false) AS a2, coalesce(time = x_l0, false) AS a3, coalesce(time = x_l12, false) AS a4 FROM civ4),
sixc AS (SELECT *, q1 IS NOT NULL AND q2 IS NOT NULL AND q3 IS NOT NULL AND q4 IS NOT NULL AND q5 IS NOT NULL AND q6 IS NOT NULL AND NOT (a1 OR a2 OR a3 OR a4) AS common FROM six),
slong AS (SELECT station, file_year, obs, common, m.mode, m.r, m.use, year(m.moment) AS year, month(m.moment) AS month FROM sixc, LATERAL (VALUES
  ('1pt_utc00', q1, q1 IS NOT NULL AND NOT a1, time), ('1pt_utc12', q2, q2 IS NOT NULL AND NOT a2, time), ('1pt_local00', q3, q3 IS NOT NULL AND NOT a3, local), ('1pt_local12', q4, q4 IS NOT NULL AND NOT a4, local),
  ('2pt_utc00_12', q5, q5 IS NOT NULL AND NOT (a1 OR a2), time), ('2pt_local00_12', q6, q6 IS NOT NULL AND NOT (a3 OR a4), local)) m(mode, r, use, moment))"""
CIVIL_CHAIN = (*STATION_CHAIN, ZONES, CIVIL)

GRID = """grid AS (SELECT CAST(ascii(event_type) % 7 * 10 AS DOUBLE) AS lat, CAST(user_id % 8 AS DOUBLE) AS lon, date_trunc('hour', ts + to_days(CAST(event_id % 12 * 31 AS INTEGER))) AS time,
  avg(value / 9.7::DOUBLE + 6 * sin(2 * pi() * hour(ts) / 24 - CASE event_type WHEN 'error' THEN pi() / 4 WHEN 'purchase' THEN pi() / 2 WHEN 'signup' THEN -pi() / 3 WHEN 'view' THEN -pi() / 2 ELSE 0 END)) AS t FROM events GROUP BY ALL),
gclim AS (SELECT lat, lon, month(time) AS month, hour(time) AS hour, avg(t) AS t FROM grid GROUP BY ALL),
gdet AS (SELECT *, avg(t) OVER m AS t_mean, t - avg(t) OVER m AS y, 2 * pi() * hour / 24 AS w FROM gclim WINDOW m AS (PARTITION BY lat, lon, month))"""
#: What is fitted: months that fail the check have no y, cells of which all fail no mean.
GSOLVE = """gfit AS (SELECT g.lat, g.lon, g.month, hour, t, w, CASE WHEN ok THEN y END AS y, CASE WHEN bool_or(ok) OVER (PARTITION BY g.lat, g.lon) THEN t_mean END AS t_mean FROM gdet g JOIN gcheck USING (lat, lon, month)),
gx AS (SELECT *, sin(w) AS x1, -cos(w) AS x2, sin(2 * w) AS x3, -cos(2 * w) AS x4 FROM gfit),
gsum AS (SELECT lat, lon, month, count(y) AS n_hours, """ + ", ".join(f"sum(x{i} * x{j}){' + 1e-8' if i == j else ''} AS a{i}{j}" for i in range(1, 5) for j in range(i, 5)) + ", " + ", ".join(f"sum(x{i} * y) AS b{i}" for i in range(1, 5)) + """ FROM gx GROUP BY ALL),
ge1 AS (SELECT *, a22 - a12 * a12 / a11 AS e22, a23 - a12 * a13 / a11 AS e23, a24 - a12 * a14 / a11 AS e24, a33 - a13 * a13 / a11 AS e33, a34 - a13 * a14 / a11 AS e34, a44 - a14 * a14 / a11 AS e44, b2 - a12 * b1 / a11 AS f2, b3 - a13 * b1 / a11 AS f3, b4 - a14 * b1 / a11 AS f4 FROM gsum),
ge2 AS (SELECT *, e33 - e23 * e23 / e22 AS g33, e34 - e23 * e24 / e22 AS g34, e44 - e24 * e24 / e22 AS g44, f3 - e23 * f2 / e22 AS k3, f4 - e24 * f2 / e22 AS k4 FROM ge1),
ge3 AS (SELECT *, (k4 - g34 * k3 / g33) / (g44 - g34 * g34 / g33) AS u4 FROM ge2), ge4 AS (SELECT *, (k3 - g34 * u4) / g33 AS u3 FROM ge3), ge5 AS (SELECT *, (f2 - e23 * u3 - e24 * u4) / e22 AS u2 FROM ge4),
gcoef AS (SELECT lat, lon, month, n_hours, CASE WHEN n_hours >= 12 THEN (b1 - a12 * u2 - a13 * u3 - a14 * u4) / a11 END AS c1, CASE WHEN n_hours >= 12 THEN u2 END AS c2, CASE WHEN n_hours >= 12 THEN u3 END AS c3, CASE WHEN n_hours >= 12 THEN u4 END AS c4 FROM ge5)"""
GPARAMS = "gparams AS (SELECT lat, lon, month, CAST(sqrt(c1 * c1 + c2 * c2) AS FLOAT) AS a1, CAST(atan2(c2, c1) AS FLOAT) AS phi1, CAST(sqrt(c3 * c3 + c4 * c4) AS FLOAT) AS a2, CAST(atan2(c4, c3) AS FLOAT) AS phi2 FROM gcoef)"
GMASK = "gmask AS (SELECT lat, lon, count(t) / 288.0 AS valid_fraction, count(t) / 288.0 > 0.5 AS is_valid FROM gclim GROUP BY ALL)"
GCHECK = """gcheck AS (SELECT lat, lon, month, n_hours, t_range, t_std, is_valid AND n_hours >= 12 AND t_range > 0.5 AND t_range < 40 AND t_std > 0.1 AS ok FROM (
  SELECT lat, lon, month, count(t) AS n_hours, max(t) - min(t) AS t_range, stddev_pop(t) AS t_std FROM gclim GROUP BY ALL) JOIN gmask USING (lat, lon))"""
GFIT = """gerr AS (SELECT d.lat, d.lon, d.month, d.t, d.y, d.y - (CAST(a1 AS DOUBLE) * sin(w - CAST(phi1 AS DOUBLE)) + CAST(a2 AS DOUBLE) * sin(2 * w - CAST(phi2 AS DOUBLE))) AS e FROM gfit d JOIN gparams USING (lat, lon, month)),
gmet AS (SELECT lat, lon, month, CAST(CASE WHEN sum(y * y) > 1e-6 AND sum(e * e) IS NOT NULL THEN greatest(0.0, least(1.0, 1 - sum(e * e) / sum(y * y))) END AS FLOAT) AS r_squared, CAST(sqrt(avg(e * e)) AS FLOAT) AS rmse, CASE WHEN max(y) - min(y) > 1e-6 THEN max(y) - min(y) END AS dtr_observed FROM gerr GROUP BY ALL)"""
GFINE = """gcurve AS (SELECT lat, lon, month, i, CAST(a1 AS DOUBLE) * sin(2 * pi() / 24 * (i * 0.1::DOUBLE) - CAST(phi1 AS DOUBLE)) + CAST(a2 AS DOUBLE) * sin(2 * (2 * pi() / 24 * (i * 0.1::DOUBLE)) - CAST(phi2 AS DOUBLE)) AS v FROM gparams, range(240) r(i)),
gfine AS (SELECT lat, lon, month, CAST(max(v) - min(v) AS FLOAT) AS dtr_fitted, CAST(arg_max(i, v) * 0.1::DOUBLE AS FLOAT) AS tmax_hour, CAST(arg_min(i, v) * 0.1::DOUBLE AS FLOAT) AS tmin_hour FROM gcurve GROUP BY ALL)"""
GARCHIVE = """garchive AS (SELECT p.*, r_squared, rmse, dtr_observed, dtr_fitted, tmax_hour, tmin_hour,
  CAST(coalesce(r_squared > 0.75 AND dtr_fitted > 0.5 AND dtr_fitted < 35 AND rmse < 2.0 AND coalesce(abs(dtr_fitted - dtr_observed) / nullif(dtr_observed, 0) < 0.4, true), false) AS BIGINT) AS quality_flag,
  CAST(NOT bool_or(coalesce(ok, false)) OVER (PARTITION BY p.lat, p.lon) AS BIGINT) AS skipped FROM gparams p LEFT JOIN gmet USING (lat, lon, month) LEFT JOIN gfine USING (lat, lon, month) LEFT JOIN gcheck USING (lat, lon, month))"""
GRID_FITTED = (GRID, GMASK, GCHECK, GSOLVE, GPARAMS)
GRID_CHAIN = (*GRID_FITTED, GFIT, GFINE, GARCHIVE)
GSHAPES = """gshapes AS (SELECT lat, lon, month, h AS hour, CAST(CAST(CAST(a1 AS DOUBLE) * sin(2 * pi() * h / 24 - CAST(phi1 AS DOUBLE)) + CAST(a2 AS DOUBLE) * sin(2 * (2 * pi() * h / 24) - CAST(phi2 AS DOUBLE)) AS FLOAT) AS DOUBLE) AS s FROM gparams, range(24) r(h)),
grange AS (SELECT lat, lon, month, CAST(CAST(max(s) AS FLOAT) - CAST(min(s) AS FLOAT) AS DOUBLE) AS span FROM gshapes GROUP BY ALL)"""

REPORTS = """rep0 AS (SELECT *, event_id % 17 AS m, event_id % 19 AS k, lpad(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), 4, '0') AS d, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events),
rep AS (SELECT lpad(CAST(user_id % 7 AS VARCHAR), 11, '0') AS STATION, CASE k WHEN 0 THEN 'bad' WHEN 1 THEN '12:30' WHEN 2 THEN iso || '+02:00' ELSE iso END AS DATE, ts, k,
  CASE WHEN event_id % 5 <> 0 THEN CAST(user_id % 80 AS VARCHAR) END AS LATITUDE, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id % 90 AS VARCHAR) END AS LONGITUDE, CASE WHEN event_id % 2 <> 0 THEN CAST(user_id % 100 AS VARCHAR) END AS ELEVATION,
  CASE m WHEN 0 THEN NULL WHEN 1 THEN d WHEN 2 THEN '+' || d || ',1,X' WHEN 3 THEN '+9999,9' WHEN 4 THEN '+' || d || ',3' WHEN 5 THEN '+0701,1' WHEN 6 THEN '"+' || d || ',1"' WHEN 7 THEN '+01a3,1' WHEN 8 THEN '' WHEN 9 THEN '-' || d || ',C' WHEN 10 THEN '-0601,1' WHEN 11 THEN '+0600,1' ELSE '+' || d || ',1' END AS TMP,
  2023 + user_id % 3 AS file_year, event_type AS file_station, event_id AS row_no FROM rep0)"""
#: Classes by the kind of fault that was put in, values by the digits: not by parsing.
CLASSED = """cls0 AS (SELECT *, row_no % 17 AS m, regexp_extract(TMP, '([+-][0-9]{4})', 1) AS num FROM rep),
cls AS (SELECT *, CASE WHEN m IN (0, 8) THEN 'na_input' WHEN m IN (1, 2, 7) THEN 'malformed' WHEN m = 3 THEN 'missing' WHEN m = 4 THEN 'qc_reject' WHEN m IN (5, 10) THEN 'phys_reject' ELSE 'valid' END AS row_class,
  CASE WHEN k >= 2 THEN date_trunc('second', ts) END AS naive_time FROM cls0),
acc AS (SELECT *, row_class = 'valid' AND naive_time IS NOT NULL AS accepted, CASE WHEN row_class = 'valid' THEN TRY_CAST(num AS DOUBLE) / 10 END AS value FROM cls)"""
FILES = """files AS (SELECT file_year, file_station, count(*) AS n_rows, """ + ", ".join(f"count(*) FILTER (WHERE row_class = '{c}') AS n_{c}" for c in ("na_input", "malformed", "missing", "qc_reject", "phys_reject", "valid")) + """,
  count(*) FILTER (WHERE row_class = 'valid' AND naive_time IS NULL) AS n_bad_time, count(*) FILTER (WHERE accepted) AS n_valid_records, count(DISTINCT date_trunc('hour', naive_time)) FILTER (WHERE accepted) AS n_valid_hours,
  min(date_trunc('hour', naive_time)) FILTER (WHERE accepted) AS first_time, max(date_trunc('hour', naive_time)) FILTER (WHERE accepted) AS last_time, count(DISTINCT STATION) AS n_station_ids, arg_min(STATION, row_no) AS station_id,
  arg_min(LATITUDE, row_no) FILTER (WHERE LATITUDE IS NOT NULL) AS latitude, arg_min(LONGITUDE, row_no) FILTER (WHERE LONGITUDE IS NOT NULL) AS longitude, arg_min(ELEVATION, row_no) FILTER (WHERE ELEVATION IS NOT NULL) AS elevation FROM acc GROUP BY ALL)"""
#: The same from files, of which those of views in 2024 cannot be read.
READ = "accf AS (SELECT * FROM acc WHERE NOT (file_year = 2024 AND file_station = 'view'))"
BROKEN = "broken AS (SELECT DISTINCT file_year, file_station, 'read: columns are missing: TMP' AS error FROM rep WHERE file_year = 2024 AND file_station = 'view'), every AS (SELECT *, error IS NULL AS ok FROM (SELECT *, CAST(NULL AS VARCHAR) AS error FROM files UNION ALL BY NAME SELECT * FROM broken))"
FILE_CHAIN = (REPORTS, CLASSED, READ, FILES.replace("FROM acc", "FROM accf"), BROKEN)
REPORT_CHAIN = (REPORTS, CLASSED, FILES)

MONTHS = """months AS (SELECT CAST(o_custkey % 60 AS VARCHAR) AS station, year(o_orderdate) AS year, month(o_orderdate) AS month, 'mode_' || o_orderstatus AS mode, count(*) * 20 AS n, stddev_pop(o_totalprice) / 9973 AS rmse, avg(o_totalprice) / 499979 AS r2 FROM orders GROUP BY ALL)"""
FEATURES = """features AS (SELECT CAST(c_custkey AS VARCHAR) AS station, c_nationkey * 7.5::DOUBLE - 90 AS lat, (c_custkey * 3 + 90) % 360 - 180.0::DOUBLE AS lon, CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey % 2 = 0 END AS coastal_30km, abs(c_acctbal) / 10 AS elev, r_name AS continent, c_mktsegment AS koppen
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
STRATA = """strata AS (SELECT m.*, f.continent, f.koppen, f.station IS NOT NULL AS known, CASE WHEN f.coastal_30km THEN 'Coastal (<=30 km)' ELSE 'Inland (>30 km)' END AS coastal_group,
  CASE WHEN elev < 100 THEN '<100 m' WHEN elev < 250 THEN '100-250 m' WHEN elev < 500 THEN '250-500 m' WHEN elev >= 500 THEN '>=500 m' END AS elevdiff_group,
  CASE WHEN lat <= -60 THEN '60-90S' WHEN lat <= -30 THEN '30-60S' WHEN lat <= 0 THEN '0-30S' WHEN lat <= 30 THEN '0-30N' WHEN lat <= 60 THEN '30-60N' WHEN lat <= 90 THEN '60-90N' END AS latitude_band,
  ['DJF', 'DJF', 'MAM', 'MAM', 'MAM', 'JJA', 'JJA', 'JJA', 'SON', 'SON', 'SON', 'DJF'][m.month] AS season FROM months m LEFT JOIN features f USING (station))"""
STRATA_CHAIN = (MONTHS, FEATURES, STRATA)


CODES = "codes AS (SELECT station, list_sum([ascii(c) FOR c IN string_split(station, '')]) AS code FROM (SELECT DISTINCT event_type AS station FROM events))"
#: Every point against every edge of every polygon.
ZONED = """corner AS (SELECT n_name AS zone, k, n_nationkey * 7.31::DOUBLE - 88.77 + (3.13 + (k * 5 + n_nationkey * 3) % 7 * 2.29::DOUBLE) * sin(2 * pi() * k / 7 + n_nationkey * 0.37::DOUBLE) AS y,
  n_nationkey * 14.17::DOUBLE - 170.39 + 6 * (3.13 + (k * 5 + n_nationkey * 3) % 7 * 2.29::DOUBLE) * cos(2 * pi() * k / 7 + n_nationkey * 0.37::DOUBLE) AS x FROM nation, range(7) r(k)),
edge AS (SELECT a.zone, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM corner a JOIN corner b ON a.zone = b.zone AND b.k = (a.k + 1) % 7),
inside AS (SELECT station, zone FROM features, edge WHERE (y1 > lat) <> (y2 > lat) AND x1 + (lat - y1) / (y2 - y1) * (x2 - x1) > lon GROUP BY station, zone HAVING count(*) % 2 = 1),
zoned AS (SELECT station, min(zone) AS zone FROM features LEFT JOIN inside USING (station) GROUP BY station)"""


def statement(chain: tuple[str, ...], select: str) -> str:
    return "WITH " + ",\n".join(chain) + "\n" + select


def r(x: str) -> str:
    """As reports round."""
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0"


def i(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def score(obs: str, rec: str, use: str = "true", least: int = 2, above: float = 1e-4, bounds: str = "") -> dict[str, str]:
    """n, rmse and r2 of an aggregation."""
    f = f"FILTER (WHERE ({use}) AND {obs} IS NOT NULL AND {rec} IS NOT NULL)"
    n, sse, sst = f"count(*) {f}", f"sum(({rec} - {obs}) * ({rec} - {obs})) {f}", f"(sum({obs} * {obs}) {f} - sum({obs}) {f} * sum({obs}) {f} / nullif(count(*) {f}, 0))"
    value = f"1 - {sse} / {sst}"
    value = f"greatest(-1.0, least(1.0, {value}))" if bounds else value
    ok = f"{n} >= {least} AND {n} > 0"
    return {"n": i(n), "rmse": r(f"CASE WHEN {ok} THEN sqrt({sse} / {n}) END"), "r2": r(f"CASE WHEN {ok} AND {sst} > {above} THEN {value} END")}


def columns(named: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in named.items())
