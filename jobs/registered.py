"""The jobs as registered queries: each runs twice into a new folder, and what stands there after the second run is returned."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from cadence.plans.catalog import report
from cadence.plans.oracle import i, r
from cadence.session import new_folder
from jobs import hourly_ingest, text_inventory
from jobs.command import settings

HERE = Path(__file__).parent


def job1_hourly_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, config = new_folder(spark, "hourly_ingest"), settings(hourly_ingest.Config, str(HERE / "hourly_ingest.json"))
    for _ in range(2):
        hourly_ingest.run(spark, f"{sf_dir}/events.parquet", f"{folder}/out", f"{folder}/marks", config)
    return report(hourly_ingest.hourly(spark, f"{folder}/out").drop("upto"))


def job2_text_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, config = new_folder(spark, "text_inventory"), settings(text_inventory.Config, str(HERE / "text_inventory.json"))
    for _ in range(2):
        text_inventory.run(spark, f"{sf_dir}/documents.parquet", folder, config)
    return report(text_inventory.groups(spark, folder, config))


JOB1 = f"""WITH v AS (SELECT event_type AS station, date_trunc('hour', ts) AS time, value * 0.2::DOUBLE AS v FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND isfinite(value))
SELECT station, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, {i('count(*)')} AS n, {r('avg(v)')} AS obs, {r('min(v)')} AS low, {r('max(v)')} AS high, {i('year(time)')} AS year, {i('month(time)')} AS month FROM v WHERE v BETWEEN -60 AND 60 GROUP BY station, time"""

_OF = {"na_input": "trim(x) = ''", "malformed": r"trim(x) <> '' AND NOT regexp_matches(x, '\p{L}')", "phys_reject": r"regexp_matches(x, '\p{L}') AND length(x) > 2000", "valid": r"regexp_matches(x, '\p{L}') AND length(x) <= 2000"}
JOB2 = f"""WITH l AS (SELECT lang, source, text IS NULL AS is_error, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents),
d AS (SELECT lang, source, is_error, len(l) AS n_rows, {', '.join(f'len([x FOR x IN l IF {c}]) AS n_{k}' for k, c in _OF.items())}, len(list_distinct([x FOR x IN l IF {_OF['valid']}])) AS n_distinct, coalesce(list_max([length(x) FOR x IN l]), 0) AS n_longest FROM l)
SELECT lang, source, {i('count(*)')} AS n_files, {i('count(*) FILTER (WHERE is_error)')} AS n_read_errors, {', '.join(f'{i(f"sum(n_{k})")} AS n_{k}' for k in ('rows', *_OF))}, {i('sum(n_valid - n_distinct)')} AS n_repeats, {i('max(n_longest)')} AS n_longest,
  {', '.join(f'{r(f"100.0 * sum(n_{k}) / nullif(sum(n_rows), 0)")} AS pct_{k}' for k in _OF)}, {r('avg(n_distinct)')} AS mean, {r('stddev_samp(n_distinct)')} AS std, {i('min(n_distinct)')} AS min,
  {', '.join(f'{r(f"quantile_cont(n_distinct, {q})")} AS {k}' for k, q in (('p5', 0.05), ('p25', 0.25), ('median', 0.5), ('p75', 0.75), ('p95', 0.95)))}, {i('max(n_distinct)')} AS max, {r('avg(CAST(n_distinct >= 24 AS INT))')} AS share_ge24 FROM d GROUP BY lang, source"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_hourly_ingest": job1_hourly_ingest, "job2_text_inventory": job2_text_inventory}
SQL = {"job1_hourly_ingest": JOB1, "job2_text_inventory": JOB2}
