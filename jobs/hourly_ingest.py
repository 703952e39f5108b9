"""Keeps hourly station values up to date from a growing folder of readings.

    python -m jobs.hourly_ingest --source IN --output OUT --checkpoint MARKS --config jobs/hourly_ingest.json

Each run takes the files that are new since the last one (a file stream with a
checkpoint, until what is there has been taken), reduces their readings to sums
by station, hour and class, and writes those as parts: OUT/parts, a folder for
each year, month and batch. Then the months whose parts are newer than their
hourly values are put together anew into OUT/hourly, a folder for each year and
month. A batch that is taken again after a failure replaces its own parts; a
month that a failed run has left behind is found by its mark, the last batch in
it. So any run can be repeated, and without new files it writes nothing.

Readings are a table of Parquet whose columns the settings name, or ("format":
"reports") raw station report files in CSV, <folder>/<year>/<station>.csv, each by
its own header, which pass the quality control of the library.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.clock import hour_floor
from cadence.functions.nulls import clean
from cadence.operators.qc import scheme_readings
from cadence.sources import tables
from jobs import command

log = logging.getLogger(__name__)

PARTS = "station string, time timestamp_ntz, row_class string, n long, total double, low double, high double, year int, month int, batch long"
HOURLY = "station string, time timestamp_ntz, n long, obs double, low double, high double, upto long, year int, month int"


@dataclass(frozen=True)
class Config:
    """``format`` is table or reports; of a table, columns of the readings, of which a value is ``scale`` times what is read and valid within the range."""

    format: str = "table"
    station: str = "event_type"
    time: str = "ts"
    value: str = "value"
    scale: float = 0.2
    low: float = -60.0
    high: float = 60.0
    files_per_batch: int = 1000


def classified(readings: DataFrame, config: Config) -> DataFrame:
    """(station, time, row_class, value): the hour, and the first fault of a reading or valid."""
    value = clean(F.col(config.value).cast("double")) * config.scale
    kind = (
        F.when(F.col(config.station).isNull(), "no_station")
        .when(F.col(config.time).isNull(), "no_time")
        .when(value.isNull(), "missing")
        .when(~value.between(config.low, config.high), "phys_reject")
        .otherwise("valid")
    )
    return readings.select(F.col(config.station).cast("string").alias("station"), hour_floor(F.col(config.time).cast("timestamp_ntz")).alias("time"), kind.alias("row_class"), F.when(kind == "valid", value).alias("value"))


def classified_reports(files: DataFrame) -> DataFrame:
    """The same of whole report files: the classes of the inventory, no_time for valid values without one, read_error for a file that has no rows or lacks a column."""
    rows = scheme_readings(tables.parse_reports(files, ("STATION", "DATE", "TMP")))
    kind = F.when(F.col("error").isNotNull(), "read_error").when((F.col("row_class") == "valid") & F.col("time").isNull(), "no_time").otherwise(F.col("row_class"))
    return rows.select(F.col("file_station").alias("station"), hour_floor(F.col("time")).alias("time"), kind.alias("row_class"), F.when(kind == "valid", F.col("value")).alias("value"))


def hourly_sums(rows: DataFrame) -> DataFrame:
    """Sums that merge; partial ones come before the shuffle, so that a busy station is no hot key."""
    found = rows.groupBy("station", "time", "row_class").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    return found.withColumns({"year": F.year("time"), "month": F.month("time")})


def _replace(rows: DataFrame, path: str, by: list[str]) -> None:
    """Only the folders that ``rows`` have values for, each whole or not at all; a month's rows are dealt to as many tasks as their size asks for."""
    rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _take_new_files(spark: SparkSession, source: str, output: str, checkpoint: str, config: Config) -> dict[str, int]:
    """Parts of all files that the checkpoint does not know yet; {row class: rows read}."""
    counted: dict[str, int] = {}

    def write(batch: DataFrame, number: int) -> None:
        rows = classified_reports(batch) if config.format == "reports" else classified(batch, config)
        _replace(hourly_sums(rows).withColumn("batch", F.lit(number)), f"{output}/parts", ["year", "month", "batch"])
        seen = {r.row_class: r.n for r in funnel(spark, output, number).collect()}
        log.info("batch %d of %s: read %s", number, source, seen)
        for k, n in ("rows", sum(seen.values())), *seen.items():
            counted[k] = counted.get(k, 0) + n

    reader = spark.readStream.option("maxFilesPerTrigger", config.files_per_batch)
    if config.format == "reports":
        stream = tables.whole_files(reader.text(f"{source}/{tables.PLAIN.files}", wholetext=True))
    elif config.format == "table":
        # a stream takes a folder or a pattern; a pattern that fits one name takes a table that is a single file too
        pattern = source if any(c in source for c in "*?[{") else f"{source[:-1]}[{source[-1]}]"
        stream = reader.schema(spark.read.parquet(source).schema).parquet(pattern)
    else:
        raise ValueError(f"format is table or reports, not {config.format}")
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return counted


def _put_months_together(spark: SparkSession, output: str) -> int:
    """Writes the months whose parts are newer than their mark; how many. The driver gets a row for each such month."""
    parts = _read(spark, f"{output}/parts", PARTS).where("row_class = 'valid'")
    newest = parts.groupBy("year", "month").agg(F.max("batch").alias("newest"))
    marks = _read(spark, f"{output}/hourly", HOURLY).groupBy("year", "month").agg(F.max("upto").alias("upto"))
    stale = newest.join(marks, ["year", "month"], "left").where("upto is null or upto < newest").select("year", "month", "newest").collect()
    if stale:
        months = spark.createDataFrame(stale, "year int, month int, newest long")
        rows = parts.join(F.broadcast(months), ["year", "month"]).groupBy("year", "month", "station", "time")
        merged = rows.agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("obs"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("newest").alias("upto"))
        _replace(merged, f"{output}/hourly", ["year", "month"])
        log.info("wrote %s/hourly: months %s", output, sorted((r.year, r.month) for r in stale))
    return len(stale)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: Config = Config()) -> dict[str, int]:
    """Takes new files of readings into hourly values; returns the rows read by class, a row for each file that cannot be read among them, and the months written.

    Readings without station, time or value, and those out of range, count in the
    parts by their class and in no hour. A file is taken once, by its path;
    tables without rows write nothing.
    """
    source, output = source.rstrip("/"), output.rstrip("/")
    counted = _take_new_files(spark, source, output, checkpoint, config)
    months = _put_months_together(spark, output)
    log.info("%s: %s rows taken, %d months written", source, counted.get("rows", 0), months)
    return counted | {"months": months}


def funnel(spark: SparkSession, output: str, batch: int | None = None) -> DataFrame:
    """(row_class, n) of all readings taken so far, or of one batch."""
    parts = _read(spark, f"{output}/parts", PARTS)
    return (parts if batch is None else parts.where(F.col("batch") == batch)).groupBy("row_class").agg(F.sum("n").alias("n"))


def hourly(spark: SparkSession, output: str) -> DataFrame:
    return _read(spark, f"{output}/hourly", HOURLY)


if __name__ == "__main__":
    command.start("hourly_ingest", Config, run, {"source": "folder, pattern or file of readings in Parquet, or the folder of report files", "output": "folder of the parts and hourly values", "checkpoint": "folder of the stream's marks"})
