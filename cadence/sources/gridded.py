"""Gridded series in chunks: rows of Parquet that hold a block of hours and cells each, in folders by year and month; and grids spread over many files."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.nulls import clean
from cadence.sources.tables import COORDINATES, VALUES

AXES = ("time", "lat", "lon")


@dataclass(frozen=True)
class Chunk:
    """A chunk spans so many days of a month and so many degrees; its cells are what the grid has there."""

    days: int = 1
    lat_degrees: float = 5.0
    lon_degrees: float = 5.0


def chunked(series: DataFrame, fields: Mapping[str, str], chunk: Chunk = Chunk()) -> DataFrame:
    """A row for each chunk of (time, lat, lon, fields): its axes, the extremes of each, and the fields as arrays in the order of ``at``.

    ``fields`` names the columns with the types they are stored in, float for
    values and tinyint for flags; NaN becomes NULL. ``at`` counts through the
    chunk by hour, latitude and longitude, so that a chunk without gaps has a run
    of numbers there and one with gaps no filler. A time and cell that repeats
    raises; a row without time or coordinate is dropped. Both shuffles go by
    chunk, whose size is bounded by its span.
    """
    stored = lambda c, kind: (clean(F.col(c)) if kind in ("float", "double") else F.col(c)).cast(kind)
    rows = series.select("time", F.col("lat").cast("double"), F.col("lon").cast("double"), *(stored(c, k).alias(c) for c, k in fields.items())).dropna(subset=list(AXES))
    keys = {
        "year": F.year("time"), "month": F.month("time"), "block": F.floor((F.dayofmonth("time") - 1) / chunk.days).cast("int"),
        "lat_block": F.floor(F.col("lat") / chunk.lat_degrees).cast("int"), "lon_block": F.floor(F.col("lon") / chunk.lon_degrees).cast("int"),
    }
    found = rows.groupBy(*(v.alias(k) for k, v in keys.items())).agg(*(F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in AXES), F.collect_list(F.struct(*AXES, *fields)).alias("cells"))
    place = lambda axis, x: (F.array_position(f"{axis}s", x[axis]) - 1).cast("int")
    at = lambda x: (place("time", x) * F.size("lats") + place("lat", x)) * F.size("lons") + place("lon", x)
    placed = found.withColumn("cells", F.array_sort(F.transform("cells", lambda x: F.struct(at(x).alias("at"), *(x[c].alias(c) for c in fields)))))
    where = F.when(F.size(F.array_distinct("cells.at")) == F.size("cells"), F.col("cells.at")).otherwise(F.raise_error(F.lit("a time and cell repeats in the grid")).cast("array<int>"))
    ends = [f(f"{c}s").alias(f"{c}_{n}") for c in AXES for n, f in (("low", F.array_min), ("high", F.array_max))]
    return placed.select("year", "month", "block", "lat_block", "lon_block", *ends, *(f"{c}s" for c in AXES), where.alias("at"), *(F.col(f"cells.{c}").alias(c) for c in fields))


def write_grid(series: DataFrame, path: str, fields: Mapping[str, str], chunk: Chunk = Chunk()) -> None:
    """Writes the chunks into a folder for each year and month; months that ``series`` has rows of are replaced whole or not at all, others stay.

    A month's chunks lie in order of place, so that a file holds neighbours and
    its statistics tell where.
    """
    rows = chunked(series, fields, chunk).hint("rebalance", "year", "month").sortWithinPartitions("year", "month", "lat_block", "lon_block", "block")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year", "month").parquet(path)


def read_chunks(spark: SparkSession, path: str, years: list[int] | None = None, months: list[int] | None = None, lat: tuple[float, float] | None = None, lon: tuple[float, float] | None = None) -> DataFrame:
    """The chunks that may hold what is asked for: folders by year and month, then files and row groups by the extremes of their axes."""
    chunks = spark.read.parquet(path)
    for c, some in (("year", years), ("month", months)):
        chunks = chunks if some is None else chunks.where(F.col(c).isin(some))
    for c, span in (("lat", lat), ("lon", lon)):
        chunks = chunks if span is None else chunks.where((F.col(f"{c}_high") >= span[0]) & (F.col(f"{c}_low") <= span[1]))
    return chunks


def read_grid(spark: SparkSession, path: str, fields: list[str], years: list[int] | None = None, months: list[int] | None = None, lat: tuple[float, float] | None = None, lon: tuple[float, float] | None = None) -> DataFrame:
    """(time, lat, lon, fields, year, month) of the cells in the years, months and spans (ends included); only the fields asked for are read."""
    chunks = read_chunks(spark, path, years, months, lat, lon)
    cells = chunks.select("year", "month", *(f"{c}s" for c in AXES), F.explode(F.arrays_zip("at", *fields)).alias("x"))
    width, depth = F.size("lons"), F.size("lats") * F.size("lons")
    axis = {"time": F.floor(F.col("x.at") / depth), "lat": F.floor(F.col("x.at") / width) % F.size("lats"), "lon": F.col("x.at") % width}
    found = cells.select(*(F.get(f"{c}s", v.cast("int")).alias(c) for c, v in axis.items()), *(F.col(f"x.{c}").alias(c) for c in fields), "year", "month")
    for c, span in (("lat", lat), ("lon", lon)):
        found = found if span is None else found.where(F.col(c).between(*span))
    return found


def _first_of(df: DataFrame, names: tuple[str, ...]) -> Column | None:
    there = [F.col(c) for c in names if c in df.columns]
    return F.coalesce(*there) if there else None


def grid_files(spark: SparkSession, root: str, pattern: str = "*.parquet", year: int | None = None, month: int | None = None) -> DataFrame:
    """(time, lat, lon, t2m in degrees Celsius, file) of all files under ``root`` whose names match, each by its own names of columns.

    Of the known names of a coordinate or value a row takes the first that its
    file has; without one in any file, or without files, this raises. A year or a
    month keeps the files that have it in their names as _YYYY_MM, which are
    found by name before any is opened. ``units`` may be a column of some files.
    """
    from cadence.operators.grid import celsius

    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(root)
    columns = {c: _first_of(rows, (c, *COORDINATES[c])) for c in AXES} | {"t2m": _first_of(rows, VALUES)}
    if missing := sorted(c for c, v in columns.items() if v is None):
        raise ValueError(f"no column for {missing} among {rows.columns}")
    if year is not None or month is not None:
        name = rf"_{r'\d{4}' if year is None else f'{year:04d}'}_{r'\d{2}' if month is None else f'{month:02d}'}\."
        rows = rows.where(F.col("_metadata.file_name").rlike(name))
    units = F.col("units") if "units" in rows.columns else F.lit("C")
    return rows.select(*(v.alias(c) for c, v in columns.items() if c != "t2m"), celsius(clean(columns["t2m"].cast("double")), F.coalesce(units, F.lit("C"))).alias("t2m"), F.col("_metadata.file_name").alias("file"))
