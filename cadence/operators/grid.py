"""Gridded series: nearest cells, shapes on other grids, and the check of the archive against its own input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.functions.clock import day_of
from cadence.functions.scoring import GRID, scores, statistics
from cadence.operators.modes import scaled


def celsius(value: Column, units: Column) -> Column:
    return F.when(F.lower(units).isin("k", "kelvin"), value - 273.15).otherwise(value)


def coordinate_key(x: Column) -> Column:
    """Hundredths of a degree, halves to even; 0 and -0 are one key."""
    return F.rint(x * 100).cast("int")


def nearest_on_axis(points: DataFrame, column: str, axis: DataFrame, axis_column: str, ties: str = "first") -> DataFrame:
    """``points`` with nearest_<column>: the axis value with the least distance, for each distinct value once.

    ``axis`` has one row for each grid line, some thousands at most whatever
    the number of points; ties go to the smaller (first) or larger value. No
    cap on the distance, no wrap.
    """
    values = points.select(column).where(F.col(column).isNotNull()).distinct()
    lines = axis.select(F.col(axis_column).cast("double").alias("line")).distinct()
    grid = lines.agg(F.sort_array(F.collect_list("line")).alias("lines"))
    nearest = F.array_min(F.transform("lines", lambda x: F.struct(F.abs(x - F.col(column)).alias("away"), (x if ties == "first" else -x).alias("order"), x.alias("x"))))["x"]
    found = values.join(F.broadcast(grid)).select(F.col(column).alias("__v"), nearest.alias(f"nearest_{column}"))
    return points.join(found, points[column] == found["__v"], "left").drop("__v")


def station_templates(stations: DataFrame, shapes: DataFrame, lat_axis: DataFrame, lon_axis: DataFrame) -> DataFrame:
    """(lat_c, lon_c, month, s, shape_range) for the distinct rounded coordinates of stations, from each's nearest cell."""
    places = stations.select(coordinate_key(F.col("lat")).alias("lat_c"), coordinate_key(F.col("lon")).alias("lon_c")).dropna().distinct().withColumns({"lat": F.col("lat_c") / 100.0, "lon": F.col("lon_c") / 100.0})
    placed = nearest_on_axis(nearest_on_axis(places, "lat", lat_axis, "lat"), "lon", lon_axis, "lon")
    cells = shapes.withColumnsRenamed({"lat": "nearest_lat", "lon": "nearest_lon"})
    return placed.join(cells, ["nearest_lat", "nearest_lon"]).select("lat_c", "lon_c", "month", "s", "shape_range")


def reindexed(shapes: DataFrame, targets: DataFrame, ties: str = "last") -> DataFrame:
    """(lat, lon, nearest_lat, nearest_lon, month, s) of the shapes on another grid: each target's nearest line on each axis on its own, the larger of two that are as near."""
    axis = shapes.select("lat", "lon").distinct()
    places = targets.select("lat", "lon").dropna().distinct()
    placed = nearest_on_axis(nearest_on_axis(places, "lat", axis, "lat", ties), "lon", axis, "lon", ties)
    cells = shapes.select(F.col("lat").cast("double").alias("nearest_lat"), F.col("lon").cast("double").alias("nearest_lon"), "month", "s")
    return placed.join(cells, ["nearest_lat", "nearest_lon"]).select("lat", "lon", "nearest_lat", "nearest_lon", "month", "s")


def daily_extremes(series: DataFrame, cell: list[str]) -> DataFrame:
    return series.groupBy(*cell, day_of(F.col("time")).alias("day")).agg(F.avg("t").alias("t_mean"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))


def as_of(times: DataFrame, values: DataFrame, keys: list[str], time: str = "time", value: str = "value", block_days: int = 30) -> DataFrame:
    """``times`` with the last value of its keys at or before its time; NULL before the first. No range join.

    Time is cut into blocks. What is last in each block is carried on to the
    blocks after it, a row for each key and block; within a block the values and
    the times asked for are put in order together. So a key is never ordered as a
    whole, however many rows it has, and a key's blocks are as many as its span
    has. NULL values are passed over; of values of one time the largest counts;
    NULL times get NULL, and NULL keys are a key.
    """
    block = lambda: F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / (86400 * block_days)).alias("__block")
    kind = values.schema[value].dataType
    key = F.struct(*keys)
    known = values.where(F.col(value).isNotNull() & F.col(time).isNotNull()).groupBy(key.alias("__key"), block(), F.col(time).alias("__time")).agg(F.max(value).alias("__value"))
    asked = times.select(key.alias("__key"), block(), F.col(time).alias("__time"), F.struct(*times.columns).alias("__row"))
    both = asked.withColumn("__value", F.lit(None).cast(kind)).unionByName(known, allowMissingColumns=True)
    within = Window.partitionBy("__key", "__block").orderBy("__time", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__within", F.last("__value", True).over(within)).where("__row is not null")
    # the last value of each block, for the next block of the key that has times or values
    ends = known.groupBy("__key", "__block").agg(F.max_by("__value", "__time").alias("__end"))
    blocks = asked.select("__key", "__block").distinct().join(ends, ["__key", "__block"], "full")
    carried = blocks.withColumn("__carried", F.last("__end", True).over(Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))).select("__key", "__block", "__carried")
    joined = found.join(carried, ["__key", "__block"], "left")
    return joined.select("__row.*", F.when(F.col("__time").isNotNull(), F.coalesce("__within", "__carried")).alias(value))


def cell_metrics(series: DataFrame, shapes: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, year, month, n, rmse_base, r2_base, rmse_scaled, r2_scaled) of the series against its own daily means and ranges.

    A flat shape's range counts as 1. The day's values are a window over the
    exchange that the month's aggregation would need anyway.
    """
    day = Window.partitionBy(*cell, "year", "month", "day")
    dated = series.withColumns({"year": F.year("time"), "month": F.month("time"), "day": day_of(F.col("time"))})
    joined = dated.join(shapes.select(*cell, "month", "s", "shape_range"), [*cell, "month"]).withColumns({"s_h": F.get("s", F.hour("time")).cast("double"), "m": F.avg("t").over(day), "lo": F.min("t").over(day), "hi": F.max("t").over(day)})
    base = F.col("m") + F.col("s_h")
    stretched = scaled(F.col("m"), F.col("lo"), F.col("hi"), F.col("s_h"), F.col("shape_range").cast("double"), guard="unit")
    stats = [v.alias(f"{p}_{k}") for p, r in (("a", base), ("b", stretched)) for k, v in statistics(F.col("t"), r).items()]
    found = joined.groupBy(*cell, "year", "month").agg(*stats)
    a, b = scores(GRID, "a_"), scores(GRID, "b_")
    return found.select(*cell, "year", "month", F.col("a_n").alias("n"), a["rmse"].alias("rmse_base"), a["r2"].alias("r2_base"), b["rmse"].alias("rmse_scaled"), b["r2"].alias("r2_scaled"))


def point_curve(archive: DataFrame, lat: float, lon: float, month: int) -> DataFrame:
    """24 rows (hour, t) at the nearest cell of the archive: its mean plus the shape; pushed down to the month's partition."""
    from cadence.functions.harmonics import shape

    place = archive.where(F.col("month") == month).orderBy(F.abs(F.col("lat") - lat), "lat", F.abs(F.col("lon") - lon), "lon").limit(1)
    p = [F.col(c).cast("double") for c in ("a1", "phi1", "a2", "phi2")]
    return place.select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")).select("lat", "lon", "month", "hour", (F.col("t_mean") + shape(F.col("hour"), *p)).alias("t"), "skipped")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
