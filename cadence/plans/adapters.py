"""The driver's tables as the inputs of this library.

Events are station observations: the type is the station, months are spread by
user, and a daily cycle of its own phase is added to each station's noise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.clock import hour_floor
from cadence.functions.scoring import deviation
from cadence.operators.climatology import climatology, detrended
from cadence.operators.fit import parameters, ridge_fit, templates
from cadence.operators.modes import strict_modes, with_templates
from cadence.operators.qc import hourly_mean
from cadence.session import new_folder

PHASES = {"click": 0.0, "error": math.pi / 4, "purchase": math.pi / 2, "signup": -math.pi / 3, "view": -math.pi / 2}
ZONES = {"click": None, "error": "America/New_York", "purchase": "Asia/Kolkata", "signup": "Asia/Kathmandu", "view": "Australia/Sydney"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_station(values: dict, otherwise):
    out = None
    for k, v in values.items():
        out = (F if out is None else out).when(F.col("event_type") == k, F.lit(v))
    return out.otherwise(F.lit(otherwise))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts") + F.make_dt_interval((F.col("user_id") % 6 * 30).cast("int"))
    value = F.col("value") / 9.7 + 6 * F.sin(2 * math.pi * F.hour("ts") / 24 - _by_station(PHASES, 0.0))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("station"), F.year(ts).alias("file_year"), ts.alias("time"), value.alias("value"), "event_id", "user_id")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_mean(observations(spark, sf_dir), ["station", "file_year"])


def zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ZONES.items()), "station string, tz string")


def station_fit(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hourly values, their detrended climatology, and the stored parameters."""
    hours = hourly(spark, sf_dir)
    det = detrended(climatology(hours, ["station"]), ["station"])
    return hours, det, parameters(ridge_fit(det, ["station"]), ["station"])


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours, _, params = station_fit(spark, sf_dir)
    return with_templates(hours, templates(params, ["station"]), ["station"])


def reconstructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict_modes(shaped(spark, sf_dir))


def grid_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time, lat, lon, t): 40 cells, months by event, half of the cells in kelvin at first."""
    from cadence.operators.grid import celsius

    lat = (F.ascii("event_type") % 7 * 10).cast("double")
    ts = F.col("ts") + F.make_dt_interval((F.col("event_id") % 12 * 31).cast("int"))
    kelvin = F.col("user_id") % 8 < 4
    value = F.col("value") / 9.7 + 6 * F.sin(2 * math.pi * F.hour("ts") / 24 - _by_station(PHASES, 0.0))
    raw = table(spark, sf_dir, "events").select(hour_floor(ts).alias("time"), lat.alias("lat"), (F.col("user_id") % 8).cast("double").alias("lon"), (value + F.when(kelvin, 273.15).otherwise(0.0)).alias("t2m"), F.when(kelvin, "K").otherwise("degC").alias("units"))
    return raw.groupBy("lat", "lon", "time").agg(F.avg(celsius(F.col("t2m"), F.col("units"))).alias("t"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw report rows with every kind of fault, by the event's number."""
    m, k = F.col("event_id") % 17, F.col("event_id") % 19
    digits = F.lpad(F.floor("value").cast("string"), 4, "0")
    packed = (
        F.when(m == 0, None).when(m == 1, digits).when(m == 2, F.concat(F.lit("+"), digits, F.lit(",1,X"))).when(m == 3, "+9999,9").when(m == 4, F.concat(F.lit("+"), digits, F.lit(",3")))
        .when(m == 5, "+0701,1").when(m == 6, F.concat(F.lit('"+'), digits, F.lit(',1"'))).when(m == 7, "+01a3,1").when(m == 8, "").when(m == 9, F.concat(F.lit("-"), digits, F.lit(",C")))
        .when(m == 10, "-0601,1").when(m == 11, "+0600,1").otherwise(F.concat(F.lit("+"), digits, F.lit(",1")))
    )
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    date = F.when(k == 0, "bad").when(k == 1, "12:30").when(k == 2, F.concat(iso, F.lit("+02:00"))).otherwise(iso)
    some = lambda c, n: F.when(F.col("event_id") % n == 0, None).otherwise((F.col("user_id") % c).cast("string"))
    return table(spark, sf_dir, "events").select(
        F.lpad((F.col("user_id") % 7).cast("string"), 11, "0").alias("STATION"), date.alias("DATE"), some(80, 5).alias("LATITUDE"), some(90, 3).alias("LONGITUDE"), some(100, 2).alias("ELEVATION"),
        packed.alias("TMP"), (2023 + F.col("user_id") % 3).cast("int").alias("file_year"), F.col("event_type").alias("file_station"), F.col("event_id").alias("row_no"),
    )


#: The names that files of a station begin with; others have those of the reports in their order.
HEADERS = {"purchase": ("TMP", "SOURCE", "ELEVATION", "LONGITUDE", "LATITUDE", "DATE", "STATION"), "signup": ("DATE", "TMP", "STATION", "LATITUDE", "LONGITUDE", "ELEVATION", "REMARK")}


def report_files(spark: SparkSession, sf_dir: str) -> str:
    """The report rows as files of CSV, one for each year and type of event, under three different headers; the files of views in 2024 lack TMP. Returns their root."""
    csv = {"quote": '"', "escape": '"'}
    rows = reports(spark, sf_dir).withColumns({"SOURCE": F.lit("s, t"), "REMARK": F.lit(None).cast("string")})
    broken = (F.col("file_station") == "view") & (F.col("file_year") == 2024)
    plain = ("STATION", "DATE", "LATITUDE", "LONGITUDE", "ELEVATION", "TMP")
    line, head = F.when(broken, F.to_csv(F.struct(*plain[:-1]), csv)), F.when(broken, ",".join(plain[:-1]))
    for station, names in HEADERS.items():
        line, head = line.when(F.col("file_station") == station, F.to_csv(F.struct(*names), csv)), head.when(F.col("file_station") == station, ",".join(f'"{c}"' for c in names))
    lines = rows.select("file_year", "file_station", "row_no", line.otherwise(F.to_csv(F.struct(*plain), csv)).alias("value"))
    heads = rows.select("file_year", "file_station").distinct().select("file_year", "file_station", F.lit(-1).cast("long").alias("row_no"), head.otherwise(",".join(plain)).alias("value"))
    root = new_folder(spark, "reports")
    ordered = lines.union(heads).repartition("file_year", "file_station").sortWithinPartitions("file_year", "file_station", "row_no")
    ordered.drop("row_no").write.partitionBy("file_year", "file_station").text(root)
    return root


def order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station-months with n, rmse and r2 by mode, from orders; months of the same prices have the same rmse to the last bit, so that ties are ties."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy((F.col("o_custkey") % 60).cast("string").alias("station"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.concat(F.lit("mode_"), "o_orderstatus").alias("mode")).agg((F.count("*") * 20).alias("n"), (deviation(F.col("o_totalprice")) / 9973).alias("rmse"), (F.avg("o_totalprice") / 499979).alias("r2"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is a station; longitudes are folded into range."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").cast("string").alias("station"), (F.col("c_nationkey") * 7.5 - 90).alias("lat"), ((F.col("c_custkey") * 3 + 90) % 360 - 180.0).alias("lon"), F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey") % 2 == 0).alias("coastal_30km"),
        (F.abs("c_acctbal") / 10).alias("abs_elev_diff_m"), F.col("r_name").alias("continent"), F.col("c_mktsegment").alias("koppen"),
    )


def station_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each type of event: its region by the sum of its letters, some of them without a coast or a height."""
    code = F.aggregate(F.transform(F.filter(F.split("station", ""), lambda c: c != ""), F.ascii), F.lit(0), lambda a, c: a + c)
    stations = table(spark, sf_dir, "events").select(F.col("event_type").alias("station")).distinct().withColumn("code", code)
    return stations.join(table(spark, sf_dir, "region"), F.col("code") % 5 == F.col("r_regionkey"), "left").select(
        "station", (F.col("code") % 180 - 90.0).alias("lat"), (F.col("code") * 7 % 360 - 180.0).alias("lon"), F.when(F.col("code") % 3 != 0, F.col("code") % 2 == 0).alias("coastal_30km"),
        F.when(F.col("code") % 4 != 0, F.col("code") % 700 * 1.0).alias("abs_elev_diff_m"), F.col("r_name").alias("continent"), F.lit("Cfb").alias("koppen"),
    )


def supplier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stations: far fewer than there are customers."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").cast("string").alias("station"), (F.col("s_nationkey") * 7.5 - 90).alias("lat"), F.lit(0.0).alias("lon"), F.lit(None).cast("boolean").alias("coastal_30km"),
        (F.abs("s_acctbal") / 10).alias("abs_elev_diff_m"), F.col("r_name").alias("continent"), F.lit("Cfb").alias("koppen"),
    )


def customer_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_months() with every customer as a station of its own."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").cast("string").alias("station"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.concat(F.lit("mode_"), "o_orderstatus").alias("mode")).agg((F.count("*") * 20).alias("n"), (F.max("o_totalprice") / 9973).alias("rmse"), (F.avg("o_totalprice") / 499979).alias("r2"))


def cell_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly values at cells as those of grid_series(), and at two more in each row, which the grid lacks."""
    return observations(spark, sf_dir).groupBy((F.ascii("station") % 7 * 10).cast("double").alias("lat"), (F.col("user_id") % 10).cast("double").alias("lon"), F.col("file_year"), hour_floor(F.col("time")).alias("time")).agg(F.avg("value").alias("obs"))


def nation_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone, ring): seven uneven corners around the middle of each nation's customers, some of them far enough out to overlap."""
    angle = lambda k: 2 * math.pi * k / 7 + F.col("n_nationkey") * 0.37
    reach = lambda k: 3.13 + (k * 5 + F.col("n_nationkey") * 3) % 7 * 2.29
    lat, lon = F.col("n_nationkey") * 7.31 - 88.77, F.col("n_nationkey") * 14.17 - 170.39
    corner = lambda k: F.struct((lat + reach(k) * F.sin(angle(k))).alias("lat"), (lon + 6 * reach(k) * F.cos(angle(k))).alias("lon"))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("zone"), F.transform(F.sequence(F.lit(0), F.lit(6)), corner).alias("ring"))
