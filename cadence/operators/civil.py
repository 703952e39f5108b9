"""Six anchor schemes on the UTC and the civil clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from cadence.functions.clock import civil_time, clock_distance, day_of
from cadence.functions.nulls import present
from cadence.operators.modes import UNIT, AnchorPolicy, one_anchor, two_anchor

SCHEMES = ("1pt_utc00", "1pt_utc12", "1pt_local00", "1pt_local12", "2pt_utc00_12", "2pt_local00_12")
TOLERANCE = 0.5 + 1e-9
POLICY = AnchorPolicy(alpha_rule="mean")
LEAST_PER_DAY = 4


def with_civil_time(shaped: DataFrame, zones: DataFrame) -> DataFrame:
    """``shaped`` with local, local_day and local_hour (with minutes) by the station's zone; no zone is UTC. The template stays that of the UTC hour."""
    zoned = shaped.join(zones.select("station", "tz"), "station", "left").withColumn("local", civil_time(F.col("time"), F.col("tz")))
    return zoned.withColumns({"local_day": day_of(F.col("local")), "local_hour": F.hour("local") + F.minute("local") / F.lit(60.0)})


def _nearest(target: float, hour: Column, day: WindowSpec) -> Column:
    """The day's row nearest to the target on the clock, the earliest on ties; NULL beyond the tolerance."""
    row = F.struct(clock_distance(hour, target).alias("away"), F.col("time").alias("time"), F.col("obs").alias("obs"), F.col("s").alias("s"))
    best = F.min(row).over(day)
    return F.when(best["away"] <= TOLERANCE, best)


def six_schemes(civil: DataFrame, least: int = LEAST_PER_DAY, policy: AnchorPolicy = POLICY) -> DataFrame:
    """The six schemes as columns, anchor_<scheme> for rows that are its anchors, and the days' counts and anchors.

    Days with fewer than ``least`` rows have none. A day's two anchors have to
    be two rows. Calibration takes the mean of both residuals.
    """
    utc, local = Window.partitionBy(*UNIT, "day"), Window.partitionBy(*UNIT, "local_day")
    out = civil.withColumns({"utc_rows": F.count("*").over(utc), "local_rows": F.count("*").over(local)})
    hour = F.col("hour").cast("double")
    for name, target, clock, day, rows in (("u00", 0, hour, utc, "utc_rows"), ("u12", 12, hour, utc, "utc_rows"), ("l00", 0, F.col("local_hour"), local, "local_rows"), ("l12", 12, F.col("local_hour"), local, "local_rows")):
        out = out.withColumn(name, F.when(F.col(rows) >= least, _nearest(target, clock, day)))
    s = F.col("s")
    single = lambda a: one_anchor(F.col(f"{a}.obs"), F.col(f"{a}.s"), s)
    double = lambda a, b: F.when(F.col(f"{a}.time") != F.col(f"{b}.time"), two_anchor(F.col(f"{a}.obs"), F.col(f"{b}.obs"), F.col(f"{a}.s"), F.col(f"{b}.s"), s, policy))
    rec = {"1pt_utc00": single("u00"), "1pt_utc12": single("u12"), "1pt_local00": single("l00"), "1pt_local12": single("l12"), "2pt_utc00_12": double("u00", "u12"), "2pt_local00_12": double("l00", "l12")}
    at = lambda *names: F.coalesce(F.greatest(*(F.coalesce(F.col("time") == F.col(f"{n}.time"), F.lit(False)) for n in names)) if len(names) > 1 else F.col("time") == F.col(f"{names[0]}.time"), F.lit(False))
    uses = {"1pt_utc00": ("u00",), "1pt_utc12": ("u12",), "1pt_local00": ("l00",), "1pt_local12": ("l12",), "2pt_utc00_12": ("u00", "u12"), "2pt_local00_12": ("l00", "l12")}
    return out.withColumns(rec).withColumns({f"anchor_{m}": at(*uses[m]) for m in SCHEMES})


def common_rows(rec: DataFrame) -> Column:
    """All six there, and an anchor of none."""
    every = present(F.col("obs"), *(F.col(m) for m in SCHEMES))
    for m in SCHEMES:
        every = every & ~F.col(f"anchor_{m}")
    return every


def scheme_long(rec: DataFrame) -> DataFrame:
    """(station, file_year, mode, year, month, obs, rec, held, common): a row for each row and scheme; months are local for civil schemes."""
    at = lambda f, m: f(F.col("local") if "local" in m else F.col("time"))
    items = F.array(*(F.struct(F.lit(m).alias("mode"), F.col(m).alias("rec"), (F.col(m).isNotNull() & ~F.col(f"anchor_{m}")).alias("held"), at(F.year, m).alias("year"), at(F.month, m).alias("month")) for m in SCHEMES))
    return rec.select("station", "file_year", "obs", common_rows(rec).alias("common"), F.explode(items).alias("x")).select("station", "file_year", "obs", "common", "x.*")
