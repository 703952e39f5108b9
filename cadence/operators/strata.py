"""Station-months by strata of their stations and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.operators.modes import STRICT_MODES
from cadence.operators.ranks import beside, quantiles

#: Labels in the order reports show them; so are the names coastal_group, elevdiff_group, latitude_band and N_hours of the reports' columns.
ELEVATION = ("<100 m", "100-250 m", "250-500 m", ">=500 m")
LATITUDE = ("60-90S", "30-60S", "0-30S", "0-30N", "30-60N", "60-90N")
SEASONS = ("DJF", "MAM", "JJA", "SON")


def elevation_bin(x: Column) -> Column:
    """Left-closed bins of the absolute elevation difference; NULL stays NULL."""
    return F.when(x < 0, None).when(x < 100, ELEVATION[0]).when(x < 250, ELEVATION[1]).when(x < 500, ELEVATION[2]).when(x >= 500, ELEVATION[3])


def latitude_bin(x: Column) -> Column:
    """Right-closed bins, -90 included."""
    out = F.when((x < -90) | (x > 90), None)
    for edge, label in zip((-60, -30, 0, 30, 60, 90), LATITUDE):
        out = out.when(x <= edge, label)
    return out


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), SEASONS[0]).when(month.isin(3, 4, 5), SEASONS[1]).when(month.isin(6, 7, 8), SEASONS[2]).otherwise(SEASONS[3])


def coastal(flag: Column) -> Column:
    """Unknown counts as inland."""
    return F.when(F.coalesce(flag, F.lit(False)), "Coastal (<=30 km)").otherwise("Inland (>30 km)")


def order_of(label: Column, labels: tuple[str, ...]) -> Column:
    """The label's place in reports."""
    return F.array_position(F.array(*map(F.lit, labels)), label).cast("int")


def with_features(months: DataFrame, features: DataFrame) -> DataFrame:
    """Left join of station-months with the features of their stations, and the strata's labels.

    Raises at run time, inside the plan, where a station has two rows of
    features; the join rate is checked by gated().
    """
    once = features.groupBy("station").agg(*(F.any_value(c).alias(c) for c in features.columns if c != "station"), F.count("*").alias("copies"))
    once = once.withColumn("known", F.when(F.col("copies") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("two rows of features: "), "station")).cast("boolean"))).drop("copies")
    joined = months.join(once, "station", "left")
    return joined.withColumns({"coastal_group": coastal(F.col("coastal_30km")), "elevdiff_group": elevation_bin(F.col("abs_elev_diff_m")), "latitude_band": latitude_bin(F.col("lat")), "season": season(F.col("month"))})


def join_rate(joined: DataFrame) -> DataFrame:
    """(rows, joined_rows, rate)."""
    return joined.agg(F.count("*").alias("rows"), F.count("known").alias("joined_rows"), F.try_divide(F.count("known").cast("double"), F.count("*")).alias("rate"))


def gated(joined: DataFrame, least: float = 0.95) -> DataFrame:
    """``joined``, after a check that raises where fewer rows than that share have features; no rows pass."""
    rate = join_rate(joined).first().rate
    if rate is not None and rate < least:
        raise ValueError(f"only {rate:.2%} of rows have features")
    return joined


def mode_months(joined: DataFrame, modes: tuple[str, ...] = STRICT_MODES) -> DataFrame:
    """A row for each station-month and mode: n, rmse and r2 of its held-out hours."""
    others = [c for c in joined.columns if not c.startswith(("n_", "rmse_", "r2_"))]
    items = F.array(*(F.struct(F.lit(m).alias("mode"), F.col(f"n_heldout_{m}").alias("n"), F.col(f"rmse_heldout_{m}").alias("rmse"), F.col(f"r2_heldout_{m}").alias("r2")) for m in modes))
    return joined.select(*others, F.explode(items).alias("x")).select(*others, "x.*")


def stratum_scores(long: DataFrame, group: str, least: int = 24) -> DataFrame:
    """(group, mode, N_hours, n_station_months, n_stations, rmse_pooled and quartiles) of months with enough hours.

    Groups stay that have no such month, with zeros and NULLs, and so does the
    NULL group.
    """
    ok = (F.col("n") >= least) & F.col("rmse").isNotNull()
    pick = lambda c: F.when(ok, F.col(c))
    n = F.sum(pick("n"))
    found = long.groupBy(group, "mode").agg(
        F.coalesce(n, F.lit(0)).cast("long").alias("N_hours"), F.count_if(ok).alias("n_station_months"), F.count_distinct(F.when(ok, F.col("station"))).alias("n_stations"),
        F.sqrt(F.try_divide(F.sum(F.when(ok, F.col("n") * F.col("rmse") * F.col("rmse"))), n)).alias("rmse_pooled"),
    )
    q = quantiles(long, [group, "mode"], {"__rmse": pick("rmse"), "__r2": pick("r2")}, [0.25, 0.5, 0.75])
    places = ((1, "median"), (0, "q25"), (2, "q75"))
    return beside(found, q, [group, "mode"]).select(*found.columns, *(F.col(f"__{c}")[i].alias(f"{c}_{k}") for c in ("rmse", "r2") for i, k in places))
