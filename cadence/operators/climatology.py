"""Month-by-hour climatologies of cells, and the checks before fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def climatology(hourly: DataFrame, cell: list[str], time: str = "time", value: str = "obs") -> DataFrame:
    """(cell, month, hour, t): the mean over all years, in one pass."""
    return hourly.groupBy(*cell, F.month(time).alias("month"), F.hour(time).alias("hour")).agg(F.avg(value).alias("t"))


def valid_cells(clim: DataFrame, cell: list[str], above: float = 0.5) -> DataFrame:
    """(cell, valid_fraction, is_valid): the share of the 288 month-hour slots that have a value, valid if strictly above."""
    share = F.count("t") / F.lit(288.0)
    return clim.groupBy(*cell).agg(share.alias("valid_fraction"), (share > above).alias("is_valid"))


def detrended(clim: DataFrame, cell: list[str]) -> DataFrame:
    """``clim`` with t_mean, the mean of the month's hourly means, and y = t - t_mean."""
    month = Window.partitionBy(*cell, "month")
    return clim.withColumn("t_mean", F.avg("t").over(month)).withColumn("y", F.col("t") - F.col("t_mean"))


def precheck(clim: DataFrame, cell: list[str], mask: DataFrame | None = None) -> DataFrame:
    """(cell, month, n_hours, t_range, t_std, ok): 12 hours at least, range within (0.5, 40), spread above 0.1, and the cell's mask."""
    checked = clim.groupBy(*cell, "month").agg(F.count("t").alias("n_hours"), (F.max("t") - F.min("t")).alias("t_range"), F.stddev_pop("t").alias("t_std"))
    ok = (F.col("n_hours") >= 12) & (F.col("t_range") > 0.5) & (F.col("t_range") < 40) & (F.col("t_std") > 0.1)
    if mask is not None:
        checked = checked.join(mask.select(*cell, "is_valid"), cell, "left")
        ok = ok & F.coalesce("is_valid", F.lit(False))
    return checked.select(*cell, "month", "n_hours", "t_range", "t_std", F.coalesce(ok, F.lit(False)).alias("ok"))


def checked(clim: DataFrame, cell: list[str], above: float = 0.5) -> DataFrame:
    """``clim`` with valid_fraction, n_hours, t_range, t_std, ok, t_mean and y: what valid_cells(), precheck(), detrended() and masked() give, as windows of one exchange by cell.

    y is NULL in months that fail, t_mean in cells of which all months do. A
    cell has 288 rows at most.
    """
    whole, month = Window.partitionBy(*cell), Window.partitionBy(*cell, "month")
    found = clim.withColumn("valid_fraction", F.count("t").over(whole) / F.lit(288.0))
    found = found.withColumns({"n_hours": F.count("t").over(month), "t_range": F.max("t").over(month) - F.min("t").over(month), "t_std": F.stddev_pop("t").over(month), "t_mean": F.avg("t").over(month)})
    ok = (F.col("valid_fraction") > above) & (F.col("n_hours") >= 12) & (F.col("t_range") > 0.5) & (F.col("t_range") < 40) & (F.col("t_std") > 0.1)
    found = found.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("__some", F.max("ok").over(whole))
    return found.withColumns({"y": F.when(F.col("ok"), F.col("t") - F.col("t_mean")), "t_mean": F.when(F.col("__some"), F.col("t_mean"))}).drop("__some")


def masked(detrended: DataFrame, checked: DataFrame, cell: list[str]) -> DataFrame:
    """``detrended`` with y only in months that passed the precheck, and t_mean only in cells of which some month did; what is fitted."""
    joined = detrended.join(checked.select(*cell, "month", "ok"), [*cell, "month"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    some = F.max("ok").over(Window.partitionBy(*cell))
    return joined.withColumns({"y": F.when(F.col("ok"), F.col("y")), "t_mean": F.when(some, F.col("t_mean"))}).drop("ok")
