"""One-anchor and two-anchor modes on exactly the same hours, and what their distributions show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.scoring import STRICT, scores, statistics
from cadence.operators.ranks import beside, ranked
from cadence.operators.ranks import quantiles as grouped_quantiles

ONE, TWO = "1pt_fixed12", "2pt_fixed_00_12_clip"


def common_hour_months(rec: DataFrame, one: str = ONE, two: str = TWO) -> DataFrame:
    """(station, year, month, n, rmse_1pt, r2_1pt, rmse_2pt, r2_2pt) over the hours other than 00 and 12 that both modes have."""
    both = F.col(one).isNotNull() & F.col(two).isNotNull() & ~F.col("hour").isin(0, 12)
    stats = [v.alias(f"{p}_{k}") for p, m in (("a", one), ("b", two)) for k, v in statistics(F.col("obs"), F.col(m), both).items()]
    found = rec.withColumn("year", F.year("time")).groupBy("station", "year", "month").agg(*stats).where("a_n > 0")
    a, b = scores(STRICT, "a_"), scores(STRICT, "b_")
    return found.select("station", "year", "month", F.col("a_n").alias("n"), a["rmse"].alias("rmse_1pt"), a["r2"].alias("r2_1pt"), b["rmse"].alias("rmse_2pt"), b["r2"].alias("r2_2pt"))


def paired_summary(months: DataFrame, least: int = 24) -> DataFrame:
    """Eligible months and stations, the shares in which two anchors are better, and quartiles of the improvement."""
    ok = months.where((F.col("n") >= least) & F.col("rmse_1pt").isNotNull() & F.col("rmse_2pt").isNotNull())
    gain = F.col("rmse_1pt") - F.col("rmse_2pt")
    share = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    found = ok.agg(F.count("*").alias("eligible_station_months"), F.count_distinct("station").alias("unique_stations"), share(F.col("rmse_2pt") < F.col("rmse_1pt")).alias("two_lower_rmse_percent"), share(F.col("r2_2pt") > F.col("r2_1pt")).alias("two_higher_r2_percent"))
    q = grouped_quantiles(ok, [], {"q": gain}, [0.25, 0.5, 0.75])
    return beside(found, q, []).select(*found.columns, *(F.col("q")[i].alias(f"{k}_improvement") for i, k in ((1, "median"), (0, "q25"), (2, "q75"))))


def quantiles(values: DataFrame, value: Column, shares: list[float]) -> DataFrame:
    """One row: q, the exact quantiles by linear interpolation (NULLs without values), and the total of the values."""
    rows = values.select(value.cast("double").alias("v")).where("v is not null")
    found = beside(rows.agg(F.count("*").alias("total")), grouped_quantiles(rows, [], {"q": F.col("v")}, shares), [])
    return found.select(F.coalesce("q", F.array(*(F.lit(None).cast("double") for _ in shares))).alias("q"), "total")


def histogram(values: DataFrame, value: Column, bins: int = 95, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(bin, left_edge, weight) of equal bins between two quantiles; weights are percents of all values, the last bin holds its right edge."""
    rows = values.select(value.alias("v")).where("v is not null")
    edges = quantiles(rows, F.col("v"), [low, high]).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "total")
    joined = rows.join(F.broadcast(edges)).where("v >= lo and v <= hi")
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return joined.groupBy(place.alias("bin"), (F.col("lo") + place * width).alias("left_edge")).agg((F.sum(F.lit(100.0) / F.col("total"))).alias("weight"))


def ecdf(values: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``values`` with fraction k / n, k the row's place by value within its keys; equal values have places of their own."""
    ties = [c for c in ("station", "year", "month") if c in values.columns]
    return ranked(values, value, keys, ties).withColumn("fraction", F.col("place") / F.col("total")).drop("place", "total")


def binned_2d(values: DataFrame, x: Column, y: Column, x_width: float, y_width: float, y_floor: float | None = None) -> DataFrame:
    """(x_bin, y_bin, n, log10_n) on a square grid; y is clipped from below."""
    y = y if y_floor is None else F.greatest(y, F.lit(y_floor))
    rows = values.select(x.alias("x"), F.when(y.isNotNull(), y).alias("y")).where("x is not null and y is not null")
    found = rows.groupBy(F.floor(F.col("x") / x_width).cast("int").alias("x_bin"), F.floor(F.col("y") / y_width).cast("int").alias("y_bin")).agg(F.count("*").alias("n"))
    return found.withColumn("log10_n", F.log10("n"))


def plot_limit(values: DataFrame, columns: list[str], least: float = 4.0, q: float = 0.995) -> DataFrame:
    """The larger of ``least`` and the quantile of all columns together."""
    rows = values.select(F.explode(F.array(*columns)).alias("v")).where("v is not null")
    return quantiles(rows, F.col("v"), [q]).select(F.greatest(F.lit(least), F.col("q")[0]).alias("plot_limit"))
