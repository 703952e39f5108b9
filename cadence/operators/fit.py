"""Weighted ridge fit of two harmonics by normal equations, and what is told from the fitted curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.functions.harmonics import amplitude_phase, basis, shape
from cadence.functions.nulls import clip
from cadence.operators.ranks import beside, quantiles

RIDGE = 1e-8
PARAMETERS = ("a1", "phi1", "a2", "phi2")


def ridge_fit(detrended: DataFrame, cell: list[str], least_hours: int = 12, ridge: float = RIDGE, beside: dict[str, Column] = {}) -> DataFrame:
    """(cell, month, n_hours, c1..c4, and the aggregates of ``beside``): 14 sums for each cell and month, then the 4 x 4 system in columns; NULL under ``least_hours``.

    Missing hours weigh nothing. The factors of the system (unit lower
    triangular and diagonal) are columns of their own, so that each is computed
    once.
    """
    x = basis(F.col("hour"))
    use = F.col("y").isNotNull()
    total = lambda v: F.sum(F.when(use, v))
    sums = {f"m{i}{j}": total(x[i - 1] * x[j - 1]) for i in range(1, 5) for j in range(1, i + 1)} | {f"r{i}": total(x[i - 1] * F.col("y")) for i in range(1, 5)}
    out = detrended.groupBy(*cell, "month").agg(F.count("y").alias("n_hours"), *(v.alias(k) for k, v in (sums | beside).items()))
    col = F.col
    out = out.withColumns({f"m{i}{i}": col(f"m{i}{i}") + ridge for i in range(1, 5)})
    for j in range(1, 5):  # factor column by column
        out = out.withColumn(f"d{j}", sum((-col(f"l{j}{k}") * col(f"l{j}{k}") * col(f"d{k}") for k in range(1, j)), col(f"m{j}{j}")))
        for i in range(j + 1, 5):
            out = out.withColumn(f"l{i}{j}", sum((-col(f"l{i}{k}") * col(f"l{j}{k}") * col(f"d{k}") for k in range(1, j)), col(f"m{i}{j}")) / col(f"d{j}"))
    for i in range(1, 5):
        out = out.withColumn(f"z{i}", sum((-col(f"l{i}{k}") * col(f"z{k}") for k in range(1, i)), col(f"r{i}")))
    for i in range(4, 0, -1):
        out = out.withColumn(f"c{i}", sum((-col(f"l{k}{i}") * col(f"c{k}") for k in range(i + 1, 5)), col(f"z{i}") / col(f"d{i}")))
    return out.select(*cell, "month", "n_hours", *(F.when(col("n_hours") >= least_hours, col(f"c{i}")).alias(f"c{i}") for i in range(1, 5)), *beside)


def parameters(fitted: DataFrame, cell: list[str], beside: list[str] = []) -> DataFrame:
    """(cell, month, a1, phi1, a2, phi2, and the columns of ``beside``) as float, the form in which they are stored and used.

    They leave a group of one row each, which needs no exchange and keeps the
    solution of the system from being copied into every place where a parameter
    is used.
    """
    a1, phi1 = amplitude_phase(F.col("c1"), F.col("c2"))
    a2, phi2 = amplitude_phase(F.col("c3"), F.col("c4"))
    found = fitted.select(*cell, "month", *(v.cast("float").alias(k) for k, v in zip(PARAMETERS, (a1, phi1, a2, phi2))), *beside)
    return found.groupBy(*cell, "month").agg(*(F.any_value(c).alias(c) for c in (*PARAMETERS, *beside)))


def wide(c: str) -> Column:
    """A stored parameter as double."""
    return F.col(c).cast("double")


def fit_metrics(detrended: DataFrame, params: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, month, r_squared, rmse, dtr_observed): errors of the stored curve at the hours with a value; observed ranges up to 1e-6 are NULL."""
    joined = detrended.join(params, [*cell, "month"]).withColumn("e", F.col("y") - shape(F.col("hour"), *(wide(p) for p in PARAMETERS)))
    found = joined.groupBy(*cell, "month").agg(F.sum(F.col("e") * F.col("e")).alias("sse"), F.sum(F.col("y") * F.col("y")).alias("sst"), F.avg(F.col("e") * F.col("e")).alias("mse"), (F.max("y") - F.min("y")).alias("dtr_observed"))
    r2 = clip(F.when(F.col("sst") > 1e-6, 1 - F.col("sse") / F.col("sst")), 0.0, 1.0)
    return found.select(*cell, "month", r2.cast("float").alias("r_squared"), F.sqrt("mse").cast("float").alias("rmse"), F.when(F.col("dtr_observed") > 1e-6, F.col("dtr_observed")).alias("dtr_observed"))


def fine_curve(params: DataFrame) -> DataFrame:
    """``params`` with dtr_fitted, tmax_hour and tmin_hour of the curve at every tenth of an hour; the first of equal extremes counts."""
    curve = F.transform(F.sequence(F.lit(0), F.lit(239)), lambda i: shape(i * 0.1, *(wide(p) for p in PARAMETERS)))
    fitted = F.col("a1").isNotNull()
    out = params.withColumn("curve", F.when(fitted, curve))
    at = lambda f: ((F.array_position("curve", f("curve")) - 1) * 0.1).cast("float")
    return out.withColumns({"dtr_fitted": (F.array_max("curve") - F.array_min("curve")).cast("float"), "tmax_hour": at(F.array_max), "tmin_hour": at(F.array_min)}).drop("curve")


def quality(params: DataFrame, metrics: DataFrame, checked: DataFrame, cell: list[str]) -> DataFrame:
    """The archive: parameters, metrics, quality_flag, and skipped, which is 1 where no month of the cell passed the precheck."""
    joined = fine_curve(params).join(metrics, [*cell, "month"], "left").join(checked.select(*cell, "month", "ok"), [*cell, "month"], "left")
    return _flagged(joined.withColumn("__some", F.max(F.coalesce("ok", F.lit(False))).over(Window.partitionBy(*cell))))


def archive(checked: DataFrame, cell: list[str]) -> DataFrame:
    """What quality() gives, with t_mean, from climatology.checked(): no join, and no exchange but that of the checks by cell.

    A month's hours, 24 at most, go through the sums as an array, from which the
    errors of its stored curve are taken.
    """
    hours = F.collect_list(F.when(F.col("y").isNotNull(), F.struct("hour", "y")))
    fitted = ridge_fit(checked, cell, beside={"hours": hours, "ok": F.any_value("ok"), "t_mean": F.any_value("t_mean")})
    found = parameters(fitted, cell, ["hours", "ok", "t_mean"]).withColumn("__some", F.max("ok").over(Window.partitionBy(*cell)))
    known = [wide(p) for p in PARAMETERS]
    found = found.withColumn("pairs", F.transform("hours", lambda x: F.struct(x["y"].alias("y"), (x["y"] - shape(x["hour"], *known)).alias("e"))))
    total = lambda c: F.when(F.size("pairs") > 0, F.aggregate("pairs", F.lit(0.0), lambda acc, x: acc + x[c] * x[c]))
    found = found.withColumns({"sse": total("e"), "sst": total("y"), "dtr_observed": F.array_max("pairs.y") - F.array_min("pairs.y")})
    r2 = clip(F.when(F.col("sst") > 1e-6, 1 - F.col("sse") / F.col("sst")), 0.0, 1.0)
    found = found.withColumns({"r_squared": r2.cast("float"), "rmse": F.sqrt(F.col("sse") / F.size("pairs")).cast("float"), "dtr_observed": F.when(F.col("dtr_observed") > 1e-6, F.col("dtr_observed"))})
    return _flagged(fine_curve(found.drop("hours", "pairs", "sse", "sst")))


def _flagged(found: DataFrame) -> DataFrame:
    off = F.try_divide(F.abs(wide("dtr_fitted") - F.col("dtr_observed")), F.col("dtr_observed"))
    good = (wide("r_squared") > 0.75) & (wide("dtr_fitted") > 0.5) & (wide("dtr_fitted") < 35) & (wide("rmse") < 2.0) & F.coalesce(off < 0.4, F.lit(True))
    return found.withColumns({"quality_flag": F.coalesce(good.cast("tinyint"), F.lit(0).cast("tinyint")), "skipped": (~F.col("__some")).cast("tinyint")}).drop("ok", "__some")


def archive_summary(archive: DataFrame) -> DataFrame:
    """Totals, shares of good and skipped rows (the others are fitted), median R2 and the share above 0.8."""
    n, fitted = F.count("*"), F.count("r_squared")
    found = archive.agg(
        n.alias("total"), (n - F.count_if(F.col("skipped") == 1)).alias("fitted"), F.count_if(F.col("quality_flag") == 1).alias("good"), F.count_if(F.col("skipped") == 1).alias("skipped"),
        F.try_divide(100.0 * F.count_if(F.col("quality_flag") == 1), n).alias("good_percent"), F.try_divide(100.0 * F.count_if(F.col("skipped") == 1), n).alias("skipped_percent"),
        F.try_divide(100.0 * F.count_if(wide("r_squared") > 0.8), fitted).alias("r2_above_08_percent"),
    )
    return beside(found, quantiles(archive, [], {"q": wide("r_squared")}, [0.5]).select(F.col("q")[0].alias("median_r2")), [])


def templates(params: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, month, s, shape_range): the 24 hourly shape values as float, NULL where a parameter is."""
    known = F.col("a1").isNotNull() & F.col("phi1").isNotNull() & F.col("a2").isNotNull() & F.col("phi2").isNotNull()
    s = F.when(known, F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: shape(h, *(wide(p) for p in PARAMETERS)).cast("float")))
    return params.withColumn("s", s).select(*cell, "month", "s", (F.array_max("s") - F.array_min("s")).alias("shape_range"))
