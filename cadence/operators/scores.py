"""Scores of reconstructions: by station-month, pooled, daily, and over calibration thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.scoring import MONTHLY_SCHEMES, POOLED_SCHEMES, STRICT, ScorePolicy, merged, scores, statistics
from cadence.operators.modes import STRICT_MODES, UNIT, AnchorPolicy, anchors, common_mask, raw_slope, two_anchor
from cadence.operators.ranks import beside, quantiles

LEAST_HOURS = 24
DELTAS = (0.1, 0.25, 0.5, 1.0, 2.0)
DAILY_METRICS = ("tmean", "tmin", "tmax", "dtr")


def mode_long(rec: DataFrame, modes: tuple[str, ...] = STRICT_MODES) -> DataFrame:
    """A row for each row, mode and scope (all, heldout), with common telling whether it counts for every mode."""
    items = [F.struct(F.lit(m).alias("mode"), F.lit(scope).alias("scope"), F.col(m).alias("rec"), use.alias("use"), common_mask(modes, scope == "heldout").alias("common")) for m in modes for scope, use in (("all", F.col(m).isNotNull()), ("heldout", F.col(f"held_{m}")))]
    return rec.select(*UNIT, "time", "day", "month", "obs", F.explode(F.array(*items)).alias("x")).select(*UNIT, "time", "day", "month", "obs", "x.*")


def pooled(long: DataFrame, keys: list[str], policy: ScorePolicy = STRICT, mask: Column | None = None) -> DataFrame:
    """(keys, n, rmse, r2) in one pass of partial sums."""
    stats = statistics(F.col("obs"), F.col("rec"), F.col("use") if mask is None else mask)
    found = long.groupBy(*keys).agg(*(v.alias(k) for k, v in stats.items()))
    return found.select(*keys, "n", *(v.alias(k) for k, v in scores(policy).items()))


def pooled_by_scope(long: DataFrame) -> DataFrame:
    """(mode, scope, n, rmse, r2) over each mode's own rows and, as <scope>_common, over the rows common to all."""
    own = pooled(long, ["mode", "scope"])
    common = pooled(long, ["mode", "scope"], mask=F.col("common"))
    return own.union(common.select("mode", F.concat("scope", F.lit("_common")), "n", "rmse", "r2"))


def pooled_levels(long: DataFrame) -> DataFrame:
    """Pooled and by station from one scan, by grouping sets; station is NULL in pooled rows."""
    stats = statistics(F.col("obs"), F.col("rec"), F.col("use"))
    found = long.groupingSets([[F.col("scope"), F.col("mode")], [F.col("scope"), F.col("mode"), F.col("station")]], "scope", "mode", "station").agg(F.grouping("station").alias("is_pooled"), *(v.alias(k) for k, v in stats.items()))
    return found.select(F.when(F.col("is_pooled") == 1, "pooled").otherwise("station").alias("level"), "station", "scope", "mode", "n", *(v.alias(k) for k, v in scores(STRICT).items()))


def station_months(rec: DataFrame, modes: tuple[str, ...] = STRICT_MODES) -> DataFrame:
    """The wide table: for each station, year and month n_obs, n_common_heldout and n, rmse, r2 of each mode and scope; one pass, no pivot."""
    stats, out = [], [F.count("obs").alias("n_obs"), F.count_if(common_mask(modes)).alias("n_common_heldout")]
    names = []
    for scope in ("all", "heldout"):
        for m in modes:
            own = statistics(F.col("obs"), F.col(m), F.col(f"held_{m}") if scope == "heldout" else None)
            stats += [v.alias(f"{scope}_{m}_{k}") for k, v in own.items()]
            names.append((scope, m))
    found = rec.withColumn("year", F.year("time")).groupBy("station", "year", "month").agg(*out, *stats)
    cols = ["station", "year", "month", "n_obs"]
    for scope, m in names:
        prefix = f"{scope}_{m}_"
        cols += [F.col(f"{prefix}n").alias(f"n_{scope}_{m}"), *(v.alias(f"{k}_{scope}_{m}") for k, v in scores(STRICT, prefix).items())]
    return found.select(*cols, "n_common_heldout")


def eligibility(months: DataFrame, modes: tuple[str, ...] = STRICT_MODES, least: int = LEAST_HOURS) -> DataFrame:
    """(scope, mode, station_months, stations) with at least so many hours of the scope and a score."""
    items = F.array(*(F.struct(F.lit(s).alias("scope"), F.lit(m).alias("mode"), ((F.col(f"n_{s}_{m}") >= least) & F.col(f"rmse_{s}_{m}").isNotNull()).alias("ok")) for s in ("all", "heldout") for m in modes))
    long = months.select("station", F.explode(items).alias("x")).select("station", "x.*")
    return long.groupBy("scope", "mode").agg(F.count_if("ok").alias("station_months"), F.count_distinct(F.when(F.col("ok"), F.col("station"))).alias("stations"))


def daily_scores(long: DataFrame) -> DataFrame:
    """(scope, mode, metric, n, rmse, r2) of daily mean, minimum, maximum and range, each from the same rows for both series."""
    use = F.col("use") & F.col("obs").isNotNull() & F.col("rec").isNotNull()
    pair = lambda c: [f(F.when(use, F.col(c))).alias(f"{c}_{k}") for k, f in (("tmean", F.avg), ("tmin", F.min), ("tmax", F.max))]
    days = long.groupBy(*UNIT, "day", "scope", "mode").agg(*pair("obs"), *pair("rec"))
    days = days.withColumns({f"{c}_dtr": F.col(f"{c}_tmax") - F.col(f"{c}_tmin") for c in ("obs", "rec")})
    items = F.array(*(F.struct(F.lit(k).alias("metric"), F.col(f"obs_{k}").alias("o"), F.col(f"rec_{k}").alias("r")) for k in DAILY_METRICS))
    rows = days.select("scope", "mode", F.explode(items).alias("x")).select("scope", "mode", "x.metric", F.col("x.o").alias("obs"), F.col("x.r").alias("rec"))
    return pooled(rows, ["scope", "mode", "metric"], mask=F.lit(True))


def day_diagnostics(rec: DataFrame, delta: float = 0.5) -> DataFrame:
    """Counts of days with both anchors: fitted, fallback, and raw slopes below 0, below 0.1 and above 5."""
    days = rec.groupBy(*UNIT, "day").agg(*(F.any_value(c, True).alias(c) for c in ("t1", "t2", "s1", "s2"))).dropna(subset=["t1", "t2", "s1", "s2"])
    fits = F.abs(F.col("s2") - F.col("s1")) > delta
    slope = F.when(fits, raw_slope(F.col("t1"), F.col("t2"), F.col("s1"), F.col("s2")))
    named = {"anchor_days": F.lit(True), "fit_days": fits, "fallback_days": ~fits, "slope_below_0": slope < 0, "slope_below_01": slope < 0.1, "slope_above_5": slope > 5}
    return days.agg(*(F.count_if(v).alias(k) for k, v in named.items()))


def delta_sensitivity(shaped: DataFrame, deltas: tuple[float, ...] = DELTAS, h1: int = 0, h2: int = 12) -> DataFrame:
    """(delta, n, rmse, r2) of the clipped two-anchor mode on held-out hours; the anchors are found once for all thresholds."""
    a = anchors(shaped, h1, h2).where(~F.col("hour").isin(h1, h2))
    t = [F.col(c) for c in ("t1", "t2", "s1", "s2", "s")]
    items = F.array(*(F.struct(F.lit(d).alias("delta"), two_anchor(*t, AnchorPolicy(d)).alias("rec")) for d in deltas))
    return pooled(a.select("obs", F.explode(items).alias("x")).select("obs", "x.*"), ["delta"], mask=F.lit(True))


def scheme_summary(long: DataFrame) -> DataFrame:
    """(mode, scope, n, rmse, r2) of the six schemes on their own held-out rows and on those common to all."""
    own = pooled(long, ["mode"], POOLED_SCHEMES, F.col("held"))
    common = pooled(long, ["mode"], POOLED_SCHEMES, F.col("common"))
    return own.select("mode", F.lit("own").alias("scope"), "n", "rmse", "r2").union(common.select("mode", F.lit("common"), "n", "rmse", "r2"))


def scheme_months(long: DataFrame) -> DataFrame:
    """(station, mode, year, month, n, rmse, r2): files' sums are merged by month before they are scored."""
    stats = statistics(F.col("obs"), F.col("rec"), F.col("held"))
    parts = long.groupBy("station", "file_year", "mode", "year", "month").agg(*(v.alias(k) for k, v in stats.items())).where("n > 0")
    found = parts.groupBy("station", "mode", "year", "month").agg(*(v.alias(k) for k, v in merged().items()))
    return found.select("station", "mode", "year", "month", "n", *(v.alias(k) for k, v in scores(MONTHLY_SCHEMES).items()))


def threshold_summary(months: DataFrame, thresholds: tuple[int, ...] = (24, 100, 240)) -> DataFrame:
    """(mode, threshold_h, n_station_months, r2_median, r2_iqr, share_r2_lt_0, share_r2_lt_02) of months with so many hours."""
    spread = months.select("mode", "n", "r2", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold_h")).where("n >= threshold_h and r2 is not null")
    keys, q = ["mode", "threshold_h"], F.col("q")
    found = spread.groupBy(*keys).agg(F.count("*").alias("n_station_months"), F.avg((F.col("r2") < 0).cast("int")).alias("share_r2_lt_0"), F.avg((F.col("r2") < 0.2).cast("int")).alias("share_r2_lt_02"))
    found = beside(found, quantiles(spread, keys, {"q": F.col("r2")}, [0.25, 0.5, 0.75]), keys)
    return found.select(*keys, "n_station_months", q[1].alias("r2_median"), (q[2] - q[0]).alias("r2_iqr"), "share_r2_lt_0", "share_r2_lt_02")


def scheme_map(long: DataFrame, least: int = LEAST_HOURS) -> DataFrame:
    """(station, file_year, mode, n, rmse, r2): a row for each file, as its parts are."""
    return pooled(long, ["station", "file_year", "mode"], POOLED_SCHEMES, F.col("held")).where(F.col("n") >= least)


def scheme_qa(rec: DataFrame, delta: float = 0.5) -> DataFrame:
    """(clock, days, days_23, days_25, two_anchor_days, fallback_rate, clip_rate, and the largest and the 95th percentile of the minutes by which either anchor is off) of the UTC and the civil clock."""
    out = None
    for clock, day, a, b, rows in (("utc", "day", "u00", "u12", "utc_rows"), ("civil", "local_day", "l00", "l12", "local_rows")):
        days = rec.groupBy(*UNIT, day).agg(F.any_value(rows).alias("rows"), F.any_value(a, True).alias("a"), F.any_value(b, True).alias("b"))
        both = F.col("a.s").isNotNull() & F.col("b.s").isNotNull() & (F.col("a.time") != F.col("b.time"))
        fits = both & (F.abs(F.col("b.s") - F.col("a.s")) > delta)
        slope = F.when(fits, F.try_divide(F.col("b.obs") - F.col("a.obs"), F.col("b.s") - F.col("a.s")))
        n = F.count_if(both)
        found = days.agg(
            F.lit(clock).alias("clock"), F.count("*").alias("days"), F.count_if(F.col("rows") == 23).alias("days_23"), F.count_if(F.col("rows") == 25).alias("days_25"), n.alias("two_anchor_days"),
            F.try_divide(F.count_if(both & ~fits), n).alias("fallback_rate"), F.try_divide(F.count_if((slope < 0.1) | (slope > 5)), n).alias("clip_rate"),
            *(F.max(F.col(f"{c}.away") * 60).alias(f"away_{h}_max") for c, h in (("a", "00"), ("b", "12"))),
        )
        off = quantiles(days, [], {f"away_{h}_p95": F.col(f"{c}.away") * 60 for c, h in (("a", "00"), ("b", "12"))}, [0.95])
        found = beside(found, off.select(*(F.col(c)[0].alias(c) for c in off.columns)), [])
        out = found if out is None else out.union(found)
    return out
