"""Reconstruction of daily curves from means, extremes and anchor hours, as window plans over (station, file_year, day)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from cadence.functions.clock import day_of
from cadence.functions.nulls import clip, present, ratio

#: Civil days and UTC days never span the files of two years.
UNIT = ["station", "file_year"]
STRICT_MODES = ("1pt_fixed12", "2pt_fixed_00_12_literal", "2pt_fixed_00_12_clip", "2pt_dynamic_strict")


@dataclass(frozen=True)
class AnchorPolicy:
    """Two-anchor calibration: below ``delta`` it falls back to slope 1; alpha comes from the second anchor or the mean of both."""

    delta: float = 0.5
    low: float = 0.1
    high: float = 5.0
    clipped: bool = True
    alpha_rule: str = "second"


def with_templates(hourly: DataFrame, templates: DataFrame, cell: list[str]) -> DataFrame:
    """``hourly`` with day, hour, month, the month's 24 shape values s_day, and s at the row's hour.

    Stations without any template go; a station's missing month is NULL. A
    station's templates are one row (a map of 12 months at most), so that one
    join serves both rules; Spark broadcasts them under its threshold and merges
    otherwise. Two templates of a month raise.
    """
    shapes = templates.groupBy(*cell).agg(F.map_from_entries(F.collect_list(F.struct("month", "s"))).alias("by_month"))
    dated = hourly.withColumns({"day": day_of(F.col("time")), "hour": F.hour("time"), "month": F.month("time")})
    shaped = dated.join(shapes, cell).withColumn("s_day", F.try_element_at("by_month", F.col("month"))).drop("by_month")
    return shaped.withColumn("s", F.get("s_day", F.col("hour")).cast("double"))


def of_day() -> WindowSpec:
    return Window.partitionBy(*UNIT, "day")


def at_hour(hour: int) -> Column:
    """The day's observation at the hour, for each of its rows."""
    return F.max(F.when(F.col("hour") == hour, F.col("obs"))).over(of_day())


def shape_at(hour: int) -> Column:
    return F.get("s_day", F.lit(hour)).cast("double")


def one_anchor(t: Column, s_anchor: Column, s: Column) -> Column:
    return s + (t - s_anchor)


def raw_slope(t1: Column, t2: Column, s1: Column, s2: Column) -> Column:
    return ratio(t2 - t1, s2 - s1)


def two_anchor(t1: Column, t2: Column, s1: Column, s2: Column, s: Column, policy: AnchorPolicy) -> Column:
    """The curve through two anchors; NULL unless both anchors and all three shape values are there."""
    fits = F.abs(s2 - s1) > policy.delta
    slope = raw_slope(t1, t2, s1, s2)
    slope = F.when(fits, clip(slope, policy.low, policy.high) if policy.clipped else slope).otherwise(F.lit(1.0))
    mean = ((t1 - slope * s1) + (t2 - slope * s2)) / 2
    alpha = mean if policy.alpha_rule == "mean" else F.when(fits, t2 - slope * s2).otherwise(mean)
    return F.when(present(t1, t2, s1, s2, s), alpha + slope * s)


def baseline(mean: Column, s: Column) -> Column:
    return mean + s


def scaled(mean: Column, low: Column, high: Column, s: Column, shape_range: Column, fitted_range: Column | None = None, guard: str = "eps") -> Column:
    """Mean plus the shape stretched to the day's range; ``guard`` says what a flat shape does.

    eps: slope 1 unless the shape's range is over 1e-4; unit: the range counts
    as 1 there; spec: slope 1 where the fitted range is under 0.5.
    """
    if guard == "spec":
        slope = F.when(fitted_range >= 0.5, ratio(high - low, shape_range)).otherwise(F.lit(1.0))
    elif guard == "unit":
        slope = (high - low) / F.when(shape_range > 1e-4, shape_range).otherwise(F.lit(1.0))
    else:
        slope = F.when(shape_range > 1e-4, ratio(high - low, shape_range)).otherwise(F.lit(1.0))
    return mean + slope * s


def daily_modes(shaped: DataFrame, guard: str = "eps") -> DataFrame:
    """``shaped`` with the baseline and scaled reconstructions of each row's day."""
    span = (F.array_max("s_day") - F.array_min("s_day")).cast("double")
    mean, low, high = (f("obs").over(of_day()) for f in (F.avg, F.min, F.max))
    return shaped.withColumns({"day_mean": mean, "day_min": low, "day_max": high, "span": span}).withColumns({"baseline": baseline(F.col("day_mean"), F.col("s")), "scaled": scaled(F.col("day_mean"), F.col("day_min"), F.col("day_max"), F.col("s"), F.col("span"), guard=guard)})


def anchors(shaped: DataFrame, h1: int = 0, h2: int = 12) -> DataFrame:
    """``shaped`` with the fixed anchors (t1, t2, s1, s2) and the dynamic ones, all from one window over the day.

    The dynamic anchors are the observed hours of the least and the largest
    shape value, the first on ties; hours without shape are passed over.
    """
    seen = present(F.col("s"), F.col("obs"))
    extreme = lambda v: F.min(F.when(seen, F.struct(v.alias("key"), F.col("hour").alias("hour"), F.col("obs").alias("obs"), F.col("s").alias("s")))).over(of_day())
    return shaped.withColumns({"t1": at_hour(h1), "t2": at_hour(h2), "s1": shape_at(h1), "s2": shape_at(h2), "lo": extreme(F.col("s")), "hi": extreme(-F.col("s"))})


def strict_modes(shaped: DataFrame, policy: AnchorPolicy = AnchorPolicy(), h1: int = 0, h2: int = 12) -> DataFrame:
    """The four modes of the strict validation as columns of their names, and held_<mode>: rows that are no anchor of the mode.

    One exchange by (station, file_year, day) serves all of them.
    """
    a = anchors(shaped, h1, h2)
    t1, t2, s1, s2, s, hour = (F.col(c) for c in ("t1", "t2", "s1", "s2", "s", "hour"))
    literal = AnchorPolicy(policy.delta, policy.low, policy.high, False, policy.alpha_rule)
    dynamic = F.when(F.col("lo.hour") != F.col("hi.hour"), two_anchor(F.col("lo.obs"), F.col("hi.obs"), F.col("lo.s"), F.col("hi.s"), s, policy))
    rec = dict(zip(STRICT_MODES, (one_anchor(t2, s2, s), two_anchor(t1, t2, s1, s2, s, literal), two_anchor(t1, t2, s1, s2, s, policy), dynamic)))
    fixed = ~hour.isin(h1, h2)
    held = dict(zip(STRICT_MODES, (hour != h2, fixed, fixed, F.coalesce((hour != F.col("lo.hour")) & (hour != F.col("hi.hour")), F.lit(False)))))
    return a.withColumns(rec).withColumns({f"held_{m}": h & F.col(m).isNotNull() for m, h in held.items()})


def common_mask(modes: tuple[str, ...] = STRICT_MODES, held: bool = True) -> Column:
    """Rows that count for every mode."""
    every = F.lit(True)
    for m in modes:
        every = every & (F.col(f"held_{m}") if held else F.col(m).isNotNull())
    return every
