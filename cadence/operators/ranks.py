"""Places and exact quantiles of groups of any size: equal values are counted first, and what is ordered in one task is the kinds of one slice.

A double is looked at three times: by the step of its logarithm, rounded to a
float, and as it is. Each is in the order of the next, so that the rows before a
value are those in earlier steps, those of its step in earlier floats, and those
of its float with lesser values. A group has some thousands of steps, a step has
200,000 floats at most, and a float holds the doubles that differ only behind
its seventh digit (beyond the range of floats, all of its step).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Steps of a factor e, and what lifts the least of them above 0.
STEPS, LIFT = 64, 64 * 746


def _step(v: Column) -> Column:
    """Grows with the value; 0 for 0, the last for infinity. Logarithms never fall where their argument grows."""
    step = lambda x: F.floor(F.least(F.log(x) * STEPS, F.lit(1e6))).cast("int") + LIFT
    return F.when(v > 0, step(v)).when(v < 0, -step(-v)).otherwise(0)


def _sliced(counted: DataFrame, v: str) -> DataFrame:
    return counted.withColumns({"__step": _step(F.col(v)), "__float": F.col(v).cast("float")})


def _summed(counted: DataFrame, within: list[str], by: str) -> DataFrame:
    """(within, by, __n, __before, __all): rows of each ``by``, those before it, and all of the group; orders one row for each ``by``."""
    own = counted.groupBy(*within, by).agg(F.sum("__n").alias("__n"))
    group = Window.partitionBy(*within)
    before = F.sum("__n").over(group.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    return own.select(*within, by, "__n", before.alias("__before"), F.sum("__n").over(group).alias("__all"))


def _holds(ranks: list[Column], before: Column) -> Column:
    """Whether one of the ranks (from 0) is among the rows that follow ``before``."""
    found = F.lit(False)
    for r in ranks:
        found = found | ((before <= r) & (r < before + F.col("__n")))
    return found


def quantiles(rows: DataFrame, keys: list[str], values: dict[str, Column], shares: list[float]) -> DataFrame:
    """(keys, and for each of ``values`` the array of its exact quantiles by linear interpolation), for the groups that have one of them.

    NULLs and NaN do not count. Values are counted where they are read; then each
    look drops all slices that hold none of the ranks asked for, so that what is
    ordered in a task is the steps of a group, the floats of a step, the values of
    a float. Groups, NULL keys among them, may be of any size.
    """
    key = F.struct(*keys) if keys else F.lit(0)
    items = F.array(*(F.struct(F.lit(m).alias("m"), v.cast("double").alias("v")) for m, v in values.items()))
    long = rows.select(key.alias("__k"), F.explode(items).alias("x")).select("__k", "x.m", "x.v").where("v is not null and not isnan(v)")
    counted = _sliced(long.groupBy("__k", "m", "v").agg(F.count("*").alias("__n")), "v")

    def ranks(total: str) -> list[Column]:
        return [f((F.col(total) - 1) * F.lit(float(s))) for s in shares for f in (F.floor, F.ceil)]

    steps = _summed(counted, ["__k", "m"], "__step").where(_holds(ranks("__all"), F.col("__before")))
    steps = steps.select("__k", "m", "__step", F.col("__before").alias("__b1"), F.col("__all").alias("__total"))
    # an inner join, as a semi-join would be pushed below the counting, which is then done twice
    floats = _summed(counted.join(steps.select("__k", "m", "__step"), ["__k", "m", "__step"]), ["__k", "m", "__step"], "__float")
    floats = floats.join(steps, ["__k", "m", "__step"]).withColumn("__b2", F.col("__b1") + F.col("__before")).where(_holds(ranks("__total"), F.col("__b2")))
    floats = floats.select("__k", "m", "__step", "__float", "__b2", "__total")
    one = Window.partitionBy("__k", "m", "__step", "__float").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = counted.join(floats, ["__k", "m", "__step", "__float"]).withColumn("__b3", F.col("__b2") + F.sum("__n").over(one) - F.col("__n"))

    def quantile(m: str, share: float) -> Column:
        at = (F.col("__total") - 1) * F.lit(float(share))
        pick = lambda r: F.max(F.when((F.col("m") == m) & (F.col("__b3") <= r) & (r < F.col("__b3") + F.col("__n")), F.col("v")))
        low, high = pick(F.floor(at)), pick(F.ceil(at))
        return low + (high - low) * F.max(F.when(F.col("m") == m, at - F.floor(at)))

    found = last.groupBy("__k").agg(*(F.array(*(quantile(m, s) for s in shares)).alias(m) for m in values))
    return found.select(*(F.col(f"__k.{c}").alias(c) for c in keys), *values)


def beside(grouped: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """``grouped`` with the columns of ``others`` for the same keys, NULL keys among them; NULLs where ``others`` has no row. Both have one row for each key; without keys, ``others`` has one at most."""
    if not keys:
        return grouped.join(others.agg(*(F.first(c).alias(c) for c in others.columns)))
    right = others.select(F.struct(*keys).alias("__k"), *(c for c in others.columns if c not in keys))
    return grouped.withColumn("__k", F.struct(*keys)).join(right, "__k", "left").drop("__k")


def ranked(values: DataFrame, value: str, keys: list[str], ties: list[str] = []) -> DataFrame:
    """Rows with a value, with their place (from 1, by value, then ``ties``) and the total of their keys; rows whose keys have a NULL, or without value, are left out.

    Equal rows are counted and take their places in turn; the kinds of rows of
    one value are ordered by their first tie, and only those that share it by
    the rest, which ends with the other columns. So no value and no key is
    ordered as a whole.
    """
    ties = [*ties, *(c for c in values.columns if c not in {*keys, *ties, value})]
    kinds = values.where(F.col(value).isNotNull()).dropna(subset=keys) if keys else values.where(F.col(value).isNotNull())
    double = F.col(value).cast("double")
    counted = kinds.groupBy(*values.columns).agg(F.count("*").alias("__n")).withColumns({"__v": double, "__tie": F.struct(F.col(ties[0])) if ties else F.lit(0)})
    found = _sliced(counted, "__v")
    within, before = list(keys), F.lit(0)
    for depth, by in enumerate(("__step", "__float", "__v", "__tie")):
        if by == "__tie" and not ties:
            break
        own = _summed(found, within, by).select(*within, by, F.col("__before").alias(f"__b{depth}"), *([F.col("__all").alias("total")] if depth == 0 else []))
        within = [*within, by]
        found = found.join(own, within)
        before = before + F.col(f"__b{depth}")
    kind = Window.partitionBy(*within).orderBy(*(ties[1:] or [F.lit(0)])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = before + F.sum("__n").over(kind) - F.col("__n")
    return found.withColumn("__start", start).select(*values.columns, "total", F.explode(F.sequence(F.col("__start") + 1, F.col("__start") + F.col("__n"))).alias("place"))
