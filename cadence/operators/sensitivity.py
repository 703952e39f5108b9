"""Sweeps over all single anchors and all pairs, from six sums a day instead of the hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.clock import separation
from cadence.functions.nulls import clip, present
from cadence.operators.modes import UNIT

SUMS = ("n", "sy", "sy2", "ss", "ss2", "sys")


def day_matrix(shaped: DataFrame) -> DataFrame:
    """A row for each day: y and s by hour (arrays of 24, NULL where there is no value), and the six sums over hours that have both."""
    both = present(F.col("obs"), F.col("s"))
    y, s = F.when(both, F.col("obs")), F.when(both, F.col("s"))
    by_hour = lambda c: F.array(*(F.max(F.when((F.col("hour") == h) & both, F.col(c))) for h in range(24)))
    return shaped.groupBy(*UNIT, "day").agg(by_hour("obs").alias("y"), by_hour("s").alias("s"), F.count(y).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("sy2"), F.sum(s).alias("ss"), F.sum(s * s).alias("ss2"), F.sum(y * s).alias("sys"))


def _without(*anchors: tuple[Column, Column]) -> dict[str, Column]:
    """The six sums less the anchors' hours."""
    out = {}
    terms = {"n": lambda y, s: F.when(present(y, s), 1).otherwise(0), "sy": lambda y, s: y, "sy2": lambda y, s: y * y, "ss": lambda y, s: s, "ss2": lambda y, s: s * s, "sys": lambda y, s: y * s}
    for k, f in terms.items():
        out[k] = F.col(k)
        for y, s in anchors:
            out[k] = out[k] - F.coalesce(F.when(present(y, s), f(y, s)), F.lit(0.0 if k != "n" else 0))
    return out


def closed_sse(x: dict[str, Column], alpha: Column, beta: Column) -> Column:
    """The sum over hours of (y - alpha - beta s) squared."""
    return x["sy2"] - 2 * alpha * x["sy"] - 2 * beta * x["sys"] + x["n"] * alpha * alpha + 2 * alpha * beta * x["ss"] + beta * beta * x["ss2"]


def _summed(days: DataFrame, keys: list[str], extra: list[Column] = []) -> DataFrame:
    ok = F.coalesce((F.col("n_") > 0) & F.col("sse_").isNotNull(), F.lit(False))
    total = lambda c: F.sum(F.when(ok, F.col(c)))
    n, sse, sy, sy2 = total("n_"), total("sse_"), total("sy_"), total("sy2_")
    sst = sy2 - sy * sy / n
    return days.groupBy(*keys).agg(F.coalesce(n, F.lit(0)).cast("long").alias("n_heldout"), *extra, F.when(n > 0, F.sqrt(F.greatest(sse, F.lit(0.0)) / n)).alias("rmse_heldout"), F.when((n > 0) & (sst > 0), 1 - sse / sst).alias("r2_heldout"))


def single_anchors(days: DataFrame) -> DataFrame:
    """(anchor_hour_utc, n_heldout, rmse_heldout, r2_heldout) for each of 24 hours; the hours' table is fixed and expands each day by 24."""
    each = days.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumns({"ya": F.get("y", F.col("h")), "sa": F.get("s", F.col("h"))}).where("ya is not null and sa is not null")
    left = _without((F.col("ya"), F.col("sa")))
    each = each.withColumns({"n_": left["n"], "sy_": left["sy"], "sy2_": left["sy2"], "sse_": closed_sse(left, F.col("ya") - F.col("sa"), F.lit(1.0))})
    return _summed(each, ["h"]).withColumnRenamed("h", "anchor_hour_utc")


def anchor_pairs(days: DataFrame, delta: float = 0.5) -> DataFrame:
    """The 276 pairs of hours: separation, held-out score, days with both anchors, and how many fell back to slope 1."""
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(24) for b in range(a + 1, 24)))
    each = days.select("*", F.explode(pairs).alias("p")).select("*", F.col("p.a").alias("h1"), F.col("p.b").alias("h2")).drop("p")
    each = each.withColumns({"y1": F.get("y", F.col("h1")), "y2": F.get("y", F.col("h2")), "s1": F.get("s", F.col("h1")), "s2": F.get("s", F.col("h2"))}).where("y1 is not null and y2 is not null")
    y1, y2, s1, s2 = (F.col(c) for c in ("y1", "y2", "s1", "s2"))
    fits = F.abs(s2 - s1) > delta
    each = each.withColumns({"fits": fits, "beta": F.when(fits, clip(F.try_divide(y2 - y1, s2 - s1), 0.1, 5.0)).otherwise(F.lit(1.0))})
    each = each.withColumn("alpha", F.when(F.col("fits"), y2 - F.col("beta") * s2).otherwise(((y1 - s1) + (y2 - s2)) / 2))
    left = _without((y1, s1), (y2, s2))
    each = each.withColumns({"n_": left["n"], "sy_": left["sy"], "sy2_": left["sy2"], "sse_": closed_sse(left, F.col("alpha"), F.col("beta"))})
    days_, back = F.count("*"), F.count_if(~F.col("fits"))
    found = _summed(each, ["h1", "h2"], [days_.alias("anchor_days"), back.alias("fallback_days"), F.try_divide(back, days_).alias("fallback_fraction")])
    return found.withColumn("circular_separation_h", separation(F.col("h1"), F.col("h2"))).withColumnsRenamed({"h1": "h1_utc", "h2": "h2_utc"})


def stable_sample(stations: DataFrame, n: int, seed: int = 20260814, least_hours: int = 24) -> DataFrame:
    """``n`` stations with coordinates and enough hours, by the hash of seed and id; the same ones on every run."""
    ok = stations.dropna(subset=["lat", "lon"]).where(F.col("total_hours") >= least_hours)
    return ok.withColumn("rank_key", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("station")), 256)).orderBy("rank_key", "station").limit(n)
