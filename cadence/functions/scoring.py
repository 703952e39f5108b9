"""Errors from mergeable sufficient statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadence.functions.nulls import clip


@dataclass(frozen=True)
class ScorePolicy:
    """When a score counts: at least ``min_n`` values, and for R2 a total sum of squares above ``sst_gt``."""

    min_n: int
    sst_gt: float
    clip: tuple[float, float] | None = None


STRICT = ScorePolicy(2, 1e-4)
POOLED_SCHEMES = ScorePolicy(3, 0.0)
MONTHLY_SCHEMES = ScorePolicy(0, 0.0)
GRID = ScorePolicy(1, 1e-6, (-1.0, 1.0))


def statistics(obs: Column, rec: Column, mask: Column | None = None) -> dict[str, Column]:
    """n, sum_o, sum_o2 and sse over rows where both values are there and the mask holds; sums of such rows merge to those of their union."""
    use = obs.isNotNull() & rec.isNotNull()
    use = use if mask is None else use & F.coalesce(mask, F.lit(False))
    return {
        "n": F.count_if(use),
        "sum_o": F.sum(F.when(use, obs)),
        "sum_o2": F.sum(F.when(use, obs * obs)),
        "sse": F.sum(F.when(use, (rec - obs) * (rec - obs))),
    }


def merged() -> dict[str, Column]:
    return {c: F.sum(c) for c in ("n", "sum_o", "sum_o2", "sse")}


def rmse(policy: ScorePolicy, n: Column, sse: Column) -> Column:
    return F.when((n >= policy.min_n) & (n > 0), F.sqrt(sse / n))


def r2(policy: ScorePolicy, n: Column, sum_o: Column, sum_o2: Column, sse: Column) -> Column:
    total = F.when(n > 0, sum_o2 - sum_o * sum_o / n)
    value = F.when((n >= policy.min_n) & (total > policy.sst_gt), 1 - sse / total)
    return value if policy.clip is None else clip(value, *policy.clip)


def scores(policy: ScorePolicy, prefix: str = "") -> dict[str, Column]:
    """rmse and r2 from the columns that statistics() names."""
    n, sum_o, sum_o2, sse = (F.col(prefix + c) for c in ("n", "sum_o", "sum_o2", "sse"))
    return {"rmse": rmse(policy, n, sse), "r2": r2(policy, n, sum_o, sum_o2, sse)}


def deviation(value: Column, digits: int = 2) -> Column:
    """The population standard deviation in a group, the same in whatever order its rows come.

    Numbers of so many decimals, below 10 ** 8, are summed as whole ones; groups
    with others have the engine's own figure, of which the last bits depend on
    that order.
    """
    unit = 10**digits
    rounded = F.round(value.cast("double") * unit)
    fits = (F.abs(rounded) < 1e8 * unit) & (rounded / unit == value)
    whole = F.when(fits, rounded.cast(f"decimal({8 + digits},0)"))
    n, total = F.count(whole), F.sum(whole)
    spread = F.try_subtract(F.try_multiply(F.sum(whole * whole), n.cast("decimal(19,0)")), F.try_multiply(total, total))
    exact = F.when(n == F.count(value), F.sqrt(spread.cast("double")) / n / unit)
    return F.coalesce(exact, F.stddev_pop(value))
