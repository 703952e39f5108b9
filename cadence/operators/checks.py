"""Invariants on keys and joins, and the units still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, copies) of keys with more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, after a check that raises where a key repeats."""
    if found := duplicates(df, keys).take(3):
        raise ValueError(f"keys {keys} repeat: {[r.asDict() for r in found]}")
    return df


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, after a check that its columns include these."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"columns are missing: {missing}")
    return df


def todo(units: DataFrame, done: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Units without a row in ``done``; ``limit`` is for trials."""
    left = units.join(done.select(*keys).distinct(), keys, "left_anti")
    return left if limit is None else left.orderBy(*keys).limit(limit)


def existing(units: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return units.join(present.select(*keys).distinct(), keys, "left_semi")


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))
