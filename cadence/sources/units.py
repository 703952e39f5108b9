"""Work in units that can be stopped and taken up again: parts of each run, and a manifest of the units that are done."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.operators.checks import todo
from cadence.sources.sinks import ALGORITHM


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _sums(columns: list[str]) -> dict[str, Column]:
    """The number of rows and two sums over them that do not depend on their order."""
    mark = F.xxhash64(*columns)
    return {"rows": F.count(F.lit(1)), "checksum": F.coalesce(F.bit_xor(mark), F.lit(0)), "checksum_low": F.coalesce(F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), F.lit(0))}


def manifest(spark: SparkSession, path: str, algorithm: str = ALGORITHM) -> DataFrame | None:
    """(keys, run, algorithm, rows, checksum, checksum_low) of the units that are done, or None before any is; a row of another algorithm raises where it is read."""
    found = _there(spark, f"{path}/manifest")
    if found is None:
        return None
    same = F.when(F.col("algorithm") == algorithm, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("parts of another algorithm: "), F.col("algorithm"))).cast("boolean"))
    return found.where(same)


def run_units(spark: SparkSession, units: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, keys: list[str], algorithm: str = ALGORITHM, limit: int | None = None) -> int:
    """Does the work of the units that are not done yet, and tells how many these were.

    ``work`` makes of units (one row for each, ``keys`` among their columns) the
    rows of their parts, which carry the keys. They go to a folder of the run;
    when all are written, a second one lists the units with the number and the
    sums of their rows, units without rows too. What a stopped run has left
    behind is in no list, so that the next one does it again. NULL keys are not
    units. ``limit`` is for trials.
    """
    units = units.dropna(subset=keys).dropDuplicates(keys)
    done = manifest(spark, path, algorithm)
    left = units if done is None and limit is None else todo(units, spark.createDataFrame([], units.select(*keys).schema) if done is None else done, keys, limit)
    n = left.count()
    if not n:
        return 0
    run = f"r{uuid.uuid4().hex}"  # not to be taken for a number
    work(left).write.parquet(f"{path}/parts/run={run}")
    parts = spark.read.parquet(f"{path}/parts/run={run}")
    sums = parts.groupBy(*keys).agg(*(v.alias(k) for k, v in _sums(sorted(parts.columns)).items()))
    listed = left.select(*keys).join(sums, keys, "left").na.fill(0, ["rows", "checksum", "checksum_low"]).withColumn("algorithm", F.lit(algorithm))
    listed.write.parquet(f"{path}/manifest/run={run}")
    return n


def read_units(spark: SparkSession, path: str, keys: list[str], algorithm: str = ALGORITHM) -> DataFrame:
    """The rows of all units that are done; those of stopped runs are left out."""
    done, parts = manifest(spark, path, algorithm), _there(spark, f"{path}/parts")
    if done is None or parts is None:
        raise ValueError(f"no unit is done at {path}")
    return parts.join(done.select(*keys, "run"), [*keys, "run"], "left_semi").drop("run")


def damaged(spark: SparkSession, path: str, keys: list[str], algorithm: str = ALGORITHM) -> DataFrame:
    """(keys, rows, found) of the units whose parts are not what their manifest says."""
    parts = _there(spark, f"{path}/parts")
    columns = sorted(c for c in parts.columns if c != "run")
    now = parts.groupBy(*keys, "run").agg(*(v.alias(f"now_{k}") for k, v in _sums(columns).items()))
    both = manifest(spark, path, algorithm).join(now, [*keys, "run"], "left").na.fill(0, ["now_rows", "now_checksum", "now_checksum_low"])
    wrong = (F.col("rows") != F.col("now_rows")) | (F.col("checksum") != F.col("now_checksum")) | (F.col("checksum_low") != F.col("now_checksum_low"))
    return both.where(wrong).select(*keys, "rows", F.col("now_rows").alias("found"))
