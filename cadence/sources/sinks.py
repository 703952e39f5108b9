"""Writers: partitioned archives, parts by unit, small reports."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts carry it; parts of another version are not merged with them.
ALGORITHM = "cadence-1"


def write_archive(df: DataFrame, path: str, by: list[str] = ["month"]) -> None:
    """One folder for each partition value, rows of a value together; the committer makes it whole or not at all."""
    df.repartition(*by).write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def write_parts(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that ``df`` has rows of, so that a run can be taken up again."""
    marked = df.withColumn("algorithm", F.lit(ALGORITHM))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def checkpointed(df: DataFrame, path: str) -> DataFrame:
    """The rows as they stand at ``path``; they are made and written first if nothing stands there."""
    spark = df.sparkSession
    try:
        return spark.read.schema(df.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def nested_parts(rows: DataFrame, unit: list[str], key: str, values: list[str]) -> DataFrame:
    """(unit, algorithm, acc): a row for each unit, with a map from key to its values, as JSON parts hold accumulators. A unit's keys are few by their nature (modes, scopes)."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, F.struct(*values)))))
    return rows.groupBy(*unit).agg(entries.alias("acc")).withColumn("algorithm", F.lit(ALGORITHM))


def flat_parts(parts: DataFrame, unit: list[str], key: str) -> DataFrame:
    """The rows that nested_parts() was made of."""
    return parts.select(*unit, F.explode("acc").alias(key, "__acc")).select(*unit, key, "__acc.*")


def read_parts(df: DataFrame) -> DataFrame:
    """The rows of this version's parts; rows of others raise where they are read."""
    ok = F.when(F.col("algorithm") == ALGORITHM, F.lit(True)).otherwise(F.raise_error(F.lit("a part of another algorithm")).cast("boolean"))
    return df.where(ok).drop("algorithm")


def write_csv(df: DataFrame, path: str, gzip: bool = False, single: bool = False, digits: int | None = None) -> None:
    """With a header; ``digits`` writes doubles and floats with so many digits after the point."""
    rows = df.coalesce(1) if single else df
    if digits is not None:
        fixed = lambda c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c).cast("double"))).alias(c)
        rows = rows.select(*(fixed(f.name) if f.dataType.typeName() in ("double", "float") else f.name for f in df.schema.fields))
    rows.write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report_json(df: DataFrame, rows: int = 1000) -> str:
    """A small report as JSON; more rows than that raise."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"a report has more than {rows} rows")
    return json.dumps([r.asDict(recursive=True) for r in found], default=str, indent=1)


def markdown(df: DataFrame, rows: int = 1000) -> str:
    """A small report as a table in Markdown; more rows than that raise."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"a report has more than {rows} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found)])
