"""Templates in buckets by cell: joined to hours without being shuffled again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _table() -> str:
    return f"templates_{uuid.uuid4().hex}"


def write_templates(templates: DataFrame, path: str, cell: list[str], buckets: int = 64) -> None:
    """Writes templates to ``path`` in so many buckets by cell, each in order of cell and month.

    Cells have to be texts or whole numbers (a station, hundredths of degrees):
    doubles are normalised in joins and lose their buckets there.
    """
    if odd := [c for c in cell if templates.schema[c].dataType.typeName() in ("double", "float")]:
        raise ValueError(f"buckets need texts or whole numbers, not {odd}")
    table = _table()
    templates.repartition(buckets, *cell).write.mode("overwrite").bucketBy(buckets, *cell).sortBy(*cell, "month").option("path", path).saveAsTable(table)
    templates.sparkSession.sql(f"DROP TABLE {table}")  # the files stay


def read_templates(spark: SparkSession, path: str, cell: list[str], buckets: int = 64) -> DataFrame:
    """What write_templates() wrote there, in any session; the numbers of buckets and the cells must be those it was written with."""
    table, schema = _table(), spark.read.parquet(path).schema.toDDL()
    by = ", ".join(cell)
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}, month) INTO {buckets} BUCKETS LOCATION '{path}'")
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the plan holds its files and buckets
    return found
