"""Inventory of a table of texts: what the lines of each document hold, and by language and source their funnel and spread.

    python -m jobs.text_inventory --source IN --output OUT --config jobs/text_inventory.json

It does for texts what the station inventory does for report files: a document
is a file, a line a row of it. OUT/documents has a row for each document, in a
folder for each language; OUT/groups one for each language and source, made from
it. Both are replaced as a whole, so that a run can be repeated.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.operators.inventory import hours_distribution
from jobs import command

log = logging.getLogger(__name__)

CLASSES = ("na_input", "malformed", "phys_reject", "valid")
COUNTS = ("n_rows", *(f"n_{c}" for c in CLASSES), "n_repeats")


@dataclass(frozen=True)
class Config:
    """Columns of the texts; lines of more than ``longest`` characters are out of range."""

    id: str = "doc_id"
    text: str = "text"
    language: str = "lang"
    source: str = "source"
    longest: int = 2000


def line_class(line: Column, longest: int) -> Column:
    """na_input: nothing but spaces; malformed: no letter; phys_reject: too long; else valid."""
    return F.when(F.trim(line) == "", "na_input").when(~line.rlike(r"\p{L}"), "malformed").when(F.length(line) > longest, "phys_reject").otherwise("valid")


def document_stats(docs: DataFrame, config: Config) -> DataFrame:
    """(lang, source, doc_id, is_error, n_rows, a count for each class, n_repeats, n_distinct, n_longest) for each row of ``docs``, from its own text: no shuffle.

    A null text is a read error without lines; an empty one has a line that is empty.
    """
    of = lambda c: F.size(F.filter("classes", lambda k: k == c))
    lines = docs.select(
        F.col(config.language).cast("string").alias("lang"), F.col(config.source).cast("string").alias("source"), F.col(config.id).alias("doc_id"),
        F.col(config.text).isNull().alias("is_error"), F.split(F.coalesce(F.col(config.text).cast("string"), F.lit("")), "\n", -1).alias("lines"),
    )
    lines = lines.withColumn("lines", F.when(F.col("is_error"), F.array().cast("array<string>")).otherwise(F.col("lines")))
    lines = lines.withColumns({"classes": F.transform("lines", lambda x: line_class(x, config.longest)), "kinds": F.array_distinct(F.filter("lines", lambda x: line_class(x, config.longest) == "valid"))})
    return lines.select(
        "lang", "source", "doc_id", "is_error", F.size("lines").cast("long").alias("n_rows"), *(of(c).cast("long").alias(f"n_{c}") for c in CLASSES),
        (of("valid") - F.size("kinds")).cast("long").alias("n_repeats"), F.size("kinds").cast("long").alias("n_distinct"), F.coalesce(F.array_max(F.transform("lines", F.length)), F.lit(0)).cast("long").alias("n_longest"),
    )


def group_stats(documents: DataFrame) -> DataFrame:
    """A row for each language and source: documents, read errors, sums and percents of lines, and how distinct valid lines spread over documents; sums come before the shuffle, quantiles are exact."""
    keys = ["lang", "source"]
    percent = lambda c: F.try_divide(100.0 * F.sum(f"n_{c}"), F.sum("n_rows"))
    sums = documents.groupBy(*keys).agg(F.count_if("is_error").alias("n_read_errors"), *(F.sum(c).alias(c) for c in COUNTS), F.max("n_longest").alias("n_longest"), *(percent(c).alias(f"pct_{c}") for c in CLASSES))
    spread = hours_distribution(documents, "n_distinct", keys).withColumnsRenamed({"n": "n_files"})
    beside = spread.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in spread.columns if c not in keys))
    return sums.join(beside, F.expr(" and ".join(f"{k} <=> __{k}" for k in keys))).drop(*(f"__{k}" for k in keys))


def _write(rows: DataFrame, path: str) -> DataFrame:
    """The rows as written; read by their own schema, as languages may look like numbers."""
    rows.write.mode("overwrite").partitionBy("lang").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def run(spark: SparkSession, source: str, output: str, config: Config = Config()) -> dict[str, int]:
    """Takes stock of a table of texts; returns the rows written to each of the two tables.

    Repeated rows count each; unknown languages and sources are groups of their
    own; a table without rows gives empty ones.
    """
    docs, output = spark.read.parquet(source), output.rstrip("/")
    log.info("read %s: %d rows", source, docs.count())
    # a language's rows share files that are dealt by size, however many of the rows it has
    documents = _write(document_stats(docs, config).hint("rebalance", "lang"), f"{output}/documents")
    groups = _write(group_stats(documents), f"{output}/groups")
    written = {"documents": documents.count(), "groups": groups.count()}
    log.info("wrote %s: %s", output, written)
    return written


def groups(spark: SparkSession, output: str, config: Config = Config()) -> DataFrame:
    """The groups as they stand in a folder that run() has written."""
    none = spark.createDataFrame([], f"{config.id} long, {config.text} string, {config.language} string, {config.source} string")
    return spark.read.schema(group_stats(document_stats(none, config)).schema).parquet(f"{output}/groups")


if __name__ == "__main__":
    command.start("text_inventory", Config, run, {"source": "table of texts in Parquet", "output": "folder of the two tables"})
