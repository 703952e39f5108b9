"""From raw documents to packed training sequences: each stage works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm import language_id
from cadence.llm.line_dedup import dedup_lines
from cadence.llm.minhash_dedup import near_duplicates
from cadence.llm.packing import pack
from cadence.llm.shared import joinable, keep, unused

#: Documents whose language has a smaller share than this go, as do those without a letter.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose text is in one of the languages of the labels.

    Null and empty texts, and those without a letter, go; repeated rows are
    judged alike; other columns are handed on, whatever their names; no rows, or
    none to learn from, give no rows.
    """
    lang, share = unused(docs.columns, "found_lang"), unused(docs.columns, "found_share")
    found = language_id.identify(docs, language_id.fit(docs), lang_out=lang, score_out=share)
    return found.where((F.col(lang) != "und") & (F.col(share) >= LEAST_SHARE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the lines that an earlier line matches.

    A null text stays null, an empty one empty, and one may end up empty; rows
    that repeat both id and text lose the same lines; other columns are handed
    on, whatever their names; no rows give no rows.
    """
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id; of rows that repeat both id and text one stays; rows without id stay.

    Null and empty texts are near nothing and stay; other columns are handed on,
    whatever their names; no rows give no rows.
    """
    found = near_duplicates(docs, with_text_hash=True).where("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"))
    found = keep(found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), (F.col("doc_id").isNotNull() & (F.col("copies") > 1)).alias("__repeated")), "kept")

    def rows(kept: DataFrame) -> DataFrame:
        return docs.join(joinable(kept), docs["doc_id"].eqNullSafe(kept["__id"]) & (F.xxhash64(docs["text"]) == kept["__hash"]), "left_semi")

    once, repeated = rows(found.where("not __repeated")), found.where("__repeated")
    return once if repeated.isEmpty() else once.union(rows(repeated).dropDuplicates(["doc_id", "text"]))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 4096 tokens.

    A null text, and one that line dedup has emptied, is the end id alone;
    repeated rows are each packed; no rows give no rows.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]
#: SQL has neither the language model nor the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
