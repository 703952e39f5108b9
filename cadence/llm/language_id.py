"""Language identification, words first: known words by frequency, others by ever shorter character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from xxhash import xxh64_intdigest

from cadence.llm.shared import byte_slices, give_back, returning_memory, small_batches

LONGEST = 5


@dataclass(frozen=True)
class LanguageModel:
    """Log frequencies by language: table 0 is for words, table n for n-grams of ^word$. A table's pieces are their 64-bit hashes, in order, beside a row of ``logs`` each."""

    languages: list[str]
    codes: list[np.ndarray]
    logs: list[np.ndarray]
    prior: np.ndarray

    def rows(self, size: int, pieces: list[str]) -> np.ndarray:
        """The place of each piece in its table, -1 for those that are not there."""
        table = self.codes[size]
        wanted = np.fromiter((xxh64_intdigest(p, 42) for p in pieces), np.uint64, len(pieces)).view(np.int64)
        if not len(table):
            return np.full(len(pieces), -1)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return np.where(table[at] == wanted, at, -1)


def learned_from(id_col: Column) -> Column:
    """Whether a row may be learned from: four fifths of the ids, by CRC."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 != 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_to_learn: int = 8000, languages: int = 1000) -> LanguageModel:
    """Learns from about ``docs_to_learn`` labelled rows, as many of each language (chosen by a hash of the id), whole texts.

    Rows without text, language or id are not learned from. Every label is
    learned, with every word and n-gram of its rows: only the sample bounds the
    tables, which come to the driver and go to each worker as numbers. More than
    ``languages`` labels raise.
    """
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(learned_from(F.col("id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    found = sorted(tuple(r) for r in usable.groupBy("lang").agg(F.count("*").alias("rows")).limit(languages + 1).collect())
    if len(found) > languages:
        raise ValueError(f"there are more than {languages} labels to learn")
    spark, names = docs.sparkSession, [x for x, _ in found]
    sizes = spark.createDataFrame([(x, i, n) for i, (x, n) in enumerate(found)], "lang string, label int, rows long")
    share = -(-docs_to_learn // max(1, len(found)))
    chosen = usable.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("id"), F.col("rows")) < share)
    counted = chosen.select("label", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("piece")).groupBy("label", "piece").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit("^"), "piece", F.lit("$"))
    grams = counted.select("label", "n", padded.alias("word")).select("label", "n", "word", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("word")))).alias("size"))
    grams = grams.select("label", "n", "word", "size", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("size") + 1)).alias("at"))
    grams = grams.groupBy("label", "size", F.expr("substring(word, at, size)").alias("piece")).agg(F.sum("n").alias("n"))
    every = counted.select("label", F.lit(0).alias("size"), "piece", "n").union(grams.select("label", "size", "piece", "n"))
    rows = every.select("label", "size", F.xxhash64("piece").alias("code"), "n").toArrow()
    label, size, code, n = (rows.column(c).to_numpy() for c in ("label", "size", "code", "n"))
    codes, logs = [], []
    for k in range(LONGEST + 1):
        mine = size == k
        table, at = np.unique(code[mine], return_inverse=True)
        counts = np.zeros((len(table), len(names)))
        np.add.at(counts, (at, label[mine]), n[mine])
        codes.append(table)
        logs.append(np.log((counts + 0.1) / (np.maximum(1, counts.sum(axis=0)) + 0.1 * max(1, len(table)))))
    del rows, label, size, code, n, every, grams
    give_back()  # on the driver
    prior = np.array([n for _, n in found], float)
    return LanguageModel(names, codes, logs, np.log(prior / prior.sum()) if len(prior) else prior)


def _word_scores(model: LanguageModel, distinct: list[str]) -> np.ndarray:
    """The log score of each word by language: its own where it is known, else the mean of its longest known n-grams."""
    scores = np.zeros((len(distinct), len(model.languages)))
    row = model.rows(0, distinct)
    known = row >= 0
    scores[known] = model.logs[0][row[known]]
    unseen = np.flatnonzero(~known)
    for size in range(LONGEST, 0, -1):
        padded = [f"^{distinct[i]}$" for i in unseen]
        counts = np.maximum(0, np.fromiter(map(len, padded), int, len(padded)) - size + 1)
        row = model.rows(size, [w[k : k + size] for w, c in zip(padded, counts) for k in range(c)])
        owner, hit = np.repeat(np.arange(len(unseen)), counts), row >= 0
        n = np.bincount(owner[hit], minlength=len(unseen))
        for k in range(len(model.languages)):
            total = np.bincount(owner[hit], model.logs[size][row[hit], k], minlength=len(unseen))
            scores[unseen, k] += np.divide(total, n, out=np.zeros(len(unseen)), where=n > 0)
        unseen = unseen[n == 0]
    return scores


def _predict(model: LanguageModel, texts: pa.Array, evidence: int) -> tuple[list[str], np.ndarray]:
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("")), r"\P{L}+")
    flat = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    by_word = _word_scores(model, distinct)
    filled = np.array([bool(w) for w in distinct], bool)
    by_word[~filled] = 0
    counts = np.diff(np.concatenate([[0], np.cumsum(filled[codes])])[ends])
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    sums = np.stack([np.diff(np.concatenate([[0.0], np.cumsum(by_word[codes, k])])[ends]) for k in range(len(model.languages))], axis=1)
    mean = sums / np.maximum(1, counts)[:, None] * np.minimum(evidence, counts)[:, None] + model.prior
    odds = np.exp(mean - mean.max(axis=1, keepdims=True))
    best = odds.argmax(axis=1)
    score = np.where(counts > 0, 1 / odds.sum(axis=1), 0.0)
    return [model.languages[b] if n else "und" for b, n in zip(best.tolist(), counts.tolist())], score


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", evidence: int = 20) -> DataFrame:
    """All columns of ``docs`` and two more: the language predicted from the whole text, and its share against the other languages.

    A null text, or one without a letter, gives ``und`` and 0. The share is that
    of the mean word, raised to the number of words but to ``evidence`` at most, as
    words of one text are not independent; it does not change which language is
    first but for the prior's part in texts of fewer words. Ties go to the
    language that sorts first; repeated rows are each returned. The two names
    must differ from those of ``docs``.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see fit()
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text_col, 3 << 20):
                lang, score = _predict(sent.value, part.column(text_col), evidence)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, lang_out, score_out])

    return docs.mapInArrow(returning_memory(run), StructType([*docs.schema.fields, StructField(lang_out, StringType()), StructField(score_out, DoubleType())]))
