"""Quality scores from preferences: Bradley-Terry strengths that are linear in features of a text's form, cut at a quantile."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.shared import byte_slices, joinable, keep, returning_memory
from cadence.llm.vectors import matrix

#: Classes of bytes; their names stand for what they hold, the last is every other byte.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "|", "'\"()[]{}-", "", "*#$%&@~^+=<>\\/_`")
LETTERS_BEYOND_ASCII, OTHERS = CLASSES.index(""), len(CLASSES)
KINDS = OTHERS + 1
BREAK = CLASSES.index("\n\r")
#: A word is compared with the ones so many places before it.
LAGS = (1, 2, 3, 4, 5)
FEATURES = KINDS * KINDS + len(LAGS) + 1
#: A text is looked at in pieces of so many bytes.
PIECE = 1 << 20
#: Strengths are counted in steps of 1/100, between these bounds.
STEPS, FARTHEST = 100, 5000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kinds = np.full(256, OTHERS, np.uint8)
    kinds[128:] = LETTERS_BEYOND_ASCII
    for n, chars in enumerate(CLASSES):
        kinds[list(chars.encode())] = n
    return kinds, np.random.default_rng(7).integers(1, 1 << 62, 256, dtype=np.uint64)


_KINDS, _MARKS = _tables()


def features(text: bytes) -> np.ndarray:
    """Of a whole text in UTF-8: the roots of the shares of pairs of byte classes, the shares of words like one 1 to 5 words before, and the log of the number of words.

    Both ends count as line breaks. Words are what lies between spaces and
    breaks; two are alike if they have the same bytes in any order. Memory is
    bounded by the piece: pieces may end at any byte, and a word that spans two is
    carried over by its sum.
    """
    pairs, alike, words = np.zeros(KINDS * KINDS, np.int64), np.zeros(len(LAGS), np.int64), 0
    last_kind, open_word, recent = BREAK, np.uint64(0), np.zeros(0, np.uint64)
    for at in range(0, len(text) + 1, PIECE):
        data = np.frombuffer(text[at : at + PIECE], np.uint8)
        ends = at + PIECE > len(text)
        kinds = np.concatenate([[last_kind], _KINDS[data], *([[BREAK]] if ends else [])]).astype(np.int64)
        pairs += np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS)
        last_kind = kinds[-1]
        gap = (kinds[1:] == CLASSES.index(" \t")) | (kinds[1:] == BREAK)
        marks = np.where(gap, np.uint64(0), np.concatenate([_MARKS[data], np.zeros(int(ends), np.uint64)]))
        sums = np.concatenate([[open_word], open_word + np.cumsum(marks, dtype=np.uint64)])
        at_gaps = np.concatenate([[np.uint64(0)], sums[1:][gap]])
        found = np.diff(at_gaps)  # sums wrap around, and so do their differences
        found = found[found != 0]
        open_word = (sums[-1:] - at_gaps[-1:])[0]
        words += len(found)
        line = np.concatenate([recent, found])
        for k, lag in enumerate(LAGS):
            new = min(len(found), max(0, len(line) - lag))
            if new:
                alike[k] += int((line[-new:] == line[len(line) - new - lag : len(line) - lag]).sum())
        recent = line[-max(LAGS) :]
    return np.concatenate([np.sqrt(pairs / pairs.sum()), alike / max(1, words), [math.log1p(words) / 10]]).astype(np.float32)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in byte_slices(batch, "text", PIECE):
            rows = [features((t or "").encode()) for t in part.column("text").to_pylist()]
            flat = pa.array(np.concatenate(rows) if rows else [], pa.float32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * FEATURES, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), lists], ["doc_id", "held_out", "f"])


def described(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, f) of all rows, written once; texts are read here and nowhere else."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, f array<float>"
    return keep(rows.mapInArrow(returning_memory(_described), schema), "features", compression="zstd")


@dataclass(frozen=True)
class Strengths:
    """strength = f . weights; ``cut`` is the strength that gets the score ``at``."""

    weights: np.ndarray
    cut: float
    at: float


def preference_fit(better: np.ndarray, worse: np.ndarray, opponents: int = 8, ridge: float = 1.0, seed: int = 3, steps: int = 50) -> np.ndarray:
    """Weights of the Bradley-Terry model: the ridge's minimum of sum log(1 + exp(-w . (x - y))) over pairs of a better x and a worse y, by Newton's steps.

    Each row meets ``opponents`` of the other side, drawn by turns from shuffled
    orders; features are divided by their spread.
    """
    if not len(better) or not len(worse):
        return np.zeros(better.shape[1])
    draw = np.random.default_rng(seed)
    n = max(len(better), len(worse))
    turns = [(np.arange(n) % len(better), draw.permutation(n) % len(worse)) for _ in range(opponents)]
    spread = np.concatenate([better, worse]).std(axis=0)
    scale = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 1e-6)
    d = np.concatenate([better[i] - worse[j] for i, j in turns]) * scale
    w = np.zeros(d.shape[1])
    loss = lambda w: np.logaddexp(0, -(d @ w)).sum() + ridge * (w @ w) / 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        slope = ridge * w - d.T @ p
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), slope)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now - 1e-4 * size * (slope @ step):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w * scale


def _steps(strength: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(strength * STEPS, -FARTHEST, FARTHEST)).astype(np.int64)


def _with_strength(rows: DataFrame, weights: np.ndarray, others: str) -> DataFrame:
    """``others`` (a schema) and the strength of each row's features."""
    names = [c.strip().split()[0] for c in others.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = matrix(batch.column("f"), FEATURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array((f * weights).sum(axis=1), pa.float64())], [*names, "strength"])

    return rows.mapInArrow(run, f"{others}, strength double")


def quantile_cut(counts: list[tuple[int, int, int]]) -> float:
    """The strength below which as large a share of rows lies as have label 0; ``counts`` holds (step, rows of label 0, rows of label 1). Halfway into the gap to the next row."""
    counts = sorted(counts)
    low, seen = sum(zeros for _, zeros, _ in counts), 0
    for (step, zeros, ones), after in zip(counts, [*counts[1:], (counts[-1][0] + 1, 0, 0)]):
        seen += zeros + ones
        if seen >= low:
            return (step + 1 + after[0]) / 2 / STEPS
    return 0.0


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", docs_per_label: int = 2000, at: float = 0.7, **settings: float) -> Strengths:
    """Learns from the rows of described() that are not held out and have a label of 0 or 1.

    Strengths are fitted on ``docs_per_label`` rows of each label at most (those
    with the least SHA-256 of the id), which is the bound of what the driver
    gets; the cut is the quantile over all labelled rows, from counts by step.
    Ids with both labels are not learned from. Without rows of both labels all
    weights are 0, and every text gets the share of label 1 (or a half) as score.
    """
    given = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    once = given.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    learned = rows.where("not held_out").join(joinable(once), "doc_id").select("doc_id", "f", "label")
    sides = []
    for label in (1, 0):
        sample = learned.where(F.col("label") == label).orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "f").limit(docs_per_label).select("f")
        sides.append(np.array([r.f for r in sample.toLocalIterator()], float).reshape(-1, FEATURES))
    weights = preference_fit(*sides, **settings)
    if not all(map(len, sides)):
        share = 0.5 if not any(map(len, sides)) else float(len(sides[0]) > 0)
        return Strengths(weights, 0.0, share)
    step = F.floor(F.greatest(F.lit(float(-FARTHEST)), F.least(F.lit(float(FARTHEST)), F.col("strength") * STEPS)))
    counted = _with_strength(learned, weights, "label int").groupBy(step.alias("step")).agg(F.count_if(F.col("label") == 0).alias("zeros"), F.count_if(F.col("label") == 1).alias("ones"))
    return Strengths(weights, quantile_cut([tuple(r) for r in counted.collect()]), at)


def score(rows: DataFrame, model: Strengths, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``least`` on) for each row of described()."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = _with_strength(rows, model.weights, f"doc_id {kind}, held_out boolean")
    if model.at in (0.0, 1.0):
        value = F.lit(model.at)
    else:
        value = 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.lit(model.cut - math.log(model.at / (1 - model.at))) - F.col("strength")))))
    return found.select("doc_id", "held_out", value.alias("score")).withColumn("predicted", (F.col("score") >= least).cast("int"))


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **settings: float) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``.

    Labels teach by pairs: of a document with label 1 and one with label 0 the
    first is preferred, and the difference of their features explains it. A
    score is the logistic function of a text's strength, 0.7 at the quantile of
    strengths that parts as many labelled documents as have label 0; what
    ``held_out`` marks is never learned from.

    Null and empty texts are scored as a text of no words; repeated rows are each
    returned; rows of labels without id or label are passed over, ids with both
    labels too; tables without rows give no rows or, for labels, a score of 0.5;
    other columns are ignored. Texts are looked at whole, in pieces of 1 MB.
    """
    rows = described(docs, held_out, id_col, text_col)
    return score(rows, fit(rows, labels, id_col, label_col, **settings))
