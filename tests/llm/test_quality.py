"""Quality scores: features against plain Python, the fit by its held-out accuracy, and what may not teach."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.llm import quality
from cadence.llm.queries import op12_quality_classifier

DOCS = "doc_id long, text string, f string, strength int, held_out string"


def plain_features(text):
    def kind(b):
        return next((n for n, c in enumerate(quality.CLASSES) if c and chr(b) in c), quality.OTHERS) if b < 128 else quality.LETTERS_BEYOND_ASCII

    data = text.encode()
    kinds = [quality.BREAK, *map(kind, data), quality.BREAK]
    pairs = np.zeros((quality.KINDS, quality.KINDS))
    for a, b in zip(kinds, kinds[1:]):
        pairs[a, b] += 1
    words = [sorted(w) for w in data.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").split(b" ") if w]
    alike = [sum(a == b for a, b in zip(words, words[lag:])) / max(1, len(words)) for lag in quality.LAGS]
    return [*np.sqrt(pairs / pairs.sum()).ravel(), *alike, math.log1p(len(words)) / 10]


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_features(monkeypatch, piece):
    monkeypatch.setattr(quality, "PIECE", piece)
    for text in ("", "a", " ", "The cat, the cat | É é\n\n$$$ 12\t12 ba ab ab", "x" * 30, "no no no no\r\nyes\x00", "ab " * 7):
        assert quality.features(text.encode()) == pytest.approx(plain_features(text), abs=1e-6)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = op12_quality_classifier(spark, d).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 80 and sum(held) / len(held) >= 0.97


def given(spark, extra=()):
    good, bad = "The sea was calm and the boats went out.", "BUY!!! NOW!!! $$$ ||| BUY!!! NOW!!! $$$"
    rows = [(i, (good if i % 3 else bad) + f" {i}") for i in range(60)] + list(extra)
    docs = spark.createDataFrame([(i, t, "f", 1, "h") for i, t in rows], DOCS)
    labels = [(i, int(i % 3 > 0), 0) for i in range(60)]
    return docs, labels


def scored(spark, docs, labels, **settings):
    table = spark.createDataFrame(labels, "doc_id long, quality int, held_out int")
    return sorted(map(tuple, quality.score_quality(docs, table, F.crc32(F.col("doc_id").cast("string")) % 4 == 2, **settings).collect()), key=str)


def test_odd_rows_and_labels(spark):
    docs, labels = given(spark, [(100, None), (101, ""), (102, "  \n"), (103, "Word " * 300_000), (1, "The sea"), (1, "The sea"), (None, "The sea was calm.")])
    odd = [(None, 1, 0), (4, None, 0), (5, 7, 0), (7, 1, 0), (7, 0, 0), (999, 1, 0), (8, 1, 0), (8, 1, 0)]
    got = scored(spark, docs, labels + odd)
    assert len(got) == 67 and sum(r[0] == 1 for r in got) == 3 and all(0 <= r[2] <= 1 for r in got)
    by_id = {r[0]: r for r in got}
    assert by_id[100][2] == by_id[101][2] and by_id[None][1] is False
    assert all(by_id[i][3] == int(i % 3 > 0) for i in range(2, 60))


def test_what_may_not_teach(spark):
    docs, labels = given(spark)
    held = {i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2}
    turned = [(i, 1 - q if i in held else q, t) for i, q, t in labels]
    assert held and scored(spark, docs, labels) == scored(spark, docs.withColumns({"f": F.lit(None).cast("string")}), turned)


def test_without_labels_of_both_kinds(spark):
    docs, labels = given(spark)
    assert {r[2:] for r in scored(spark, docs, [])} == {(0.5, 0)}
    assert {r[2:] for r in scored(spark, docs, [x for x in labels if x[1] == 1])} == {(1.0, 1)} and {r[2:] for r in scored(spark, docs, [x for x in labels if x[1] == 0])} == {(0.0, 0)}
    assert scored(spark, docs.limit(0), labels) == []


def test_cut_parts_as_many_as_have_label_0():
    assert quality.quantile_cut([(-300, 4, 0), (200, 0, 6)]) == pytest.approx((-299 + 200) / 2 / 100)
    assert quality.quantile_cut([(10, 1, 1), (20, 1, 3)]) == pytest.approx((11 + 20) / 2 / 100)


def test_preferences_are_fitted():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 3))
    better = draw.random(400) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))
    w = quality.preference_fit(x[better], x[~better], opponents=16)
    assert w[0] == pytest.approx(2, abs=0.6) and w[1] == pytest.approx(-1, abs=0.4) and abs(w[2]) < 0.3
