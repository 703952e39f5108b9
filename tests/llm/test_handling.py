"""Few rows, extreme vectors, odd ids, clashing names and empty tables."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from cadence.llm.exact_topk import exact_topk
from cadence.llm.line_dedup import dedup_lines
from cadence.llm.packing import WordIds, encode_words, token_ids
from cadence.llm.pstable import nearest
from cadence.llm.token_counts import load_tokenizer
from cadence.llm.warc import archive_round_trip


def cosines(rows, k=5):
    out = []
    for q, a in rows:
        if q % 50 == 0:
            found = sorted((-float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))), i) for i, b in rows if i != q)
            out += [(q, n + 1, i) for n, (_, i) in enumerate(found[:k])]
    return sorted(out)


def found_by(spark, rows):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    return df, sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, F.col("id") % 50 == 0).collect())


def test_few_rows_are_all_found(spark):
    for rows in ([(0, [1, 0]), (1, [-1, 0.1]), (2, [0, -1]), (3, [-1, -1])], [(0, [1, 0])], [(50, [1, 0]), (100, [-1, 0])]):
        assert [x[:3] for x in found_by(spark, rows)[1]] == cosines(rows)


def test_vectors_of_any_size(spark):
    rng = np.random.default_rng(4)
    plain = [(i, rng.normal(size=8)) for i in range(60)]
    sizes = [1.0, 1e-200, 1e200, 1e-300]
    grown = [(i, v * sizes[i % 4]) for i, v in plain]
    a, b = found_by(spark, plain)[1], found_by(spark, grown)[1]
    assert [x[:3] for x in a] == [x[:3] for x in b] == cosines(plain)
    assert np.allclose([x[3] for x in a], [x[3] for x in b], atol=1e-12)


def test_topk_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id, r.score) for r in exact_topk(df, F.col("id") % 20 == 0).orderBy("rank").collect()] == [(1, 1, 2048), (2, 2, -4096)]


def test_any_record_id_comes_back(spark):
    page = "x" * 200
    rows = [("a b/é<>", page), ("", page + "y"), (None, "z"), ("c%20d", page)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id string, url string, html string")
    got = sorted(((r.page_id is None, r.page_id or "", r.record_type, r.refers_to) for r in archive_round_trip(pages).collect()))
    assert got == [(False, "", "response", None), (False, "a b/é<>", "response", None), (False, "c%20d", "revisit", "a b/é<>"), (True, "", "response", None)]


def test_names_that_operators_use_themselves(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(1, "one two three", "en", 1, 2, 3, "x"), (2, "one two three\nfour", "en", 4, 5, 6, "y")], "doc_id long, text string, lang string, of int, removed int, text_hash int, found_lang string")
    got = dedup_lines(docs)
    assert got.columns == docs.columns and sorted((r.doc_id, r.text, r.of, r.found_lang) for r in got.collect()) == [(1, "one two three", 1, "x"), (2, "four", 4, "y")]
    assert p.language(spark, docs, "").columns == docs.columns


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_words_together_encode_as_alone():
    import pyarrow as pa

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = load_tokenizer(f.read())
    words = ["a", "́b́", "İΣ", "ΣΣ", "<|endoftext|>z", "<|startoftext|>", "'s", "'ll　q", "한", "", "😀‍👨", " ", "x" * 900, "5,000.5"] * 30
    sizes, ids = encode_words(tokenizer, words, together=7)
    alone = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert sizes.tolist() == [len(x) for x in alone] and ids.tolist() == [y for x in alone for y in x]
    known = WordIds(tokenizer, most=5)
    for text in ("a b c d e f g a", "a h i b é", ""):
        got, counts = token_ids(known, pa.array([text, None]))
        assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(got), 0]
