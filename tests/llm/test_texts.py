"""Token counts, BPE, packing and language identification against the libraries and brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cadence.llm import language_id
from cadence.llm.bpe import decode_ids, encode_and_decode, split_words
from cadence.llm.packing import nnls, pack, plan
from cadence.llm.token_counts import count_tokens, safe_pieces

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "a b  c\n\n d", "voilà le  x　y", "x <|endoftext|> y<|endoftext|>", "it's 12,345 don't…\u0085 z", "\x1c odd \u00a0 space", "ab " * 40_000, "z" * 3000, "a b  c\n\n d", "Ünï \u0301x"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string, block long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_counts_are_the_librarys(docs, empty):
    t = Tokenizer.from_file(BYTES)
    got = {r.doc_id: r for r in count_tokens(docs, BYTES).collect()}
    for i, x in enumerate(TEXTS):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((x or "").encode()), n, n > 1024)
    assert count_tokens(empty, BYTES).count() == 0


def test_counts_of_sentencepiece(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, path).collect()} == {i: len(p.encode(x or "")) for i, x in enumerate(TEXTS)}


ODD = st.text(st.sampled_from("ab é\u0301\n\t\u00a0\u0085\u2003　\x1c'.1<|>"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(ODD)
def test_words_and_pieces_are_safe_units(text):
    t = Tokenizer.from_file(BYTES) if not hasattr(test_words_and_pieces_are_safe_units, "t") else test_words_and_pieces_are_safe_units.t
    test_words_and_pieces_are_safe_units.t = t
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    words, edges = split_words(pa.array(["", text, None, text]))
    assert "".join(words.to_pylist()) == text * 2 and edges[0] == 0 and edges[-1] == len(words) and edges[1] == 0
    assert [i for w in words.to_pylist()[edges[1] : edges[2]] for i in ids(w)] == ids(text)
    assert [i for x in safe_pieces(text, 5) for i in ids(x)] == ids(text)


def test_bpe_round_trip(docs, empty):
    t = Tokenizer.from_file(BYTES)
    got = {r.doc_id: r for r in encode_and_decode(docs, BYTES, with_ids=True, with_text=True, block_bytes=50).collect()}
    for i, x in enumerate(TEXTS):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].text == t.decode(ids, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(got[i].text.encode()).hexdigest()
    assert encode_and_decode(empty, BYTES).count() == 0


def test_decode_join(spark):
    t = Tokenizer.from_file(BYTES)
    rows = [(1, t.encode("é <|endoftext|> x").ids), (2, []), (3, None), (1, [0, 1])]
    got = sorted((r.doc_id, r.text or "") for r in decode_ids(spark.createDataFrame(rows, "doc_id int, ids array<int>"), BYTES).collect())
    assert got == sorted((k, t.decode(i, skip_special_tokens=False) if i is not None else "") for k, i in rows)


def check_packing(rows, texts, capacity):
    t = Tokenizer.from_file(WORDS)
    want = set()
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity])) for k in range(0, len(ids), capacity)}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= capacity
    return len(held)


def test_words_are_known_or_encoded_anew():
    from cadence.llm.packing import WordIds, token_ids

    t = Tokenizer.from_file(WORDS)
    known = WordIds(t, most=3)
    for _ in range(3):
        texts = ["one two three four", "four  five!", None, "", "two <|endoftext|>x"]
        ids, counts = token_ids(known, pa.array(texts))
        want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want] and len(known.words) == 3


def test_packing_places_every_piece_once(docs, empty):
    assert check_packing(pack(docs, WORDS, capacity=64).collect(), TEXTS, 64)
    assert pack(empty, WORDS).count() == 0
    assert len(pack(docs, WORDS, with_ids=True).first().ids) >= 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 400), max_size=30), st.integers(100, 130))
def test_plans_hold_the_histogram(histogram, capacity):
    planned = plan(histogram, capacity)
    count = {}
    for lengths, n in planned:
        assert sum(lengths) <= capacity and n > 0
        for x in lengths:
            count[x] = count.get(x, 0) + n
    assert count == histogram
    total = sum(k * v for k, v in histogram.items())
    assert sum(n for _, n in planned) <= 2 * total / capacity + 2


def test_plans_are_close_to_the_bound():
    lengths = np.minimum(4096, np.exp(np.random.default_rng(0).normal(6.2, 1.2, 100_000)).astype(int) + 1)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    assert sum(n for _, n in plan(histogram)) <= 1.002 * (lengths.sum() / 4096) + 1


def test_nnls_meets_its_optimum():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((8, 12)), rng.normal(size=8)
        x = nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and g.max() < 1e-6 and abs(g[x > 0]).max(initial=0) < 1e-6


def test_languages(spark):
    words = {"xx": "lorem ipsum dolor sit", "yy": "über straße groß viel"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(words[k].split() * 3)), k) for i in range(60) for k in [("xx", "yy")[i % 2]]] + [(100, None, "xx"), (101, "12 -- 3", "yy"), (102, "", None), (None, "lorem", "xx")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == ["xx", "yy"]
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:60]) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    unseen = spark.createDataFrame([(1, "dolorem strassegroß"), (2, "ipsumsit")], "doc_id int, text string")
    assert [r.lang_pred for r in language_id.identify(unseen, model).orderBy("doc_id").collect()][1] == "xx"
    none = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from cadence.llm.queries import op7_language_id

    d = "/root/testdata/sf0.01"
    got = op7_language_id(spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) > 100 and (got["lang"] == got["lang_pred"]).mean() > 0.97
