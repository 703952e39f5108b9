"""The query's decoded texts, from the table of distinct words, against the join of each document's ids to pieces."""

import numpy as np
import public_tokenizers
import zstandard

from cadence.llm.bpe import _pack_ranks, _unpack_ranks, decode_ids, decoded_words, encode_and_decode, encode_lists, piece_table, word_lists


def test_words_decode_as_whole_texts_do(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "a b  c\n\n d"), (2, "voilà <|endoftext|> 　y"), (3, ""), (4, None), (5, "a b " * 3000)], "doc_id long, text string")
    got = encode_and_decode(docs, path, with_ids=True, with_text=True, block_bytes=10)
    joined = {r.doc_id: r.text or "" for r in decode_ids(got.select("doc_id", "ids"), path).collect()}
    assert {r.doc_id: r.text for r in got.collect()} == joined == {r.doc_id: r.text or "" for r in docs.collect()}


def test_words_are_joined_to_their_pieces(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, f"one two three {'x' * i} é") for i in range(1, 21)], "doc_id long, text string")
    with open(path, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    encoded = encode_lists(word_lists(docs, 3, block_bytes=60), source)
    found = decoded_words(encoded, piece_table(spark, path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter, (id#" in plan and "piece#" in plan
    texts = sorted(zstandard.ZstdDecompressor().decompress(r.strings) for r in found.collect())
    assert all(b"".join(texts).count(w) == 1 for w in (b"one", b" two", b" three", " é".encode()))


def test_ranks_are_packed():
    rng = np.random.default_rng(1)
    for x in ([], [0], [127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**32 - 1, 5], rng.integers(0, 300_000, 10_000).tolist()):
        assert _unpack_ranks(_pack_ranks(np.array(x, np.int64))).tolist() == x
