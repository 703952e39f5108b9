"""Language identification against the same model in plain Python."""

import math
import zlib
from collections import Counter

import pytest
import regex

from cadence.llm import language_id
from cadence.llm.queries import op7_language_id

LONGEST = 5


def words_of(text):
    return regex.findall(r"\p{L}+", (text or "").lower())


def grams_of(word, size):
    padded = f"^{word}$"
    return [padded[k : k + size] for k in range(len(padded) - size + 1)]


def brute(rows):
    """{id: (held_out, lang, score)} of rows (id, text, lang)."""
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    learned = [(t, x) for i, t, x in rows if not held[i] and t is not None and x is not None]
    languages = sorted({x for _, x in learned})
    counts = {(x, size): Counter() for x in languages for size in range(LONGEST + 1)}
    for text, lang in learned:
        for w in words_of(text):
            counts[lang, 0][w] += 1
            for size in range(1, LONGEST + 1):
                counts[lang, size].update(grams_of(w, size))
    tables = []
    for size in range(LONGEST + 1):
        top = {x: counts[x, size] for x in languages}
        pieces = set().union(*top.values())
        total = {x: sum(counts[x, size].values()) or 1 for x in languages}
        tables.append({p: [math.log((top[x].get(p, 0) + 0.1) / (total[x] + 0.1 * max(1, len(pieces)))) for x in languages] for p in pieces})
    prior = Counter(x for _, x in learned)

    def word_score(w):
        if w in tables[0]:
            return tables[0][w]
        for size in range(LONGEST, 0, -1):
            if hits := [tables[size][g] for g in grams_of(w, size) if g in tables[size]]:
                return [sum(h[k] for h in hits) / len(hits) for k in range(len(languages))]
        return [0.0] * len(languages)

    out = {}
    for i, text, _ in rows:
        words = words_of(text)
        if not words or not languages:
            out[i] = (held[i], "und", 0.0)
            continue
        sums = [sum(c) for c in zip(*map(word_score, words))]
        mean = [s / len(words) * min(20, len(words)) + math.log(prior[x] / len(learned)) for s, x in zip(sums, languages)]
        odds = [math.exp(m - max(mean)) for m in mean]
        out[i] = (held[i], languages[odds.index(max(odds))], 1 / sum(odds))
    return out


def test_query_against_plain_python(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [tuple(r) for r in given] + [(900_000, None, "en"), (900_001, "", "en"), (900_002, "123 !?", "de"), (900_003, "qqzzx 日本語", None), (900_004, "ÉTÉ zzz", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in op7_language_id(spark, str(tmp_path)).collect()}
    want = brute(rows)
    assert {i: v[:2] for i, v in got.items()} == {i: v[:2] for i, v in want.items()}
    assert all(got[i][2] == pytest.approx(want[i][2], abs=1e-9) for i in want)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.identify(docs, language_id.fit(docs)).collect()] == ["und", "und"]


def test_every_word_and_gram_is_learned(spark):
    """More kinds of word than any cut that was made before; the rarest still tells languages apart."""
    letters = "abcdefghijklmnop"
    word = lambda i: "".join(letters[i >> s & 15] for s in (16, 12, 8, 4, 0))
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    docs = [(i, " ".join(word(200 * n + k + 70_000 * (i % 2)) for k in range(200)), "xy"[i % 2]) for n, i in enumerate(ids)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.fit(frame)
    words = {w for _, t, _ in docs for w in t.split()}
    assert len(model.codes[0]) == len(words) > 50_000 and len(model.codes[5]) > 50_000
    rare = spark.createDataFrame([(1, docs[-1][1].split()[-1], None)], frame.schema)
    assert language_id.identify(rare, model).first().lang_pred == docs[-1][2]
