"""Near duplicates, line dedup, components and the pipeline against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest

from cadence.llm.circulant import CirculantMinHash
from cadence.llm.components import components
from cadence.llm.line_dedup import dedup_lines, removed_lines
from cadence.llm.minhash_dedup import near_duplicates, shared_counts
from cadence.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, component long, bands string"


def shingles(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    at = {i: i for i in sets}

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                at[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for g in range(12):
        base = list(rng.choice(vocabulary, 120))
        for k in range(8):
            w = list(base)
            for _ in range(k // 2):
                w[rng.integers(len(w))] = str(rng.integers(10**6))
            out.append(" ".join(w))
    out += [out[0]] * 5 + [out[3].upper(), "a b c", "A  b\nc", "a b", "", " \t ", None, "ÉTÉ é", "x " * 9000, "x " * 9000 + "y"]
    return list(enumerate(out))


def test_near_duplicates(spark, rows):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA)
    for block in (256, 3):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, block=block).collect()}
        assert got == brute_components(rows)
    again = near_duplicates(docs.union(docs.where("doc_id in (0, 99, 101)"))).collect()
    assert len(again) == len(rows) + 3 and {r.doc_id: r.component_id for r in again} == {i: c for i, (_, c) in brute_components(rows).items()}
    assert near_duplicates(docs.limit(0)).count() == 0
    none = near_duplicates(spark.createDataFrame([(None, "a b c d e f", 1, ""), (3, "a b c d e f", 1, "")], SCHEMA)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in none} == {(None, None, True), (3, 3, True)}


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    m = CirculantMinHash(512)
    for share in (0.3, 0.6, 0.9):
        n = int(2000 * share)
        a, b = x[:2000], np.concatenate([x[:n], x[2000 : 2000 + 2000 - n] if 4000 - n <= 3000 else rng.integers(0, 2**63, 2000 - n).astype(np.uint64)])
        j = n / (4000 - n)
        assert abs((m.signature(a) == m.signature(b)).mean() - j) < 0.1
    assert (m.signature(x, chunk=100) == m.signature(x)).all()


def test_shared_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (5, 40, 30, 1, 50, 20, 30, 30, 44, 51, 12, 0)]
    want = [[len(np.intersect1d(a, b)) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = shared_counts(sets)
    assert all(want[i][j] in (None, got[i, j]) for i in range(12) for j in range(12))


def test_shingles_of_a_batch():
    texts = ["One two  three four five six", "x", None, "", " a b ", "One two three four five six"]
    got = [len(s) for s in shingle_sets(pa.array(texts))]
    assert got == [2, 1, 0, 0, 1, 2]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (70, 60), (5, 5), (80, 90), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 70: 50, 80: 80, 90: 80}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def line_tokens(line):
    return frozenset(x for x in re.split(r"[ \t\n\x0b\f\r]+", line.lower()) if x)


def brute_lines(rows):
    lines = [(d, no, line_tokens(x)) for d, t in sorted(rows) for no, x in enumerate((t or "").split("\n"))]
    gone = {}
    for k, (d, no, s) in enumerate(lines):
        if s and any(e and 100 * len(s & e) >= 75 * len(s | e) for _, _, e in lines[:k]):
            gone.setdefault(d, []).append(no)
    return gone


def test_near_copies_do_not_make_all_their_pairs(spark, monkeypatch):
    from cadence.llm import line_dedup

    made, keep = [], line_dedup.keep

    def counted(df, name, **options):
        kept = keep(df, name, **options)
        if name == "pairs":
            made.append(kept.count())
        return kept

    monkeypatch.setattr(line_dedup, "keep", counted)
    n = 150
    line = " ".join(f"word{i}" for i in range(24))
    docs = spark.createDataFrame([(i, f"{line} own{i}") for i in range(n)], "doc_id long, text string")
    assert sorted(r.doc_id for r in removed_lines(docs).collect()) == list(range(1, n))
    assert sum(made) < 12 * n, made


def test_long_unrelated_lines_make_no_pairs(spark, monkeypatch):
    from cadence.llm import line_dedup

    made, keep = [], line_dedup.keep

    def counted(df, name, **options):
        kept = keep(df, name, **options)
        if name == "pairs":
            made.append(kept.count())
        return kept

    monkeypatch.setattr(line_dedup, "keep", counted)
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{k}" for k in rng.permutation(1500)[:250])) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace("w1", "x1", 3)) for i in range(5)]  # near copies are found among them
    assert {r.doc_id: r.removed for r in removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute_lines(rows) == {100 + i: [0] for i in range(5)}
    assert sum(made[1:]) < 60, made


def test_line_dedup(spark):
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(40)]
    base = [" ".join(rng.choice(words, n)) for n in (3, 5, 12, 30, 80, 200)]
    rows = []
    for d in range(30):
        own = []
        for _ in range(6):
            w = str(rng.choice(base)).split()
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(len(w))] = str(rng.choice(words))
            own.append(" ".join(w))
        rows.append((d, "\n".join(own)))
    rows += [(40, None), (41, ""), (42, "\n \n\t\n"), (43, "V1  v2\n" + base[3].upper() + "\n\n" + base[3] + " \n"), (44, "q " * 5000)]
    docs = spark.createDataFrame([(d, t, d, "x") for d, t in rows], "doc_id long, text string, no long, doc string")
    got = {r.doc_id: r.removed for r in removed_lines(docs).collect()}
    assert got == brute_lines(rows)
    kept = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert dedup_lines(docs).columns == docs.columns and len(kept) == len(rows)
    for d, t in rows:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in got.get(d, []))
        assert kept[d].text == want and kept[d].no == d
    assert dedup_lines(docs.limit(0)).count() == 0
    none = spark.createDataFrame([(None, base[3]), (None, base[3]), (1, base[3] + "\nend"), (1, base[3] + "\nend")], "doc_id long, text string")
    assert sorted(r.text for r in dedup_lines(none).collect()) == sorted([base[3], base[3], "end", "end"])


def test_texts_are_not_shuffled_for_many_changed_documents(spark):
    n = 100_100
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('one line of all\nown', id) AS text")
    out = dedup_lines(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert out.where("text NOT LIKE '%\n%'").count() == n - 1


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "near_dedup", "packing"]
    for name, stage in p.STAGES:
        before, out = docs, stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.schema == before.schema
        old, new = {r.doc_id: r.text for r in before.collect()}, docs.collect()
        if name == "language_id":
            assert {r.doc_id for r in new} >= {i for i, t in old.items() if re.search(r"[^\W\d_]", t or "") and len(t) > 300}
        if name == "line_dedup":
            gone = brute_lines(list(old.items()))
            assert {r.doc_id: r.text for r in new} == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, [])) for i, t in old.items()}
        if name == "near_dedup":
            assert {r.doc_id for r in new} == {i for i, (_, c) in brute_components(list(old.items())).items() if c == i}
    assert p.run(spark, sf).count() == docs.count()
