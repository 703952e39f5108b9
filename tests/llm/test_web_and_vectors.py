"""WARC, URL filters and the two searches, and the registered SQL."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.llm import oracles, queries
from cadence.llm.cover_tree import CoverTree, dual_tree_search
from cadence.llm.exact_topk import exact_topk
from cadence.llm.pstable import nearest, probe_sets
from cadence.llm.shared import fresh_path
from cadence.llm.url_filter import ALPHABET, CLASSES, judge_urls
from cadence.llm.warc import archive_round_trip, read_archives, record_chunks, write_archives


def test_warc_round_trip(spark):
    big = "ü" * 2_000_000
    rows = [(5, "http://a/ x\n", "p" * 100), (2, None, "p" * 100), (9, "u", "p" * 100), (1, "u", "q" * 99), (3, "u", "q" * 99), (4, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big), (10, "u", "WARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, head int")
    got = {r.page_id: r for r in archive_round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        first = min(j for j, _, x in rows if x == h) if len(data) >= 100 else i
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "response" if first == i else "revisit", None if first == i else first)
    assert archive_round_trip(pages.limit(0)).count() == 0


def test_warc_chunks_carry_their_digests(spark):
    pages = spark.createDataFrame([(1, "u", "abc" * 5000)], "page_id long, url string, html string")
    archives = write_archives(record_chunks(pages, "page_id", "url", F.col("html"), 4096), fresh_path(spark, "warc"))
    rows = sorted(read_archives(spark.createDataFrame(archives.collect()), 4096).collect(), key=lambda r: r.chunk_no)
    data = b"".join(bytes(r.data) for r in rows)
    assert data == b"abc" * 5000 and [r.last for r in rows] == [False] * (len(rows) - 1) + [True] and max(len(r.data) for r in rows) <= 4096
    for r in rows:
        assert r.sha256_so_far == hashlib.sha256(data[: r.bytes_so_far]).hexdigest()


def python_ratios(accepted, rejected):
    """Witten-Bell in dictionaries."""
    code = lambda u: [0, 0, *(ALPHABET.find(c) + 1 for c in "".join("0" if c in "123456789" else c for c in u.lower())), 0]
    tables = []
    for urls in (accepted, rejected):
        n = [defaultdict(int) for _ in range(3)]
        for u in urls:
            x = code(u)
            for i in range(2, len(x)):
                for k in range(3):
                    n[k][tuple(x[i - k : i + 1])] += 1
        tables.append(n)

    def p(n, gram):
        k = len(gram) - 1
        lower = p(n, gram[1:]) if k else 1 / CLASSES
        own = {g: c for g, c in n[k].items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        return (own.get(gram, 0) + len(own) * lower) / (total + len(own)) if total else lower

    def score(u):
        x = code(u)
        r = [math.log(p(tables[0], tuple(x[i - 2 : i + 1]))) - math.log(p(tables[1], tuple(x[i - 2 : i + 1]))) for i in range(2, len(x))]
        return sum(r) / len(r)

    return score


def test_url_rules_and_scores(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.NET/en/1?x", "https://a.example.net/de/1", "http://example.net/en", "http://net/", "http://xnet/", "http://b.example.com/de/2#x", "http://example.com/fr/", "http://c.org/fr/1", "http://org/fr/", "ftp://x?y/net/", "a://b://net/", "http://é.org/é\n", "http://example.com/de/2#x"]
    urls += [f"http://s{i}.example.net/en/{i}" for i in range(20)] + [f"http://t{i}.shop.net/buy?{i}" for i in range(20)]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, row int")
    got = {r.page_id: r for r in judge_urls(pages).collect()}
    assert len(got) == len(urls)
    want = {0: ("", "", None), 2: ("", "", None), 3: ("www.example.net", "/en/1", "example.net/en/"), 4: ("a.example.net", "/de/1", "net/"), 5: ("example.net", "/en", "net/"), 6: ("net", "/", "net/"), 7: ("xnet", "/", None), 8: ("b.example.com", "/de/2", "example.com/de/"), 10: ("c.org", "/fr/1", "org/fr/"), 11: ("org", "/fr/", "org/fr/"), 12: ("x", "", None), 13: ("b:", "//net/", None)}
    assert {i: (got[i].host, got[i].path, got[i].rule) for i in want} == want
    ruled = [(u, got[i].verdict) for i, u in enumerate(urls) if got[i].rule and hashlib.md5(u.encode()).hexdigest() >= "3"]
    score = python_ratios([u for u, v in ruled if v == "allow"], [u for u, v in ruled if v == "block"])
    for i, u in enumerate(urls):
        if got[i].rule is None:
            assert got[i].score == pytest.approx(score(u or ""), abs=1e-9)
    assert judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in judge_urls(pages.where("page_id in (0, 2, 7)")).collect()} == {"allow"}


def brute_top(ids, vectors, query, k, score):
    own = [(-score(vectors[query], v), i) for i, v in zip(ids, vectors) if i != ids[query]]
    return [(i, -s) for s, i in sorted(own)[:k]]


def test_topk_raises_where_scores_would_not_be_exact(spark):
    rows = [(0, [2.0**18, 3.0]), (1, [2.0**18 + 1 / 64, -1.0]), (2, [-(2.0**18), 1.0])]
    got = exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()
    scaled = {i: [int(64 * x) for x in v] for i, v in rows}
    assert {(r.vec_id, r.score) for r in got} == {(i, sum(a * b for a, b in zip(scaled[0], scaled[i]))) for i in (1, 2)}
    with pytest.raises(Exception, match="too large for exact scores: 7"):
        exact_topk(spark.createDataFrame([*rows, (7, [1e12, 3.0])], "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()


def test_exact_topk(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(150, 6)), np.repeat(rng.normal(size=(1, 6)), 60, 0), rng.normal(size=(40, 6)) * 9])
    ids = rng.permutation(len(x)) * 5
    v = np.floor(64 * x)
    rows = [(int(i), y.tolist(), 1, 2) for i, y in zip(ids, x)] + [(7, None, 0, 0), (9, [1.0, None], 0, 0), (11, [float("nan")], 0, 0), (13, [float("inf")], 0, 0), (None, [1.0], 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, q int")
    df = df.union(df.where("vec_id = 10"))
    for blocks in ((4096, 8192), (4, 64)):
        got = defaultdict(list)
        for r in exact_topk(df, F.col("id") % 20 == 0, k=20, query_block=blocks[0], data_block=blocks[1]).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        want = {int(i): brute_top(ids.tolist(), v, k, 20, lambda a, b: int(a @ b)) for k, i in enumerate(ids) if i % 20 == 0}
        assert got == want
    assert exact_topk(df.limit(0), F.col("id") % 20 == 0).count() == 0
    few = exact_topk(df.where("vec_id in (0, 5, 10)"), F.col("id") % 20 == 0)
    assert few.count() == 2


def test_cover_tree_covers():
    x = np.random.default_rng(4).normal(size=(700, 3))
    t = CoverTree(x, 16)

    def below(n):
        return [t.members[n]] if t.members[n] is not None else [m for c in t.children[n] for m in below(c)]

    for n in range(len(t.centre)):
        at = np.concatenate(below(n))
        assert np.sqrt(((x[at] - t.centre[n]) ** 2).sum(1)).max() <= t.radius[n] + 1e-9
    assert sorted(np.concatenate(below(0)).tolist()) == list(range(700))
    q, i, s = dual_tree_search(x[:50], np.arange(50), x, np.arange(700), 3, 16)
    assert len(q) == 150


def test_cover_tree_of_points_without_structure_has_few_leaves():
    x = np.floor(64 * np.random.default_rng(5).normal(size=(3000, 64)))
    t = CoverTree(x, 64)
    assert t.leaves < 8 * 3000 / 64
    q, i, s = dual_tree_search(x[:40], np.arange(40), x, np.arange(3000), 20, 64)
    got = defaultdict(list)
    for a, b, c in zip(q.tolist(), i.tolist(), s.tolist()):
        got[a].append((b, c))
    assert got == {k: brute_top(range(3000), x, k, 20, lambda a, b: float(a @ b)) for k in range(40)}


def test_nearest(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres[rng.integers(30, size=900)] + 0.3 * rng.normal(size=(900, 16)), np.ones((100, 16))])
    rows = [(i, y.tolist(), 1) for i, y in enumerate(x)] + [(2000, [0.0] * 16, 1), (2001, None, 1), (2002, [float("nan")] * 16, 1), (2050, [0.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in nearest(df, F.col("id") % 50 == 0, piece=40).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = []
    assert sorted(got) == list(range(0, 1000, 50))
    for q, own in got.items():
        s = u @ u[q]
        s[q] = -2
        best = sorted(range(1000), key=lambda i: (-round(s[i], 12), i))[:5]
        hits.append(len({i for i, _ in own} & set(best)) / 5)
        assert all(sc == pytest.approx(s[i], abs=1e-12) for i, sc in own) and [i for i, _ in own] == [i for i, _ in sorted(own, key=lambda y: (-y[1], y[0]))]
    assert np.mean(hits) >= 0.9
    assert [i for i, _ in got[950]] == [900, 901, 902, 903, 904]
    assert nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_recall_on_the_table(spark):
    d = "/root/testdata/sf0.01"
    t = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    x = np.stack(t["embedding"]).astype(float)
    u, ids = x / np.linalg.norm(x, axis=1)[:, None], t["vec_id"].to_numpy()
    got = queries.op10_nearest_neighbours(spark, d).toPandas().groupby("query_id")["vec_id"].apply(set)
    hits = []
    for k in np.flatnonzero(ids % 50 == 0):
        s = u @ u[k]
        s[k] = -2
        hits.append(len(got[ids[k]] & set(ids[np.lexsort((ids, -s))[:5]])) / 5)
    assert np.mean(hits) >= 0.9


def test_probe_sets():
    sets = probe_sets(4, 40)
    assert sets[0] == () and sets[1] == (0,) and len(set(sets)) == 40
    assert all(not (7 - a in s) for s in sets for a in s)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_registered_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.sql(oracles.oracle_sql()[name])
    df = queries.queries()[name](spark, d)
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    show = lambda v: "null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    assert sorted(tuple(show(v) for v in r) for r in df.collect()) == sorted(tuple(show(r[i]) for i in at) for r in want.fetchall())
