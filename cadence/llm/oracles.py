"""DuckDB statements for the queries that SQL can express; tests/llm compares the others with brute force."""

from __future__ import annotations

from cadence.llm.url_filter import ALPHABET, CLASSES, FARTHEST, RULES, STEPS

OP2 = """
WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM p)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 20
"""

OP3 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
kinds AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
each AS (SELECT rep, n, unnest(s) AS x FROM kinds),
links AS (SELECT a.rep AS a, b.rep AS b FROM each a JOIN each b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS node, rep AS found FROM kinds UNION SELECT ends.b, reach.found FROM reach JOIN ends ON ends.a = reach.node),
least AS (SELECT node, min(found) AS component FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(component, s.doc_id) AS component_id, coalesce(component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN kinds k ON k.s = list_sort(s.s) AND len(s.s) > 0 LEFT JOIN least ON least.node = k.rep
"""

OP4 = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
n AS (SELECT doc_id, coalesce(len(l), 0) AS n_lines, range(len(l)) AS no, l FROM l),
line AS (SELECT doc_id, unnest(no) AS no, unnest(l) AS line FROM n),
w AS (SELECT doc_id, no, [x FOR x IN regexp_split_to_array(lower(line), '[ \t\n\x0B\f\r]+') IF x <> ''] AS w FROM line),
s AS (SELECT doc_id, no, list_sort(list_distinct(w)) AS s FROM w WHERE len(w) > 0),
kinds AS (SELECT s, min((doc_id, no)) AS first, len(s) AS n, row_number() OVER () AS k FROM s GROUP BY s),
each AS (SELECT k, first, n, unnest(s) AS x FROM kinds),
match AS (SELECT DISTINCT k FROM (SELECT b.k FROM each a JOIN each b ON a.x = b.x AND a.first < b.first AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*)))),
gone AS (SELECT s.doc_id, s.no FROM s JOIN kinds USING (s) WHERE (s.doc_id, s.no) <> first OR k IN (SELECT k FROM match)),
byd AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) AS removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed FROM n LEFT JOIN byd USING (doc_id)
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), h AS (SELECT *, CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS head FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN head <> page_id THEN head END AS refers_to FROM h
"""


def _op11(k: int = 16, rounds: int = 3) -> str:
    """Plain Lloyd: every round compares all, and sums all anew."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS (SELECT row, min((d, c)).c AS c, min((d, c)).d AS d FROM (SELECT row, c, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(r.v, k.v)]) AS BIGINT) AS d FROM r, c{n} k) GROUP BY row)""".replace("min((d, c)).c", "min({'d': d, 'c': c}).c").replace("min((d, c)).d", "min({'d': d, 'c': c}).d"))
        if n < rounds:
            steps.append(f"""m{n} AS (SELECT c, list(CAST(floor_div AS BIGINT) ORDER BY i) AS v FROM (SELECT c, i, (s - ((s % n) + n) % n) // n AS floor_div FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{n} JOIN r USING (row)) GROUP BY c, i)) GROUP BY c),
c{n + 1} AS (SELECT c, coalesce(m.v, k.v) AS v FROM c{n} k LEFT JOIN m{n} m USING (c))""")
    return f"""
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
r AS (SELECT *, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) AS row FROM v),
c0 AS (SELECT row - 1 AS c, v FROM r WHERE row <= {k}),
{", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN r USING (row) JOIN c{rounds} k USING (c)
"""


def _op9() -> str:
    rules = sorted(RULES, key=lambda r: (-len(r.text), r.text))
    fits = " ".join(f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND path LIKE '{r.path}%' THEN '{r.text}'" for r in rules)
    allowed = ", ".join(f"'{r.text}'" for r in RULES if r.action == "allow")
    share = lambda c, n, t, p: f"CASE WHEN coalesce({n}, 0) > 0 THEN (coalesce({c}, 0) + {t} * {p}) / ({n} + {t}) ELSE {p} END"
    return f"""
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS row FROM u),
ruled AS (SELECT *, CASE {fits} END AS rule FROM parts),
coded AS (SELECT *, [instr('{ALPHABET}', c) FOR c IN string_split(translate(lower(coalesce(url, '')), '123456789', '000000000'), '') IF c <> ''] || [0] AS codes FROM ruled),
pos AS (SELECT row, rule, url, unnest(range(1, len(codes) + 1)) AS i, codes FROM coded),
tri AS (SELECT row, rule, url, CASE WHEN i > 2 THEN codes[i - 2] ELSE 0 END AS a, CASE WHEN i > 1 THEN codes[i - 1] ELSE 0 END AS b, codes[i] AS c FROM pos),
c3 AS (SELECT rule IN ({allowed}) AS k, a, b, c, count(*) AS n FROM tri WHERE rule IS NOT NULL AND NOT md5(url) < '3' GROUP BY ALL),
n2 AS (SELECT k, a, b, sum(n) AS n, count(*) AS t FROM c3 GROUP BY ALL), c2 AS (SELECT k, b, c, sum(n) AS n FROM c3 GROUP BY ALL), n1 AS (SELECT k, b, sum(n) AS n, count(*) AS t FROM c2 GROUP BY ALL),
c1 AS (SELECT k, c, sum(n) AS n FROM c2 GROUP BY ALL), n0 AS (SELECT k, sum(n) AS n, count(*) AS t FROM c1 GROUP BY ALL),
kinds AS (SELECT unnest([true, false]) AS k),
grams AS (SELECT DISTINCT a, b, c FROM tri),
p0 AS (SELECT k, g.c, {share('c1.n', 'n0.n', 'n0.t', f'(1.0::DOUBLE / {CLASSES})')} AS p FROM (SELECT DISTINCT c FROM grams) g CROSS JOIN kinds LEFT JOIN c1 USING (k, c) LEFT JOIN n0 USING (k)),
p1 AS (SELECT k, g.b, g.c, {share('c2.n', 'n1.n', 'n1.t', 'p0.p')} AS p FROM (SELECT DISTINCT b, c FROM grams) g CROSS JOIN kinds JOIN p0 USING (k, c) LEFT JOIN c2 USING (k, b, c) LEFT JOIN n1 USING (k, b)),
p2 AS (SELECT k, g.a, g.b, g.c, {share('c3.n', 'n2.n', 'n2.t', 'p1.p')} AS p FROM grams g CROSS JOIN kinds JOIN p1 USING (k, b, c) LEFT JOIN c3 USING (k, a, b, c) LEFT JOIN n2 USING (k, a, b)),
ratio AS (SELECT x.a, x.b, x.c, ln(x.p) - ln(y.p) AS r FROM p2 x JOIN p2 y ON x.a = y.a AND x.b = y.b AND x.c = y.c AND x.k AND NOT y.k),
scored AS (SELECT row, sum(r) / count(*) AS score FROM tri JOIN ratio USING (a, b, c) GROUP BY row),
steps AS (SELECT row, score, greatest(-{FARTHEST}, least({FARTHEST}, CAST(floor(score * {STEPS}) AS INTEGER))) AS step FROM scored),
cal AS (SELECT step, count(*) FILTER (WHERE rule IN ({allowed})) AS acc, count(*) FILTER (WHERE NOT rule IN ({allowed})) AS rej FROM steps JOIN ruled USING (row) WHERE rule IS NOT NULL AND md5(url) < '3' GROUP BY step),
gain AS (SELECT x.step, (SELECT coalesce(sum(acc), 0) FROM cal WHERE step >= x.step) * (SELECT sum(rej) FROM cal) + (SELECT coalesce(sum(rej), 0) FROM cal WHERE step < x.step) * (SELECT sum(acc) FROM cal) AS g FROM cal x WHERE (SELECT sum(rej) FROM cal) > 0 AND (SELECT sum(acc) FROM cal) > 0),
at AS (SELECT coalesce((SELECT step FROM gain ORDER BY g DESC, abs(step), step LIMIT 1), 0) AS step)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({allowed}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN steps.step >= (SELECT step FROM at) THEN 'allow' ELSE 'block' END AS verdict,
  CASE WHEN rule IS NULL THEN round(score, 6) + 0.0 END AS score FROM ruled LEFT JOIN steps USING (row)
""".replace("at AS (", "cut AS (").replace("FROM at)", "FROM cut)")


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": OP2, "op3_minhash_near_dedup": OP3, "op4_line_dedup": OP4, "op6_warc": OP6, "op9_url_filter": _op9(), "op11_centroid_clustering": _op11()}
