"""Delta Lloyd against plain Lloyd in Python."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadence.llm.delta_lloyd import EXACT, cluster, reassigned, squared_distances

SCHEMA = "vec_id long, embedding array<double>, cluster string, v int"


def plain(rows, k, rounds, size):
    """{(id, vector): (cluster, distance, digest)}, and the sums of distances by cluster, of rows (id, vector)."""
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in start]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[v for _, v in kept if nearest(v)[1] == n] for n in range(len(centroids))]
        centroids = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for vs, c in zip(own, centroids)]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    out = [(i, nearest(v)[1], nearest(v)[0], digests[nearest(v)[1]]) for i, v in kept]
    inertia = {n: sum(d for _, m, d, _ in out if m == n) for n in range(len(centroids))}
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), x) for i, n, d, x in out), key=str)


def found(spark, rows, **settings):
    given = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in cluster(given, **settings).collect()), key=str)


@pytest.mark.parametrize("k", [3, 7])
def test_against_plain_lloyd(spark, k):
    draw = random.Random(5)
    rows = [(i, [draw.uniform(-2, 2) + 3 * (i % 4) for _ in range(4)]) for i in range(150)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(200, 280)]  # a hot vector
    rows += [(7, rows[7][1]), (7, rows[7][1]), (8, rows[9][1]), (None, [1.0] * 4)]  # repeated rows and ids, and a row without id
    rows += [(300, None), (301, [1.0]), (302, [1.0] * 5), (303, [1.0, None, 1.0, 1.0]), (304, [float("nan")] * 4), (305, [float("inf"), 0.0, 0.0, 0.0]), (306, [])]
    assert found(spark, rows, k=k, components=4) == plain(rows, k, 3, 4)


def test_fewer_vectors_than_centroids_and_equal_ones(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [5.0, 5.0])]
    assert found(spark, rows, components=2) == plain(rows, 16, 3, 2)


def test_nothing_to_cluster(spark):
    assert found(spark, [(1, None)]) == [] and cluster(spark.createDataFrame([], SCHEMA)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_too_large_raise(spark):
    with pytest.raises(Exception, match="a scaled component is not under"):
        found(spark, [(1, [1e30, 0.0])], components=2)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([3, 10 * EXACT]))
def test_a_round_that_meets_changed_centroids_only(seed, width):
    draw = np.random.default_rng(seed)
    v, before = draw.integers(-width, width + 1, (30, 3)), draw.integers(-width, width + 1, (5, 3))
    owner, distance = reassigned(v, np.full(30, -1), np.zeros(30, np.int64), before, np.ones(5, bool))
    changed = draw.random(5) < 0.4
    after = np.where(changed[:, None], draw.integers(-width, width + 1, (5, 3)), before)
    got = reassigned(v, owner, distance, after, changed)
    away = np.array([[sum(int(a - b) ** 2 for a, b in zip(x, c)) for c in after] for x in v])
    assert (got[0] == away.argmin(axis=1)).all() and (got[1] == away.min(axis=1)).all() and (squared_distances(v, after) == away).all()
