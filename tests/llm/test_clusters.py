"""Operator 13: rounds against plain Python; edge cases."""

import hashlib
import math
import random

import pytest

from orograph.llm import clusters


def vectors(spark, rows):
    """Vectors with extra columns whose names clash with what the operator adds."""
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string")


def brute(rows, k, rounds, dimensions, seed=2):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) and abs(x) <= 1 << 19 for x in v)]
    centroids = [v for _, _, v in sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v, v) for i, v in kept)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, g in groups.items():
            centroids[n] = [sum(x) // len(g) for x in zip(*g)]
    found = [(i, *near(v)) for i, v in kept]
    own = [sum(d for _, d, n in found if n == m) for m in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, own[n], sum(own), digest[n]) for i, d, n in found), key=str)


def numbers(n, dimensions, seed=1):
    draw = random.Random(seed)
    return [(i, [draw.choice([-1.0, 0.0, 0.25, draw.gauss(0, 2)]) for _ in range(dimensions)]) for i in range(n)]


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_query_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 50)
    rows = numbers(400, 64)
    rows += [(1000, None), (1001, []), (1002, [0.5] * 63), (1003, [0.5] * 65), (1004, [math.nan] + [0.5] * 63), (1005, [math.inf] * 64), (1006, [None] + [0.5] * 63), (None, [0.5] * 64), (1007, [1e30] * 64)]
    assert found(clusters.cluster_rows(vectors(spark, rows).repartition(5))) == brute(rows, 40, 5, 64)


@pytest.mark.parametrize("k, rounds", [(3, 0), (1, 2), (500, 3)])
def test_other_parameters(spark, k, rounds):
    rows = numbers(60, 3)
    assigned, known = clusters.cluster(vectors(spark, rows), k, rounds, 3)
    wanted = brute(rows, k, rounds, 3)
    assert sorted((tuple(r) for r in assigned.collect()), key=str) == sorted((w[:3] for w in wanted), key=str)
    known = known.collect()
    assert len(known) == min(k, 60) and sum(r["size"] for r in known) == 60 and sum(r.inertia for r in known) == wanted[0][4]


def test_repeated_rows_and_ties(spark):
    """One vector holds most rows and takes several first centroids: the smallest number
    of equals takes all, the others stay empty where they are."""
    rows = [(5, [1.0] * 64)] * 200 + numbers(30, 64)
    assert found(clusters.cluster_rows(vectors(spark, rows).repartition(9))) == brute(rows, 40, 5, 64)
    _, known = clusters.cluster(vectors(spark, [(5, [1.0] * 64)] * 50))
    assert sorted((r["cluster"], r["size"]) for r in known.collect()) == [(0, 50)] + [(i, 0) for i in range(1, 40)]


def test_halfway_and_negative_means(spark):
    rows = [(i, [x / 256, -x / 256]) for i, x in enumerate([0, 1, 3, -7, -8, 100, 101])]
    assigned, known = clusters.cluster(vectors(spark, rows), 2, 5, 2)
    assert sorted((tuple(r) for r in assigned.collect()), key=str) == sorted((w[:3] for w in brute(rows, 2, 5, 2)), key=str)


def test_largest_components_and_sums(spark):
    rows = [(i, [(-1.0) ** i * (1 << 19)] * 64) for i in range(6)] + [(9, [float((1 << 19) + 1)] * 64)]
    made = clusters.cluster_rows(vectors(spark, rows)).collect()
    assert len(made) == 6 and all(r.distance == 0 for r in made)
    assigned, known = clusters.cluster(vectors(spark, rows), 1, 0)
    assert sum(r.distance for r in assigned.collect()) > clusters._LONG and known.first().inertia == clusters._LONG


def test_empty_table(spark):
    assert clusters.cluster_rows(vectors(spark, [])).count() == 0
    assert clusters.cluster_rows(vectors(spark, [(1, None)])).count() == 0
