import hashlib

import numpy as np
import pytest

from tidemark.llm import weighted_lloyd as wl

SCHEMA = "vec_id long, embedding array<float>, label int, v int, cluster string, weight int, distance int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, None, None, None, None) for i, v in rows], SCHEMA)


def brute(rows, size, count, rounds):
    """Python's integers over every row, equal ones included."""
    x = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]
    first = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[0] or 0, r[1]))
    centroids = [v for _, v in first[:count]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(centroids)), key=lambda k: (far(v, centroids[k]), k))
    for _ in range(rounds):
        own = [near(v) for _, v in x]
        for k in range(len(centroids)):
            if members := [v for (_, v), o in zip(x, own) if o == k]:
                centroids[k] = None, [sum(c) // len(members) for c in zip(*members)]
        centroids = [c[1] if isinstance(c, tuple) else c for c in centroids]
    out = [(i, near(v), far(v, centroids[near(v)])) for i, v in x]
    inertia = {k: sum(d for _, o, d in out if o == k) for k in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), sha[k]) for i, k, d in out), key=repr)


def check(spark, rows, size=4, count=3, rounds=4):
    want = brute(rows, size, count, rounds)
    got = sorted((tuple(r) for r in wl.cluster(table(spark, rows), size, count, rounds).collect()), key=repr)
    assert got == want
    return want


def test_against_plain_rounds_with_repeats_and_ties(spark):
    r = np.random.default_rng(2)
    vectors = (r.integers(-6, 7, (60, 4)) / 8).astype(np.float32).tolist()
    rows = [(i, vectors[int(r.integers(60))]) for i in range(300)] + [(1000 + i, vectors[7]) for i in range(200)]
    rows += [(5000, None), (5001, []), (5002, [0.1] * 3), (5003, [0.1, None, 0.1, 0.1]), (5004, [float("nan")] * 4), (5005, [float("-inf")] * 4), (None, vectors[0]), (None, vectors[1]), (3, vectors[2])]
    assert len(check(spark, rows)) == 503
    check(spark, rows, count=8, rounds=10)


def test_fewer_vectors_than_centroids_and_none(spark):
    assert len(check(spark, [(1, [0.5, 0.5, 0.5, 0.5]), (2, [0.5, 0.5, 0.5, 0.5]), (None, [0.0, 0.0, 0.0, 1.0])], count=8)) == 3
    assert wl.cluster(table(spark, []), 4, 3, 2).collect() == []
    assert wl.cluster(table(spark, [(1, None), (2, [1.0])]), 4, 3, 2).collect() == []


def test_large_components_are_added_exactly(spark):
    rows = [(i, [float(2.0 ** (20 + i % 5)), -float(i), 1e9 * (i % 2), 3e8]) for i in range(40)]
    want = brute(rows, 4, 2, 3)
    got = sorted((tuple(r) for r in wl.cluster(table(spark, rows), 4, 2, 3).collect()), key=repr)
    fits = lambda v: v if not isinstance(v, int) or v < 2**63 else None
    assert got == sorted((tuple(map(fits, r)) for r in want), key=repr)


@pytest.mark.parametrize("dtype", [np.int64, object])
def test_ties_go_to_the_smaller_number(dtype):
    x = np.array([[0, 0], [4, 0]], dtype)
    k, d = wl.nearest(x, np.array([[2, 0], [-2, 0], [6, 0], [2, 0]], object))
    assert k.tolist() == [0, 0] and [int(v) for v in d] == [4, 4]
