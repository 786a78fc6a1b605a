import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, w string, n int, component int"


def table(spark, vectors):
    return spark.createDataFrame([(i if i % 7 else None, v, None, None, None, None, None) for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors):
    """Exact integers, then plain matrix products."""
    keep = [v for v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in keep]
    n, s = len(x), [sum(c) for c in zip(*x)]
    d = [[n * c - t for c, t in zip(row, s)] for row in x]
    centred = np.array([[float(c) / n for c in row] for row in d])
    v = centred.T @ centred / n
    return n, [sum(c * c for c in row) for row in d], centred, v


def test_whitened_vectors_against_numpy(spark):
    r = np.random.default_rng(1)
    vectors = (r.normal(size=(300, 12)) @ r.normal(size=(12, 12)) * 0.2).astype(np.float32).tolist()
    vectors += [None, [], [0.5] * 11 + [None], [0.5] * 11 + [float("nan")], [float("inf")] * 12, vectors[3], vectors[3]]
    rows = whitening.whiten(table(spark, vectors)).collect()
    n, deviation, centred, v = brute(vectors)
    assert len(rows) == 8 * n == 8 * 302 and {r.n for r in rows} == {n}
    assert sorted(r.deviation for r in rows if r.component == 1) == sorted(deviation)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    for k in range(1, 9):
        own = [r for r in rows if r.component == k]
        assert own[0].explained == pytest.approx(values[k - 1] / np.trace(v), rel=1e-9)
        got = np.array(sorted(r.whitened for r in own))
        want = centred @ axes[:, k - 1] / np.sqrt(values[k - 1])
        assert min(np.abs(got - np.sort(want)).max(), np.abs(got - np.sort(-want)).max()) < 1e-7
    w = np.array([[r.whitened for r in rows if r.component == k] for k in range(1, 9)])
    assert np.abs(w @ w.T / n - np.eye(8)).max() < 1e-8
    assert len({r.identity_error for r in rows}) == 1 and 0 <= rows[0].identity_error < 1e-8


def test_components_without_variance_and_lengths_apart(spark):
    flat = [[0.25, float(i), 2.0 * i] for i in range(5)] + [[1.0, 2.0]] * 3
    rows = whitening.whiten(table(spark, flat)).collect()
    three = [r for r in rows if r.n == 5]
    assert len(three) == 15 and all((r.whitened is None) == (r.component > 1) for r in three)
    assert three[0].identity_error < 1e-9 and {r.component: r.explained for r in three}[1] == pytest.approx(1)
    two = [r for r in rows if r.n == 3]
    assert len(two) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in two)


def test_empty_table(spark):
    out = whitening.whiten(table(spark, []))
    assert out.collect() == [] and out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(table(spark, [None, []])).count() == 0


def test_squares_beyond_64_bits_are_exact_or_null():
    d = np.array([[2**31, 1], [2**40, 0]], np.int64)
    assert whitening.exact_squares(d) == [2**62 + 1, None]
