import math

import numpy as np

from tidemark.llm import cover_tree


def brute(rows, k=5, every=50):
    seen = {}
    for i, e in rows:
        if i is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        seen[(i, tuple(math.floor(256 * float(np.float32(x))) for x in e))] = None
    out = []
    for i, q in seen:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in seen if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, **options):
    t = spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<float>, rank int")
    return sorted(map(tuple, cover_tree.top_k(t, **options).collect()))


def test_equals_brute_force_in_several_blocks(spark):
    r = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in r.normal(size=8) * r.choice([0.2, 1, 5])]) for i in range(700)]
    assert run(spark, rows, block_rows=150, query_rows=5) == brute(rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (None, [9.0, 9.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [1.0, 2.0]), (10, [1.0, 2.0, 3.0]), (50, []), (51, []), (100, [-1.0, -0.001]), (100, [-1.0, -0.001]), (150, [4.0, 4.0, 4.0, 4.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_large_components_stay_exact():
    v = np.array([[2.0**31, 1.0], [2.0**31, 2.0], [2.0**31, 3.0]])
    q, i, s = cover_tree.search(np.array([0]), v[:1], np.array([0, 1, 2]), v, 2)
    assert i.tolist() == [2, 1] and s.tolist() == [2**62 + 3, 2**62 + 2]


def test_clusters_are_pruned():
    r = np.random.default_rng(2)
    centre = r.normal(size=(40, 16)) * 2000
    points = np.floor(np.repeat(centre, 500, axis=0) + r.normal(size=(20000, 16)) * 5)
    stats = {}
    ids = np.arange(20000)
    q, i, s = cover_tree.search(ids[::50], points[::50], ids, points, 5, stats)
    want = points[::50] @ points.T
    for row in range(400):
        own = row * 50
        order = [j for j in np.lexsort((ids, -want[row])) if j != own][:5]
        assert i[q == own].tolist() == order
    assert stats["compared"] < 0.3 * 400 * 20000


def test_every_node_covers_and_separates():
    r = np.random.default_rng(4)
    shapes = [r.normal(size=(3000, 3)) * 500, np.repeat(r.normal(size=(30, 16)) * 2000, 100, axis=0) + r.normal(size=(3000, 16)) * 5, np.ones((500, 4)), np.zeros((0, 4))]
    inner = 0
    for x in (np.floor(s).astype(np.int64) for s in shapes):
        t = cover_tree.CoverTree(np.arange(len(x)), x, 16, 4)
        assert np.array_equal(t.points, x[t.ids]) and sorted(t.ids) == list(range(len(x)))
        for i in range(len(t.radius)):
            part = t.points[t.start[i] : t.stop[i]]
            if len(part):
                assert np.isclose(np.linalg.norm(part - t.centres[i], axis=1).max(), t.radius[i])
            kids = np.arange(t.first[i], t.last[i])
            if len(kids):
                inner += 1
                assert t.start[kids[0]] == t.start[i] and t.stop[kids[-1]] == t.stop[i] and (t.stop[kids[:-1]] == t.start[kids[1:]]).all()
                assert (t.radius[kids] <= t.radius[i] / 2 + 1e-6).all()
                apart = np.linalg.norm(t.centres[kids][:, None] - t.centres[kids][None], axis=2)
                assert (apart[~np.eye(len(kids), dtype=bool)] > t.radius[i] / 2).all()
    assert inner > 20


def test_saved_trees_come_back(tmp_path):
    t = cover_tree.CoverTree(np.arange(200), np.arange(800).reshape(200, 4) ** 2 % 977, 8)
    t.save(str(tmp_path / "t.npz"))
    back = cover_tree.CoverTree.load(str(tmp_path / "t.npz"))
    assert all(np.array_equal(getattr(t, f), getattr(back, f)) for f in (*t.FIELDS, "centres", "norms"))


def test_bounds_prune_across_blocks(spark):
    """Clusters over many blocks: most pairs of query group and block are never read, and few products are made in the rest."""
    r = np.random.default_rng(5)
    centre = r.normal(size=(24, 16)) * 8
    x = np.repeat(centre, 250, axis=0) + r.normal(size=(6000, 16)) * 0.02
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    told = cover_tree.search_blocks(t, block_rows=400, query_rows=20).where("query_id is null").toPandas()
    groups, blocks = told["grp"].nunique(), 24
    assert told["block"].nunique() >= 12 and len(told) < 0.3 * groups * blocks
    assert told["compared"].sum() < 0.2 * 120 * 6000
    assert run(spark, rows, block_rows=400, query_rows=20) == brute(rows)


def test_one_vector_a_third_of_all_rows(spark):
    r = np.random.default_rng(6)
    rows = [(i, [1.0, 1.0, 1.0, 1.0] if i % 3 == 0 else [float(c) for c in r.normal(size=4)]) for i in range(900)]
    assert run(spark, rows, block_rows=64, query_rows=4, chunk=3) == brute(rows)
