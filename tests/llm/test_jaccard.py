import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join as jj

LOWER = {c: chr(c + 32) for c in range(65, 91)}


def brute_set(text, words=4):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_links(sets, percent=85):
    return {(i, j) for j in range(len(sets)) for i in range(j) if (both := len(sets[i] & sets[j])) and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)}


def brute_components(rows, percent=85):
    """rows: (doc_id, text); of each row its id, set size and component."""
    sets, label = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in brute_links(sets, percent):
        label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def check(table, percent=85, **options):
    want = brute_components([tuple(r) for r in table.select("doc_id", "text").collect()], percent)
    got = sorted((tuple(r) for r in jj.components(table, percent=percent, **options).collect()), key=repr)
    assert got == want
    return want


def made(spark, seed=1, n=400, low=3, high=90):
    """Bases with edited copies near the threshold, exact copies, and a passage that half of them share."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    passage = [word() for _ in range(30)]
    texts = []
    while len(texts) < n:
        base = [word() for _ in range(r.randint(low, high))] + (passage if r.random() < 0.5 else [])
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, len(base) // 25])):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy[r.choice([0, 0, 0, 2]) :]))
    r.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_documents_against_brute_force(docs):
    check(docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_near_the_threshold(spark, seed):
    want = check(made(spark, seed))
    assert len({c for _, _, c in want}) < 350


def test_short_sets_and_other_thresholds(spark):
    check(made(spark, 3, 300, 1, 12))
    check(made(spark, 4, 200, 5, 40), percent=60)


def test_odd_documents(odd_docs, empty_docs):
    check(odd_docs)
    assert jj.components(empty_docs).collect() == []


def test_every_route_alone_finds_all(spark, monkeypatch):
    """All sets light, all heavy, small blocks, and shingles of the passage last in the order."""
    table = made(spark, 5, 250)
    for heavy_from in (1, 10**6, 40):
        monkeypatch.setattr(jj, "boundary", lambda cost, percent, at=heavy_from: at)
        check(table)
    monkeypatch.setattr(jj, "BLOCK_ROWS", 8)
    monkeypatch.setattr(jj, "LEAST_FREQUENT", 3)
    check(table)


def test_lists_in_small_blocks_hold_each_pair_once(spark):
    lists = spark.range(50).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("node"), (F.col("id") % 3).alias("comp"), F.lit(50).cast("long").alias("rows"))
    bits = jj.parity(np.arange(20, dtype=np.uint64) << np.uint64(20))
    blocks = jj.in_blocks(lists, 8).withColumn("n", F.lit(20).cast("long")).withColumn("bits", F.lit(bits)).withColumn("lo", F.lit(0).cast("long")).withColumn("part", F.col("block") % 3)
    assert blocks.groupBy("key", "block").count().agg(F.max("count")).first()[0] < 25
    found = [tuple(r) for r in jj.scanned(blocks, 85).collect()]
    assert len(found) == len(set(found))
    assert sorted(found) == sorted({(a, b) for a in range(50) for b in range(a + 1, 50) if a % 3 != b % 3})


def test_bounds_never_rule_out_a_similar_pair():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(6, 3000))
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        drop, new = int(r.integers(0, n // 8 + 1)), int(r.integers(0, n // 8 + 1))
        b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**63, new, dtype=np.uint64)]))
        if not jj.similar(a, b, 85):
            continue
        width, folded = jj.bitmap_rows([jj.parity(a), jj.parity(b)])
        w = int(width.min())
        most = len(a) + len(b) + 2 * (85 * (len(a) + len(b)) // -185)
        assert np.bitwise_count(folded[w][0] ^ folded[w][1]).sum() <= len(a) + len(b) - 2 * len(np.intersect1d(a, b)) <= most
        for k in (1, 2):
            x, y = (set(s[: jj.opening(len(s), k, 85)].tolist()) for s in (a, b))
            assert np.array_equal(a, b) or len(x & y) >= k


def test_boundary_takes_the_cheaper_side():
    sets = {b: 100 for b in range(8, 48)}
    assert jj.boundary([(b, n, 0) for b, n in sets.items()], 85) < 20
    assert jj.boundary([(b, n, 10**9) for b, n in sets.items()], 85) > 1000
    assert jj.boundary([], 85) == 1


def test_frequent_shingles_survive_merging():
    r, seen = np.random.default_rng(0), jj.Frequent()
    for _ in range(60):
        seen.add(np.unique(np.concatenate([np.arange(50, dtype=np.uint64), r.integers(100, 2**63, 60_000, dtype=np.uint64)])))
    seen.flush()
    assert len(seen.items) <= jj.MOST_FREQUENT and (seen.counts[:50] > 50).all() and (seen.items[:50] == np.arange(50)).all()


def test_long_texts_split_as_short_ones(monkeypatch):
    text = " ".join(f"A{i % 977}\t" for i in range(5000)) + "x" * 300
    want = jj.shingles(text, jj.WordHashes())
    monkeypatch.setattr(jj, "_STRETCH", 64)
    assert np.array_equal(jj.shingles(text, jj.WordHashes()), want) and len(want) == len(brute_set(text))


def test_lists_of_the_same_nodes_give_a_pair_once(spark):
    bits = jj.parity(np.arange(20, dtype=np.uint64) << np.uint64(20))
    rows = [(0, k, 0, v, v, 20, 0, bits) for k in range(12) for v in (range(3) if k == 3 else range(5))]
    blocks = spark.createDataFrame(rows, "lo long, key long, block int, node long, comp long, n long, slice int, bits binary")
    want = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    for parts in (1, 4):
        assert sorted(tuple(r) for r in jj.scanned(blocks.withColumn("part", F.col("key") % parts), 85).collect()) == want


@pytest.mark.parametrize("percent", [85, 75, 50, 34])
def test_small_sets_inside_one_of_one_more(spark, percent, monkeypatch):
    """At 85, six shingles link to the same six and another (6 / 7); below 51, sets may share a single shingle."""
    texts = [" ".join(f"p{i}w{j}" for j in range(n)) for i in range(12) for n in (i + 3, i + 4)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    linked = {s for d, s, c in check(table, percent) if d > c}
    assert 7 in linked if percent == 85 else min(linked) <= 4
    monkeypatch.setattr(jj, "boundary", lambda cost, percent: 10**6)
    check(table, percent)


def test_postings_stay_in_proportion_whatever_the_sample_says(spark, monkeypatch):
    """A common shingle in the sample speaks for light sets alone, whose 2-subsets grow with the square of a set."""
    table = made(spark, 6, 60, 300, 900)
    monkeypatch.setattr(jj, "boundary", lambda cost, percent: 10**6)
    monkeypatch.setattr(jj, "_KEYS", 500, raising=False)
    frequent, rank, at = jj.learned(table, 4, 85)
    keys = [r.k for r in jj.posted(table, 4, 85, frequent, rank, at).selectExpr("size(keys) as k").collect()]
    heavy = [r.k for r in jj.posted(table, 4, 85, frequent, rank, 1).selectExpr("size(keys) as k").collect()]
    assert len(keys) == table.count() and sum(keys) <= 2 * sum(heavy)
    check(table)


def test_light_sets_as_far_as_the_input_pays():
    assert jj.most_light([], 85) == 1
    assert jj.most_light([(b, 100) for b in range(8, 48)], 85) < 500 < jj.most_light([(20, 10), (36, 10**6)], 85)


def test_lists_part_where_sizes_are_too_different(spark):
    rows = [(i, n, [7]) for i, n in enumerate([10, 11, 12, 100, 110, 1000], 1)] + [(2, 11, [7]), (8, 50, [9]), (9, 58, [9]), (10, 50, [8]), (11, 59, [8])]
    lists = jj.lists_of(spark.createDataFrame(rows, "node long, n long, keys array<long>"), 85)
    got = sorted(sorted(r.nodes) for r in lists.groupBy("key").agg(F.collect_list("node").alias("nodes")).collect())
    assert got == [[1, 2, 3], [4, 5], [8, 9]]  # a repeated row counts once; 50 and 59 can't be similar


def test_lists_of_two_are_done_after_the_first_round(spark):
    lists = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (2, 3, 3)], "key long, node long, comp long")
    assert {r.key for r in jj.mixed(lists).collect()} == {2}
