import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def brute_targets(sizes):
    """sizes: source -> words. Shares by weight; what is above twice a source's size goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def check(table):
    rows = mixing.mix(table).collect()
    source = table.select("doc_id", "source", "text").collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert sorted((repr(r.doc_id), repr(r.source), r.size) for r in rows) == sorted((repr(r.doc_id), repr(r.source), size(r.text)) for r in source)
    total = defaultdict(int)
    for r in source:
        total[r.source] += size(r.text)
    target, taken, largest = brute_targets(total), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9)
        assert r.taken == r.size * r.copies <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in total:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6
    return rows


def test_mix_meets_targets(docs, odd_docs, empty_docs):
    check(docs)
    check(odd_docs)
    assert mixing.mix(empty_docs).collect() == []
    assert mixing.mix_documents(empty_docs).collect() == []


def test_reruns_agree_whatever_the_partitions(docs, odd_docs):
    for table in (docs, odd_docs):
        key = lambda rows: sorted((repr(r.doc_id), r.size, r.copies) for r in rows)
        assert key(mixing.mix(table).collect()) == key(mixing.mix(table.repartition(7)).collect())


def test_hot_source_needs_several_levels(spark):
    rows = [(i, "w " * (1 + i * 7919 % 50), "hot" if i % 20 else f"s{i % 3}") for i in range(9000)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    # Chances stay fair: small and large documents of the hot source are taken at the same rate.
    hot = [r for r in got if r.source == "hot"]
    rate = hot[0].target / hot[0].source_size
    for part in ([r for r in hot if r.size <= 25], [r for r in hot if r.size > 25]):
        assert sum(r.copies for r in part) / len(part) == pytest.approx(rate, abs=0.03)


def test_mix_documents_repeats_rows(docs, odd_docs):
    for table in (docs, odd_docs):
        out = mixing.mix_documents(table)
        assert out.columns == table.columns
        want = sorted(repr(r.doc_id) for r in mixing.mix(table).collect() if r.size for _ in range(r.copies))
        assert sorted(repr(r.doc_id) for r in out.collect()) == want


def scalar_step(a, x, rise):
    """One pivotal step over (size, p) in plain arithmetic: a rises while x falls, or the reverse, until one is whole."""
    give = min(a[0] * (1 - a[1]), x[0] * x[1]) if rise else min(a[0] * a[1], x[0] * (1 - x[1]))  # words
    sign = 1 if rise else -1
    return a[1] + sign * give / a[0], x[1] - sign * give / x[0]


def test_a_step_equals_scalar_arithmetic_and_keeps_expectations(spark):
    r = random.Random(9)
    pairs = [(n, r.randrange(1, 60), r.uniform(0.01, 0.99), r.randrange(1, 60), r.uniform(0.01, 0.99)) for n in range(400)]
    again = [(1000 + n, 7, 0.3, 20, 0.85) for n in range(6000)]
    rows = spark.createDataFrame([(n, n * 31, s, p, n * 37 + 5, t, q) for n, s, p, t, q in pairs + again], "n long, ka long, sa long, pa double, kx long, sx long, px double")
    item = lambda k, d, s, p: F.struct(F.col(k).alias("key"), F.lit(d).cast("long").alias("doc_id"), F.lit(1).alias("nth"), F.col(s).alias("size"), F.col(p).alias("p"))
    done = F.array().cast("array<struct<doc_id:bigint,key:bigint,nth:int,size:bigint,extra:int>>")
    met = rows.select("n", "sa", "pa", "sx", "px", mixing._meet(F.struct(item("ka", 1, "sa", "pa").alias("open"), done.alias("done")), item("kx", 2, "sx", "px")).alias("m")).collect()
    mean = [0.0, 0.0]
    for m in met:
        (out,), stay = m.m.done, m.m.open
        got = {out.doc_id: float(out.extra), stay.doc_id: stay.p}
        rise = got[1] > m.pa
        assert (got[1], got[2]) == pytest.approx(scalar_step((m.sa, m.pa), (m.sx, m.px), rise), abs=1e-9)
        assert m.sa * got[1] + m.sx * got[2] == pytest.approx(m.sa * m.pa + m.sx * m.px)
        if m.n >= 1000:
            mean[0] += got[1] / len(again)
            mean[1] += got[2] / len(again)
    assert mean == pytest.approx([0.3, 0.85], abs=0.02)


def test_the_text_decides_between_rows_equal_otherwise(spark):
    """Rows of equal id, source and size, null ids too: reruns over other partitions repeat the same texts."""
    rows = [(None if i % 2 else 7, f"text number {i % 50} " + "w " * 5, "s") for i in range(200)] + [(i + 100, "w " * (i % 9), "t") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, second = (sorted(map(repr, mixing.mix_documents(t).collect())) for t in (docs.repartition(3), docs.repartition(8, "text")))
    assert first == second and len(first) == sum(r.copies for r in mixing.mix(docs).collect() if r.size)


def test_native_plan(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
