import random

import numpy as np
import xxhash

import corpus_pipeline
from tidemark.llm import simhash


def brute_fingerprint(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows):
    """rows: (doc_id, fingerprint)."""
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 2:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(rows))]


def check(table, **options):
    rows = table.select("doc_id", "text").collect()
    fp = [brute_fingerprint(r.text) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], fp, brute_components([(r.doc_id, f) for r, f in zip(rows, fp)])), key=repr)
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.components(table, **options).collect()), key=repr)
    assert got == want


def test_documents_against_brute_force(docs):
    check(docs)


def test_odd_documents(odd_docs, empty_docs):
    check(odd_docs)
    assert simhash.components(empty_docs).collect() == []
    assert simhash.one_of_each_component(empty_docs).collect() == []


def clustered(n, seed):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 3, 40])):
            out.add(x)
            x ^= 1 << r.randrange(64)
            if r.random() < 0.5:
                x ^= 1 << r.randrange(64)
    return np.array(sorted(out), np.uint64)


def pairs_of(fp):
    d = np.bitwise_count(fp[:, None] ^ fp[None, :])
    return {(int(a), int(b)) for i, j in zip(*np.nonzero(d <= 2)) if i < j for a, b in [sorted((int(fp[i]), int(fp[j])))]}


def test_shards_and_trees_find_every_pair(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_NODES", 16)
    for seed in range(3):
        fp = clustered(700, seed)
        tree = simhash.shard_tree(fp[::3], 9)
        found, homes = set(), 0
        for _, home, guest in simhash.route(tree, fp, 2):
            homes += len(home)
            for a, b in simhash.close_pairs(home, guest, 2):
                found |= {tuple(sorted((int(x), int(y)))) for x, y in zip(a, b) if x != y}
        assert homes == len(fp) and found == pairs_of(fp)


def test_many_shards_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_NODES", 64)
    fp = clustered(900, 7)
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    roots = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in simhash.star_closure(simhash.link_forest(nodes, 2)).collect()}
    want = brute_components([(i, int(x)) for i, x in enumerate(fp)])
    classes = {}
    for x, c in zip(fp, want):
        classes.setdefault(c, set()).add(roots.get(int(x), int(x)))
    assert all(len(s) == 1 for s in classes.values())
    assert len({next(iter(s)) for s in classes.values()}) == len(classes)


def test_long_chain_closes(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(300)], "a long, b long")
    got = simhash.star_closure(links.orderBy("a")).collect()
    assert sorted(r.node for r in got) == list(range(1, 301)) and {r.root for r in got} == {0}


def test_large_shards_meet_in_blocks(spark, monkeypatch):
    """Blocks stay bounded, and no link between nodes of a shard is lost."""
    fp = clustered(900, 11)
    rows = [(int(i % 2), int(x), bool(i % 3)) for i, x in enumerate(fp.view(np.int64))]
    dealt = spark.createDataFrame(rows, "shard int, fp long, home boolean")
    want = {(s, *sorted((a, b))) for s, a, h in rows for t, b, _ in rows if s == t and h and a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    found, blocks = set(), {}
    for r in simhash.in_blocks(dealt, most=120).collect():
        blocks.setdefault((r.shard, r.block), []).append((r.fp, r.home))
    for (shard, _), nodes in blocks.items():
        assert len(nodes) < 3 * 120
        home, guest = (np.array([x for x, h in nodes if h == side], np.int64).view(np.uint64) for side in (True, False))
        for a, b in simhash.close_pairs(home, guest, 2):
            found |= {(shard, *sorted((int(x), int(y)))) for x, y in zip(a.view(np.int64), b.view(np.int64)) if x != y}
    assert len(blocks) > 8 and found == want
    monkeypatch.setattr(simhash, "BLOCK_NODES", 100)
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in simhash.star_closure(simhash.link_forest(nodes, 2)).collect()}
    classes = {}
    for x, c in zip(fp.view(np.int64).tolist(), brute_components([(i, int(x)) for i, x in enumerate(fp)])):
        classes.setdefault(c, set()).add(roots.get(x, x))
    assert all(len(s) == 1 for s in classes.values()) and len({next(iter(s)) for s in classes.values()}) == len(classes)


def test_near_dedup_keeps_one_row_of_each_component(spark, docs, odd_docs, empty_docs):
    """Also where ids repeat with other texts, or are null."""
    for table in (docs, odd_docs):
        kept = corpus_pipeline.near_dedup(spark, table, "")
        assert kept.columns == table.columns
        rows = [(r.doc_id, brute_fingerprint(r.text)) for r in table.collect()]
        at = {f: n for n, f in enumerate(f for _, f in rows)}
        part = brute_components([(i, f) for i, (_, f) in enumerate(rows)])
        least = {}
        for (d, _), c in zip(rows, part):
            least[c] = min(least.get(c, (True, 0)), (d is None, d or 0))
        got = [(part[at[brute_fingerprint(r.text)]], (r.doc_id is None, r.doc_id or 0)) for r in kept.collect()]
        assert sorted(got) == sorted(least.items())
    assert corpus_pipeline.near_dedup(spark, empty_docs, "").collect() == []


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    say = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(3, say("a")), (5, say("a")), (5, say("b")), (None, say("c")), (None, say("d")), (None, say("d")), (None, say("b"))]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [rows[0], rows[2], rows[3], rows[4]]))
