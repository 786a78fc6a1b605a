"""SimHash near-duplicates: exact Hamming links by vantage-point trees.

1. Each text gets a 64-bit fingerprint; equal fingerprints collapse to one node.
2. A vantage-point tree over a bounded sample cuts Hamming space into shards. At a vantage point v
   with radius m a node lives inside (distance at most m) or outside. By the triangle inequality a
   partner within r of an inside node with distance d lies outside only if d + r > m, so just those
   nodes also visit the outside, as queries. Every pair thus meets in exactly one shard as (home, home)
   or (visitor, home).
3. A shard repeats the same recursion over its own nodes down to small leaves and compares those
   bit by bit; a shard of more than ``BLOCK_NODES`` nodes is worked in blocks. Its links leave it as a forest, so a group of n nodes gives n - 1 rows, never n * n.
4. The forests are joined by alternating large-star and small-star steps (Kiveris and others, 2014), each
   written to the shared folder.

Defined cases: a null text counts as empty; texts without words share the fingerprint zero and link like
any other; repeated rows keep a row each; a null ``doc_id`` keeps its row and never is a component's id unless
all its members are null; an empty table gives no rows; further columns are ignored by ``components``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.shared import discard, materialize, new_folder

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
SHARD_NODES = 2048
MOST_SHARDS = 4096
SAMPLE_NODES = 16384
BLOCK_NODES = 1 << 18
LEAF_NODES = 512
_STRIPE = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Bit i is set if it is in more than half of the shingles' hashes, repeats counted. Only A-Z are lowered."""
    w = (text or "").encode().lower().split()  # of bytes: exactly ASCII letters, and exactly the six ASCII white spaces
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64)
    votes = np.zeros(64, np.int64)
    for a in range(0, len(h), _STRIPE):
        votes += np.unpackbits(h[a : a + _STRIPE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


# --- vantage-point trees -------------------------------------------------------------------


def distance(a: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(a ^ v).astype(np.int16)


def choose_split(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and a radius that cut ``points`` near their median, where few lie on the boundary; None if no radius does."""
    best = None
    for v in points[:: max(1, len(points) // 8)][:8]:
        per = np.bincount(distance(points, v), minlength=65)
        inside = np.cumsum(per)
        for m in range(64):
            small = min(inside[m], len(points) - inside[m])
            if small:
                # Boundary nodes are stored or asked twice; lopsided cuts deepen the tree.
                near = per[max(0, m - MAX_BITS + 1) : m + MAX_BITS + 1].sum()
                cost = near / len(points) + 2 * (0.5 - small / len(points)) ** 2
                if best is None or cost < best[0]:
                    best = (cost, v, m)
    return best and best[1:]


def shard_tree(sample: np.ndarray, shards: int):
    """Nested ``(vantage point, radius, inside, outside)``; a leaf is its shard's number."""
    count = iter(range(1 << 30))

    def build(points: np.ndarray, parts: int):
        cut = choose_split(points) if parts > 1 else None
        if cut is None:
            return next(count)
        inner = distance(points, cut[0]) <= cut[1]
        share = min(parts - 1, max(1, round(parts * inner.mean())))
        return (*cut, build(points[inner], share), build(points[~inner], parts - share))

    return build(sample, shards)


def route(tree, fp: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shards with their home nodes and visitors."""
    stack = [(tree, fp, fp[:0])]
    while stack:
        node, home, guest = stack.pop()
        if not isinstance(node, tuple):
            yield node, home, guest
        elif len(home) or len(guest):
            inside, outside = cut_at(node[0], node[1], home, guest, radius)
            stack += [(node[2], *inside), (node[3], *outside)]


def cut_at(v, m: int, home: np.ndarray, guest: np.ndarray, radius: int):
    dh, dg = distance(home, v), distance(guest, v)
    inner = dh <= m
    over = home[inner & (dh + radius > m)]
    return (home[inner], guest[dg - radius <= m]), (home[~inner], np.concatenate([guest[dg + radius > m], over]))


def close_pairs(home: np.ndarray, guest: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within ``radius`` of two home nodes, or of a guest and a home node, in bounded blocks."""
    stack = [(home, guest, 0)]
    while stack:
        home, guest, depth = stack.pop()
        cut = choose_split(home[:: max(1, len(home) // 1024)]) if len(home) > LEAF_NODES and depth < 40 else None
        if cut is not None:
            inside, outside = cut_at(*cut, home, guest, radius)
            stack += [(*x, depth + 1) for x in (inside, outside) if len(x[0])]
            continue
        for a in range(0, len(home), LEAF_NODES):
            block = home[a : a + LEAF_NODES]
            for other in (home[a:], guest):
                for b in range(0, len(other), 4096):
                    i, j = np.nonzero(np.bitwise_count(block[:, None] ^ other[None, b : b + 4096]) <= radius)
                    yield block[i], other[b : b + 4096][j]


class Forest:
    """Union of links over known nodes; keeps one label per node."""

    def __init__(self, nodes: np.ndarray):
        self.nodes = np.unique(nodes)
        self.label = np.arange(len(self.nodes))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        i, j = np.searchsorted(self.nodes, a), np.searchsorted(self.nodes, b)
        while True:
            x, y = self.label[i], self.label[j]
            differ = x != y
            if not differ.any():
                return
            i, j, x, y = i[differ], j[differ], x[differ], y[differ]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        child = self.label != np.arange(len(self.label))
        return self.nodes[child], self.nodes[self.label[child]]


# --- distributed part ----------------------------------------------------------------------


def link_forest(nodes: DataFrame, radius: int) -> DataFrame:
    """``a, b`` links of distinct ``fp`` nodes whose closure is the closure of all pairs within ``radius``."""
    n = nodes.count()
    shards = min(MOST_SHARDS, -(-n // SHARD_NODES))
    likely = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < min(1 << 30, (2 * SAMPLE_NODES << 30) // max(n, 1))  # spares the sort most rows
    sample = np.array([r.fp for r in nodes.where(likely).orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_NODES if shards > 1 else 1).collect()], np.int64).view(np.uint64)
    tree = shard_tree(sample, shards) if shards > 1 else 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for shard, home, guest in route(tree, fp, radius):
                if len(home) + len(guest):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(home) + len(guest), shard, np.int32)), pa.array(np.concatenate([home, guest]).view(np.int64)), pa.array(np.arange(len(home) + len(guest)) < len(home))], names=["shard", "fp", "home"])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fp, home = group["fp"].to_numpy().view(np.uint64), group["home"].to_numpy(bool)
        forest = Forest(fp)
        for a, b in close_pairs(fp[home], fp[~home], radius):
            forest.add(a, b)
        a, b = forest.edges()
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = nodes.select("fp").mapInArrow(deal, "shard int, fp long, home boolean")
    return in_blocks(dealt).groupBy("shard", "block").applyInPandas(compare, "a long, b long")


def in_blocks(dealt: DataFrame, most: int | None = None) -> DataFrame:
    """Adds ``block``: groups of ``shard, block`` hold a bounded number of nodes and every pair of a shard meets in one.

    A shard of up to ``most`` nodes is one block. A larger one, as space allows no even cut, is dealt by hash into slices: each slice of
    homes meets each slice of all its nodes, which come as guests.
    """
    dealt = materialize(dealt, "dealt")
    half = (most or BLOCK_NODES) // 2
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
    large = sizes.where(F.col("n") > 2 * half).select("shard", F.ceil(F.col("homes") / half).cast("int").alias("rows"), F.ceil(F.col("n") / half).cast("int").alias("cols"))
    # One row a large shard, of which there are at most ``MOST_SHARDS``.
    marked = dealt.join(F.broadcast(large), "shard", "left")
    small = marked.where("rows is null").select("shard", F.lit(0).alias("block"), "fp", "home")
    split = marked.where("rows is not null")
    row, col = F.pmod(F.xxhash64("fp", F.lit(1)), "rows").cast("int"), F.pmod(F.xxhash64("fp", F.lit(2)), "cols").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    homes = split.where("home").select("shard", "fp", "cols", row.alias("i"), every("cols").alias("j")).select("shard", (F.col("i") * F.col("cols") + F.col("j")).alias("block"), "fp", F.lit(True).alias("home"))
    guests = split.select("shard", "fp", "cols", col.alias("j"), every("rows").alias("i")).select("shard", (F.col("i") * F.col("cols") + F.col("j")).alias("block"), "fp", F.lit(False).alias("home"))
    return small.unionByName(homes).unionByName(guests)


def star_closure(links: DataFrame, name: str = "links", most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of an undirected link table; the root is the component's smallest node."""

    def summary(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def oriented(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if large else e
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("u", "m").alias("m"))
        # Large: all larger neighbours point to the smallest of the neighbourhood. Small: all smaller ones, and the node.
        side = both.where("b > a") if large else both
        moved = side.join(low, side.a == low.u).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return oriented(moved if large else moved.union(low.select("u", "m")))

    def written(e: DataFrame) -> tuple[DataFrame, str]:
        folder = new_folder(e.sparkSession, name)
        e.write.parquet(folder)
        return e.sparkSession.read.schema(e.schema).parquet(folder), folder

    e, folder = written(oriented(links))
    was = summary(e)
    for _ in range(most_rounds):
        if not was[0]:
            break
        last = folder
        e, folder = written(star(star(e, True), False))
        discard([last])
        now = summary(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` for each row; the component is named by its smallest ``doc_id``."""
    fp = materialize(fingerprints(docs, words), "fingerprints")
    nodes = materialize(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = star_closure(link_forest(nodes, radius))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    class_of = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return fp.join(class_of, "fp").select("doc_id", "fp", "component_id")


def one_of_each_component(docs: DataFrame) -> DataFrame:
    """Exactly one row of ``docs`` for each component: that with the smallest ``doc_id`` (null last), then by the text's digest.

    Rows of equal or null ``doc_id`` are told apart by their text, and rows equal in both are copies. All columns of ``docs`` stay.
    """
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), digest.alias("digest"))
    name = lambda k: F.concat_ws(":", F.col(k)["digest"], F.col(k)["id"].cast("string"))  # noqa: E731  (a null id adds nothing, not even the colon)
    least = components(docs.select(key.alias("doc_id"), "text"))
    kept = least.select("component_id").distinct().select(name("component_id").alias("_kept"))
    rows = docs.select(F.struct("*").alias("d"), key.alias("key"), "text").select("d", "text", name("key").alias("name"))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("text"))).where("nth = 1")
    return first.join(kept, F.col("name") == F.col("_kept"), "left_semi").select("d.*")
