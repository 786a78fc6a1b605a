"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets (after Deng, Tao and Li, 2018), exact.

Two sets link when their Jaccard similarity reaches ``percent``. Equal sets collapse to one node first. A similar pair shares at
least ``ceil(percent * n)`` shingles of either set, so under any one order of all shingles the first k shared ones lie within the first
``n - ceil(percent * n) + k`` of both sets:

1. *Profile.* One pass finds frequent shingles with mergeable Misra-Gries summaries, counts sets by size, and counts the
   documents of a hash sample of all shingles. Frequent shingles come last in the order, so passages that many documents share seldom open a set.
2. *Boundary.* By these counts, light sets are those whose size makes enumerating subsets cheaper than scanning lists (``boundary``), as far as
   postings stay in proportion to the input (``most_light``).
3. *Postings.* A light set posts every 2-subset of its first shingles (k = 2), a heavy one each of its first shingles (k = 1), and so do light
   sets large enough to match a heavy one. Postings with one key are an inverted list, which is cut by size where no pair across is similar; those of a single node go.
4. *Hubs.* In each list that holds several components (at first every node is its own) one node of one component is the hub; nodes of other components are
   compared with it, and links join components. After ``HUB_ROUNDS`` such rounds, groups of copies have fallen together at a cost in proportion to their rows.
5. *Lists.* Lists of more than two nodes that still hold several components are scanned, block against block, for all pairs of different components. Components are the closure of all links found.

A pair is compared by its whole sets only if exact bounds, by size and by parity bitmap, leave it possible.

No list meets in one task beyond a bounded block, no pair inside a component is formed, and the driver sees the profile alone.

Defined cases: a null text counts as empty; texts without words have no shingles and link with nothing, their component is their own ``doc_id``;
fewer words than a shingle's make one shingle of them all; repeated rows get a row each; a null ``doc_id`` keeps its row and names no component
unless all its members are null; an empty table gives no rows; further columns are ignored. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.shared import materialize
from tidemark.llm.simhash import star_closure

WORDS = 4
PERCENT = 85
MOST_FREQUENT = 1 << 16  # shingles kept by a summary, and broadcast as the end of the order
LEAST_FREQUENT = 16
ONE_IN = 1024  # shingles of the profile's sample, by hash, over all documents
HUB_ROUNDS = 3
LIGHT_TIMES = 1.25  # postings with light sets, at most, over those of heavy sets alone
_KEYS = 1 << 19  # of a batch that a task gives out
BLOCK_ROWS = 4096
SLOTS = 1 << 20
TASK_ROWS = 1 << 18
_STRETCH = 1 << 22
_SEEN_PAIRS = 1 << 20
_PAIR = np.dtype([("a", np.int64), ("b", np.int64)])
_FLUSH = 1 << 20
_MEMO_WORDS, _MEMO_LENGTH = 400_000, 64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[ \t-\r]")


# --- sets ----------------------------------------------------------------------------------


class WordHashes(dict):
    """64-bit hashes of words, remembered for a bounded number of short ones."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= _MEMO_LENGTH:
            if len(self) >= _MEMO_WORDS:
                self.clear()
            self[word] = h
        return h


def word_hashes(text: str | None, memo: WordHashes) -> np.ndarray:
    """A hash for each word, in order; only A-Z are lowered. Long texts are split a stretch at a time."""
    raw, parts, a = (text or "").encode().lower(), [], 0
    while a < len(raw):
        end = _SPACE.search(raw, a + _STRETCH) if len(raw) - a > _STRETCH else None
        b = end.start() if end else len(raw)
        words = raw[a:b].split()  # of bytes: exactly the six ASCII white spaces
        parts.append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
        a = b
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingles(text: str | None, memo: WordHashes, words: int = WORDS) -> np.ndarray:
    """The text's distinct shingles as ascending hashes."""
    h = word_hashes(text, memo)
    if not len(h):
        return h
    width = min(words, len(h))
    grams = h[: len(h) - width + 1] + np.uint64(width if width < words else 0)  # a short text's one shingle differs from any other's
    for i in range(1, width):
        grams = grams * _FACTOR + h[i : len(h) - width + 1 + i]
    return np.unique(grams)


def node_of(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes(), seed=1)


def opening(n: int, k: int, percent: int) -> int:
    """How many first shingles hold the first ``k`` that a similar pair shares."""
    return n + percent * n // -100 + k


def subsets_of(first: np.ndarray) -> np.ndarray:
    """One hash for each 2-subset."""
    i, j = np.triu_indices(len(first), 1)
    return (first[i] ^ (first[i] >> np.uint64(31))) * _FACTOR + first[j]


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap in which each shingle turns one bit over: two sets differ in as many shingles as their bitmaps do in bits, at least."""
    bits = 512 << min(5, max(0, math.ceil(math.log2(len(tokens) / 512))))
    odd = np.bincount((tokens >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


# --- profile -------------------------------------------------------------------------------


class Frequent:
    """A Misra-Gries summary: an item's count falls short by at most the items seen over ``MOST_FREQUENT``."""

    def __init__(self):
        self.items, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new: list[np.ndarray] = []
        self.waiting = 0

    def add(self, items: np.ndarray) -> None:
        self.new.append(items)
        self.waiting += len(items)
        if self.waiting >= _FLUSH:
            self.flush()

    def flush(self) -> None:
        items, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.new]), return_counts=True)
        self.new, self.waiting = [], 0
        items, at = np.unique(np.concatenate([self.items, items]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([self.counts, counts]), len(items)).astype(np.int64)
        if len(items) > MOST_FREQUENT:
            counts = counts - np.partition(counts, -MOST_FREQUENT - 1)[-MOST_FREQUENT - 1]
            items, counts = items[counts > 0], counts[counts > 0]
        self.items, self.counts = items, counts


def size_bin(n: int) -> int:
    return int(4 * math.log2(n))


def profile(docs: DataFrame, words: int) -> DataFrame:
    """``kind, item, n``: frequent shingles and their counts (0), sets by size bin (1), sampled shingles with their set's bin (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, frequent, sizes = WordHashes(), Frequent(), {}

        def rows(kind, items, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(items), kind, np.int8)), pa.array(np.asarray(items).view(np.int64)), pa.array(n)], names=["kind", "item", "n"])

        for batch in batches:
            items, bins = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for text in batch.column(0):
                tokens = shingles(text.as_py(), memo, words)
                if len(tokens):
                    frequent.add(tokens)
                    b = size_bin(len(tokens))
                    sizes[b] = sizes.get(b, 0) + 1
                    items.append(tokens[tokens % np.uint64(ONE_IN) == 0])
                    bins.append(np.full(len(items[-1]), b))
            yield rows(2, np.concatenate(items), np.concatenate(bins))
        frequent.flush()
        often = frequent.counts > 1
        yield rows(0, frequent.items[often], frequent.counts[often])
        yield rows(1, np.array(list(sizes), np.int64), np.array(list(sizes.values()), np.int64))

    return docs.select("text").mapInArrow(run, "kind byte, item long, n long")


def boundary(cost: list[tuple[int, int, int]], percent: int) -> int:
    """The size from which sets are heavy, given ``bin, sets, entries`` (other entries in the lists of all their shingles): where rows and entries cost least in all."""
    light, heavy = [0.0], [0.0]
    bins = list(range(max((b for b, _, _ in cost), default=0) + 1))
    by_bin = {b: (sets, entries) for b, sets, entries in cost}
    for b in bins:
        sets, entries = by_bin.get(b, (0, 0))
        n = 2 ** ((b + 0.5) / 4)
        spare = n * (100 - percent) / 100
        light.append(light[-1] + sets * (spare + 2) * (spare + 1) / 2)
        heavy.append(heavy[-1] + sets * (spare + 1) + entries * (spare + 1) / (n + 1))
    total = [light[k] + heavy[-1] - heavy[k] for k in range(len(light))]
    return math.ceil(2 ** (int(np.argmin(total)) / 4))


def most_light(sizes: list[tuple[int, int]], percent: int) -> int:
    """The largest boundary at which all postings are at most ``LIGHT_TIMES`` those of heavy sets alone, given ``bin, sets``: 2-subsets grow with the square of a set."""
    rows = []
    for b, sets in sorted(sizes):
        spare = 2 ** ((b + 1) / 4) * (100 - percent) / 100
        rows.append((b, sets * (spare + 1), sets * (spare + 2) * (spare + 1) / 2))
    left = (LIGHT_TIMES - 1) * sum(heavy for _, heavy, _ in rows)
    for b, _, light in rows:
        left -= light
        if left < 0:
            return math.ceil(2 ** (b / 4))
    return math.ceil(2 ** ((rows[-1][0] + 1) / 4)) if rows else 1


def learned(docs: DataFrame, words: int, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Frequent shingles in ascending order of hash, their ranks by count, and the boundary; of bounded size, whatever the documents."""
    seen = materialize(profile(docs, words), "jaccard-profile")
    often = seen.where("kind = 0").groupBy("item").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_FREQUENT)
    frequent = [r.item for r in often.orderBy(F.desc("n"), "item").limit(MOST_FREQUENT).select("item").collect()][::-1]
    sample = seen.where("kind = 2").groupBy("item", F.col("n").alias("bin")).agg(F.count("*").alias("c"))
    sample = sample.withColumn("df", F.sum("c").over(Window.partitionBy("item"))).where(F.col("df") > 1)
    entries = {r.bin: r.e * ONE_IN for r in sample.groupBy("bin").agg(F.sum(F.col("c") * (F.col("df") - 1)).alias("e")).collect()}
    sizes = seen.where("kind = 1").groupBy("item").agg(F.sum("n").alias("n")).collect()
    # The sample multiplies a single shingle by ONE_IN, so its verdict may be far off: it decides within what the input can pay for.
    at = min(boundary([(r.item, r.n, entries.get(r.item, 0)) for r in sizes], percent), most_light([(r.item, r.n) for r in sizes], percent))
    items = np.array(frequent, np.int64).view(np.uint64)
    order = np.argsort(items)
    return items[order], order, at


# --- postings ------------------------------------------------------------------------------


def in_order(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set's shingles by hash, those known as frequent last, by count."""
    if not len(frequent):
        return tokens
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    often = frequent[at] == tokens
    return np.concatenate([tokens[~often], tokens[often][np.argsort(rank[at[often]])]]) if often.any() else tokens


def posted(docs: DataFrame, words: int, percent: int, frequent: np.ndarray, rank: np.ndarray, heavy_from: int) -> DataFrame:
    """``doc_id, place, node, n, keys, bits`` for each row; ``place`` finds the text again, node is null for an empty set."""
    matches_heavy = -(percent * heavy_from // -100)

    def keys_of(tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        if 100 * n < percent * (n + 1):
            return tokens[:0]  # so few that not even a set of one more is similar
        first = in_order(tokens, frequent, rank)[: opening(n, 2, percent)]
        keys = [subsets_of(first)] if n < heavy_from else []
        if n >= matches_heavy or percent * n <= 100:  # the latter may share a single shingle
            keys.append(first[: opening(n, 1, percent)])
        return np.concatenate(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            nodes, sizes, keys, bits, held, start = [], [], [], [], 0, 0
            for at, text in enumerate(batch.column("text"), 1):
                tokens = shingles(text.as_py(), memo, words)
                sizes.append(len(tokens))
                nodes.append(np.uint64(node_of(tokens)).view(np.int64) if len(tokens) else None)
                keys.append(keys_of(tokens).view(np.int64) if len(tokens) else np.zeros(0, np.int64))
                bits.append(parity(tokens) if len(tokens) else None)
                held += len(keys[-1])
                if held < _KEYS and at < batch.num_rows:
                    continue
                ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys)))
                own = batch.slice(start, at - start)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("place"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(bits, pa.binary())], names=["doc_id", "place", "node", "n", "keys", "bits"])
                nodes, sizes, keys, bits, held, start = [], [], [], [], 0, at

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("place"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, place long, node long, n long, keys array<long>, bits binary")


def lists_of(rows: DataFrame, percent: int) -> DataFrame:
    """``key, node, lo``: the inverted lists that hold two nodes or more, and a list's smallest node.

    By size, a list falls apart wherever even neighbours are too different to be similar: unrelated sets that share a shingle mostly part here.
    """
    entries = rows.select("node", "n", F.explode("keys").alias("key"))
    by_size = Window.partitionBy("key").orderBy("n")
    gap = F.coalesce((100 * F.lag("n").over(by_size) < percent * F.col("n")).cast("int"), F.lit(0))
    runs = entries.withColumn("_gap", gap).withColumn("run", F.sum("_gap").over(by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = Window.partitionBy("key", "run")
    several = runs.withColumn("lo", F.min("node").over(own)).withColumn("hi", F.max("node").over(own)).where("lo < hi")
    return several.select("key", "run", "node", "lo").distinct().select(F.xxhash64("key", "run").alias("key"), "node", "lo")


# --- links ---------------------------------------------------------------------------------


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a, b``, distinct) whose whole sets are similar. Each node's text is read back by one of its rows."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named = rows.where("node is not null").join(wanted, "node", "left_semi")
    one = named.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "place")).alias("r")).select("node", F.col("r.doc_id").alias("_id"), F.col("r.place").alias("_place"))
    one = materialize(one, "jaccard-wanted")
    slot = lambda c: F.pmod(F.col(c), F.lit(SLOTS))
    # At most SLOTS rows: this spares the shuffle most texts that no pair asks for.
    slots = F.broadcast(one.select(slot("_place").alias("_slot")).distinct())
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_place")).withColumn("_slot", slot("_place")).join(slots, "_slot", "left_semi")
    found = texts.join(one, (texts["_place"] == one["_place"]) & texts["doc_id"].eqNullSafe(one["_id"])).groupBy("node").agg(F.min("text").alias("text"))
    left = pairs.join(found.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(found.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            mask = [similar(shingles(x.as_py(), memo, words), shingles(y.as_py(), memo, words), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(mask, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def possible(i: np.ndarray, j: np.ndarray, n: np.ndarray, width: np.ndarray, folded: dict[int, np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of rows neither their sizes nor their bitmaps rule out."""
    ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    most = n[i] + n[j] + 2 * (percent * (n[i] + n[j]) // -(100 + percent))  # shingles that only one of a similar pair holds
    narrow = np.where(ok, np.minimum(width[i], width[j]), 0)
    for w in np.unique(narrow[ok]):
        p = np.flatnonzero(narrow == w)
        ok[p] = np.bitwise_count(folded[w][i[p]] ^ folded[w][j[p]]).sum(axis=1, dtype=np.int64) <= most[p]
    return ok


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a, b``) that no bound rules out."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("bits1"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n = np.concatenate([batch.column(2).to_numpy(), batch.column(4).to_numpy()])
            width, folded = bitmap_rows(batch.column(3).to_pylist() + batch.column(5).to_pylist())
            yield batch.select([0, 1]).filter(pa.array(possible(np.arange(rows), np.arange(rows) + rows, n, width, folded, percent)))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "n1", "bits1", "n2", "bits2").mapInArrow(run, "a long, b long")


def in_blocks(lists: DataFrame, most: int | None = None) -> DataFrame:
    """Adds ``block`` and ``slice``: a list of more than ``most`` rows is dealt by node into slices, and each pair of slices is a block."""
    half = (most or BLOCK_ROWS) // 2
    slices = F.when(F.col("rows") <= 2 * half, 1).otherwise(F.ceil(F.col("rows") / half)).cast("int")
    dealt = lists.withColumn("slices", slices).withColumn("slice", F.pmod(F.xxhash64("node"), "slices").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    dealt = dealt.withColumn("_other", other)
    return dealt.withColumn("block", F.least("slice", "_other") * F.col("slices") + F.greatest("slice", "_other")).drop("_other", "slices")


def bitmap_rows(bits: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Widths in words of 64 bits, and for each width the bitmaps folded to it; rows narrower than a width are zero there."""
    width = np.array([len(b) // 8 for b in bits])
    folded, w = {}, int(width.max(initial=4))
    while w >= 4:
        at = np.flatnonzero(width >= w)
        table = np.zeros((len(bits), w), np.uint64)
        for own in np.unique(width[at]):
            rows = at[width[at] == own]
            x = np.frombuffer(b"".join(bits[i] for i in rows), np.uint64).reshape(len(rows), own // w, w)
            table[rows] = np.bitwise_xor.reduce(x, axis=1)
        folded[w] = table
        w //= 2
    return width, folded


def candidates(frame: pd.DataFrame, percent: int) -> np.ndarray:
    """Pairs of rows of one block (equal ``key``, ``block``; sorted by them) in different components, in different slices unless the block has one, that no bound rules out."""
    start = np.flatnonzero((frame["key"].ne(frame["key"].shift()) | frame["block"].ne(frame["block"].shift())).to_numpy())
    length = np.diff([*start, len(frame)])
    ends = np.repeat(start + length, length)
    several = np.repeat(np.maximum.reduceat(frame["slice"].to_numpy(), start) > np.minimum.reduceat(frame["slice"].to_numpy(), start), length) if len(start) else np.zeros(0, bool)
    node, comp, n, part = (frame[c].to_numpy() for c in ("node", "comp", "n", "slice"))
    width, folded = bitmap_rows(frame["bits"].tolist())
    out = [np.zeros((0, 2), np.int64)]
    here = np.arange(len(frame))
    for d in range(1, int(length.max(initial=1))):
        here = here[here + d < ends[here]]
        i, j = here, here + d
        ok = (comp[i] != comp[j]) & (~several[i] | (part[i] != part[j]))
        i, j = i[ok], j[ok]
        ok = possible(i, j, n, width, folded, percent)
        i, j = node[i[ok]], node[j[ok]]
        out.append(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1))
    return np.concatenate(out)


def scanned(blocks: DataFrame, percent: int) -> DataFrame:
    """``a, b``: candidates of all blocks, each block's rows together in one task.

    Lists with the same smallest component ``lo`` mostly hold the same nodes, so they go to one task as far as ``TASK_ROWS`` allows (``part`` numbers such tasks), where a pair
    that several of them hold is given once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, seen, of = None, np.zeros(0, _PAIR), None

        def fresh(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal seen, of
            for lo, own in part.groupby("lo", sort=False):
                if lo != of or len(seen) > _SEEN_PAIRS:
                    seen, of = np.zeros(0, _PAIR), lo
                pairs = np.unique(np.ascontiguousarray(candidates(own.reset_index(drop=True), percent)).view(_PAIR).ravel())
                pairs = pairs[~np.isin(pairs, seen)] if len(seen) else pairs
                seen = np.concatenate([seen, pairs])
                yield pd.DataFrame({"a": pairs["a"], "b": pairs["b"]})

        for frame in frames:
            frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            if not len(frame):
                continue
            last = (frame["key"] == frame["key"].iloc[-1]) & (frame["block"] == frame["block"].iloc[-1])
            kept = frame[last].reset_index(drop=True)
            yield from fresh(frame[~last])
        if kept is not None:
            yield from fresh(kept)

    dealt = blocks.select("lo", "part", "key", "block", "node", "comp", "n", "slice", "bits").repartition("lo", "part").sortWithinPartitions("lo", "part", "key", "block")
    return dealt.mapInPandas(run, "a long, b long").distinct()


def mixed(lists: DataFrame) -> DataFrame:
    """Of ``key, node, comp`` the lists with several components, with ``lo``, the smallest of them, and their ``rows``. Lists of two nodes have met their hub: nothing is left in them."""
    several = lists.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")).where("lo < hi and rows > 2").drop("hi")
    return lists.join(several, "key")


def links(docs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b``: verified links of nodes whose closure is the closure of all similar pairs."""
    left = materialize(lists_of(rows.where("node is not null"), percent), "jaccard-lists")
    nodes = rows.join(left.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    nodes = materialize(nodes, "jaccard-nodes")
    tried = found = left.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    for k in range(HUB_ROUNDS):
        if k:
            left = materialize(mixed(left), "jaccard-mixed")
            hubs = left.where("comp = lo").groupBy("key").agg(F.min_by("node", F.xxhash64("node", F.lit(k))).alias("hub"))
            met = left.where("comp <> lo").join(hubs, "key").select("node", "hub")
        else:  # every node is its own component
            met = left.where("node <> lo").select("node", F.col("lo").alias("hub"))
        pairs = met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = materialize(plausible(pairs, nodes, percent), "jaccard-pairs")
        tried = tried.unionByName(pairs)
        found = found.unionByName(materialize(verified(docs, rows, pairs, words, percent), "jaccard-links"))
        roots = star_closure(found, "jaccard-roots")
        left = left.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    left = materialize(mixed(left), "jaccard-mixed")
    parts = left.groupBy("lo").agg(F.ceil(F.count("*") / TASK_ROWS).cast("int").alias("parts"))
    blocks = in_blocks(left.join(parts, "lo")).withColumn("part", F.pmod(F.xxhash64("key", "block"), "parts")).join(nodes, "node")
    more = materialize(scanned(blocks, percent).join(tried, ["a", "b"], "left_anti"), "jaccard-candidates")
    return found.unionByName(materialize(verified(docs, rows, more, words, percent), "jaccard-links"))


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row; the component is named by its smallest ``doc_id``."""
    frequent, rank, heavy_from = learned(docs, words, percent)
    rows = materialize(posted(docs, words, percent, frequent, rank, heavy_from), "jaccard-rows")
    roots = star_closure(links(docs, rows, words, percent), "jaccard-roots")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    class_of = rooted.select("node", "root").join(named, "root").select("node", "component_id")
    out = rows.select("doc_id", "node", F.col("n").alias("n_shingles")).join(class_of, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
