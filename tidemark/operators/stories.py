"""Duplicate stories: by text, by embedding, and their groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.text import non_empty, text_key
from tidemark.work import cut


def exact_clusters(news: DataFrame, key: str, text: str) -> DataFrame:
    """``key, cluster_id``: the smallest ``key`` with the same normalised text; empty texts stay alone.

    Texts are read and hashed once; what is shuffled after that is ids and hashes of 32 characters, the hot ones pre-aggregated.
    """
    hashed = cut(news.select(key, F.when(non_empty(text), text_key(text)).alias("_h")), "text-hashes")
    least = hashed.where("_h is not null").groupBy("_h").agg(F.min(key).alias("_least"))
    return hashed.join(least, "_h", "left").select(key, F.coalesce("_least", key).alias("cluster_id"))


def exact_groups(news: DataFrame, key: str, text: str) -> DataFrame:
    """``news`` with ``cluster_id`` (``exact_clusters``); ``key`` must be unique."""
    return news.join(exact_clusters(news, key, text), key)


STRIP_CELLS = 1 << 18  # similarities in memory at a time, where a block's are not kept: they fit a core's cache
_LEAST_BLOCKS, _SMALL_BLOCK = 12, 2048
_MARGIN = 1e-5  # single precision is off by less for unit vectors of some hundred components


def _block_pairs(vectors: DataFrame, key: str, vector: str, block_rows: int, found, schema: str) -> DataFrame:
    """Runs ``found(same, keys, other keys, unit vectors, other unit vectors)`` on each pair of blocks; see ``cosine_pairs``. Each row is dealt once a block."""
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    n = v.count()
    # Large blocks spare the shuffle; some dozen of them keep all cores at work.
    blocks = max(1, -(-n // block_rows), min(_LEAST_BLOCKS, -(-n // _SMALL_BLOCK)))
    own = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = v.withColumn("own", own).withColumn("other", every)
    left = dealt.where("own <= other").select("k", "v", F.col("own").alias("i"), F.col("other").alias("j"))
    right = dealt.where("other <= own").select(F.col("k").alias("k2"), F.col("v").alias("v2"), F.col("other").alias("i"), F.col("own").alias("j"))
    names = [c.split()[0] for c in schema.split(", ")]

    def multiply(i, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: [] for c in names})]
        if not len(a) or not len(b):
            return out[0]
        for size in set(a["v"].map(len)) & set(b["v2"].map(len)) - {0}:
            x, y = a[a["v"].map(len) == size], b[b["v2"].map(len) == size]
            m, o = (np.array(t.tolist(), np.float64) for t in (x["v"], y["v2"]))
            with np.errstate(invalid="ignore", divide="ignore"):
                m, o = m / np.linalg.norm(m, axis=1, keepdims=True), o / np.linalg.norm(o, axis=1, keepdims=True)
            out.append(found(i[0] == i[1], x["k"].to_numpy(), y["k2"].to_numpy(), m, o))
        return pd.concat(out[1:]) if out[1:] else out[0]

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(multiply, schema)


def cosine_pairs(vectors: DataFrame, key: str, vector: str, least: float, block_rows: int = 2048) -> DataFrame:
    """``a, b, similarity`` of all pairs with a < b at or above ``least``: exact, block against block.

    Rows are dealt by hash into blocks of bounded size; each pair of blocks is one task's matrix product. Zero vectors and
    vectors of other length have no similarity. Its work is quadratic by nature, and so is its output where groups are large: ``cosine_links`` is
    for their closure, ``lsh_pairs`` for high thresholds beyond some ten million rows.
    """

    def pairs(same: bool, ka: np.ndarray, kb: np.ndarray, m: np.ndarray, o: np.ndarray) -> pd.DataFrame:
        s = m @ o.T
        r, c = np.nonzero((s >= least) & (ka[:, None] < kb[None, :] if same else ka[:, None] != kb[None, :]))
        return pd.DataFrame({"a": np.minimum(ka[r], kb[c]), "b": np.maximum(ka[r], kb[c]), "similarity": s[r, c]})

    kind = dict(vectors.dtypes)[key]
    return _block_pairs(vectors, key, vector, block_rows, pairs, f"a {kind}, b {kind}, similarity double")


class Forest:
    """Links of things by number, kept if they join two groups."""

    def __init__(self, n: int):
        self.up, self.size = np.arange(n), np.ones(n, np.int64)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while (r != (further := self.up[r])).any():
            r = further
        self.up[x] = r
        return r

    def join(self, one: int, others: np.ndarray) -> np.ndarray:
        """Joins ``one`` with each of ``others``; places in ``others`` of one link to each group that was apart."""
        own, theirs = self.roots(np.array([one]))[0], self.roots(others)
        apart = np.flatnonzero(theirs != own)
        if not len(apart):
            return apart
        groups, first = np.unique(theirs[apart], return_index=True)
        every = np.append(groups, own)
        top = every[self.size[every].argmax()]  # under the largest, so ways up stay short
        self.size[top] = self.size[every].sum()
        self.up[every] = top
        return apart[first]


def spanning_links(s: np.ndarray, same: bool, forest: Forest | None = None, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a boolean matrix whose links join what all true cells join: fewer than rows and columns together. ``same``: both are the same things.

    With ``forest`` the matrix is a strip of a larger one from row ``at`` on, whose other strips went before; columns then come before rows there.
    """
    forest = forest or Forest(s.shape[1] + (0 if same else s.shape[0]))
    rows = 0 if same else s.shape[1]
    kept_r, kept_c = [], []
    for r in np.flatnonzero(s.any(axis=1)):
        c = np.flatnonzero(s[r])
        c = c[forest.join(rows + at + r, c)]
        if len(c):
            kept_r.append(np.full(len(c), at + r))
            kept_c.append(c)
    flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    return flat(kept_r), flat(kept_c)


def at_least(m: np.ndarray, o: np.ndarray, least: float, single: np.ndarray | None = None) -> np.ndarray:
    """Where ``m @ o.T`` (double precision, unit rows) reaches ``least``: single precision decides what is far from it (``single``: ``o`` in it)."""
    s = m.astype(np.float32) @ (o.astype(np.float32) if single is None else single).T
    hit = s >= np.float32(least - _MARGIN)
    r, c = np.nonzero(hit)
    close = s[r, c] <= np.float32(least + _MARGIN)
    r, c = r[close], c[close]
    for a in range(0, len(r), 1 << 16):
        i, j = r[a : a + (1 << 16)], c[a : a + (1 << 16)]
        hit[i, j] = np.einsum("ij,ij->i", m[i], o[j]) >= least
    return hit


SAMPLE_CELLS = 1 << 20  # numbers in the sample that lays out the regions: of 64 components some 16,000 vectors
TILE_ROWS, BOX_SIDES = 1024, 16


def regions(x: np.ndarray, parts: int) -> tuple | None:
    """Halves rows along their widest component until there are ``parts``: (component, bound, below, from there on), None for a part. Equal rows stay together."""
    if parts < 2 or len(x) < 2:
        return None
    side = int(x.std(axis=0).argmax())
    bound = np.quantile(x[:, side], parts // 2 / parts, method="lower")
    below = x[:, side] < bound
    if not below.any():
        bound = np.nextafter(bound, np.float32(np.inf))
        below = x[:, side] < bound
        if below.all():
            return None
    return side, bound, regions(x[below], parts // 2), regions(x[~below], parts - parts // 2)


def in_regions(x: np.ndarray, tree: tuple | None) -> list[np.ndarray]:
    """Rows of each part, in the order of the parts."""
    out = []

    def go(rows: np.ndarray, node: tuple | None) -> None:
        if node is None:
            out.append(rows)
            return
        below = x[rows, node[0]] < node[1]
        go(rows[below], node[2])
        go(rows[~below], node[3])

    go(np.arange(len(x)), tree)
    return out


def reach(least: float) -> float:
    """The square of the distance between unit vectors whose cosine is ``least``, and what single precision may be off."""
    return max(0.0, 2 - 2 * least) + 4 * _MARGIN


def near_boxes(x: np.ndarray, low: np.ndarray, high: np.ndarray, square: float) -> np.ndarray:
    """Rows by boxes: False where no point of the box can be within reach. The sides in which the boxes differ most decide."""
    sides = np.sort(np.argsort(-(low + high).std(axis=0), kind="stable")[:BOX_SIDES])
    y, out = np.ascontiguousarray(x[:, sides]), np.empty((len(x), len(low)), bool)
    for j, (a, b) in enumerate(zip(low[:, sides], high[:, sides])):
        gap = y - np.clip(y, a, b)
        out[:, j] = np.einsum("ij,ij->i", gap, gap) <= square
    return out


def forest_links(m: np.ndarray, o: np.ndarray | None, least: float, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, Forest]:
    """Numbers of unit rows that are linked (those of ``o`` come after those of ``m``), and the forest. Rows with one label (none: -1) are joined to begin with.

    All links of ``m`` with ``o`` (None: with itself) are weighed, but for those that regions of some ``TILE_ROWS`` rows rule out, or whose ends are joined.
    """
    n, same = len(m), o is None
    forest = Forest(len(labels))
    named = np.flatnonzero(labels >= 0)
    _, first, back, count = np.unique(labels[named], return_index=True, return_inverse=True, return_counts=True)
    forest.up[named] = named[first][back]
    forest.size[named[first]] = count
    o = m if same else o
    x, y = m.astype(np.float32), None if same else o.astype(np.float32)
    y = x if same else y
    tiles = [[t for t in in_regions(z, regions(z, -(-len(z) // TILE_ROWS))) if len(t)] for z in ((x,) if same else (x, y))]
    ta, tb = tiles[0], tiles[-1]
    box = lambda z, ts: (np.array([z[t].min(axis=0) for t in ts]), np.array([z[t].max(axis=0) for t in ts]))
    square = reach(least)
    to_b = near_boxes(x, *box(y, tb), square)
    to_a = to_b if same else near_boxes(y, *box(x, ta), square)
    kept = [np.zeros((2, 0), np.int64)]
    for i, j in ((i, j) for i in range(len(ta)) for j in range(i if same else 0, len(tb))):
        every, c = ta[i][to_b[ta[i], j]], tb[j][to_a[tb[j], i]]
        if not len(every) or not len(c):
            continue
        at_c, columns, high = c if same else c + n, y[c], max(1, STRIP_CELLS // len(c))
        for at in range(0, len(every), high):
            r = every[at : at + high]
            ours, theirs = forest.roots(r), forest.roots(at_c)
            if (ours == ours[0]).all() and (theirs == ours[0]).all():
                continue
            s = (x[r] @ columns.T).ravel()
            if not s.max() >= least - _MARGIN:
                continue
            hit = np.flatnonzero(s >= np.float32(least - _MARGIN))
            p, q = np.divmod(hit, len(c))
            apart = np.flatnonzero(ours[p] != theirs[q])
            # Single precision decides what is far from the threshold; of a row's links to one group any will do.
            sure = s[hit[apart]] > np.float32(least + _MARGIN)
            unsure, apart = apart[~sure], apart[sure]
            for k in range(0, len(unsure), 1 << 16):
                e = unsure[k : k + (1 << 16)]
                apart = np.append(apart, e[np.einsum("ij,ij->i", m[r[p[e]]], o[c[q[e]]]) >= least])
            apart = apart[np.unique(p[apart] * len(labels) + theirs[q[apart]], return_index=True)[1]]
            rows, begin = np.unique(p[apart], return_index=True)
            for row, w in zip(rows, np.split(at_c[q[apart]], begin[1:])):
                w = w[forest.join(r[row], w)]
                kept.append(np.stack([np.full(len(w), r[row]), w]))
    return *np.concatenate(kept, axis=1), forest


def _units(raw: np.ndarray) -> np.ndarray:
    """Rows at unit length; NaN or infinite where there is none."""
    x = raw.astype(np.float64)
    with np.errstate(all="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine_links(vectors: DataFrame, key: str, vector: str, least: float, block_rows: int = 1 << 16) -> DataFrame:
    """``a, b``: links whose closure is that of ``cosine_pairs``. A block gives a forest, so a group of n stories costs n links a block and never n * n.

    A sample lays out regions of some ``block_rows`` vectors, larger ones are cut by hash. Two regions meet in a task, to which each sends those rows that lie within
    reach of the other's bounding box: all others cannot have a link there. Groups that the sample itself forms are known beforehand: who is linked to one of them
    is linked to its first, and two of one group are not compared again. The sample decides on time alone. Null keys have no links.
    """
    v = vectors.where(F.col(key).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    kind, wide = dict(v.dtypes)["k"], np.float64 if dict(v.dtypes)["v"] == "array<double>" else np.float32
    if dict(v.dtypes)["v"] not in ("array<double>", "array<float>"):
        v, wide = v.withColumn("v", F.col("v").cast("array<double>")), np.float64
    sizes = {r.size: r["count"] for r in v.groupBy(F.size("v").alias("size")).count().collect()}
    n = sum(sizes.values())
    # Large blocks spare the shuffle; some dozen of them keep all cores at work.
    blocks = max(1, -(-n // block_rows), min(_LEAST_BLOCKS, -(-n // _SMALL_BLOCK)))
    one_of = max(1, sum(s * c for s, c in sizes.items()) // SAMPLE_CELLS)
    sample = v.where(F.pmod(F.xxhash64("k", F.lit(2)), F.lit(one_of)) == 0).limit(2 * n // one_of + 1).toArrow() if blocks > 1 else None
    lengths = np.array([len(x) for x in sample["v"].to_pylist()]) if sample else None
    trees, leaders, names, leaves = {}, {}, [], 0
    for size, count in sizes.items():
        tree = None
        if sample and (rows := np.flatnonzero(lengths == size)).size:
            x = _units(_numbers(sample["v"].take(rows), size))
            rows, x = rows[(ok := np.isfinite(x).all(axis=1))], x[ok]
            tree = regions(x.astype(np.float32), max(1, blocks * count // n))
            if one_of > 1 and len(x):
                forest = forest_links(x, None, least, np.full(len(x), -1))[2]
                roots = forest.roots(np.arange(len(x)))
                _, group, members = np.unique(roots, return_inverse=True, return_counts=True)
                known = members[group] > 1
                at, label = np.unique(roots[known], return_inverse=True)
                leaders[size] = x[known].astype(np.float32), label + len(names)
                names += sample["k"].take(rows[at]).to_pylist()
        trees[size] = leaves, tree
        leaves += len(in_regions(np.zeros((0, size), np.float32), tree))
    k_type = sample.schema.field("k").type if sample else None
    firsts = pa.array(names, k_type) if names else None

    def place(batches):
        for batch in batches:
            lengths = pc.list_value_length(batch["v"]).to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                part = batch.filter(pa.array(lengths == size))
                raw = _numbers(part["v"], size).astype(wide)
                x = _units(raw)
                ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                part, raw, x = part.filter(pa.array(ok)), raw[ok], x[ok].astype(np.float32)
                start, tree = trees[int(size)]
                leaf, label = np.empty(len(x), np.int32), np.full(len(x), -1, np.int32)
                for i, rows in enumerate(in_regions(x, tree)):
                    leaf[rows] = start + i
                lead, group = leaders.get(int(size), ((), ()))
                high = STRIP_CELLS // max(1, len(lead))
                for at in range(0, len(x) if len(lead) else 0, high):
                    s = x[at : at + high] @ lead.T
                    best = s.argmax(axis=1)
                    # What is nearer to the threshold than single precision tells stays without a label, and is found later.
                    label[at : at + high] = np.where(s[np.arange(len(s)), best] >= least + _MARGIN, group[best], -1)
                first = firsts.take(pa.array(label, mask=label < 0)) if firsts is not None else pa.nulls(len(x), part["k"].type)
                flat = pa.array([r.tobytes() for r in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([part["k"], flat, pa.array(np.full(len(x), size, np.int32)), pa.array(leaf), pa.array(label), first, part["h"]], ["k", "v", "size", "leaf", "label", "first", "h"])

    hashed = v.withColumn("h", F.pmod(F.xxhash64("k", F.lit(3)), F.lit(1 << 20)).cast("int"))
    placed = cut(hashed.mapInArrow(place, f"k {kind}, v binary, size int, leaf int, label int, first {kind}, h int"), "link-rows")

    def bounds(batches):
        seen = {}
        for batch in batches:
            leaf, size = batch["leaf"].to_numpy(), batch["size"].to_numpy()
            for i in np.unique(leaf):
                rows = np.flatnonzero(leaf == i)
                x = _units(_read(batch["v"].take(pa.array(rows)), int(size[rows[0]]), wide)).astype(np.float32)
                c, low, high = seen.get(i, (0, x[0], x[0]))
                seen[i] = c + len(x), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if seen:
            yield pa.RecordBatch.from_pydict({"leaf": pa.array(list(seen), pa.int32()), "n": [c for c, _, _ in seen.values()], "low": [a.tobytes() for _, a, _ in seen.values()], "high": [b.tobytes() for _, _, b in seen.values()]})

    def bound(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = (np.array([np.frombuffer(b, np.float32) for b in frame[c]]) for c in ("low", "high"))
        return pd.DataFrame({"leaf": frame["leaf"].iloc[:1], "n": [frame["n"].sum()], "low": [low.min(axis=0).tobytes()], "high": [high.max(axis=0).tobytes()]})

    schema = "leaf int, n long, low binary, high binary"
    boxes = {r.leaf: r for r in placed.select("v", "size", "leaf").mapInArrow(bounds, schema).groupBy("leaf").applyInPandas(bound, schema).collect()}
    by_size: dict[int, list[int]] = {}
    for i, r in boxes.items():
        by_size.setdefault(len(r.low) // 4, []).append(i)
    shape = {s: (at, np.array([np.frombuffer(boxes[i].low, np.float32) for i in at]), np.array([np.frombuffer(boxes[i].high, np.float32) for i in at])) for s, at in by_size.items()}
    slices, start, total = {}, {}, 0
    for i in sorted(boxes):
        start[i], slices[i] = total, -(-boxes[i].n // (block_rows + block_rows // 2))
        total += slices[i]
    square = reach(least)

    def deal(batches):
        for batch in batches:
            size, leaf, h = (batch[c].to_numpy() for c in ("size", "leaf", "h"))
            own = np.array([start[i] for i in leaf], np.int64) + h % np.array([slices[i] for i in leaf], np.int64)
            for s in np.unique(size):
                rows = np.flatnonzero(size == s)
                at, low, high = shape[int(s)]
                near = near_boxes(_units(_read(batch["v"].take(pa.array(rows)), int(s), wide)).astype(np.float32), low, high, square)
                for c, i in enumerate(at):
                    close = rows[near[:, c] | (leaf[rows] == i)]
                    for other in range(start[i], start[i] + slices[i]) if len(close) else ():
                        lo, hi = np.minimum(own[close], other), np.maximum(own[close], other)
                        part = batch.select(["k", "v", "label"]).take(pa.array(close))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lo), pa.array(hi), pa.array(own[close] == lo)], ["k", "v", "label", "lo", "hi", "left"])

    def links(table: pa.Table) -> pa.Table:
        left = table["left"].to_numpy()
        k, label = table["k"].combine_chunks(), table["label"].to_numpy()
        order = np.concatenate([np.flatnonzero(left), np.flatnonzero(~left)])
        count, same = int(left.sum()), table["lo"][0].as_py() == table["hi"][0].as_py()
        empty = pa.table({"a": k.slice(0, 0), "b": k.slice(0, 0)})
        if not same and count in (0, len(order)):
            return empty
        x = _units(_read(table["v"].take(pa.array(order)), len(table["v"][0].as_py()) // np.dtype(wide).itemsize, wide))
        label = label[order]
        r, c, _ = forest_links(x, None, least, label) if same else forest_links(x[:count], x[count:], least, label)
        if not len(r):
            return empty
        k = k.take(pa.array(order))
        if firsts is not None:
            k = pc.coalesce(firsts.take(pa.array(label, mask=label < 0)), k)
        a, b = k.take(pa.array(r)), k.take(pa.array(c))
        return pa.table({"a": pc.min_element_wise(a, b), "b": pc.max_element_wise(a, b)})

    dealt = placed.select("k", "v", "size", "leaf", "label", "h").mapInArrow(deal, f"k {kind}, v binary, label int, lo long, hi long, left boolean")
    found = dealt.groupBy("lo", "hi").applyInArrow(links, f"a {kind}, b {kind}")
    told = placed.where("first is not null").select(F.least("k", "first").alias("a"), F.greatest("k", "first").alias("b"))
    return found.unionByName(told).where("a <> b")


def _numbers(lists, size: int) -> np.ndarray:
    """Rows of lists of one length; a null among the numbers is NaN."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _read(raw, size: int, wide: type) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), wide).reshape(-1, size)


BUCKET_ROWS = 2048


def lsh_shape(least: float, rows: int, recall: float) -> tuple[int, int]:
    """``tables, bits``: buckets of some ``BUCKET_ROWS`` rows, and tables enough for a pair at ``least`` to meet with chance ``recall``.

    Every table shuffles all vectors, while a bucket's products are one matrix product: so buckets are large and tables few.

    No bits, where the tables would hold more candidates than there are pairs.
    """
    agree = 1 - np.arccos(np.clip(least, -1, 1)) / np.pi
    bits = min(62, max(0, int(np.log2(max(rows, 1) / BUCKET_ROWS)))) if rows >= 2 * BUCKET_ROWS else 0
    meet = agree**bits
    tables = 1 if meet >= 1 else int(np.ceil(np.log(1 - recall) / np.log1p(-meet))) if meet > 0 else 1 << 62
    return (1, 0) if tables >= 2**bits else (tables, bits)


def in_slices(rows: DataFrame, key: str, total: str, most: int) -> DataFrame:
    """Adds ``slice`` and ``block``: a bucket of more than ``most`` rows (``total``) is dealt by ``key`` into slices, and each pair of slices is a block, besides each slice itself."""
    n = F.when(F.col(total) <= most, 1).otherwise(F.ceil(F.col(total) / (most // 2))).cast("int")
    dealt = rows.withColumn("_n", n).withColumn("slice", F.pmod(F.xxhash64(key, F.lit(1)), "_n").cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return dealt.withColumn("block", F.least("slice", "_other") * F.col("_n") + F.greatest("slice", "_other")).drop("_n", "_other")


def lsh_pairs(vectors: DataFrame, key: str, vector: str, least: float, recall: float = 0.95, seed: int = 7) -> DataFrame:
    """``a, b, similarity`` of pairs with a < b that share a random-hyperplane bucket in any table and reach ``least``: no false pairs.

    ``lsh_shape`` takes tables and bits from the threshold and the distinct vectors, so that a pair at the threshold is found with chance
    ``recall``; nearer ones more often. Equal vectors are hashed once; vectors of other length never meet. The work grows with the rows to the power
    1 + log(agree) / log(1/2), agree = 1 - arccos(least) / pi: 1.66 at 0.4, 1.22 at 0.9. Buckets are compared where they meet, large ones in slices, so what is
    shuffled is each vector once a table, and no candidates. Without bits ``cosine_pairs`` finds all.
    """
    from tidemark.functions.vector import cosine

    v = vectors.where(F.col(key).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    groups = cut(v.select("v").distinct().withColumn("g", F.monotonically_increasing_id()), "lsh-vectors")
    members = cut(v.join(groups, "v").select("g", "k").distinct(), "lsh-members")
    tables, bits = lsh_shape(least, groups.count(), recall)

    def codes(frames):
        for frame in frames:
            for size, part in frame.groupby(frame["v"].map(len)):
                x = np.array(part["v"].tolist(), np.float64)
                each = np.empty((len(part), tables), np.int64)
                for t in range(tables):
                    plane = np.random.default_rng([seed, size, t]).choice([-1.0, 1.0], size=(size, bits))
                    each[:, t] = (x @ plane >= 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield pd.DataFrame({"g": part["g"].to_numpy(), "v": part["v"].to_numpy(), "size": size, "codes": list(each)})

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("slice", kind="stable")
        x, g = np.array(frame["v"].tolist(), np.float64), frame["g"].to_numpy()
        with np.errstate(invalid="ignore", divide="ignore"):
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
        first = int((frame["slice"] == frame["slice"].iloc[0]).sum())
        several, out = first < len(g), []
        for at in range(0, first if several else len(g), 512):
            end = min(at + 512, first) if several else at + 512
            y, names = (x[first:], g[first:]) if several else (x, g)
            s = x[at:end] @ y.T
            r, c = np.nonzero(s >= least) if several else np.nonzero((s >= least) & (g[at:end][:, None] < names[None, :]))
            i, j = g[at:end][r], names[c]
            out.append(pd.DataFrame({"g": np.minimum(i, j), "h": np.maximum(i, j), "similarity": s[r, c]}))
        return pd.concat(out)

    if bits:
        coded = cut(groups.select("g", "v").mapInPandas(codes, f"g long, v {dict(groups.dtypes)['v']}, size int, codes array<long>"), "lsh")
        dealt = coded.select("g", "v", "size", F.posexplode("codes").alias("t", "code"))
        # Pairs meet where their bucket is: ids and vectors are shuffled, candidates never. Of a table there are at most 2**bits buckets.
        sizes = dealt.groupBy("size", "t", "code").agg(F.count("*").alias("rows")).where("rows > 1")
        dealt = in_slices(dealt.join(F.broadcast(sizes), ["size", "t", "code"]), "g", "rows", 2 * BUCKET_ROWS)
        close = dealt.groupBy("size", "t", "code", "block").applyInPandas(compare, "g long, h long, similarity double")
        close = close.groupBy("g", "h").agg(F.max("similarity").alias("similarity"))
    else:
        close = cosine_pairs(groups, "g", "v", least).select(F.col("a").alias("g"), F.col("b").alias("h"), "similarity")
    close = close.unionByName(groups.select("g", F.col("g").alias("h"), cosine("v", "v").alias("similarity")))
    close = close.where((F.col("similarity") >= least) & ~F.isnan("similarity"))
    found = close.join(members, "g").join(members.select(F.col("g").alias("h"), F.col("k").alias("k2")), "h").where("k <> k2")
    return found.groupBy(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b")).agg(F.max("similarity").alias("similarity"))


def groups_of(pairs: DataFrame, name: str = "story-links", most_rounds: int = 50) -> DataFrame:
    """``node, cluster_id`` of the transitive closure; the cluster's id is its smallest node.

    Labels travel along links and jump to their label's label, so rounds grow with the logarithm of the longest chain. Each
    round is a written table. Nodes without links do not appear.
    """
    links = cut(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), name)
    label = cut(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("cluster_id")), name)
    for _ in range(most_rounds):
        theirs = links.join(label.select(F.col("node").alias("b"), "cluster_id"), "b").groupBy(F.col("a").alias("node")).agg(F.min("cluster_id").alias("near"))
        moved = label.join(theirs, "node").select("node", F.least("cluster_id", "near").alias("cluster_id"), F.col("cluster_id").alias("was"))
        jump = moved.select(F.col("node").alias("_n"), F.col("cluster_id").alias("_c"))
        new = cut(moved.join(jump, moved.cluster_id == jump._n, "left").select("node", F.least("cluster_id", F.coalesce("_c", "cluster_id")).alias("cluster_id"), "was"), name)
        label = new.select("node", "cluster_id")
        if new.where("cluster_id <> was").isEmpty():
            return label
    raise RuntimeError("groups did not settle")


def representatives(news: DataFrame, cluster: str, time: str, key: str) -> DataFrame:
    """The earliest story of each cluster; ties go to the smallest ``key``."""
    w = Window.partitionBy(cluster).orderBy(time, key)
    return news.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def window_pairs(vectors: DataFrame, key: str, vector: str, day: str, days: int, least: float, block_rows: int = 2048) -> DataFrame:
    """``a, b, similarity, gap`` of pairs with a < b at or above ``least`` whose dates lie at most ``days`` apart: exact, and its work grows with the rows in a span, not with all rows squared.

    Time is cut into spans of ``days`` days; a story is at home in its own and a guest in the next, so each pair meets once, where the later of the two is at home. A
    span is worked in blocks of bounded size, however many stories fall on one day. Rows with a null key, date or vector have no pairs; vectors of other length are not alike.
    """
    v = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.col(day).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"), F.unix_date(F.col(day).cast("date")).alias("d"))
    width = max(1, days)
    v = cut(v.withColumn("span", F.floor(F.col("d") / width)), "window-rows")
    both = v.withColumn("own", F.lit(True)).unionByName(v.select("k", "v", "d", (F.col("span") + 1).alias("span"), F.lit(False).alias("own")))
    sizes = both.groupBy("span").agg(F.count_if("own").alias("n"), F.count("*").alias("m")).where("n > 0")
    shape = cut(sizes.select("span", F.ceil(F.col("n") / block_rows).cast("int").alias("rows"), F.ceil(F.col("m") / block_rows).cast("int").alias("cols")), "window-spans")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    slot = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    left = v.join(shape, "span").select("k", "v", "d", "span", slot("rows").alias("i"), every("cols").alias("j"))
    right = both.join(shape, "span").select(F.col("k").alias("k2"), F.col("v").alias("v2"), F.col("d").alias("d2"), "own", F.col("span").alias("span2"), slot("cols").alias("j2"), every("rows").alias("i2"))
    kind = dict(v.dtypes)["k"]

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "b": [], "similarity": [], "gap": []})]
        b = b.rename(columns={"k2": "k", "v2": "v", "d2": "d"})
        for size in set(a["v"].map(len)) & set(b["v"].map(len)) - {0}:
            x, y = a[a["v"].map(len) == size], b[b["v"].map(len) == size]
            m, o = (np.array(t["v"].tolist(), np.float64) for t in (x, y))
            with np.errstate(invalid="ignore", divide="ignore"):
                s = (m / np.linalg.norm(m, axis=1, keepdims=True)) @ (o / np.linalg.norm(o, axis=1, keepdims=True)).T
            ka, kb, gap = x["k"].to_numpy(), y["k"].to_numpy(), np.abs(x["d"].to_numpy()[:, None] - y["d"].to_numpy()[None, :])
            # Two rows at home in one span meet twice; a guest meets a row at home once.
            once = np.where(y["own"].to_numpy(bool)[None, :], ka[:, None] < kb[None, :], ka[:, None] != kb[None, :])
            r, c = np.nonzero((s >= least) & (gap <= days) & once)
            out.append(pd.DataFrame({"a": np.minimum(ka[r], kb[c]), "b": np.maximum(ka[r], kb[c]), "similarity": s[r, c], "gap": gap[r, c]}))
        return pd.concat(out[1:]) if out[1:] else out[0]

    return left.groupBy("span", "i", "j").cogroup(right.groupBy("span2", "i2", "j2")).applyInPandas(compare, f"a {kind}, b {kind}, similarity double, gap int")
