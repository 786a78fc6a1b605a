"""Exact top-k inner products by dual-tree search over cover trees, in blocks that the top of one cover tree cuts.

Vectors become whole numbers, floor(256 * x). The top level of a cover tree over a bounded sample (centres taken farthest first) cuts space into
at most ``MOST_REGIONS`` regions; a region's rows are slices of bounded size, the blocks, and its queries are groups of bounded size. Each block and
each group gets a cover tree once, written to the shared folder. With centres q, p and covering radii a, b no pair below two nodes scores
more than <q, p> + a |p| + b |q| + a b (Curtin and Ram, 2014), nor more than the product of the longest norms. Each query group first searches
its most promising block; its worst kth score then decides, by the same bound on whole regions, which blocks it meets at all. Those are
searched best first in chunks, the kth scores carried from block to block, and pairs of nodes below a query node's worst kth score go.
The chunks' best are merged per query.

Defined cases: null vectors, vectors with null or non-finite components and rows with null ``vec_id`` take no part; an empty
vector scores 0 with its like; vectors of different length have no inner product and never meet; equal rows count once; rows with
the query's own ``vec_id`` are no candidates of it; ties go to the smaller ``vec_id``; fewer than k candidates are all returned; an empty
table gives no rows; further columns are ignored. Scores are 64-bit whole numbers, exact while components stay below 2**25.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.shared import materialize, new_folder, open_fs, task_name

K = 5
SCALE = 256
QUERY_EVERY = 50
BLOCK_ROWS, QUERY_ROWS, CHUNK_BLOCKS = 8192, 512, 16
MOST_REGIONS, SAMPLE_ROWS = 1024, 8192
# Leaf sizes, and the points a child must have on average, of blocks' and of query groups' trees.
BLOCK_TREE, QUERY_TREE = (64, 16), (2, 2)
_BATCH_ROWS = 4096
_NONE = -np.iinfo(np.int64).max  # its negative exists


def farthest_first(x: np.ndarray, first: int, near: np.ndarray, cover: float, most: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres more than ``cover`` apart until all points are within ``cover`` of one, or there are ``most``; owners and distances."""
    picked, owner = [first], np.zeros(len(x), np.int64)
    while len(picked) < most and near.max(initial=0) > cover:
        far = int(near.argmax())
        d = np.sqrt(((x - x[far]) ** 2).sum(axis=1))
        owner[d < near] = len(picked)
        near = np.minimum(near, d)
        picked.append(far)
    return picked, owner, near


class CoverTree:
    """Nodes over slices of reordered points, as arrays; a node's centre is one of its points, its radius exact.

    Every node with children satisfies both invariants: each of its points is within half its radius of its child's centre (covering), and
    the children's centres are more than that apart (separation). A node that would need more children than one in ``share`` of its points
    has none and is compared as a whole: there the points are too spread for a tree to tell them apart.
    """

    FIELDS = ("ids", "points", "start", "stop", "radius", "centre", "first", "last")

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int, share: int = 16):
        x = points.astype(np.float64)
        order = np.arange(len(x))
        nodes: list[list] = [[0, len(x), 0.0, 0, 0, 0]]  # start, stop, radius, centre (a row of ``points``), first and last child
        at = 0
        while at < len(nodes) and len(x):
            a, b, _, centre, _, _ = nodes[at]
            own = order[a:b].copy()
            part = x[own]
            dist = np.sqrt(((part - x[centre]) ** 2).sum(axis=1))
            radius = nodes[at][2] = float(dist.max(initial=0))
            if b - a > leaf and radius > 0:
                picked, owner, near = farthest_first(part, int(np.flatnonzero(own == centre)[0]), dist, radius / 2, max(2, (b - a) // share))
                if near.max() <= radius / 2:
                    sort = np.argsort(owner, kind="stable")
                    order[a:b] = own[sort]
                    cuts = a + np.searchsorted(owner[sort], np.arange(len(picked) + 1))
                    nodes[at][4:] = len(nodes), len(nodes) + len(picked)
                    nodes += [[int(lo), int(hi), 0.0, int(own[c]), 0, 0] for lo, hi, c in zip(cuts, cuts[1:], picked)]
            at += 1
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        self.ids, self.points = ids[order], points[order]
        table = np.array(nodes, np.float64).reshape(-1, 6)
        self.start, self.stop, self.first, self.last = (table[:, i].astype(np.int64) for i in (0, 1, 4, 5))
        self.radius, self.centre = table[:, 2], place[table[:, 3].astype(np.int64)] if len(x) else np.zeros(1, np.int64)
        self._prepare()

    def _prepare(self) -> None:
        x = self.points.astype(np.float64)
        self.centres = x[self.centre] if len(x) else np.zeros((1, x.shape[1]))
        self.norms = np.sqrt((self.centres**2).sum(axis=1))
        self.largest = int(np.abs(self.points).max(initial=0))

    def save(self, uri: str) -> None:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        fs, path = open_fs(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as f:
            f.write(out.getvalue())

    @classmethod
    def load(cls, uri: str) -> "CoverTree":
        fs, path = open_fs(uri)
        tree = cls.__new__(cls)
        with fs.open_input_stream(path) as f, np.load(io.BytesIO(f.read())) as arrays:
            for name in cls.FIELDS:
                setattr(tree, name, arrays[name])
        tree._prepare()
        return tree


class Search:
    """The k best of each query of a tree, carried from block to block. Scores below a query's ``floors`` are of no interest."""

    def __init__(self, queries: CoverTree, k: int = K, floors: np.ndarray | None = None):
        self.q, self.k = queries, k
        self.score = np.full((len(queries.ids), k), _NONE, np.int64)
        self.floors = self.score[:, -1] if floors is None else floors
        self.name = np.full((len(queries.ids), k), np.iinfo(np.int64).max)

    def worst(self, i: int = 0) -> float:
        own = slice(self.q.start[i], self.q.stop[i])
        return float(np.maximum(self.score[own, -1], self.floors[own]).min())

    def bounds(self, p: CoverTree, i: int, nodes: np.ndarray) -> np.ndarray:
        """What no pair of a query below node ``i`` and a row below one of ``nodes`` exceeds."""
        q, a, b = self.q, self.q.radius[i], p.radius[nodes]
        top = p.centres[nodes] @ q.centres[i] + a * p.norms[nodes] + b * q.norms[i] + a * b
        return top + 1e-9 * np.abs(top) + 1e-6  # never below the true bound through rounding

    def block(self, p: CoverTree) -> int:
        """Search one block; returns how many products it took."""
        q, compared = self.q, 0
        if not len(q.ids) or not len(p.ids):
            return 0
        exact = np.int64 if q.largest * p.largest * q.points.shape[1] >= 2**52 else np.float64
        qx, px = q.points.astype(exact), p.points.astype(exact)
        stack = [(0, np.zeros(1, np.int64))]
        while stack:
            i, nodes = stack.pop()
            top = self.bounds(p, i, nodes)
            alive = top >= self.worst(i)
            nodes, top = nodes[alive], top[alive]
            if not len(nodes):
                continue
            if q.last[i]:
                wide = (p.radius[nodes] >= q.radius[i]) & (p.last[nodes] > 0)
                finer = np.concatenate([nodes[~wide], *(np.arange(p.first[j], p.last[j]) for j in nodes[wide])])
                stack += [(kid, finer) for kid in range(q.first[i], q.last[i])]
            else:
                compared += self._leaf(p, qx, px, i, nodes, top)
        return compared

    def _leaf(self, p: CoverTree, qx: np.ndarray, px: np.ndarray, i: int, nodes: np.ndarray, top: np.ndarray) -> int:
        """Queries of one leaf against ``nodes``, the most promising first."""
        heap = list(zip((-top).tolist(), nodes.tolist()))
        heapq.heapify(heap)
        compared = 0
        while heap:
            worst, spans, n = self.worst(i), [], 0
            while heap and n < _BATCH_ROWS and -heap[0][0] >= worst:
                _, j = heapq.heappop(heap)
                if p.last[j]:
                    kids = np.arange(p.first[j], p.last[j])
                    for t, kid in zip(self.bounds(p, i, kids).tolist(), kids.tolist()):
                        if t >= worst:
                            heapq.heappush(heap, (-t, kid))
                else:
                    spans.append(np.arange(p.start[j], p.stop[j]))
                    n += len(spans[-1])
            if not spans:
                break
            compared += n * int(self.q.stop[i] - self.q.start[i])
            self._compare(p, qx, px, i, np.concatenate(spans))
        return compared

    def _compare(self, p: CoverTree, qx: np.ndarray, px: np.ndarray, i: int, rows: np.ndarray) -> None:
        a, b, names = int(self.q.start[i]), int(self.q.stop[i]), p.ids[rows]
        s = (qx[a:b] @ px[rows].T).astype(np.int64)
        own = self.q.ids[a:b, None] == names[None]
        s[own] = _NONE
        least = np.maximum(self.score[a:b, -1], self.floors[a:b])
        if s.shape[1] > self.k:
            least = np.maximum(least, np.partition(s, -self.k, axis=1)[:, -self.k])
        some = (s >= least[:, None]) & ~own
        for r in np.flatnonzero(some.any(axis=1)):
            hit = np.flatnonzero(some[r])
            score, name = np.concatenate([self.score[a + r], s[r, hit]]), np.concatenate([self.name[a + r], names[hit]])
            best = np.lexsort((name, -score))[: self.k]
            self.score[a + r], self.name[a + r] = score[best], name[best]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, col = np.nonzero(self.name < np.iinfo(np.int64).max)
        return self.q.ids[row], self.name[row, col], self.score[row, col]


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int = K, stats: dict | None = None):
    """Each query's k best of one block: ``query_id, vec_id, score``. Both sides are arrays of whole numbers."""
    found = Search(CoverTree(query_ids, queries.astype(np.int64), *QUERY_TREE), k)
    compared = found.block(CoverTree(ids, points.astype(np.int64), *BLOCK_TREE))
    if stats is not None:
        stats["compared"] = stats.get("compared", 0) + compared
    return found.found()


# --- distributed part ----------------------------------------------------------------------


def whole_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` with whole components; rows that take no part are gone."""
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("long"))
    return table.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).dropDuplicates(["vec_id", "v"])


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), dim)


def region_centres(vectors: DataFrame, block_rows: int) -> dict[int, np.ndarray]:
    """Centres of each vector length's regions: the top level of a cover tree over the first ``SAMPLE_ROWS`` rows by hash.

    Where four centres a block do not cover the sample at half its radius, it has no clusters to cut along, and one centre a block is enough.
    """
    sizes = {r.dim: r.n for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    likely = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < min(1 << 30, (2 * SAMPLE_ROWS << 30) // max(sum(sizes.values()), 1))  # spares the sort most rows
    sample = vectors.where(likely).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("dim", "v").toPandas()
    centres = {}
    for dim, n in sizes.items():
        x = matrix(sample["v"][sample["dim"] == dim], dim).astype(np.float64)
        blocks = -(-n // block_rows)
        if blocks > 1 and len(x) and dim:
            dist = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
            picked, _, near = farthest_first(x, 0, dist, dist.max() / 2, min(MOST_REGIONS, 4 * blocks))
            covered = near.max() <= dist.max() / 2
            centres[dim] = x[picked if covered else picked[:min(MOST_REGIONS, blocks)]]
        else:
            centres[dim] = np.zeros((1, dim))
    return centres


def search_blocks(table: DataFrame, k: int = K, every: int = QUERY_EVERY, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, chunk: int = CHUNK_BLOCKS) -> DataFrame:
    """``query_id, vec_id, score`` of each chunk's best; a row with null ``query_id`` for each pair of query group and block tells ``compared`` and ``possible`` products.

    Pairs that the bounds on regions leave out have no row at all.
    """
    spark = table.sparkSession
    vectors = materialize(whole_vectors(table).withColumn("dim", F.size("v")), "vectors")
    centres = region_centres(vectors, block_rows)
    folder = new_folder(spark, "cover-trees")

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                x, c = matrix(part["v"], dim).astype(np.float64), centres[dim]
                # Nearest centre, up to rounding: which region a row falls in is no matter of exactness, its distance is (below).
                yield part.assign(region=((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1).astype(np.int32))

    routed = materialize(vectors.mapInPandas(route, "vec_id long, v array<long>, dim int, region int"), "routed")

    def grown(rows: DataFrame, most: int, kind: str, shape: tuple[int, int]) -> DataFrame:
        """One tree for each slice of a region: ``dim, region, part, n, path`` and how far and how long its vectors are."""

        def build(frame: pd.DataFrame) -> pd.DataFrame:
            dim, region, part = (int(frame[c].iloc[0]) for c in ("dim", "region", "part"))
            x = matrix(frame["v"], dim)
            path = f"{folder}/{task_name(kind)}.npz"
            CoverTree(frame["vec_id"].to_numpy(), x.astype(np.int32) if np.abs(x).max(initial=0) < 2**31 else x, *shape).save(path)
            far, long = (float(np.sqrt((y.astype(np.float64) ** 2).sum(axis=1)).max()) for y in (x - centres[dim][region], x))
            return pd.DataFrame({"dim": [dim], "region": [region], "part": [part], "n": [len(frame)], "path": [path], "far": [far], "long": [long]})

        parts = rows.groupBy("dim", "region").agg(F.ceil(F.count("*") / most).alias("parts"))
        sliced = rows.join(parts, ["dim", "region"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), "parts").cast("int"))
        made = sliced.drop("parts").groupBy("dim", "region", "part").applyInPandas(build, "dim int, region int, part int, n long, path string, far double, long double")
        return materialize(made, f"{kind}-trees")

    blocks = grown(routed, block_rows, "block", BLOCK_TREE)
    groups = grown(routed.where(F.col("vec_id") % every == 0), query_rows, "group", QUERY_TREE)
    # At most ``MOST_REGIONS`` rows of each vector length.
    reach = {(r.dim, r.region): (r.far, r.long) for r in blocks.groupBy("dim", "region").agg(F.max("far").alias("far"), F.max("long").alias("long")).collect()}

    def region_bounds(dim: int, region: int, far: float, long: float) -> tuple[np.ndarray, np.ndarray]:
        """Regions that hold rows, and what no pair of the group and one of their rows exceeds; the most promising first."""
        at = np.array([r for d, r in reach if d == dim], np.int64)
        b, most = np.array([reach[dim, r] for r in at.tolist()]).T
        c, q = centres[dim][at], centres[dim][region]
        dot = c @ q
        top = np.minimum(dot + far * np.sqrt((c**2).sum(axis=1)) + b * np.sqrt((q**2).sum()) + far * b, long * most)
        first = np.lexsort((-dot, -top))
        return at[first], (top + 1e-9 * np.abs(top) + 1e-6)[first]

    out = "query_id long, vec_id long, score long, grp string, block string, compared long, possible long, worst double, floors string"
    wide = [c.split()[0] for c in out.split(", ")]

    def rows_of(search: Search, told: list[dict]) -> pd.DataFrame:
        best = pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), search.found())))
        frame = pd.concat([best, pd.DataFrame(told, columns=wide[3:])]).reindex(columns=wide)
        return frame.astype({c: "Int64" for c in ("query_id", "vec_id", "score", "compared", "possible")} | {c: object for c in ("grp", "block", "floors")})

    def look(search: Search, group: str, path: str) -> dict:
        tree = CoverTree.load(path)
        return {"grp": group, "block": path, "compared": search.block(tree), "possible": len(search.q.ids) * len(tree.ids)}

    def promising(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = [int(region_bounds(r.dim, r.region, r.far, r.long)[0][0]) for r in frame.itertuples()]
            yield pd.DataFrame({"grp": frame["path"], "dim": frame["dim"], "near": np.array(at, np.int32)})

    def seed(frame: pd.DataFrame) -> pd.DataFrame:
        group = frame["grp"].iloc[0]
        search = Search(CoverTree.load(group), k)
        told = look(search, group, frame["block"].iloc[0])
        floors = f"{folder}/{task_name('floors')}.npy"
        fs, path = open_fs(floors)
        with fs.open_output_stream(path) as f:
            f.write(search.score[:, -1].tobytes())
        return rows_of(search, [told | {"worst": search.worst(), "floors": floors}])

    def rest(frame: pd.DataFrame) -> pd.DataFrame:
        """One chunk's blocks, starting from the kth scores of the group's first block."""
        group = frame["grp"].iloc[0]
        fs, path = open_fs(frame["floors"].iloc[0])
        with fs.open_input_stream(path) as f:
            search = Search(CoverTree.load(group), k, np.frombuffer(f.read(), np.int64))
        told = []
        for r in frame.sort_values(["top", "block"], ascending=[False, True]).itertuples():
            if r.top < search.worst():
                break  # the others promise no more
            told.append(look(search, group, r.block))
        return rows_of(search, told)

    tops = groups.mapInPandas(promising, "grp string, dim int, near int")
    firsts = blocks.groupBy("dim", F.col("region").alias("near")).agg(F.min_by("path", "part").alias("block"))
    seeds = materialize(tops.join(firsts, ["dim", "near"]).groupBy("grp").applyInPandas(seed, out), "cover-seeds")

    def surviving(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                at, top = region_bounds(r.dim, r.region, r.far, r.long)
                ok = top >= r.worst
                yield pd.DataFrame({"grp": r.path, "done": r.block, "floors": r.floors, "dim": r.dim, "region": at[ok].astype(np.int32), "top": top[ok]})

    told = seeds.where("query_id is null").select(F.col("grp").alias("path"), "block", "floors", "worst")
    pairs = groups.join(told, "path").mapInPandas(surviving, "grp string, done string, floors string, dim int, region int, top double")
    pairs = pairs.join(blocks.select("dim", "region", F.col("path").alias("block")), ["dim", "region"]).where("block <> done")
    order = Window.partitionBy("grp").orderBy(F.desc("top"), "block")
    pairs = pairs.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / chunk)).select("grp", "floors", "chunk", "block", "top")
    return seeds.unionByName(materialize(pairs.groupBy("grp", "chunk").applyInPandas(rest, out), "cover-rest"))


def top_k(table: DataFrame, k: int = K, every: int = QUERY_EVERY, **sizes) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the queries, rows whose id is divisible by ``every``, against all rows."""
    found = search_blocks(table, k, every, **sizes).where("query_id is not null")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
