"""Exact top-k by inner product: a dual-tree search over cover trees.

Vectors turn into whole numbers, so scores are exact. Rows are dealt to cells, each around the nearest of a bounded number of
sampled pivots, and a large cell into blocks; of a cell its pivot and covering radius are known. Every query's own cell is
searched first, which gives a kth score; after that a group of queries meets only the cells whose pivot and radius allow a
score that reaches the worst kth score of the group. Data are shuffled once for each of the two steps, queries go to the
blocks that they may need.

Within a block both sides have a cover tree: each node has a centre and the radius that covers all below it; the centres of
its children lie farther apart than half of that radius and cover all of its rows within half of it. A node whose rows would
take more than FANOUT such centres, or one for every few rows (EACH), is a leaf, for there a tree excludes nothing that a product
would not do faster; in a leaf, rows are left out one by one by their own lengths. A pair of nodes is left out if the largest product that centres and radii allow falls short of the worst kth score in the query node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget, written

SCALE, K, QUERY_STEP = 256, 5, 50
#: A leaf's rows; the most children of a node, and the rows that each has on average at least, of data and of queries.
LEAF, FANOUT, EACH, EACH_QUERY = 64, 512, 8, 2
#: Pivots (a bounded sample), the most bytes of a data block's vectors, queries that are searched together or in one task.
CELLS, BLOCK_BYTES, QUERIES, QUERY_PART = 512, 8 << 20, 2048, 65_536
#: Whole-number vectors at least this long take no part, as their scores may be more than a long holds.
LONGEST = 2.0**31


class CoverTree:
    """Nodes as lists: centre (row), radius, all rows below, and for inner nodes the numbers of the children."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, each: int = EACH, fanout: int = FANOUT):
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.rows: list[np.ndarray] = []
        self.below: list[list[int] | None] = []
        self.leaf, self.each, self.fanout = leaf, each, fanout
        x = x.astype(np.float64)
        self.square = (x * x).sum(axis=1)
        self.norm = np.sqrt(self.square)
        if len(x):
            middle = x.mean(axis=0)
            self._build(x, np.arange(len(x)), int((self.square - 2 * x @ middle).argmin()))
        del self.square

    def _from(self, x: np.ndarray, rows: np.ndarray, centre: int) -> np.ndarray:
        """Distances of ``x``, which are these rows, to a row."""
        at = int(np.searchsorted(rows, centre))
        out = np.sqrt(np.maximum(self.square[rows] + self.square[centre] - 2 * x @ x[at], 0))
        out[at] = 0.0
        return out

    def _build(self, x: np.ndarray, rows: np.ndarray, centre: int) -> int:
        me, near = len(self.centre), self._from(x, rows, centre)
        radius = float(near.max())
        for values, value in ((self.centre, centre), (self.radius, radius), (self.rows, rows), (self.below, None)):
            values.append(value)
        if len(rows) <= self.leaf or radius == 0:
            return me
        centres, owner = [centre], np.zeros(len(rows), np.int64)
        most = min(self.fanout, len(rows) // self.each)
        while near.max() > radius / 2:  # the farthest row becomes a centre until all are covered
            if len(centres) >= most:
                return me
            i = int(near.argmax())
            d = self._from(x, rows, int(rows[i]))
            owner[d < near] = len(centres)
            near = np.minimum(near, d)
            centres.append(int(rows[i]))
        self.below[me] = [self._build(x[owner == c], rows[owner == c], centres[c]) for c in range(len(centres))]
        return me


def as_exact(x: np.ndarray, most: float) -> np.ndarray:
    """int32 rows in the fastest type in which products up to ``most`` come out exactly."""
    return x.astype(np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64)


def dual_search(q: np.ndarray, q_own: np.ndarray, d: np.ndarray, d_own: np.ndarray, d_ids: np.ndarray, k: int, floor: np.ndarray | None = None, trees: tuple | None = None, tally: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, scores, whether there is such a candidate), k a query and best first, of int32 vectors ``q`` and ``d``.

    Ties go to the smaller id; a row with the query's own number (``own``) is no candidate. Candidates below ``floor``, a
    score for each query, may be left out. ``tally`` gains the number of products that were computed.
    """
    trees = trees or (CoverTree(q, 8, EACH_QUERY), CoverTree(d))
    q_tree, d_tree = trees
    best, ids = np.full((len(q), k), np.iinfo(np.int64).min), np.zeros((len(q), k), np.int64)
    got = np.zeros((len(q), k), bool)
    if not len(q) or not len(d):
        return ids, best, got
    worst = np.full(len(q), -np.inf) if floor is None else floor.astype(np.float64)
    most = float(q_tree.norm.max()) * float(d_tree.norm.max())
    qx, dx = as_exact(q, most), as_exact(d, most)
    slack = 1e-6 * (1 + most)

    def bounds(a: int, nodes: list[int]) -> np.ndarray:
        c, rc = q_tree.centre[a], q_tree.radius[a]
        centres, radii = [d_tree.centre[b] for b in nodes], np.array([d_tree.radius[b] for b in nodes])
        return (dx[centres] @ qx[c]).astype(np.float64) + q_tree.norm[c] * radii + rc * (d_tree.norm[centres] + radii) + slack

    def compare(a: int, b: int) -> None:
        mine, c = q_tree.rows[a], q_tree.centre[a]
        for at in range(0, len(d_tree.rows[b]), 8192):
            theirs = d_tree.rows[b][at : at + 8192]
            can = (dx[theirs] @ qx[c]).astype(np.float64) + q_tree.radius[a] * d_tree.norm[theirs] + slack >= worst[mine].min()
            theirs = theirs[can]
            if not len(theirs):
                continue
            if tally is not None:
                tally[0] += len(mine) * len(theirs)
            s = (qx[mine] @ dx[theirs].T).astype(np.int64)
            fit = (s >= worst[mine][:, None]) & (q_own[mine][:, None] != d_own[theirs][None])
            rows, columns = np.flatnonzero(fit.any(axis=1)), np.flatnonzero(fit.any(axis=0))
            if not len(rows):
                continue
            target, box = mine[rows], np.ix_(rows, columns)
            scores = np.concatenate([best[target], s[box]], axis=1)
            names = np.concatenate([ids[target], np.broadcast_to(d_ids[theirs[columns]], (len(rows), len(columns)))], axis=1)
            there = np.concatenate([got[target], fit[box]], axis=1)
            order = np.lexsort((names, -scores, ~there), axis=1)[:, :k]
            best[target], ids[target], got[target] = (np.take_along_axis(v, order, axis=1) for v in (scores, names, there))
            full = got[target, k - 1]
            worst[target[full]] = np.maximum(worst[target[full]], best[target[full], k - 1])

    # each group of queries first meets the data leaf that promises most, so that pairs can be left out at any height
    done = set()
    for a in range(len(q_tree.centre)):
        if q_tree.below[a] is None:
            b = 0
            while (kids := d_tree.below[b]) is not None:
                b = kids[int(bounds(a, kids).argmax())]
            compare(a, b)
            done.add((a, b))
    stack = [(0, 0, float(bounds(0, [0])[0]))]
    while stack:
        a, b, most_here = stack.pop()
        if most_here < worst[q_tree.rows[a]].min():
            continue
        if q_tree.below[a] is None and d_tree.below[b] is None:
            if (a, b) not in done:
                compare(a, b)
            continue
        if q_tree.below[a] is not None and (d_tree.below[b] is None or q_tree.radius[a] >= d_tree.radius[b]):
            pairs = [(c, b, float(bounds(c, [b])[0])) for c in q_tree.below[a]]
        else:
            pairs = [(a, c, m) for c, m in zip(d_tree.below[b], bounds(a, d_tree.below[b]).tolist(), strict=True)]
        stack += sorted(pairs, key=lambda t: t[2])  # the most promising pair comes next
    return ids, best, got


def _assigned(use: DataFrame, pivots: dict[int, np.ndarray], scale: int) -> DataFrame:
    """(dim, cell, far, vec_id, x): x holds the whole numbers as int32, far the distance to the cell's pivot."""
    shared = use.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, ids, values = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            starts, flat = values.offsets.to_numpy(), np.asarray(values.values.to_numpy(zero_copy_only=False), np.float64)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                for i in range(0, len(rows), 2048):
                    part = rows[i : i + 2048]
                    x = np.floor(flat[starts[part][:, None] + np.arange(dim)] * scale)
                    p = shared.value.get(dim, np.zeros((1, dim)))
                    cell = ((p**2).sum(axis=1)[None] - 2 * x @ p.T).argmin(axis=1)
                    far = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
                    whole = x.astype(np.int32)
                    at = pa.py_buffer((np.arange(len(part) + 1) * 4 * dim).astype(np.int32))
                    packed = pa.Array.from_buffers(pa.binary(), len(part), [None, at, pa.py_buffer(np.ascontiguousarray(whole))])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), dim), pa.int32()), pa.array(cell, pa.int32()), pa.array(far), ids.take(pa.array(part)), packed], names=["dim", "cell", "far", "vec_id", "x"])

    return use.select("dim", "vec_id", "embedding").mapInArrow(run, "dim int, cell int, far double, vec_id long, x binary")


def _search(groups: DataFrame, k: int) -> DataFrame:
    """Groups (dim, cell, sub, part, role, qcell, own, vec_id, x, floor), a block's data (role 0) before the queries that are
    held against it; queries come in any number and are searched QUERIES at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, data, waiting, block = None, [], [], None

        def results() -> pa.RecordBatch:
            nonlocal block
            if block is None:
                own, ids, x = (np.concatenate(v) for v in zip(*((o, i, v) for o, i, v, _ in data), strict=True))
                block = own, ids, x, CoverTree(x)
            own, ids, qx, floor = (np.concatenate(v) for v in zip(*waiting, strict=True))
            waiting.clear()
            found, score, got = dual_search(qx, own, block[2], block[0], block[1], k, floor, (CoverTree(qx, 8, EACH_QUERY), block[3]))
            n = got.sum(axis=1)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.repeat(own, n)), pa.array(found[got]), pa.array(score[got])], names=["query_id", "own", "vec_id", "score"])

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(5)]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            heads = np.flatnonzero(new)
            for h, end in zip(heads.tolist(), [*heads[1:].tolist(), batch.num_rows], strict=True):
                now, role = tuple(int(c[h]) for c in cols[:4]), int(cols[4][h])
                if now != key:
                    if waiting and data:
                        yield results()
                    key, data, block = now, [], None
                    waiting.clear()
                for i in range(h, end, QUERIES):
                    part = batch.slice(i, min(end, i + QUERIES) - i)
                    x = np.frombuffer(b"".join(part.column(8).to_pylist()), np.int32).reshape(part.num_rows, -1)
                    piece = part.column(6).to_numpy(), part.column(7).to_numpy(), x, part.column(9).to_numpy(zero_copy_only=False)
                    (waiting if role else data).append(piece)
                    if role and data and sum(len(w[0]) for w in waiting) >= QUERIES:
                        yield results()
        if waiting and data:
            yield results()

    return groups.mapInArrow(run, "query_id long, own long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, scale: int = SCALE, block_bytes: int = BLOCK_BYTES, cells: int = CELLS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``query_step`` its k highest scores among
    all other rows; ties go to the smaller vec_id.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids, nor vectors of a length
    of 2**31 and more in whole numbers (their scores may be more than a long holds). Vectors meet only those of their own
    number of components. Every row stands for itself: rows that repeat an id, with its vector or another one, are
    candidates for each other, and each of them that is a query has ranks of its own. Fewer than k candidates give fewer rows,
    an empty table none. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    use = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & fine)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)) * scale + F.sqrt(F.size("embedding"))
    use = use.where(length < LONGEST).withColumn("dim", F.size("embedding"))
    held = use.agg(F.sum(F.col("dim").cast("long") * 4)).first()[0] or 0
    block_bytes = min(block_bytes, max(1 << 18, held // (2 * spark.sparkContext.defaultParallelism)))
    wanted = min(cells, max(1, held // block_bytes))
    sample = use.orderBy(F.xxhash64("embedding"), "vec_id").limit(wanted).collect()  # bounded by ``cells``
    pivots: dict[int, list] = {}
    for r in sample:
        pivots.setdefault(r["dim"], []).append(r["embedding"])
    points = {dim: np.floor(np.unique(np.array(v), axis=0) * scale) for dim, v in pivots.items()}
    # numbered and written once, so that a row's own number stays
    rows = written(_assigned(use, points, scale).withColumn("own", F.monotonically_increasing_id()), "vectors")
    is_query = F.col("vec_id") % query_step == 0
    # a row for each cell
    known = rows.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.count(F.when(is_query, 1)).alias("q"), F.max(F.when(is_query, F.col("far"))).alias("q_far")).collect()
    by_dim: dict[int, list] = {}
    for r in known:
        by_dim.setdefault(r["dim"], []).append(r)
    subs = {(r["dim"], r["cell"]): -(-r["n"] * r["dim"] * 4 // block_bytes) for r in known}
    queries = rows.where(is_query)

    def step(pairs: list[tuple[int, int, int]], floors: DataFrame | None) -> DataFrame | None:
        if not pairs:
            return None
        load: dict[tuple[int, int], int] = {}
        size = {(r["dim"], r["cell"]): r["q"] for r in known}
        for dim, qcell, cell in pairs:
            load[dim, cell] = load.get((dim, cell), 0) + size[dim, qcell]
        parts = {c: -(-n // QUERY_PART) for c, n in load.items()}
        # at most a row for each pair of cells, and for each cell
        plan = spark.createDataFrame([(d, a, b, subs[d, b], parts[d, b]) for d, a, b in pairs], "dim int, cell int, to int, subs int, parts int")
        into = spark.createDataFrame([(*c, subs[c], p) for c, p in parts.items()], "dim int, cell int, subs int, parts int")
        data = rows.join(F.broadcast(into), ["dim", "cell"])
        data = data.select("dim", "cell", F.pmod(F.xxhash64("own"), "subs").cast("int").alias("sub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.lit(0).alias("qcell"), "own", "vec_id", "x", F.lit(0.0).alias("floor"))
        q = queries.withColumn("floor", F.lit(float("-inf"))) if floors is None else queries.join(floors, "own", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        q = q.join(F.broadcast(plan), ["dim", "cell"])
        q = q.select("dim", F.col("to").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.pmod(F.xxhash64("own"), "parts").cast("int").alias("part"), F.lit(1).alias("role"), F.col("cell").alias("qcell"), "own", "vec_id", "x", "floor")
        number = min(10_000, 2 * sum(subs[c] * p for c, p in parts.items()))
        groups = data.unionByName(q).repartition(number, "dim", "cell", "sub", "part").sortWithinPartitions("dim", "cell", "sub", "part", "role", "qcell")
        return _search(groups, k)

    first, home = [], set()
    for dim, cs in by_dim.items():
        p = points.get(dim, np.zeros((1, dim)))
        for c in cs:
            if c["q"]:  # the cells around the query's own, until they hold candidates enough
                here, order = 0, sorted(cs, key=lambda o: (o["cell"] != c["cell"], -float(p[o["cell"]] @ p[c["cell"]])))
                for o in order:
                    if here > 4 * k:
                        break
                    here += o["n"]
                    first.append((dim, c["cell"], o["cell"]))
    home.update(first)
    near = step(first, None)
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if near is None:
        return none
    near = written(near, "near")
    by_score = Window.partitionBy("own").orderBy(F.desc("score"), F.asc("vec_id"))
    kth = written(near.withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") == k).select("own", F.col("score").cast("double").alias("floor")), "floors")
    worst = {(r["dim"], r["cell"]): r["w"] for r in queries.join(kth, "own", "left").groupBy("dim", "cell").agg(F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("w")).collect()}
    later = []
    for dim, cs in by_dim.items():
        p = points.get(dim, np.zeros((1, dim)))
        length_of = np.sqrt((p**2).sum(axis=1))
        for c in cs:
            if c["q"]:
                for o in cs:
                    a, b = c["cell"], o["cell"]
                    most = float(p[a] @ p[b]) + length_of[a] * o["far"] + c["q_far"] * (length_of[b] + o["far"])
                    if (dim, a, b) not in home and most * (1 + 1e-9) + 1e-3 >= worst[dim, a]:
                        later.append((dim, a, b))
    far = step(later, kth)
    found = near if far is None else near.unionByName(far)
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
