"""N-gram Jaccard join by chosen paths.

Documents are sets of hashed word n-grams. Copies (equal sets) are one class, and classes are what is compared. A path is a
list of sampled tokens: under each of POOL hash functions the token that is least is a sample of the set, and two sets share
it with the probability of their similarity. Each run splits the classes on a path of STEP tokens. A bucket of at most BLOCK
classes is compared by brute force on sketches. A larger one is first held against pivots, some 256 of its own classes: all
that are near to more than half of them are connected (any two have a near pivot in common), and if at most BLOCK others are
left these are compared with the whole bucket, and it is done. If more are left, the bucket is split again: every class goes
on by several branches, each with STEP more tokens chosen by the path, and the same holds for the buckets these lead to, at
any depth. There are so many branches that a pair at the threshold stays together with a known probability however deep the
recursion goes, and so many runs that it meets in one of them at least with the wanted probability.

Candidates form components; within a component each pair of classes is checked exactly on the whole n-gram sets, block by
block, without writing pairs down: what leaves a block is each class's number of links and a spanning set of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from ..storage import forget, written
from .buffers import BLANK, pieces, text_bytes
from .common import free_names

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Tokens by which a path grows, hash functions at least, and those that make up a sketch.
STEP, POOL, SKETCH = 4, 128, 128
#: Classes of a bucket or component that are compared in one go; pivots and rows of a part of a larger bucket.
BLOCK, PIVOTS, PART = 512, 256, 2048
#: The probability, at least, that a pair at the threshold stays together from a split on, at any depth.
KEPT = 0.9
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1


def branches_for(threshold: float, kept: float = KEPT) -> tuple[int, float]:
    """(branches of a split, probability that a pair at the threshold meets below it, at any depth). The probability is the
    fixed point of q = 1 - (1 - s q) ** branches, s being that of sharing STEP tokens."""
    s = threshold**STEP
    for branches in range(math.ceil(1 / s), 10_000):
        q = 1.0
        for _ in range(1000):
            q = 1 - (1 - s * q) ** branches
        if q >= kept:
            return branches, q
    raise ValueError("the threshold is too low to split by")


def runs_for(threshold: float, recall: float) -> int:
    """Runs until sets of this similarity meet in a bucket that is compared with this probability, split or not."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**STEP * branches_for(threshold)[1])))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def _word_bytes() -> np.ndarray:
    """Lower-cased word byte, 0 for the others: ASCII letters and digits, and every byte above ASCII."""
    t = np.zeros(256, np.uint8)
    for b in range(256):
        if b >= 128 or chr(b).isalnum():
            t[b] = ord(chr(b).lower()) if b < 128 else b
    return t


TABLE = _word_bytes()
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for p in (BASE, pow(BASE, -1, 1 << 64)):
            a = np.full(size, p, np.uint64)
            a[0] = 1
            both.append(np.cumprod(a))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its text's number) for texts side by side."""
    lo, hi = int(starts[0]), int(ends[-1])
    b = TABLE[data[lo:hi]]
    inside = np.zeros(hi - lo + 2, bool)
    inside[1:-1] = b != 0
    first = np.zeros(hi - lo + 1, bool)
    first[starts[starts < hi] - lo] = True
    begin = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    stop = np.flatnonzero(inside[1:-1] & (~inside[2:] | np.append(first[1:-1], True))) + 1
    power, inverse = _powers(hi - lo + 1)
    total = np.zeros(hi - lo + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: hi - lo] * (b != 0), out=total[1:])
    return _mix((total[stop] - total[begin]) * inverse[begin]), np.searchsorted(starts, begin + lo, side="right") - 1


def documents(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, word hashes, words of each text) for runs of whole texts."""
    held: list[np.ndarray] = []
    for docs, starts, ends in pieces(data, offsets, after=(BLANK, TABLE == 0)):
        h, text = word_hashes(data, starts, ends)
        if len(docs) == 1 and int(ends[-1]) < int(offsets[docs[0] + 1]):
            held.append(h)
            continue
        if held:
            h, text, held = np.concatenate([*held, h]), np.zeros(sum(map(len, held)) + len(h), np.int64), []
        yield docs, h, np.bincount(text, minlength=len(docs))


def shingles(h: np.ndarray, counts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams, text of each), distinct within a text and sorted; a text of fewer words is one n-gram."""
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(counts, counts) - place
    total = np.zeros(len(h), np.uint64)
    for k in range(words):
        n = max(0, len(h) - k)
        term = _mix(h[k:] + np.uint64(k + 1))
        total[:n] += np.where(left[:n] > k, term * np.uint64(2 * k + 1), np.uint64(0))
    heads = (left >= words) | (place == 0)
    x, text = _mix(total[heads]), text[heads]
    order = np.lexsort((x, text))
    x, text = x[order], text[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (text[1:] != text[:-1])
    return x[new], text[new]


def signatures(batch_text: pa.Array, runs: int, words: int) -> dict[str, np.ndarray]:
    """For each text: n (its n-grams), d1 and d2 (digests of the set), the pool of sampled tokens and the runs' first paths."""
    data, offsets = text_bytes(batch_text)
    n = len(offsets) - 1
    rng = np.random.default_rng(11)
    k = max(POOL, runs * STEP)
    mult, add = (rng.integers(0, 1 << 32, size=k, dtype=np.uint32) | np.uint32(1) for _ in range(2))
    out = {"n": np.zeros(n, np.int64), "d1": np.zeros(n, np.uint64), "d2": np.zeros(n, np.uint64)}
    least = np.zeros((k, n), np.uint32)
    for docs, h, counts in documents(data, offsets):
        x, text = shingles(h, counts, words)
        if not len(x):
            continue
        heads = np.flatnonzero(np.diff(text, prepend=-1))
        at = docs[text[heads]]
        out["n"][at] = np.diff(heads, append=len(x))
        out["d1"][at] = np.add.reduceat(_mix(x + MIX2), heads)
        out["d2"][at] = np.add.reduceat(_mix(x ^ MIX1), heads)
        low = (x ^ (x >> np.uint64(32))).astype(np.uint32)
        for j in range(k):
            least[j, at] = np.minimum.reduceat(low * mult[j] + add[j], heads)
    paths = np.zeros((n, runs), np.uint64)
    for r in range(runs):
        for j in range(r * STEP, (r + 1) * STEP):
            paths[:, r] = _mix(paths[:, r] + least[j].astype(np.uint64) + np.uint64(j + 1))
    out["paths"] = paths.view(np.int64)
    out["pool"] = np.ascontiguousarray(least.T)
    return out


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(values).ravel()))


def _rows_as_binary(values: np.ndarray) -> pa.Array:
    width = values.shape[1] * values.itemsize
    at = pa.py_buffer((np.arange(len(values) + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(values), [None, at, pa.py_buffer(np.ascontiguousarray(values))])


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _signed(docs: DataFrame, runs: int, words: int) -> DataFrame:
    """(doc_id, th, n, d1, d2, paths, pool, sketch); th is a hash of the text, which tells apart rows that share an id."""
    source = docs.select("doc_id", "th", "text")
    names = ["doc_id", "th", "n", "d1", "d2", "paths", "pool", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                s = signatures(part.column(2), runs, words)
                sketch = (s["pool"][:, :SKETCH] >> np.uint32(9)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s["n"]), pa.array(s["d1"].view(np.int64)), pa.array(s["d2"].view(np.int64)), _lists(s["paths"]), _rows_as_binary(s["pool"]), _rows_as_binary(sketch)], names=names)

    long = T.LongType()
    kinds = [source.schema["doc_id"].dataType, long, long, long, long, T.ArrayType(long), T.BinaryType(), T.BinaryType()]
    return source.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of complete groups from sorted batches: (rows, where each group begins)."""
    held: pa.Table | None = None

    def cut(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in range(keys):
            v = t.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        heads = cut(t) if t.num_rows else np.zeros(0, np.int64)
        if len(heads) > 1:
            yield t.slice(0, int(heads[-1])), heads[:-1]
            held = t.slice(int(heads[-1]))
        else:
            held = t
    if held is not None and held.num_rows:
        yield held, cut(held)


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a forest over 0..n-1 with the same components as edges (a, b)."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def _alike(sketch: np.ndarray, mine: np.ndarray, theirs: np.ndarray, same: bool, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose sketches agree in ``least`` places, a few rows at a time."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # a block may be empty
    step = max(1, (1 << 22) // max(1, len(theirs) * sketch.shape[1]))
    for i in range(0, len(mine), step):
        part = mine[i : i + step]
        agree = (sketch[part][:, None, :] == sketch[theirs][None]).sum(axis=2) >= least
        x, y = np.nonzero(agree)
        x, y = part[x], theirs[y]
        if same:
            keep = x < y
            x, y = x[keep], y[keep]
        left.append(x)
        right.append(y)
    return np.concatenate(left), np.concatenate(right)


def _in_small(buckets: DataFrame, least: int) -> DataFrame:
    """Spanning candidate links (a, b) within buckets (path, cls, sketch), each compared by brute force."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, heads in _groups(batches, 1):
            cls, sketch = t.column("cls").to_numpy(), _matrix(t.column("sketch"), np.uint8)
            sizes = np.diff(heads, append=len(cls))
            a, b = [], []
            two = heads[sizes == 2]
            if len(two):  # most buckets
                ok = two[(sketch[two] == sketch[two + 1]).sum(axis=1) >= least]
                a.append(cls[ok])
                b.append(cls[ok + 1])
            for h, n in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                rows = np.arange(n)
                x, y = _alike(sketch[h : h + n], rows, rows, True, least)
                for i, j in _spanning(n, x, y):
                    a.append(cls[h + i : h + i + 1])
                    b.append(cls[h + j : h + j + 1])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return buckets.repartition("path").sortWithinPartitions("path").mapInArrow(run, "a long, b long")


def _bipartite(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of the graph between the rows and the columns of a matrix: a column's number for each row (-1 for a row
    without any) and for each column."""
    columns = np.arange(near.shape[1])
    while True:
        rows = np.where(near, columns, near.shape[1]).min(axis=1, initial=near.shape[1])
        new = np.minimum(columns, np.where(near, rows[:, None], near.shape[1]).min(axis=0, initial=near.shape[1]))
        if (new == columns).all():
            return np.where(rows < near.shape[1], rows, -1), columns
        columns = new


def _against(members: DataFrame, pivots: DataFrame, least: int) -> DataFrame:
    """Members of large buckets (path, size, cls, sketch) held against pivots of theirs (path, size, cls, sketch), PART members
    at a time: rows (null, a, b) of candidate links and (path, cls, null) for members that are near to half of the pivots or
    fewer."""
    parts = F.ceil(F.col("size") / F.lit(PART)).cast("int")
    rows = members.select("path", F.pmod(F.xxhash64("cls", "path"), parts).cast("int").alias("part"), F.lit(1).alias("role"), "cls", "sketch")
    rows = rows.unionByName(pivots.select("path", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("role"), "cls", "sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, heads in _groups(batches, 2):
            path, role, cls, sketch = t.column("path").to_numpy(), t.column("role").to_numpy(), t.column("cls").to_numpy(), _matrix(t.column("sketch"), np.uint8)
            for h, end in zip(heads.tolist(), [*heads[1:].tolist(), len(cls)], strict=True):
                cut = h + int((role[h:end] == 0).sum())
                near = np.zeros((end - cut, cut - h), bool)
                for i in range(0, end - cut, 64):
                    near[i : i + 64] = (sketch[cut + i : min(end, cut + i + 64)][:, None, :] == sketch[h:cut][None]).sum(axis=2) >= least
                mine, theirs = _bipartite(near)
                tied = np.flatnonzero(mine >= 0)
                a, b = np.concatenate([cls[cut + tied], cls[h:cut]]), np.concatenate([cls[h + mine[tied]], cls[h + theirs]])
                a, b = a[a != b], b[a != b]
                far = cls[cut:end][near.sum(axis=1) * 2 <= cut - h]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None] * len(a) + [int(path[h])] * len(far), pa.int64()), pa.array(np.concatenate([a, far])), pa.array([*b.tolist(), *[None] * len(far)], pa.int64())], names=["path", "a", "b"]
                )

    rows = rows.repartition("path", "part").sortWithinPartitions("path", "part", "role")
    return rows.mapInArrow(run, "path long, a long, b long")


def _split(members: DataFrame, branches: int) -> DataFrame:
    """(path, cls) one level deeper: each member (path, cls, pool) goes on by ``branches`` paths, STEP sampled tokens longer;
    which ones is chosen by the path it comes from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path, pool = batch.column(0).to_numpy().view(np.uint64), _matrix(batch.column(2), np.uint32).astype(np.uint64)
            out, rows = [], np.arange(len(path))
            for j in range(branches):
                new = _mix(path + np.uint64(j + 1) * MIX2)
                for i in range(STEP):
                    at = _mix(path ^ _mix(np.array([j * STEP + i + 1], np.uint64))) % np.uint64(pool.shape[1])
                    new = _mix(new + pool[rows, at.astype(np.int64)] + np.uint64(i + 1))
                out.append(new.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.tile(batch.column(1).to_numpy(), branches))], names=["path", "cls"])

    return members.select("path", "cls", "pool").mapInArrow(run, "path long, cls long")


def _candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """Candidate links (a, b) that hold every pair at the threshold in one component, but for the recall."""
    # sketches within four standard errors of the threshold count as candidates
    least = math.floor(SKETCH * (threshold - 4 * math.sqrt(threshold * (1 - threshold) / SKETCH)))
    branches, _ = branches_for(threshold)
    sketches, pools = classes.select("cls", "sketch"), classes.select("cls", "pool")
    paths, links, small, done = classes.select("cls", F.explode("paths").alias("path")), [], [], []
    while True:
        sizes = written(paths.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        met = written(paths.join(sizes, "path"), "met")
        forget(sizes, *done)
        done = [met]
        small.append(met.where(F.col("size") <= BLOCK).select("path", "cls"))
        large = met.where(F.col("size") > BLOCK)
        if not large.limit(1).count():
            break
        members = written(large.join(sketches, "cls"), "members")
        pivots = members.where(F.pmod(F.xxhash64("path", "cls"), F.col("size")) < PIVOTS)
        held = written(_against(members, pivots, least), "held")
        links.append(held.where("b is not null").select("a", "b"))
        others = held.where("b is null").select("path", F.col("a").alias("cls"))
        left = written(others.groupBy("path").agg(F.count("*").alias("left")), "left")
        few, many = left.where(F.col("left") <= BLOCK).select("path"), left.where(F.col("left") > BLOCK).select("path")
        rest = members.join(few, "path", "left_semi")
        links.append(_against(rest, rest.join(others, ["path", "cls"], "left_semi"), least).where("b is not null").select("a", "b"))
        paths = _split(large.join(many, "path", "left_semi").join(pools, "cls"), branches)
        small[-1] = written(small[-1], "small")
        links[-1] = written(links[-1], "links")
        done += [members, left]
    buckets = small[0]
    for part in small[1:]:
        buckets = buckets.unionByName(part)
    out = _in_small(buckets.join(sketches, "cls").select("path", "cls", "sketch"), least)
    for part in links:
        out = out.unionByName(part)
    return out


def _in_blocks(df: DataFrame, size: str, key: str) -> DataFrame:
    """Adds b1, b2 and mine: a row goes to every pair of blocks that holds its own; a group within one block has one pair."""
    parts = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64(F.col(key), F.lit(3)), parts).cast("int")
    df = df.withColumn("_parts", parts).withColumn("mine", own)
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return df.withColumn("b1", F.least("mine", "_other")).withColumn("b2", F.greatest("mine", "_other")).drop("_parts", "_other")


def _linked(texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """Exact links within pairs of blocks (comp, b1, b2, mine, cls, copies, text), sorted: rows (a, null, weight) with each
    class's documents linked to it there, and (a, b, null) of a spanning set."""
    bar = round(threshold * 10_000)

    def sets(column: pa.Array) -> list[np.ndarray]:
        data, offsets = text_bytes(column)
        out = [np.zeros(0, np.uint64)] * (len(offsets) - 1)
        for docs, h, counts in documents(data, offsets):
            x, text = shingles(h, counts, words)
            heads = np.flatnonzero(np.diff(text, prepend=-1))
            for d, part in zip(docs[text[heads]].tolist(), np.split(x, heads[1:]), strict=False):
                out[d] = part
        return out

    def common(s: list[np.ndarray], t: list[np.ndarray]) -> np.ndarray:
        """Sizes of the intersections of all of s with all of t."""
        if len(s) * len(t) <= 16:
            return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in t] for x in s]).reshape(len(s), len(t))
        values, inverse = np.unique(np.concatenate([*s, *t]), return_inverse=True)
        row = np.repeat(np.arange(len(s) + len(t)), [len(x) for x in [*s, *t]])
        shared = np.bincount(inverse, minlength=len(values)) > 1
        number = np.cumsum(shared) - 1
        keep = shared[inverse]
        row, col = row[keep], number[inverse[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        total, width = np.zeros((len(s), len(t)), np.float32), 4096
        for c in range(0, int(shared.sum()), width):
            i, j = np.searchsorted(col, [c, c + width])
            m = np.zeros((len(s) + len(t), width), np.float32)
            m[row[i:j], col[i:j] - c] = 1
            total += m[: len(s)] @ m[len(s) :].T
        return total.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, heads in _groups(batches, 3):
            cls, copies, mine = (t.column(c).to_numpy() for c in ("cls", "copies", "mine"))
            b1, b2, texts = t.column("b1").to_numpy(), t.column("b2").to_numpy(), t.column("text").combine_chunks()
            a, b, w = [], [], []
            for h, n in zip(heads.tolist(), np.diff(heads, append=len(cls)).tolist(), strict=True):
                s = sets(texts.slice(h, n))
                size = np.array([len(x) for x in s])
                rows = np.arange(n)
                one = b1[h] == b2[h]
                left, right = (rows, rows) if one else (rows[mine[h : h + n] == b1[h]], rows[mine[h : h + n] == b2[h]])
                if not len(left) or not len(right):
                    continue
                inter = common([s[i] for i in left], [s[i] for i in right])
                union = size[left][:, None] + size[right][None] - inter
                ok = (inter * 10_000 >= bar * union) & (inter > 0)
                if one:
                    np.fill_diagonal(ok, False)
                number = copies[h : h + n]
                gain = np.zeros(n, np.int64)
                gain[left] += ok @ number[right]
                if not one:
                    gain[right] += number[left] @ ok
                linked = np.flatnonzero(gain)
                x, y = np.nonzero(ok)
                span = _spanning(n, left[x], right[y])
                a += [*cls[h + linked].tolist(), *(int(cls[h + i]) for i, _ in span)]
                b += [*[None] * len(linked), *(int(cls[h + j]) for _, j in span)]
                w += [*gain[linked].tolist(), *[None] * len(span)]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.int64())], names=["a", "b", "w"])

    return texts.mapInArrow(run, "a long, b long, w long")


def _joined(docs: DataFrame, words: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(rows (doc_id, th, n, d1, d2) of all documents, classes (d1, d2, n, rep, rep_th, copies, first, first_th, links)): rep is
    the least id of the class and first that of its component, each with its text's hash; both are written tables."""
    runs = runs_for(threshold, recall)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    signed = written(_signed(rows, runs, words), "signatures")
    worded = signed.where("doc_id is not null and n > 0")
    least = F.min(F.struct("doc_id", "th"))
    classes = worded.groupBy("d1", "d2", "n").agg(least.alias("_of"), F.count("*").alias("copies"), F.first("paths").alias("paths"), F.first("pool").alias("pool"), F.first("sketch").alias("sketch"))
    # numbered once and written, so the numbers stay
    classes = written(classes.select(F.monotonically_increasing_id().alias("cls"), "d1", "d2", "n", F.col("_of.doc_id").alias("rep"), F.col("_of.th").alias("rep_th"), "copies", "paths", "pool", "sketch"), "classes")
    groups = components(_candidates(classes, threshold), "candidates")
    sizes = written(groups.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    members = groups.join(sizes, "component").select(F.col("component").alias("comp"), F.col("node").alias("cls"), "size")
    members = written(members.join(classes.select("cls", "rep", "rep_th", "copies"), "cls"), "members")
    # one way at every size: members grow with the input
    texts = rows.select("doc_id", "th", "text").join(members.hint("merge"), (rows["doc_id"] == members["rep"]) & (rows["th"] == members["rep_th"]))
    # one text for each class, however often its row is repeated
    texts = texts.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("comp", "size", "copies", "text")])
    texts = _in_blocks(texts, "size", "cls").select("comp", "b1", "b2", "mine", "cls", "copies", "text")
    texts = texts.repartition("comp", "b1", "b2").sortWithinPartitions("comp", "b1", "b2")
    links = written(_linked(texts, words, threshold), "links")
    linked = links.where("w is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("w").alias("w"))
    found = components(links.where("b is not null").select("a", "b"), "linked").select(F.col("node").alias("cls"), "component")
    grouped = written(found.join(classes.select("cls", F.struct("rep", "rep_th").alias("_of")), "cls"), "grouped")
    first = written(grouped.groupBy("component").agg(F.min("_of").alias("_first")), "first")
    info = classes.select("cls", "d1", "d2", "n", "rep", "rep_th", "copies").join(linked, "cls", "left").join(grouped.join(first, "component").select("cls", "_first"), "cls", "left")
    first_of = lambda c: F.coalesce(F.col(f"_first.{c}"), F.col(c))
    info = info.select("d1", "d2", "n", "rep", "rep_th", "copies", first_of("rep").alias("first"), first_of("rep_th").alias("first_th"), (F.col("copies") - 1 + F.coalesce("w", F.lit(0))).alias("links"))
    info = written(info, "joined")
    forget(classes, sizes, members, links, grouped, first)
    return signed.select("doc_id", "th", "n", "d1", "d2"), info


def jaccard_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id, copy_id, n_links.

    ``class_id`` is the least id of all documents that links reach from this one, ``copy_id`` the least id with the same set
    of n-grams, ``n_links`` the number of other documents at the threshold or above, copies included. Words are runs of
    ASCII letters and digits (case aside) and characters beyond ASCII; a text of fewer words than an n-gram is one n-gram. A
    text without words, or null, links to nothing and is a class of its own. A null id is in no class (null) and has no
    links. Rows that repeat an id and its text are copies of each other; rows that share an id but not the text are
    documents of their own. Ids may be of any type that can be ordered. Other columns are not looked at; an empty table
    gives an empty one.
    """
    rows, info = _joined(docs, words, threshold, recall)
    out = rows.select("doc_id", "d1", "d2", "n").join(info, ["d1", "d2", "n"], "left")
    known = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        F.when(known, F.coalesce("first", "doc_id")).alias("class_id"),
        F.when(known, F.coalesce("rep", "doc_id")).alias("copy_id"),
        F.when(known, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each linked group: that of the least id, of one id that of the least text hash, of rows that
    are equal in both any one. Rows with a null id, or without words, stay, all of them."""
    rows, info = _joined(docs, words, threshold, recall)
    of = rows.join(info.where("copies > 1 or first <> rep or first_th <> rep_th"), ["d1", "d2", "n"])
    wins = (F.col("doc_id") == F.col("first")) & (F.col("th") == F.col("first_th"))
    id_, hash_, wins_, n_ = free_names(docs, "_id", "_hash", "_wins", "_n")
    of = of.where("doc_id is not null").groupBy(F.col("doc_id").alias(id_), F.col("th").alias(hash_)).agg(F.max(wins).alias(wins_), F.count("*").alias(n_))
    marked = written(of.where(~F.col(wins_) | (F.col(n_) > 1)), "marked")
    out = docs.join(marked.hint("merge"), (docs["doc_id"] == F.col(id_)) & (F.xxhash64(docs["text"].cast("string")) == F.col(hash_)), "left")
    once = out.where(F.col(id_).isNull()).select(*docs.columns)
    if not marked.where(F.col(wins_)).limit(1).count():
        return once
    repeated = out.where(F.col(wins_)).dropDuplicates([id_, hash_]).select(*docs.columns)
    return once.unionByName(repeated)
