"""Quality: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks of CHUNK bytes that cover it whole. Learned filters over WIDTH bytes
slide over each chunk and are max-pooled within it; over the document the chunks' features are pooled once more, by maximum
and by mean, and with the length combined by a hidden layer into one probability. Scoring is linear in the text, and its
memory is bounded by a slice of chunks, whatever a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buffers import text_bytes
from .common import fold, labelled_sample

CHUNK, OVERLAP, WIDTH, STRIDE = 256, 16, 8, 2
EMBED, FILTERS, HIDDEN = 8, 24, 24
FOLDS, HELD = 3, 1
#: The network is fitted on at most this many labelled documents of each class.
PER_CLASS = 600
#: Chunks in memory at once.
SLICE = 1024
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1


def chunks_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each chunk, its first byte, its text's end); a text without bytes has one chunk of padding."""
    lengths = np.diff(offsets)
    step = CHUNK - OVERLAP
    counts = np.maximum(1, -(-(lengths - OVERLAP) // step))
    text = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, offsets[text] + nth * step, offsets[text + 1]


def chunk_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(chunks x CHUNK) bytes as numbers, 256 where a chunk goes beyond its text."""
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    if not len(data):
        return np.full(at.shape, 256, np.int16)
    return np.where(inside, data[np.minimum(at, len(data) - 1)].astype(np.int16), np.int16(256))


class Network:
    """``embed`` (257 x EMBED), ``filters`` (WIDTH * EMBED x FILTERS) and two dense layers."""

    def __init__(self, rng: np.random.Generator):
        f = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
        self.p = {
            "embed": f(257, EMBED, scale=0.5),
            "filters": f(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5),
            "fb": np.zeros(FILTERS, np.float32),
            "dense": f(2 * FILTERS + 1, HIDDEN, scale=(2 * FILTERS) ** -0.5),
            "db": np.zeros(HIDDEN, np.float32),
            "out": f(HIDDEN, scale=HIDDEN**-0.5),
            "ob": np.zeros(1, np.float32),
        }

    def _windows(self, codes: np.ndarray) -> np.ndarray:
        """(chunks, POSITIONS, WIDTH * EMBED)"""
        e = self.p["embed"][codes].reshape(len(codes), CHUNK * EMBED)
        s0, s1 = e.strides
        return np.lib.stride_tricks.as_strided(e, (len(codes), POSITIONS, WIDTH * EMBED), (s0, s1 * EMBED * STRIDE, s1))

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(max-pooled features of each chunk, position of each maximum, windows)"""
        w = self._windows(codes)
        h = w.reshape(-1, WIDTH * EMBED) @ self.p["filters"]
        h = h.reshape(len(codes), POSITIONS, FILTERS)
        return np.maximum(h.max(axis=1) + self.p["fb"], 0), h, w

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A probability for each text, empty ones too."""
        n = len(offsets) - 1
        text, starts, ends = chunks_of(offsets)
        top, total = np.zeros((n, FILTERS), np.float32), np.zeros((n, FILTERS), np.float64)
        for i in range(0, len(text), SLICE):
            s = slice(i, i + SLICE)
            f, _, _ = self.pooled(chunk_bytes(data, starts[s], ends[s]))
            heads = np.flatnonzero(np.diff(text[s], prepend=-1))
            at = text[s][heads]
            top[at] = np.maximum(top[at], np.maximum.reduceat(f, heads))
            total[at] += np.add.reduceat(f.astype(np.float64), heads)
        return self._combined(top, (total / np.bincount(text, minlength=n)[:, None]).astype(np.float32), np.diff(offsets))[0].astype(float)

    def _combined(self, top: np.ndarray, mean: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.concatenate([top, mean, (np.log1p(lengths) / 4 - 1.5)[:, None].astype(np.float32)], axis=1)
        hidden = np.maximum(x @ self.p["dense"] + self.p["db"], 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.p["out"] + self.p["ob"], -30, 30))), hidden, x

    def gradients(self, data: np.ndarray, offsets: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        n = len(y)
        text, starts, ends = chunks_of(offsets)
        codes = chunk_bytes(data, starts, ends)
        f, h, w = self.pooled(codes)
        heads = np.flatnonzero(np.diff(text, prepend=-1))
        counts = np.bincount(text, minlength=n)
        top = np.maximum.reduceat(f, heads)
        p, hidden, x = self._combined(top, np.add.reduceat(f, heads) / counts[:, None].astype(np.float32), np.diff(offsets))
        g: dict[str, np.ndarray] = {}
        d = ((p - y) * weight / n).astype(np.float32)
        g["out"], g["ob"] = hidden.T @ d, d.sum(keepdims=True)
        dh = np.outer(d, self.p["out"]) * (hidden > 0)
        g["dense"], g["db"] = x.T @ dh, dh.sum(axis=0)
        dx = dh @ self.p["dense"].T
        df = dx[text, FILTERS : 2 * FILTERS] / counts[text][:, None] + dx[text, :FILTERS] * (f == top[text])
        df = (df * (f > 0)).astype(np.float32)
        best = h.argmax(axis=1)  # (chunks, FILTERS)
        picked = w[np.arange(len(codes))[:, None], best]  # (chunks, FILTERS, WIDTH * EMBED)
        g["filters"] = np.einsum("cfk,cf->kf", picked, df, optimize=True)
        g["fb"] = df.sum(axis=0)
        dw = df[:, :, None] * self.p["filters"].T[None]
        at = codes[np.arange(len(codes))[:, None, None], (best * STRIDE)[:, :, None] + np.arange(WIDTH)]
        ge = np.zeros_like(self.p["embed"])
        np.add.at(ge, at.ravel(), dw.reshape(-1, EMBED))
        g["embed"] = ge
        return g


def train(sample: list[tuple[str, int]], epochs: int = 14, batch: int = 16, rate: float = 4e-3, seed: int = 3) -> Network:
    """Adam over the whole texts of ``sample``, classes weighted as in the sample; an empty sample leaves every score near
    one half, a sample of one class leads to that class."""
    rng = np.random.default_rng(seed)
    net = Network(rng)
    blobs, y = [t.encode() for t, _ in sample], np.array([v for _, v in sample], np.float32)
    m, v = ({n: np.zeros_like(a) for n, a in net.p.items()} for _ in range(2))
    k = 0
    steps = epochs * -(-len(blobs) // batch)
    for _ in range(epochs if blobs else 0):
        order = rng.permutation(len(blobs))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            text = [blobs[j] for j in part]
            g = net.gradients(np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)]), y[part], np.ones(len(part)))
            k += 1
            now = rate * min(1, k / 40) * max(0.02, 1 - k / steps)
            for n in net.p:
                m[n] += 0.1 * (g[n] - m[n])
                v[n] += 0.01 * (g[n] ** 2 - v[n])
                net.p[n] -= (now * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.99**k)) + 1e-7)).astype(np.float32)
    return net


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network:
    """The network from the labelled rows outside the held-out fold, ``per_class`` of each label at most."""
    return train(labelled_sample(docs, labels, "quality", FOLDS, HELD, per_class))


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1), predicted.

    Null texts score as empty ones, which are one chunk of padding; long texts are read whole. A null id is in no fold but the
    one of remainder 0, so not held out, and gives no label. Repeated rows are scored each by itself and get equal scores;
    columns beside doc_id and text are not looked at. No documents give no rows; without labels every score is near one half.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, per_class))  # some 5,000 floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(*text_bytes(batch.column(1))))], names=["doc_id", "score"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
