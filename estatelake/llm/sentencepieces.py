"""SentencePiece encoding and decoding by a streaming lattice.

The lattice runs over a text's characters from left to right; an automaton names the pieces that end at each boundary. Of
the past it keeps a window bounded by the longest piece: for each boundary in it the best piece that ends there. Whenever
all surviving backpointer paths lead through one boundary, the ids up to it are committed and forgotten, so memory doesn't
grow with the text.

Two kinds of model share the lattice. In a unigram model the best piece is that of the highest summed score. In a BPE model
scores don't add up: the merges of a prefix end in exactly one piece, the piece that stays apart from its predecessor when
the two are merged by themselves; that test takes the place of the sum, and the ids are those of the merges. No search of
merges over the text is needed.

A seam that no piece of the vocabulary crosses (before a word mark, say) is a boundary where all paths converge whatever
stands around it. Texts are cut there first, the distinct stretches of a batch are found by Arrow's dictionary encoding, each
goes through the lattice once, and their ids are gathered back in order. A table of bounded size remembers stretches from one
batch to the next; a text without seams is one stretch, which the lattice commits as it goes.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buffers import text_bytes

MARK = "▁"
#: Fixed values of the model format: fields of its message and kinds of model.
TRAINER_SPEC, MODEL_TYPE, UNIGRAM, BPE = 2, 3, 1, 2
NORMALIZER_SPEC, CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 3, 2, 3, 4, 5
#: Stretches whose ids are remembered, and the longest of them in bytes; texts of a batch that are encoded at once.
REMEMBERED, STRETCH, PART = 400_000, 64, 4 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        n = shift = 0
        while True:
            b = data[i]
            i += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[i : i + n]
            i += n
        else:
            n = 8 if kind == 1 else 4
            yield key >> 3, data[i : i + n]
            i += n


class Codec:
    """Encodes and decodes with one model. Models that normalise characters or drop spaces are refused, for they don't
    round-trip."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        top = {n: v for n, v in _fields(model) if n in (TRAINER_SPEC, NORMALIZER_SPEC)}
        trainer, normal = (dict(_fields(top.get(n, b""))) for n in (TRAINER_SPEC, NORMALIZER_SPEC))
        self.bpe = trainer.get(MODEL_TYPE, UNIGRAM) == BPE
        if normal.get(CHARSMAP) or normal.get(REMOVE_EXTRA, 1) or not normal.get(ESCAPE, 1):
            raise ValueError("this model changes characters or spaces; its ids can't be turned back into the text")
        self.prefix = bool(normal.get(DUMMY_PREFIX, 1))
        self.pieces = [sp.id_to_piece(i) for i in range(len(sp))]
        self.unk = sp.unk_id()
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.silent = {i for i in range(len(sp)) if sp.is_control(i)}
        usable = [i for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in usable}
        self.score = {self.pieces[i]: sp.get_score(i) for i in usable}
        self.longest = max(map(len, self.ids), default=1)
        self.lowest = min(self.score.values(), default=0.0) - 10
        self.kinds = self._byte_kinds()
        self.memory: dict[bytes, bytes] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.split: dict[str, tuple[str, str] | None] = {}
        self.rank = {p: -v for p, v in self.score.items() if len(p) > 1}
        #: Finds the pieces of two characters and more, those that merges can make in a BPE model.
        self.whole = ahocorasick.Automaton()
        for p in self.rank:
            if not self.bpe or self._halves(p):
                self.whole.add_word(p, (p, len(p)))
        self.whole.make_automaton()
        #: The bytes that each id stands for.
        self.raw = pa.array([self._bytes_of(i) for i in range(len(self.pieces))], pa.large_binary())

    def _bytes_of(self, i: int) -> bytes:
        if i in self.byte_of:
            return self.byte_of[i]
        return b"" if i in self.silent else " ⁇ ".encode() if i == self.unk else self.pieces[i].replace(MARK, " ").encode()

    # encoding

    def _byte_kinds(self) -> np.ndarray | None:
        """For each byte 0, or 1: a space, which no piece holds but at its beginning; 2: a character that pieces never put
        after any but its own kind (full stops and commas, in most models); 3: a character that stands in no longer piece.
        Only ASCII characters count, as a byte is then a character. None if pieces go on across word marks."""
        longer = [p for p in self.ids if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in longer):
            return None
        ascii_ = {chr(i) for i in range(128)} - {" "}
        alone = (ascii_ if self.byte_id else ascii_ & set(self.ids)) - {c for p in longer for c in p}
        closing = {c for p in longer for c in p[1:] if not c.isalnum()} & ascii_
        before = [(a, b) for p in longer for a, b in zip(p, p[1:], strict=False) if a != MARK]
        while bad := {b for a, b in before if b in closing and a not in closing}:
            closing -= bad
        kinds = np.zeros(256, np.uint8)
        for kind, chars in ((2, closing), (3, alone), (1, {" "})):
            kinds[[ord(c) for c in chars]] = kind
        return kinds

    def _seams(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where stretches begin, and the end; texts never share one."""
        seam = np.zeros(len(data) + 1, bool)
        seam[offsets] = True
        if self.kinds is not None and len(data):
            kind = self.kinds[data]
            was, now = kind[:-1], kind[1:]
            seam[1:-1] |= (now == 3) | (was == 3) | ((now == 1) & (was != 1)) | ((now == 2) & ((was == 0) | (was == 3)))
        return np.flatnonzero(seam)

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """BPE merges over a short string, by definition: the best known pair first, the leftmost of equals. Also the last
        pair merged."""
        parts, pair = list(text), None
        while True:
            best = None
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best[0]):
                    best = (r, i)
            if best is None:
                return parts, pair
            i = best[1]
            pair = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The pair whose merge makes ``piece``; None if merges never make it whole."""
        if piece not in self.split:
            parts, pair = self._merge(piece)
            self.split[piece] = pair if len(parts) == 1 else None
        return self.split[piece]

    def _apart(self, a: str, b: str) -> bool:
        """Whether the merges of a + b end in just these two: going back through the merges on both sides of the seam, no
        pair across it may come before the merge that took its half away."""
        rank = self.rank
        ra, rb, limit = rank.get(a, -1.0), rank.get(b, -1.0), float("inf")
        while True:
            across = rank.get(a + b)
            if across is not None and across < limit:
                return False
            if ra > rb:
                limit = ra
                a = self._halves(a)[1]
                ra = rank.get(a, -1.0)
            elif len(b) == 1:
                return True
            else:
                limit = rb + 0.5  # of equal ranks the left pair goes first
                b = self._halves(b)[0]
                rb = rank.get(b, -1.0)

    def _joins(self, before: str, piece: str) -> bool:
        """Whether ``piece`` can follow ``before`` as the last piece of a prefix's merges."""
        key = (before, piece)
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > REMEMBERED:
                self.apart.clear()
            known = self.apart[key] = self._apart(before, piece)
        return known

    def stream(self, chars: str) -> Iterator[list[str]]:
        """The pieces of ``chars`` in committed runs. The window holds at most a few times the longest piece unless paths
        stay apart for longer; then as much as they need."""
        bpe, apart, score, lowest = self.bpe, self.apart, self.score, self.lowest
        # for each boundary from ``done`` on: the piece that ends there, where that begins, and the sum of scores up to it
        last, back, worth = [""], [0], [0.0]
        done, settled, check = 0, 0, 2 * self.longest
        for at, (piece, k) in self.whole.iter(chars):  # of pieces that end at one place the longest comes first
            end = at + 1 - done
            if end == settled:
                continue
            while len(last) <= end:  # a character by itself, till a longer piece takes its place
                here = len(last)
                if here > check:
                    common = self._converged(back)
                    if common:
                        yield self._path(last, back, common)
                        last, back, worth = last[common:], [0, *(b - common for b in back[common + 1 :])], worth[common:]
                        done, end, here, settled, check = done + common, end - common, here - common, settled - common, 2 * self.longest
                    else:
                        check *= 2
                c = chars[done + here - 1]
                last.append(c)
                back.append(here - 1)
                worth.append(0.0 if bpe else worth[here - 1] + score.get(c, lowest))
            start = end - k
            if bpe:
                ok = not last[start]  # nothing stands before the first piece
                if not ok:
                    key = (last[start], piece)
                    ok = apart.get(key)
                    if ok is None:
                        ok = self._joins(*key)
                if ok:
                    last[end], back[end], settled = piece, start, end
            elif (v := worth[start] + score[piece]) > worth[end]:
                last[end], back[end], worth[end] = piece, start, v
        if len(last) > 1:
            yield self._path(last, back, len(last) - 1)
        for i in range(done + len(last) - 1, len(chars), 4096):  # no longer piece ends in the rest
            yield list(chars[i : i + 4096])

    def _converged(self, back: list[int]) -> int:
        """The boundary through which the paths of all boundaries lead that a piece can still begin at; 0 if there is none."""
        tips = set(range(max(0, len(back) - 1 - self.longest), len(back)))
        while len(tips) > 1:
            tip = max(tips)
            tips.remove(tip)
            tips.add(back[tip])
        return tips.pop()

    @staticmethod
    def _path(last: list[str], back: list[int], end: int) -> list[str]:
        out = []
        while end:
            out.append(last[end])
            end = back[end]
        return out[::-1]

    def _ids(self, stretch: bytes) -> bytes:
        out: list[int] = []
        ids, unk = self.ids, self.unk
        for run in self.stream(stretch.decode("utf-8", "surrogateescape").replace(" ", MARK)):
            for p in run:
                known = ids.get(p)
                if known is not None:
                    out.append(known)
                elif self.byte_id:
                    out += [self.byte_id[b] for b in p.encode("utf-8", "surrogateescape")]
                elif not out or out[-1] != unk:
                    out.append(unk)
        return array("i", out).tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(int32 ids of all texts, where each text's begin, and the end); empty and null texts have none."""
        if pc.any(pc.match_substring(texts, MARK)).as_py():
            texts = pc.replace_substring(texts, MARK, " ")
        data, offsets = text_bytes(texts)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        if self.prefix:
            filled = np.diff(offsets) > 0
            data = np.insert(data, offsets[:-1][filled], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        cuts = self._seams(data, offsets)
        n = max(0, len(cuts) - 1)
        stretches = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(cuts.astype(np.int64) if n else np.zeros(1, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = stretches.dictionary_encode()
        memory, known = self.memory, []
        for w in coded.dictionary.to_pylist():
            got = memory.get(w)
            if got is None:
                got = self._ids(w)
                if len(w) <= STRETCH:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[w] = got
            known.append(got)
        which = coded.indices.to_numpy()
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin = np.cumsum(size) - size
        values, size, begin = np.frombuffer(b"".join(known), np.int32), size[which], begin[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = values[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)]
        return ids, ends[np.searchsorted(cuts, offsets)]

    def encode(self, text: str | None) -> np.ndarray:
        """int32 ids; none for an empty or null text."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    # decoding

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, where each text's begin, and the end) of ids side by side; the space that stands before a
        text is not part of it. Control ids are silent, an unknown id reads as U+2047 between spaces."""
        taken = self.raw.take(pa.array(ids))
        _, places, data = taken.buffers()
        places = np.frombuffer(places, np.int64)[taken.offset : taken.offset + len(taken) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = places[ends]
        if self.prefix:
            first = at[:-1][at[:-1] < at[1:]]
            first = first[data[first] == 32]
            data = np.delete(data, first)
            at = at - np.searchsorted(first, at)
        return data, at

    def decode(self, ids: list[int] | np.ndarray | None) -> str:
        """The text of ids; bytes that are no UTF-8 read as U+FFFD."""
        ids = np.asarray([] if ids is None else ids, np.int64)
        return self.decode_all(ids, np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace")


def _codec(model: bytes, held: dict = {}) -> Codec:  # noqa: B006  one for a worker's life
    if held.get("model") != model:
        held.update(model=model, codec=Codec(model))
    return held["codec"]


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about PART bytes of text each, one text at least."""
    _, offsets = text_bytes(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PART, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def encode_texts(docs: DataFrame, model_file: str) -> DataFrame:
    """Per document: doc_id, n_chars (long), n_tokens (long), ids (array of int), round_trip (boolean).

    ``round_trip`` says whether the ids decode to the text again; a text that itself holds U+2581 reads back with a space
    there, and so is false. Empty and null texts have no ids and are true. Repeated rows are encoded each by itself.
    ``model_file`` is read by the driver; its bytes (bounded by the vocabulary) are broadcast.
    """
    with open(model_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    names = ["doc_id", "n_chars", "n_tokens", "ids", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for part in _parts(batch, 1):
                texts = part.column(1)
                ids, ends = codec.encode_all(texts)
                (data, at), (back, to) = text_bytes(texts), codec.decode_all(ids, ends)
                same = [np.array_equal(data[a:b], back[c:d]) for a, b, c, d in zip(at[:-1].tolist(), at[1:].tolist(), to[:-1].tolist(), to[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), pc.fill_null(pc.utf8_length(texts).cast(pa.int64()), 0), pa.array(np.diff(ends)), lists, pa.array(same, pa.bool_())], names=names)

    kinds = [source.schema["doc_id"].dataType, T.LongType(), T.LongType(), T.ArrayType(T.IntegerType()), T.BooleanType()]
    return source.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def decode_ids(encoded: DataFrame, model_file: str) -> DataFrame:
    """Rows (doc_id, text) from rows (doc_id, ids); null ids give an empty text."""
    with open(model_file, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    source = encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                lists = part.column(1).fill_null([])
                rows = pa.array(lists.flatten()), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
                known = rows[0].is_valid().to_numpy(zero_copy_only=False)  # null ids are left out
                ends = np.concatenate([[0], np.cumsum(known)])[rows[1]]
                data, at = codec.decode_all(rows[0].drop_null().to_numpy().astype(np.int64), ends)
                texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("text", T.StringType())]))
