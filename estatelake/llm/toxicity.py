"""Toxicity: a support vector machine on a gapped-subsequence string kernel, with Nystrom landmarks, over sentences.

The kernel of two units counts their common subsequences of three letters, gaps allowed, each weighted by DECAY to the power
of the stretch it spans in either unit (SPAN letters at most), divided by a norm for either unit's length (that of a unit
whose subsequences are all distinct). A letter put into an insult leaves most of its subsequences in place, so the kernel
stays high. Units are a sentence's words and its pairs of neighbouring words, so that an insult or threat of two words, or a
word that is torn apart, counts as a whole. Punctuation inside a word is dropped, some digits read as letters, and letters
that stand alone in a row join to one word.

A machine over m landmarks is linear in the subsequences: once trained, its weights fold into one table with a value for
each subsequence, and a unit's decision is a sum of table entries. A sentence scores as its worst unit, a document by its
worst sentence and by how much of it lies above the margin, so scoring is linear in the text and of bounded memory.

The machine is trained on labelled sentences: each sentence inherits its document's label and is represented by its worst
unit as the machine sees it. Every sentence of a clean document is a negative example; of a toxic document, where most
sentences are harmless, the worst ones are the positive examples, re-chosen in each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buffers import BLANK, pieces, text_bytes
from .common import fold, labelled_sample

LETTERS, SPAN, DECAY, SPACE = 40, 7, 0.6, 255
FOLDS, HELD = 5, 0
#: The model is fitted on at most this many labelled documents of each class, whole texts.
PER_CLASS = 700
LANDMARKS = 160
#: A sentence ends at a line's end, or at white space after one of these.
ENDS = np.isin(np.arange(256), list(b".!?"))
NEWLINE = np.arange(256) == 10
#: Long texts are cut at a line's end, or else after white space.
AFTER = (NEWLINE, BLANK)


def _letter_table() -> np.ndarray:
    """For each byte its letter class 1..39, 0 (dropped) or SPACE. Second bytes of accented letters are letters, case aside."""
    t = np.zeros(256, np.uint8)
    t[:33] = SPACE
    for i in range(26):
        t[65 + i] = t[97 + i] = i + 1
    for digit, letter in zip("01345@", "oieasa", strict=True):
        t[ord(digit)] = ord(letter) - 96
    for b in range(0x80, 0xC0):
        t[b] = 27 + (b & 0x1F) % 13
    return t


TABLE = _letter_table()


class Words:
    """Words of texts side by side: ``letters`` with a mark (class 0) before each word, so that beginnings of words are
    subsequences of their own; of each word its first place, its text and its sentence, both numbered from 0."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        lo, hi = int(starts[0]), int(ends[-1])
        raw = data[lo:hi]
        codes = TABLE[raw]
        blank = codes == SPACE
        first = np.zeros(hi - lo + 1, bool)
        first[starts - lo] = True
        # a boundary before a letter: white space since the letter before, or another text
        boundary = np.cumsum(blank | first[:-1], dtype=np.int32)
        stop = first[:-1] | NEWLINE[raw]
        stop[1:] |= blank[1:] & ENDS[raw[:-1]]
        sentence = np.cumsum(stop, dtype=np.int32)
        keep = (codes != 0) & ~blank
        letters, part = codes[keep], boundary[keep]
        self.letters, self.heads, self.text, self.sentence = letters, *(np.zeros(0, np.int64) for _ in range(3))
        if not len(letters):
            return
        heads = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
        place = np.flatnonzero(keep)[heads]
        sentence = sentence[place]
        text = np.searchsorted(starts, place + lo, side="right") - 1
        lengths = np.diff(heads, append=len(letters))
        joined = np.zeros(len(heads), bool)
        joined[1:] = (lengths[1:] == 1) & (lengths[:-1] == 1) & (sentence[1:] == sentence[:-1])
        heads, text, sentence = heads[~joined], text[~joined], sentence[~joined]
        marked = np.zeros(len(letters) + len(heads), np.uint8)
        number = np.zeros(len(letters), np.int64)
        number[heads] = 1
        marked[np.arange(len(letters)) + np.cumsum(number)] = letters
        self.letters, self.heads, self.text = marked, heads + np.arange(len(heads)), text
        self.sentence = np.cumsum(np.diff(sentence, prepend=sentence[0]) != 0)

    def __len__(self) -> int:
        return len(self.heads)

    def pairs(self) -> np.ndarray:
        """For each word whether the next one stands in its sentence."""
        out = np.zeros(len(self), bool)
        out[:-1] = self.sentence[1:] == self.sentence[:-1]
        return out

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each unit: the words, then the pairs."""
        lengths = np.diff(self.heads, append=len(self.letters))
        power = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
        place = np.arange(len(self.letters)) - np.repeat(self.heads, lengths)
        word = np.add.reduceat((self.letters.astype(np.uint64) + np.uint64(1)) * power[place], self.heads)
        word ^= word >> np.uint64(31)
        return np.concatenate([word, word * np.uint64(0xBF58476D1CE4E5B9) + np.roll(word, -1)])

    def unit(self, i: int) -> bytes:
        """Unit i of ``unit_sums``: a word, or (from the number of words on) a pair."""
        n = len(self)
        first, words = (i, 1) if i < n else (i - n, 2)
        end = self.heads[first + words] if first + words < n else len(self.letters)
        return self.letters[self.heads[first] : end].tobytes()


def norms(most: int) -> np.ndarray:
    """The norm of a unit by its length, as if its subsequences were distinct."""
    n = np.arange(most + 1)
    total = np.zeros(most + 1)
    for b in range(2, SPAN):
        total += np.maximum(0, n - b) * (b - 1) * DECAY ** (2 * (b + 1))
    return np.sqrt(np.maximum(total, DECAY**6))


def unit_sums(letters: np.ndarray, heads: np.ndarray, table: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """For each word the weighted sum of ``table`` (one value or row a subsequence) over its subsequences, by its norm; then,
    if ``pairs`` says for each word whether it and the next one are a pair, the same for these pairs (0 for what is none)."""
    n, words = len(letters), len(heads)
    word = np.zeros(n, np.int32)
    word[heads[1:]] = 1
    word = np.cumsum(word, dtype=np.int32)
    wide = letters.astype(np.int32)
    shape = (n, *table.shape[1:])
    total, cross = np.zeros(shape, np.float32), np.zeros(shape if pairs is not None else 0, np.float32)
    for b in range(2, SPAN):
        if n <= b:
            break
        outer = wide[: n - b] * (LETTERS * LETTERS) + wide[b:]
        s = np.zeros((n - b, *table.shape[1:]), np.float32)
        for a in range(1, b):
            s += table[outer + LETTERS * wide[a : n - b + a]]
        s *= np.float32(DECAY ** (b + 1))
        apart = word[b:] - word[: n - b]
        if pairs is not None:
            over = apart == 1
            cross[: n - b][over] += s[over]
        s[apart != 0] = 0
        total[: n - b] += s
    lengths = np.diff(heads, append=n)
    norm = norms(2 * int(lengths.max())).astype(np.float32)
    tall = lambda x: x.reshape(-1, *[1] * (total.ndim - 1))
    raw = np.add.reduceat(total, heads, axis=0)
    alone = raw / tall(norm[lengths])
    if pairs is None:
        return alone
    both = raw + np.add.reduceat(cross, heads, axis=0)
    both[:-1] += raw[1:]
    size = lengths.copy()
    size[:-1] += lengths[1:]
    return np.concatenate([alone, both / tall(norm[size]) * tall(pairs.astype(np.float32))]) if words else alone


def landmark_table(landmarks: list[np.ndarray]) -> np.ndarray:
    """(subsequences x landmarks): the landmarks' own weights, so that summing it over a unit gives the kernel values."""
    table = np.zeros((LETTERS**3, len(landmarks)), np.float32)
    for j, w in enumerate(landmarks):
        w = w.astype(np.int64)
        norm = norms(len(w))[len(w)]
        for b in range(2, SPAN):
            for a in range(1, b):
                for i in range(len(w) - b):
                    table[(w[i] * LETTERS + w[i + a]) * LETTERS + w[i + b], j] += DECAY ** (b + 1) / norm
    return table


class Sentences:
    """The sentences of texts side by side, from a score of each word and of each pair: score, text and worst unit of each."""

    def __init__(self, words: Words, units: np.ndarray):
        n = len(words)
        alone, both = units[:n], np.where(words.pairs(), units[n:], -np.inf)
        best = np.maximum(alone, both)
        heads = np.flatnonzero(np.diff(words.sentence, prepend=-1))
        self.score, self.text = np.maximum.reduceat(best, heads), words.text[heads]
        at = np.flatnonzero(best == np.repeat(self.score, np.diff(heads, append=n)))
        at = at[np.flatnonzero(np.diff(words.sentence[at], prepend=-1))]  # of equals the first
        self.unit = np.where(alone[at] >= both[at], at, at + n)

    @staticmethod
    def scored(words: Words, table: np.ndarray, bias: float) -> Sentences:
        return Sentences(words, unit_sums(words.letters, words.heads, table, words.pairs()) + np.float32(bias))


class Model:
    """``table``: the folded machine; ``bias``: added to each unit; ``out``: weights of the document features."""

    def __init__(self, table: np.ndarray, bias: float, out: np.ndarray):
        self.table, self.bias, self.out = table, bias, out

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows (worst sentence, excess over the margin on a log scale, the same a sentence, 1); every byte of every text is
        read."""
        n = len(offsets) - 1
        worst, excess, count = np.full(n, -3.0), np.zeros(n), np.ones(n)
        for docs, starts, ends in pieces(data, offsets, after=AFTER):
            words = Words(data, starts, ends)
            if len(words):
                sentences = Sentences.scored(words, self.table, self.bias)
                score, at = np.maximum(sentences.score, -3), docs[sentences.text]
                np.maximum.at(worst, at, score)
                np.add.at(count, at, 1)
                over = score > 0
                np.add.at(excess, at[over], score[over])
        return np.stack([worst, np.log1p(excess), np.log1p(10 * excess / count), np.ones(n)], axis=1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(data, offsets) @ self.out, -40, 40)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 4.0, steps: int = 400) -> np.ndarray:
    """Squared-hinge linear machine by accelerated gradient steps; the last column of x is the bias."""
    w = v = np.zeros(x.shape[1], np.float32)
    share = (weight / weight.sum()).astype(np.float32)
    gram = (x * share[:, None]).T @ x
    rate = 1 / (1e-3 + 2 * c * float(np.linalg.norm(gram, 2)))
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = 1e-3 * v - 2 * c * ((share * y * slack) @ x)
        new = (v - rate * grad).astype(np.float32)
        v, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


class _Counted:
    """The distinct units of a sample: how many documents of each label hold them, and where each is found."""

    def __init__(self, sample: list[Words], docs: list[np.ndarray], labels: np.ndarray):
        hashes, doc, part, unit = [], [], [], []
        for k, (words, d) in enumerate(zip(sample, docs, strict=True)):
            n = len(words)
            keep = np.concatenate([np.ones(n, bool), words.pairs()])
            hashes.append(words.hashes()[keep])
            doc.append(np.tile(d[words.text], 2)[keep])
            unit.append(np.arange(2 * n)[keep])
            part.append(np.full(keep.sum(), k))
        self.sample, h, d = sample, np.concatenate(hashes), np.concatenate(doc)
        self.hash, first, number = np.unique(h, return_index=True, return_inverse=True)
        self.part, self.unit = np.concatenate(part)[first], np.concatenate(unit)[first]
        held = np.unique(np.stack([d, number]), axis=1)
        self.pos, self.neg = (np.bincount(held[1][labels[held[0]] == y], minlength=len(self.hash)).astype(float) for y in (1, 0))
        self.size, self.paired = np.zeros(len(self.hash), np.int64), np.zeros(len(self.hash), bool)
        for k, words in enumerate(sample):
            mine, lengths = self.part == k, np.diff(words.heads, append=len(words.letters))
            u = self.unit[mine]
            self.size[mine], self.paired[mine] = lengths[u % len(words)], u >= len(words)

    def of(self, words: Words) -> np.ndarray:
        """The number of each unit; those that are none (the last word of a sentence and the next) get any."""
        return np.minimum(np.searchsorted(self.hash, words.hashes()), len(self.hash) - 1)

    def text(self, i: int) -> bytes:
        return self.sample[self.part[i]].unit(int(self.unit[i]))


def train(sample: list[tuple[str, int]], landmarks: int = LANDMARKS, rounds: int = 4, seed: int = 5) -> Model:
    """Fits the machine on all sentences of ``sample``. Without both labels, or without words, the model says the one label it
    has seen, or 0 for an empty sample."""
    labels = np.array([y for _, y in sample], float)
    blob = [t.encode() for t, _ in sample]
    data, offsets = np.frombuffer(b"".join(blob), np.uint8), np.cumsum([0, *map(len, blob)])
    parts = [(d, w) for d, s, e in pieces(data, offsets, after=AFTER) if len(w := Words(data, s, e))]
    if len(set(labels.tolist())) < 2 or not parts:
        return Model(np.zeros(LETTERS**3, np.float32), 0.0, np.array([0.0, 0.0, 0.0, 8.0 if labels.sum() * 2 > len(labels) else -8.0]))
    rng = np.random.default_rng(seed)
    docs, sample_words = [d for d, _ in parts], [w for _, w in parts]
    known = _Counted(sample_words, docs, labels)
    n_pos, n_neg = labels.sum(), (1 - labels).sum()
    odds = np.log((known.pos + 0.2) / (n_pos + 1)) - np.log((known.neg + 0.2) / (n_neg + 1))
    odds *= 1 - np.exp(-(known.pos + known.neg) / 4)  # rare units say little by themselves
    fit = (known.size >= 5) & (known.size <= 40)
    best = lambda of, most: np.argsort(np.where(of & fit, -odds, 9), kind="stable")[: min(most, int((of & fit).sum()))]
    words_alone = np.flatnonzero(~known.paired)
    others = rng.choice(words_alone, size=min(len(words_alone), landmarks // 4), replace=False)
    picks = [*best(~known.paired, landmarks // 2).tolist(), *best(known.paired, landmarks // 4).tolist(), *others.tolist()]
    chosen = [np.frombuffer(known.text(i), np.uint8) for i in dict.fromkeys(picks)]
    table = landmark_table(chosen)

    def kernel(units: list[bytes]) -> np.ndarray:
        out = [np.zeros((0, len(chosen)), np.float32)]
        for i in range(0, len(units), 1000):
            part = units[i : i + 1000]
            out.append(unit_sums(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part[:-1])]), table))
        return np.concatenate(out)

    k_zz = kernel([z.tobytes() for z in chosen])
    values, vectors = np.linalg.eigh((k_zz + k_zz.T) / 2)
    root = (vectors / np.sqrt(np.maximum(values, 1e-2))).astype(np.float32)

    def rows(units: list[bytes]) -> np.ndarray:
        return np.concatenate([kernel(units) @ root, np.ones((len(units), 1), np.float32)], axis=1)

    folded, bias = None, 0.0
    for _ in range(rounds):
        texts, scores, worst = [], [], []
        for d, words in zip(docs, sample_words, strict=True):
            # before the first round a sentence's worst unit is that of the highest odds
            s = Sentences(words, odds[known.of(words)]) if folded is None else Sentences.scored(words, folded, bias)
            texts.append(d[s.text])
            scores.append(s.score)
            worst += [words.unit(int(i)) for i in s.unit]
        text, score = np.concatenate(texts), np.concatenate(scores)
        clean = labels[text] == 0
        # of a toxic document the two worst sentences, if they are worse than nearly all clean ones
        order = np.lexsort((-score, text))
        heads = np.flatnonzero(np.diff(text[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(heads, np.diff(heads, append=len(order)))
        bar = np.quantile(score[clean], 0.99) if clean.any() else -np.inf
        picked = [i for i in order[place < 2].tolist() if not clean[i] and score[i] > bar]
        support: dict[bytes, int] = {}
        for i in picked:
            support[worst[i]] = support.get(worst[i], 0) + 1
        against: dict[bytes, int] = {}
        for i in np.flatnonzero(clean).tolist():
            if worst[i] not in support:
                against[worst[i]] = against.get(worst[i], 0) + 1
        if not support or not against:
            break
        good, bad = sorted(support), sorted(against)
        gapped = [_with_letter(u, rng) for u in good for _ in range(2)]
        x = np.concatenate([rows(good), rows(gapped), rows(bad)])
        y = np.concatenate([np.ones(len(good) + len(gapped)), -np.ones(len(bad))]).astype(np.float32)
        up, down = np.log1p([support[u] for u in good]), np.log1p([against[u] for u in bad])
        w = _svm(x, y, np.concatenate([up, np.repeat(up, 2) / 4, down * 3 * up.sum() / down.sum()]))
        folded, bias = (table @ (root @ w[:-1])).astype(np.float32), float(w[-1])
    if folded is None:
        folded = np.zeros(LETTERS**3, np.float32)
    model = Model(folded, bias, np.zeros(4))
    model.out = _logistic(model.features(data, offsets), labels)
    return model


def _with_letter(unit: bytes, rng: np.random.Generator) -> bytes:
    at = int(rng.integers(1, len(unit) + 1))
    return unit[:at] + bytes([int(rng.integers(1, 27))]) + unit[at:]


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """The model from the labelled rows outside the held-out fold, ``per_class`` of each label at most."""
    return train(labelled_sample(docs, labels, "toxic", FOLDS, HELD, per_class))


def score_texts(docs: DataFrame, model: Model, keep_below: float | None = None) -> DataFrame:
    """With ``keep_below`` None, rows (doc_id, score); else ``docs`` with all columns, without rows of that score or more.

    Null texts score as empty ones. Repeated rows are scored each by itself; other columns, whatever their names, are passed
    on; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # one table of 64,000 floats, whatever the input's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores(*text_bytes(batch.column(batch.schema.get_field_index("text"))))
            if keep_below is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])
            else:
                yield batch.filter(pa.array(score < keep_below))

    if keep_below is None:
        source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
        return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1), predicted.

    Null and empty texts score alike, by the model's value for a text without sentences; long texts are read whole. A null id
    belongs to no fold but the held-out one of remainder 0, and gives no label. Repeated rows are scored each by itself and
    get equal scores; columns beside doc_id and text are not looked at. No documents give no rows; without labels of both
    kinds every score is that of the kind there is, 0 for none.
    """
    scored = score_texts(docs, fitted(docs, labels, per_class))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
