"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are tokens with a digit and at least twelve characters of the kind keys are made of, values assigned to words
like "password", and private-key headers. The forest sees a candidate's length, how its characters change class, how much
of it dictionary words cover, whether it looks like a path, and the words around it. The dictionary is that of the documents
themselves: the words that most of them hold, counted over all. The forest is trained from labelled findings; the ones given
here are drawn from a rule for each kind of secret and of harmless look-alike, the latter with words of the dictionary.
"""

from __future__ import annotations

import math
import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import forget, written

NEAR = 40
DIGITS = re.compile(r"[0-9]+")
KEY_CHARS = frozenset(string.ascii_letters + string.digits + "_+/=.~%:@-")
RIGHT = re.compile(r"[A-Za-z0-9_+/=.~%:@\-]*")
ASSIGNED = re.compile(r"""(?i)\b(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|auth|credential|private[_-]?key)\w*["']?\s*(?:=|:)\s*["']?([^\s"',;]{6,})""")
HEADER = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
#: Beginnings of keys of public services.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "xoxb-", "xoxp-", "AIza", "eyJ", "npm_", "SG.", "ya29.")
#: Words that stand near secrets, and near other long tokens.
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "auth", "credential", "bearer", "private", "access", "key")
OTHER_WORDS = ("commit", "sha", "md5", "hash", "checksum", "uuid", "isbn", "doi", "version", "license", "phone", "tel", "card", "example", "sample", "index", "http", "www", "file", "path", "image", "page", "order", "build")
#: Words that stand in file names, addresses and placeholders, beside those of the documents.
COMMON = ("example", "changeme", "placeholder", "password", "secret", "test", "sample", "dummy", "your", "here", "user", "admin", "config", "local", "home", "data", "file", "image", "index", "page", "news", "article", "release", "version", "build", "main", "http", "https", "www", "com", "org", "net", "html", "json", "path", "token", "value", "name", "date", "item", "list", "src", "lib", "bin", "usr", "var", "log", "tmp")
#: The dictionary holds so many words of the documents at most, of so many letters at least, each in so many documents.
DICTIONARY, LETTERS, SEEN = 20_000, 4, 3


def corpus_words(docs: DataFrame, most: int = DICTIONARY) -> list[str]:
    """Words (LETTERS ASCII letters and more, lower case) that most documents hold, counted over all whole texts: as many as
    fit into ``most``, words of about one frequency (within a 16th of a power of two) all or none. What comes to the driver is
    bounded by ``most`` words and some hundred counts."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(f"[a-z]{{{LETTERS},20}}"), F.lit(0)))
    counted = docs.select(F.explode(found).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    counted = written(counted.select("w", F.floor(F.log2("n") * 16).cast("int").alias("level")), "words")
    total, least = 0, None
    for r in counted.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        total += r["n"]
        if total > most:
            break
        least = r["level"]
    out = [] if least is None else sorted(r["w"] for r in counted.where(F.col("level") >= least).select("w").collect())
    forget(counted)
    return out


class Dictionary:
    """Finds words in a candidate."""

    def __init__(self, words: list[str]):
        self.words = sorted({*COMMON, *words})
        self.find = ahocorasick.Automaton()
        for w in self.words:
            self.find.add_word(w, len(w))
        self.find.make_automaton()

    def __reduce__(self):
        return Dictionary, (self.words,)

    def covered(self, s: str) -> int:
        """Characters of ``s`` that lie in a word."""
        mark = bytearray(len(s))
        for end, n in self.find.iter(s):
            mark[end + 1 - n : end + 1] = b"\1" * n
        return sum(mark)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidates, in order, none twice; linear in the text, and two calls on it agree."""
    found: dict[tuple[int, int], str] = {}
    for m in HEADER.finditer(text):
        found[m.span()] = "private_key"
    for m in ASSIGNED.finditer(text):
        found.setdefault(m.span(1), "assigned")
    at = 0
    for m in DIGITS.finditer(text):
        if m.start() < at:
            continue
        left = m.start()
        while left > at and text[left - 1] in KEY_CHARS:
            left -= 1
        at = RIGHT.match(text, m.end()).end()
        token = text[left:at].rstrip(".:")
        name, eq, value = token.partition("=")
        if eq and value.strip("="):  # name=value
            left, token = left + len(name) + 1, value
        if len(token) >= 12:
            found.setdefault((left, left + len(token)), "token")
    spans: list[tuple[int, int, str]] = []
    for (s, e), kind in sorted(found.items()):
        if spans and s < spans[-1][1]:
            continue  # of overlapping candidates the first is kept; it covers the key
        spans.append((s, e, kind))
    return spans


def features(text: str, start: int, end: int, words: Dictionary) -> list[float]:
    s = text[start:end]
    n = len(s)
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s]
    counts = Counter(classes)
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    inner = sum(a != b and "o" not in (a, b) for a, b in zip(classes, classes[1:], strict=False))
    entropy = -sum(v / n * math.log2(v / n) for v in Counter(s).values()) if n else 0.0
    low = s.lower()
    covered = words.covered(low) if len(low) == n else 0  # a few letters change their number when lowered
    before, after = text[max(0, start - NEAR) : start].lower(), text[end : end + NEAR].lower()
    longest_letters = max((len(x) for x in re.findall(r"[A-Za-z]+", s)), default=0)
    return [
        n,
        counts["d"] / max(1, n),
        counts["u"] / max(1, n),
        counts["l"] / max(1, n),
        counts["o"] / max(1, n),
        changes / max(1, n - 1),
        inner / max(1, n - 1),
        entropy,
        covered / max(1, n),
        s.count("/") + s.count("\\"),
        s.count(".") + s.count("@"),
        s.count("-"),
        float(s.startswith(PREFIXES)),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", s))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s))),
        float(s.startswith("-----BEGIN")),
        float(any(w in before[-24:] for w in SECRET_WORDS)),
        float(any(w in before or w in after for w in OTHER_WORDS)),
        float(before.rstrip(" \"'").endswith(("=", ":"))),
        longest_letters / max(1, n),
    ]


def labelled_findings(n: int = 3000, seed: int = 10, words: list[str] | None = None, without: int | None = None) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) drawn from rules: keys, hashes in assignments and passwords; versions, dates, numbers,
    addresses, paths, identifiers and placeholders, their words from ``words`` (those that are given, or else letters at
    random). ``without`` leaves out one rule, counted over both kinds."""
    r = random.Random(seed)
    pick = lambda a, k: "".join(r.choices(a, k=k))
    word = lambda: r.choice(words) if words and r.random() < 0.8 else pick(string.ascii_lowercase, r.randint(2, 9))
    upper, lower, digits, hexa = string.ascii_uppercase, string.ascii_lowercase, string.digits, "0123456789abcdef"
    secrets = [
        lambda: ("", "AKIA" + pick(upper + "234567", 16), ""),
        lambda: (r.choice(["token", "secret", "api_key", "auth_token"]) + r.choice([" = \"", "=", ": ", ":"]), pick(hexa, r.choice([16, 20, 32, 40, 64])), r.choice(["\"", ""])),
        lambda: (r.choice(["password=", "passwd: ", "pwd=", "password = "]), pick(hexa if r.random() < 0.5 else upper + lower + digits + "!#%_-", r.randint(8, 24)), ""),
        lambda: ("", r.choice(["ghp_", "sk_live_", "glpat-", "xoxb-", "npm_"]) + pick(upper + lower + digits, r.randint(20, 40)), ""),
        lambda: (r.choice(["key=", "secret_access_key = ", "bearer "]), pick(upper + lower + digits + "+/", 40), ""),
        lambda: ("", "eyJ" + pick(upper + lower + digits, 30) + ".eyJ" + pick(upper + lower + digits, 60) + "." + pick(upper + lower + digits + "_-", 43), ""),
        lambda: ("", "-----BEGIN RSA PRIVATE KEY-----", "\n" + pick(upper + lower + digits, 30)),
    ]
    harmless = [
        lambda: ("", pick(digits, r.randint(12, 19)), ""),
        lambda: ("", ".".join(str(r.randint(0, 255)) for _ in range(4)), ""),
        lambda: ("", f"{word()}.{r.randint(1, 99)}@{word()}{r.randint(1, 9)}.example.com", ""),
        lambda: ("", f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}:00:{r.randint(0, 59):02}", ""),
        lambda: (r.choice(["commit ", "sha256:", "checksum ", "md5 "]), pick(hexa, r.choice([32, 40, 64])), ""),
        lambda: (r.choice(["uuid ", "id ", "order "]), str(uuid.UUID(int=r.getrandbits(128))), ""),
        lambda: ("", "/".join(["", *(word() for _ in range(r.randint(2, 5)))]) + f"/{word()}{r.randint(1, 99)}.html", ""),
        lambda: ("", f"https://www.{word()}.com/{word()}/{r.randint(1, 99999)}/{word()}-{word()}-{word()}", ""),
        lambda: (r.choice(["password=", "token = \"", "api_key: "]), r.choice(["changeme123", "your_token_here_1", "EXAMPLEKEY123", "<password1>", "placeholder-000000", "xxxxxxxxxxxx1234", "${TOKEN_1}00000"]), ""),
        lambda: ("", "-".join(word() for _ in range(4)) + str(r.randint(1, 9999)), ""),
        lambda: (r.choice(["phone ", "tel:", "call "]), f"+{r.randint(1, 99)}-{pick(digits, 3)}-{pick(digits, 3)}-{pick(digits, 4)}", ""),
        lambda: ("version ", f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}-{word()}.{r.randint(1, 200)}", ""),
        lambda: (r.choice(["password: ", "token: ", "secret = "]), word() + word(), " " + word()),
    ]
    if without is not None:
        del (secrets if without < len(secrets) else harmless)[without if without < len(secrets) else without - len(secrets)]
    out = []
    for i in range(n):
        y = i % 2
        before, s, after = r.choice(secrets if y else harmless)()
        lead = " ".join(word() for _ in range(6)) + " " + before
        out.append((lead + s + after + " " + " ".join(word() for _ in range(5)), len(lead), len(lead) + len(s), y))
    return out


class Forest:
    """Trees as arrays (feature, threshold, left, right, probability), each grown on a bootstrap of the findings."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 9, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees if len(y) else 0):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows], depth, rng, nodes)
            self.trees.append(np.array(nodes, float))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, nodes: list) -> int:
        me = len(nodes)
        nodes.append([-1, 0, 0, 0, float(y.mean())])
        if depth == 0 or len(y) < 6 or y.min() == y.max():
            return me
        best = (y.mean() * (1 - y.mean()) * len(y) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], size=max(2, int(x.shape[1] ** 0.5) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            if not len(at):
                continue
            n = at + 1
            left, right = t[at] / n, (t[-1] - t[at]) / (len(y) - n)
            cost = left * (1 - left) * n + right * (1 - right) * (len(y) - n)
            i = int(cost.argmin())
            if cost[i] < best[0]:
                best = (float(cost[i]), int(f), float((v[at[i]] + v[at[i] + 1]) / 2))
        if best[1] < 0:
            return me
        go = x[:, best[1]] <= best[2]
        nodes[me][:2] = best[1], best[2]
        nodes[me][2] = self._grow(x[go], y[go], depth - 1, rng, nodes)
        nodes[me][3] = self._grow(x[~go], y[~go], depth - 1, rng, nodes)
        return me

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), int)
            while (inner := t[at, 0] >= 0).any():
                left = x[np.arange(len(x)), np.maximum(t[at, 0], 0).astype(int)] <= t[at, 1]
                at = np.where(inner, np.where(left, t[at, 2], t[at, 3]), at).astype(int)
            total += t[at, 4]
        return total / max(1, len(self.trees))


def fitted(findings: list[tuple[str, int, int, int]] | None = None, words: list[str] | None = None) -> tuple[Forest, Dictionary]:
    """A forest from labelled findings, and the dictionary it goes by."""
    known = Dictionary(words or [])
    findings = labelled_findings(words=words) if findings is None else findings
    return Forest(np.array([features(t, s, e, known) for t, s, e, _ in findings], float).reshape(len(findings), -1), np.array([y for *_, y in findings], float)), known


def scan(docs: DataFrame, model: tuple[Forest, Dictionary] | None = None, bar: float = 0.5) -> DataFrame:
    """A row per candidate of each whole text: doc_id, start, end (code points), kind, score, is_secret.

    Null and empty texts have none; repeated rows are scanned each by itself, a null id is passed on. ``is_secret`` is score >=
    ``bar``; rows below are the false positives that the forest removes. Overlapping candidates are one, the first; other
    columns, whatever their names, are not looked at; an empty table gives no rows. Without ``model`` one is fitted with the
    dictionary of ``docs``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fitted(words=corpus_words(docs)))  # some thousand nodes, and DICTIONARY words
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, words = shared.value
        for batch in batches:
            rows, found, x = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for s, e, kind in candidates(t) if t else ():
                    rows.append(i)
                    found.append((s, e, kind))
                    x.append(features(t, s, e, words))
            score = forest.scores(np.array(x, float))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.string()), pa.array(score), pa.array(score >= bar)],
                names=["doc_id", "start", "end", "kind", "score", "is_secret"],
            )

    kinds = [("start", T.LongType()), ("end", T.LongType()), ("kind", T.StringType()), ("score", T.DoubleType()), ("is_secret", T.BooleanType())]
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], *(T.StructField(n, k) for n, k in kinds)]))
