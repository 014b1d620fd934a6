"""Cohort clustering where the order of steps is part of the definition: seeded k-means and greedy phrase clusters.

Each cohort (a bounded list of comparables, or one scope's distinct phrases) is one group and goes through Arrow as a whole."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_CLUSTERS, RESTARTS, ROUNDS = 8, 5, 100


def z_scores(x: np.ndarray) -> np.ndarray:
    """By the population deviation; a column without spread is 0."""
    spread = x.std(axis=0)
    return np.where(spread > 0, (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1), 0.0)


def k_means(x: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, float]:
    """(cluster of each row, inertia) of one start: rows drawn by the seed; ties go to the lower cluster, an empty cluster
    starts again from a drawn row."""
    rng = random.Random(seed)
    centres = x[rng.sample(range(len(x)), k)]
    of = np.full(len(x), -1)
    for _ in range(ROUNDS):
        d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
        new = d.argmin(axis=1)
        if (new == of).all():
            break
        of = new
        centres = np.array([x[of == c].mean(axis=0) if (of == c).any() else x[rng.randrange(len(x))] for c in range(k)])
    return of, float(((x - centres[of]) ** 2).sum())


def cluster_rows(x: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Cluster numbers from 0 in the order of size (larger first), the best of RESTARTS starts."""
    k = min(max(k, 1), len(x), MOST_CLUSTERS)
    z = z_scores(x.astype(float))
    of = min((k_means(z, k, seed + r) for r in range(RESTARTS)), key=lambda t: t[1])[0]
    sizes = [(-(of == c).sum(), c) for c in range(k) if (of == c).any()]
    number = {c: i for i, (_, c) in enumerate(sorted(sizes))}
    return np.array([number[c] for c in of])


def cluster_comparables(df: DataFrame, keys: list[str], id_: str, features: list[str], k: int, seed: int = 42) -> DataFrame:
    """Rows (keys, id, cluster) for rows whose features are all known."""
    known = df.select(*keys, id_, *[F.col(f).cast("double").alias(f) for f in features]).dropna(subset=features)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_)
        return pdf[[*keys, id_]].assign(cluster=cluster_rows(pdf[features].to_numpy(), k, seed).astype("int32"))

    schema = T.StructType([*[known.schema[c] for c in (*keys, id_)], T.StructField("cluster", T.IntegerType())])
    return known.groupBy(*keys).applyInPandas(run, schema)


def alike(a: str, b: str, ratio: float = 0.85, overlap: float = 0.7) -> bool:
    """By matching blocks or by shared words."""
    x, y = set(a.split()), set(b.split())
    return SequenceMatcher(None, a, b).ratio() >= ratio or bool(x | y) and len(x & y) / len(x | y) >= overlap


def greedy_phrases(df: DataFrame, scope: str, phrase: str, count: str) -> DataFrame:
    """Phrases of a scope in the order of count: each joins the first cluster whose head is alike, or heads a new one. Rows
    (scope, head, phrase, count)."""
    rows = df.groupBy(scope, phrase).agg(F.sum(count).cast("long").alias("count"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heads, out = [], []
        for _, r in pdf.sort_values(["count", phrase], ascending=[False, True]).iterrows():
            head = next((h for h in heads if alike(h, r[phrase])), None)
            if head is None:
                head = r[phrase]
                heads.append(head)
            out.append((r[scope], head, r[phrase], r["count"]))
        return pd.DataFrame(out, columns=[scope, "head", phrase, "count"])

    schema = T.StructType([rows.schema[scope], T.StructField("head", T.StringType()), rows.schema[phrase], T.StructField("count", T.LongType())])
    return rows.where(F.col(phrase).isNotNull()).groupBy(scope).applyInPandas(run, schema)


def majority(rows: DataFrame, keys: list[str], vote: str) -> DataFrame:
    """Per group the most frequent vote and its count; ties go to the smaller vote, nulls don't vote."""
    n = rows.where(F.col(vote).isNotNull()).groupBy(*keys, vote).agg(F.count("*").alias("votes"))
    return n.groupBy(*keys).agg(F.min_by(F.struct(vote, "votes"), F.struct((-F.col("votes")).alias("n"), F.col(vote))).alias("_m")).select(*keys, F.col(f"_m.{vote}").alias(vote), F.col("_m.votes").alias("votes"))
