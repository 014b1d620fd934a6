"""What several operators of this package share: the vocabulary's place, the fold rule and labelled samples."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The vocabulary files' folder; the files stay where they are.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def model_file() -> str:
    return f"{TOKENIZERS}/piece_bpe_32k.model"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of ``df`` has it, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (0 for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % F.lit(folds), F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int) -> list[tuple[str, int]]:
    """At most ``per_class`` (text, label) rows of each label, from ids outside the held-out fold.

    The rows come in the order of a hash of the id, so the sample is the same on every run. Null ids, texts and labels are
    left out; an id with several labels counts with the largest, an id with several texts with one of them. The chosen ids
    are a bounded list (two times ``per_class``), so broadcasting them to the scan of ``docs`` is safe, and of each id one
    text comes to the driver, however often its row is repeated.
    """
    ids = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (fold("_id", folds) != held))
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
        .withColumn("_h", F.xxhash64("_id"))
    )
    picked = None
    for y in (0, 1):
        part = ids.where(F.col("_y") == y).orderBy("_h", "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = (
        docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
        .where(F.col("_text").isNotNull())
        .join(F.broadcast(picked), F.col("_doc") == F.col("_id"))
        .groupBy("_h", "_id", "_y")
        .agg(F.min("_text").alias("_text"))
        .collect()
    )
    return [(r["_text"], r["_y"]) for r in sorted(rows, key=lambda r: (r["_h"], r["_id"]))]
