"""A training corpus from raw documents: five filtering stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and reads
it again as the next one's docs, so a lost executor brings back one stage's work at most. All but the last return the
columns of documents, whatever these are; the last gives token ids. No stage fails on nulls in any column, empty or very
long texts, repeated rows, empty tables, or further columns of any name; what it makes of them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import forget, written
from . import decontaminate, jaccard, lines, sentencepieces, toxicity
from .common import model_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go. Null and empty texts score alike; each of several equal rows by itself; a
    null id is a document like others. Without labels of both kinds the model says the kind there is, none: nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_texts(docs, toxicity.fitted(docs, labels), keep_below=0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a hundredth of a source's documents (five at least) go; every row stays, and n_chars, if there is
    such a column, is the length of the text that stays. Null texts stay null; documents without a source are one source."""
    out = lines.drop_boilerplate(docs)
    return out.select(*(F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by n-gram Jaccard similarity one row stays, that of the least id. Rows without an id
    or without words stay."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of benchmark words go; rows that share an id are judged each by its own text."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids and whether they decode to the text again; null and empty texts have no ids."""
    return sentencepieces.encode_texts(docs, model_file())


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("jaccard_join", drop_near_copies), ("decontamination", drop_contaminated), ("sentencepiece", tokenize)]

#: SQL can express neither the machine of the first stage nor the tokens of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is removed once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        new = written(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(docs)
        docs = new
    return docs
