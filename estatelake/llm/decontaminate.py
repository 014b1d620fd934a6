"""Benchmark decontamination: windows of the benchmark's words, found anywhere in the documents.

The distinct windows form a hash set that is broadcast while it has at most ``broadcast_windows`` entries (of ten words each),
and shuffled beyond. The scan of the documents hashes each window of words, probes the set and compares the words themselves, all in
built-in functions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .common import free_names

WINDOW = 10
#: Fixed by the contract: words after A-Z became a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Normalised words; null has none."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (item, size, gram, h), distinct: every ``window`` consecutive words of an item, or the whole of a shorter one.

    Items without words have none; an item with a null id has its windows like others.
    """
    items = benchmark.select(F.col("item_id").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    return (
        items.select("item", "w", F.least(F.size("w"), F.lit(window)).alias("size"))
        .select("item", "w", "size", F.explode(F.expr("sequence(1, size(w) - size + 1)")).alias("at"))
        .select("item", "size", F.expr("slice(w, at, size)").alias("gram"))
        .distinct()
        .withColumn("h", F.xxhash64("gram"))
    )


def _scan(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows (doc_id, _t, _w, _p, _n, _h, _first): each position of each text with each window length and the hash of the words
    there, null where they don't suffice. One row of each document, whatever its text, is ``_first``."""
    base = docs.select(F.col("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("_t"), words(F.col("text").cast("string")).alias("_w"))
    scan = base.select("doc_id", "_t", "_w", F.posexplode_outer("_w").alias("_p", "_word"))
    scan = scan.withColumn("_p", F.coalesce("_p", F.lit(0)))
    scan = scan.withColumn("_n", F.lit(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*[F.lit(n) for n in lengths])))
    scan = scan.withColumn("_h", F.when(F.expr("_p + _n <= size(_w)"), F.xxhash64(F.expr("slice(_w, _p + 1, _n)"))))
    return scan.withColumn("_first", (F.col("_p") == 0) & (F.col("_n") == lengths[0]))


def _digest(docs: DataFrame, benchmark: DataFrame, window: int, broadcast_windows: int) -> DataFrame:
    """A row for each row of ``docs``: its id, a hash of its text, and what the windows hit."""
    grams = written(benchmark_windows(benchmark, window), "windows")
    known = grams.select("size", "gram", "h").distinct()
    # at most ``window`` rows: the windows' lengths with their numbers
    sizes = {r["size"]: r["n"] for r in known.groupBy("size").agg(F.count("*").alias("n")).collect()}
    lengths = sorted(sizes) or [window]
    # a row for each hash, so that a position meets one row at most
    right = known.groupBy(F.col("h").alias("_h")).agg(F.collect_set("gram").alias("_gs"))
    here = F.expr("slice(_w, _p + 1, _n)")
    if sum(sizes.values()) <= broadcast_windows:
        hits = _scan(docs, lengths).join(F.broadcast(right), "_h", "left").withColumn("_v", F.when(F.col("_gs").isNotNull(), here))
    else:
        # the set is too large to send around: of the texts only hashes are shuffled, without those of too few words, and the
        # texts with a hash in the set are read once more to compare the words
        at = _scan(docs, lengths).where("_h is not null").select("doc_id", "_t", "_p", "_n", "_h")
        found = at.join(right.select("_h").hint("merge"), "_h", "left_semi")
        places = found.groupBy(F.col("doc_id").alias("_d"), F.col("_t").alias("_u")).agg(F.sort_array(F.collect_set(F.struct("_p", "_n"))).alias("_at"))
        base = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("_t"), words(F.col("text").cast("string")).alias("_w"))
        joined = base.join(places.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_u")), "left")
        spots = joined.select("doc_id", "_t", "_w", F.posexplode_outer("_at").alias("_i", "_s"))
        spots = spots.select("doc_id", "_t", "_w", F.col("_s._p").alias("_p"), F.col("_s._n").alias("_n"), F.coalesce(F.col("_i") == 0, F.lit(True)).alias("_first"))
        spots = spots.withColumn("_v", F.when(F.col("_p").isNotNull(), here)).withColumn("_h", F.when(F.col("_v").isNotNull(), F.xxhash64("_v")))
        hits = spots.select("doc_id", "_t", F.size("_w").alias("_c"), "_p", "_n", "_v", "_h", "_first").join(right.hint("merge"), "_h", "left")
    ok = F.coalesce(F.array_contains("_gs", F.col("_v")), F.lit(False))
    count = F.size("_w") if "_w" in hits.columns else F.col("_c")
    hits = hits.select("doc_id", "_t", count.cast("long").alias("_c"), "_p", "_n", "_v", "_first", ok.alias("_ok")).where("_ok or _first")
    return _per_document(hits, grams)


def _per_document(hits: DataFrame, grams: DataFrame) -> DataFrame:
    """From hits (and one row at least for each document) to the digest; lists stay within a document's own length."""
    covered = F.expr("sequence(_p, _p + _n - 1)")
    docs = hits.groupBy("doc_id", "_t").agg(
        F.max("_c").alias("n_words"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("_ok"), covered))))).cast("long").alias("n_hit"),
        F.collect_set(F.when(F.col("_ok"), F.col("_v"))).alias("_grams"),
        F.count(F.when(F.col("_first"), 1)).alias("_rows"),
    )
    # written, for it is read twice and the scan below it is all the work
    docs = written(docs, "hits")
    of = grams.where("item is not null").select(F.col("gram").alias("_gram"), F.col("item").cast("string").alias("_item"))
    items = (
        docs.where("n_hit > 0")
        .select("doc_id", "_t", F.explode("_grams").alias("_gram"))
        .join(of, "_gram")
        .groupBy(F.col("doc_id").alias("_d"), F.col("_t").alias("_u"))
        .agg(F.sort_array(F.collect_set("_item")).alias("_items"))
    )
    out = docs.join(items, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_u")), "left")
    listed = F.coalesce("_items", F.array().cast("array<string>"))
    each = F.explode(F.expr("sequence(1, _rows)"))  # rows that repeat an id and a text have a result each
    return out.withColumn("_row", each).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "_t",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = 400_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a benchmark window is hit. Null texts have no words; a null doc_id is a document like
    others; rows that repeat an id, with the same text or another one, have a result each. Windows of fewer than ``window``
    words (whole short items) are probed at their own lengths. Items with a null id hit like others, but are neither counted
    in n_items nor listed; items that share an id are one. Other columns of either table are not looked at. An empty benchmark
    gives no hits, no documents no rows.
    """
    return _digest(docs, benchmark, window, broadcast_windows).drop("_t")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = 400_000) -> DataFrame:
    """``docs`` without the rows in which any benchmark window occurs. Rows are told apart by id and text, so a clean row stays
    that shares its id (or the lack of one) with a contaminated one."""
    id_, hash_ = free_names(docs, "_id", "_hash")
    bad = _digest(docs, benchmark, window, broadcast_windows).where("contaminated").select(F.col("doc_id").alias(id_), F.col("_t").alias(hash_)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"].cast("string")) == F.col(hash_)), "left_anti")
