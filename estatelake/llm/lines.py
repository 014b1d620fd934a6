"""Line dedup by site-relative frequency, in built-in functions only.

A line is boilerplate of a host if more than ``ratio`` of the host's pages hold it. By that very rule a host has fewer than
(mean distinct lines of a page) / ``ratio`` such lines, however large it is, so the list for a host is short; all lists are
broadcast only if their lines number at most ``broadcast_lines``. Beyond that documents meet their host's list in a sort-merge
join, whose large hosts adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .common import free_names

#: A line of a site's own texts stands on a few pages, boilerplate on one in a hundred and more; on a small site a line that is
#: on fewer than MIN_PAGES pages may still be a chance repetition.
RATIO, MIN_PAGES = 0.01, 5


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Rows (_host, _k1, _k2, pages, host_pages, share) of lines above the ratio, on at least ``min_pages`` pages.

    Lines are compared by two 64-bit hashes, trimmed of spaces; empty lines never count, and a line that a page repeats counts
    once. Null hosts are one host; null texts are no pages; rows that are repeated are pages of their own. An empty table has
    no lines.
    """
    pages = docs.select(F.col(host).alias("_host"), F.col("text").alias("_text")).where("_text is not null")
    totals = pages.groupBy("_host").agg(F.count("*").alias("host_pages"))
    lines = (
        pages.select("_host", F.explode(F.array_distinct(F.transform(F.split("_text", "\n"), F.trim))).alias("_line"))
        .where("_line <> ''")
        .groupBy("_host", F.xxhash64("_line").alias("_k1"), F.xxhash64(F.lit(7), F.col("_line")).alias("_k2"))
        .agg(F.count("*").alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    t = totals.select(F.col("_host").alias("_th"), "host_pages")
    # totals have a row a host; the lines are already one row each, so a hot host isn't one key of many rows here
    return (
        lines.join(t, F.col("_host").eqNullSafe(F.col("_th")))
        .where(F.col("pages") > F.lit(ratio) * F.col("host_pages"))
        .select("_host", "_k1", "_k2", "pages", "host_pages", (F.col("pages") / F.col("host_pages")).alias("share"))
    )


def without_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = 200_000) -> tuple[DataFrame, str, str]:
    """(``docs`` with all its columns and two more, the names of these: the lines of a text, and how many of them were dropped).

    In ``text`` the host's boilerplate lines are gone. Kept lines stay as they were, joined by one newline. Null text stays null
    with no lines; a text of boilerplate only becomes empty and its row stays, and so does every other row, repeated ones too.
    The added columns take names that ``docs`` hasn't. An empty table gives an empty one.
    """
    drop, there, all_, kept, n_all, n_dropped = free_names(docs, "_drop", "_there", "_all", "_kept", "_n_lines", "_n_dropped")
    found = written(boilerplate(docs, host, ratio, min_pages).groupBy("_host").agg(F.collect_set(F.struct("_k1", "_k2")).alias(drop), F.count("*").alias("_n")), "lines")
    small = (found.agg(F.sum("_n")).first()[0] or 0) <= broadcast_lines
    right = found.select(F.col("_host").alias(there), drop)
    joined = docs.join(F.broadcast(right) if small else right.hint("merge"), docs[host].eqNullSafe(right[there]), "left")
    lines = F.split("text", "\n")
    hit = lambda x: F.array_contains(F.col(drop), F.struct(F.xxhash64(F.trim(x)).alias("_k1"), F.xxhash64(F.lit(7), F.trim(x)).alias("_k2")))
    rest = F.when(F.col(drop).isNull(), lines).otherwise(F.filter(lines, lambda x: ~hit(x)))
    out = joined.select(*[F.col(c) for c in docs.columns if c != "text"], lines.alias(all_), rest.alias(kept))
    text = F.when(F.col(kept).isNotNull(), F.array_join(kept, "\n"))
    count = lambda c: F.when(F.col(all_).isNull(), 0).otherwise(c).cast("long")
    cols = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return out.select(*cols, count(F.size(all_)).alias(n_all), count(F.size(all_) - F.size(kept)).alias(n_dropped)), n_all, n_dropped


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = 200_000) -> DataFrame:
    """``without_boilerplate`` with the columns of ``docs`` only."""
    return without_boilerplate(docs, host, ratio, min_pages, broadcast_lines)[0].select(*docs.columns)
