"""Sorting and paging: keyset predicates, composite keys, cursors, facets, queues."""

from __future__ import annotations

import base64
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order(columns: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c, desc in columns]


def after(columns: list[tuple[str, bool]], last: list) -> Column:
    """Rows that come after ``last`` in an order of (column, descending) with nulls last: a null stands behind all values."""
    parts, equal = [], F.lit(True)
    for (c, desc), v in zip(columns, last, strict=True):
        col = F.col(c)
        if v is None:
            same, beyond = col.isNull(), F.lit(False)
        else:
            same = col == F.lit(v)
            beyond = (col < F.lit(v) if desc else col > F.lit(v)) | col.isNull()
        parts.append(equal & F.coalesce(beyond, F.lit(False)))
        equal = equal & F.coalesce(same, F.lit(False))
    return reduce(lambda a, b: a | b, parts)


def page(df: DataFrame, columns: list[tuple[str, bool]], size: int, last: list | None = None) -> DataFrame:
    """One page; Spark takes the first rows of each partition and merges them, so nothing is sorted as a whole."""
    rows = df if last is None else df.where(after(columns, last))
    return rows.orderBy(*_order(columns)).limit(size)


def cursor(values: list) -> str:
    return base64.urlsafe_b64encode(json.dumps(values).encode()).decode()


def from_cursor(text: str) -> list:
    return json.loads(base64.urlsafe_b64decode(text.encode()))


def feed_key(seconds: Column, id_: Column) -> Column:
    """Sort key whose byte order is (seconds, id)."""
    return F.concat(F.lpad(seconds.cast("string"), 12, "0"), F.lpad(id_.cast("string"), 19, "0"))


def leaderboard(df: DataFrame, keys: list[str], metrics: dict[str, Column], by: str, limit: int) -> DataFrame:
    """Groups by a chosen metric, descending; the limit is held between 1 and 2000."""
    if by not in metrics:
        raise ValueError(f"no metric {by!r}")
    agg = df.groupBy(*keys).agg(*[c.alias(n) for n, c in metrics.items()])
    return agg.orderBy(F.col(by).desc_nulls_last(), *[F.asc(k) for k in keys]).limit(max(1, min(2000, limit)))


def stalest(df: DataFrame, at: str, key: str, limit: int, due: Column | None = None) -> DataFrame:
    """Work in the order of staleness, never-checked rows first; ``due`` leaves out what was done lately."""
    rows = df if due is None else df.where(F.col(at).isNull() | due)
    return rows.orderBy(F.col(at).asc_nulls_first(), key).limit(limit)


def claim_queue(df: DataFrame, limit: int, most_attempts: int = 5) -> DataFrame:
    """Open rows (priority, enqueued_at, id, attempts, claimed_at) to work on next."""
    return df.where((F.col("attempts") < most_attempts) & F.col("claimed_at").isNull()).orderBy(F.desc("priority"), "enqueued_at", "id").limit(limit)


def lease(claims: DataFrame, resource: str, holder: str, order: list[str], now: str, seconds: int) -> DataFrame:
    """Who holds each resource at ``now`` by the last claim before it (``order`` begins with its time), and whether the lease has
    run out, so that another may take it."""
    at = F.lit(now).cast("timestamp_ntz")
    last = claims.where(F.col(order[0]) <= at).groupBy(resource).agg(F.max_by(F.struct(holder, order[0]), F.struct(*order)).alias("_l"))
    return last.select(resource, F.col(f"_l.{holder}").alias(holder), (F.unix_timestamp(at) - F.unix_timestamp(F.col(f"_l.{order[0]}")) >= seconds).alias("free"))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every value of each column (facet, value, n) in one pass over unpivoted rows."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(rows.alias("_r")).select("_r.*").groupBy("facet", "value").agg(F.count("*").alias("n"))


def positions(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds _position (from 1, by ``order``, which must be total) and _size within each group. Rows are dealt out by ranges and
    numbered within a range; sums of the ranges before it, a row for each range and group, are added. A group of any size
    is never sorted in one task."""
    from pyspark.sql import Window

    from ..storage import written

    dealt = written(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_range")
    before = sums.select("_range", *keys, (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_size"))
    before = before.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k_{k}") for k in keys], "_before", "_size")
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    numbered = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)))
    return numbered.join(before, same).select(*df.columns, (F.col("_before") + F.col("_rn")).alias("_position"), "_size")


def stratified_sample(df: DataFrame, keys: list[str], price: str, id_: str, seed: str, per_stratum: int) -> DataFrame:
    """Price quartiles within each group (the first ones a row larger where rows don't divide by four); of each quartile the
    ids whose seeded md5 comes first."""
    from pyspark.sql import Window

    small, extra, at = F.floor(F.col("_size") / 4), F.col("_size") % 4, F.col("_position") - 1
    larger = extra * (small + 1)
    band = F.when(at < larger, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - larger) / F.greatest(small, F.lit(1)))) + 1
    q = positions(df, keys, [price, id_]).withColumn("band", band.cast("int")).drop("_position", "_size")
    h = F.md5(F.concat(F.lit(seed), F.col(id_).cast("string")))
    return q.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "band").orderBy(h, id_))).where(F.col("rank") <= per_stratum)
