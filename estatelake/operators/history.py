"""Change history over append-only snapshots: change detection, price changes, patterns, carried values, islands."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: list[str], order: list[str]):
    """Series in their order; nulls come last, as in SQL on DuckDB and Postgres."""
    return Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])


def with_previous(snap: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``prev``: the value of the snapshot before, within the series."""
    return snap.withColumn("prev", F.lag(value).over(ordered(keys, order)))


def on_change_only(snap: DataFrame, digest: str, keys: list[str], order: list[str]) -> DataFrame:
    """Snapshots whose digest differs from the one before; the first of a series always stays."""
    prev = F.lag(F.col(digest)).over(ordered(keys, order))
    first = F.row_number().over(ordered(keys, order)) == 1
    return snap.withColumn("_keep", first | ~F.col(digest).eqNullSafe(prev)).where("_keep").drop("_keep")


def price_history(snap: DataFrame, price: str, at: str, keys: list[str], order: list[str], as_of: datetime) -> DataFrame:
    """Per series: drops, rises, changes, changes with the later snapshot within 30, 90 and 365 days, and the deepest drop in
    per cent of the price before."""
    s = with_previous(snap, price, keys, order)
    p, q = F.col(price), F.col("prev")
    moved = q.isNotNull() & p.isNotNull() & (p != q)
    within = lambda d: F.count(F.when(moved & (F.col(at) >= F.lit(as_of) - F.make_dt_interval(days=F.lit(d))), 1)).alias(f"changes_{d}d")
    return s.groupBy(*keys).agg(
        F.count(F.when(moved & (p < q), 1)).alias("drops"),
        F.count(F.when(moved & (p > q), 1)).alias("rises"),
        F.count(F.when(moved, 1)).alias("changes"),
        *[within(d) for d in (30, 90, 365)],
        F.round(F.max(F.when(moved & (p < q) & (q > 0), (q - p) / q * 100)).cast("decimal(28,10)"), 2).cast("double").alias("max_drop_pct"),
    )


def price_span(snap: DataFrame, price: str, keys: list[str], order: list[str]) -> DataFrame:
    """Per series: first and last price and the total change in per cent, from two points on and a positive first price."""
    o = F.struct(*order)
    has = F.col(price).isNotNull()
    g = snap.where(has).groupBy(*keys).agg(F.count("*").alias("points"), F.min_by(price, o).alias("first_price"), F.max_by(price, o).alias("last_price"))
    pct = (F.col("last_price") - F.col("first_price")) / F.col("first_price") * 100
    return g.withColumn("total_change_pct", F.when((F.col("points") >= 2) & (F.col("first_price") > 0), F.round(pct.cast("decimal(28,10)"), 2).cast("double")))


def patterns(snap: DataFrame, price: str, keys: list[str], order: list[str]) -> DataFrame:
    """Per series: changes (adjacent unequal prices), total change (last minus first known price) and the pattern: stable,
    single_drop, stairstep_dropping, rising or volatile. A null price breaks the pairs on both its sides."""
    s = with_previous(snap, price, keys, order)
    step = F.when(F.col("prev").isNotNull() & F.col(price).isNotNull(), F.col(price) - F.col("prev"))
    o = F.struct(*order)
    has = F.col(price).isNotNull()
    g = s.groupBy(*keys).agg(
        F.count(F.when(step < 0, 1)).alias("_down"),
        F.count(F.when(step > 0, 1)).alias("_up"),
        F.min_by(price, o).alias("_all_first"),
        F.expr(f"min_by({price}, struct({', '.join(order)})) FILTER (WHERE {price} IS NOT NULL)").alias("_first"),
        F.expr(f"max_by({price}, struct({', '.join(order)})) FILTER (WHERE {price} IS NOT NULL)").alias("_last"),
    )
    del has
    down, up, first, last = (F.col(c) for c in ("_down", "_up", "_first", "_last"))
    ends = F.when(last < first, "single_drop").when(last > first, "rising").otherwise("stable")
    name = F.when((down == 0) & (up == 0), ends).when(up == 0, F.when(down == 1, "single_drop").otherwise("stairstep_dropping")).when(down == 0, "rising").otherwise("volatile")
    return g.select(*keys, (down + up).alias("changes"), F.round((last - first).cast("decimal(28,10)"), 2).cast("double").alias("total_change"), name.alias("pattern"))


def drops_within(snap: DataFrame, price: str, at: str, keys: list[str], order: list[str], as_of: datetime, days: int, pct: float = 0.0) -> DataFrame:
    """Single drops of at least ``pct`` per cent whose later snapshot is within ``days``. Series untouched in the window are
    left out before the window function; the price before may be older. Rows without a key are a series too."""
    start = F.lit(as_of) - F.make_dt_interval(days=F.lit(days))
    touched = snap.where(F.col(at) >= start).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    s = with_previous(snap.join(touched, same, "left_semi"), price, keys, order)
    drop = (F.col("prev") - F.col(price)) / F.col("prev") * 100
    return s.where((F.col(at) >= start) & (F.col("prev") > F.col(price)) & (F.col("prev") > 0) & (drop >= pct)).withColumn("drop_pct", F.round(drop.cast("decimal(28,10)"), 2).cast("double"))


def field_changes(snap: DataFrame, fields: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """A row per field that differs from the snapshot before: field, before, after as text. First snapshots have none."""
    w = ordered(keys, order)
    s = snap.withColumn("_n", F.row_number().over(w))
    pairs = [F.struct(F.lit(f).alias("field"), F.lag(F.col(f).cast("string")).over(w).alias("before"), F.col(f).cast("string").alias("after")) for f in fields]
    s = s.withColumn("_d", F.array(*pairs)).where("_n > 1")
    return s.select(*keys, *order, F.explode("_d").alias("_x")).select(*keys, *[o for o in order], "_x.*").where(~F.col("before").eqNullSafe(F.col("after")))


def carried(axis: DataFrame, points: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """As-of pick: each axis row with the last known value at or before it, carried forward within the key. Points without a time
    or a key are before no axis row, so rows without either get null."""
    a = axis.select(*keys, at, F.lit(None).cast(points.schema[value].dataType).alias(value), F.lit(1).alias("_axis"))
    p = points.dropna(subset=[*keys, at]).where(F.col(value).isNotNull()).select(*keys, at, value, F.lit(0).alias("_axis"))
    w = Window.partitionBy(*keys).orderBy(at, "_axis").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(p).withColumn("_v", F.last(value, ignorenulls=True).over(w)).where("_axis = 1").select(*keys, at, F.col("_v").alias(value))


def islands(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Runs of equal state: state, run number, first and last of the leading order column, rows."""
    w = ordered(keys, order)
    started = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("_start", started).withColumn("run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run", state).agg(F.min(order[0]).alias("run_from"), F.max(order[0]).alias("run_to"), F.count("*").alias("n"))


def oscillation(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Per series: runs, changes (runs after the first) and returns (runs of a value seen before)."""
    r = islands(df, keys, order, value)
    return r.groupBy(*keys).agg(F.count("*").alias("runs"), (F.count("*") - 1).alias("changes"), (F.count("*") - F.countDistinct(value)).alias("returns"))


def active_by_day(life: DataFrame, start: str, end: str, days: DataFrame, group: list[str]) -> DataFrame:
    """Rows active and new on each day. A lifetime counts from its start to its end; running sums over daily starts and ends
    take the place of a join of days with lifetimes."""
    s = life.select(*group, F.to_date(start).alias("day"), F.lit(1).alias("_d"), F.lit(1).alias("_new"))
    e = life.select(*group, F.date_add(F.to_date(end), 1).alias("day"), F.lit(-1).alias("_d"), F.lit(0).alias("_new"))
    delta = s.unionByName(e).groupBy(*group, "day").agg(F.sum("_d").alias("_d"), F.sum("_new").alias("_new"))
    axis = life.select(*group).distinct().join(F.broadcast(days), how="cross").withColumn("_axis", F.lit(1))
    both = delta.withColumn("_axis", F.lit(0)).unionByName(axis.select(*group, "day", F.lit(0).cast("long").alias("_d"), F.lit(0).cast("long").alias("_new"), "_axis"))
    daily = both.groupBy(*group, "day").agg(F.sum("_d").alias("_d"), F.sum("_new").alias("new"), F.max("_axis").alias("_axis"))
    w = Window.partitionBy(*group).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("active", F.sum("_d").over(w)).where("_axis = 1").select(*group, "day", "active", "new")


def total_order_rank(keys: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
