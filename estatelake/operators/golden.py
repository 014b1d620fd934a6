"""Golden records: best value per field by rank, child rollups, merges and their ledger, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def survivors(children: DataFrame, key: str, fields: list[str], order: list[Column]) -> DataFrame:
    """Per parent the best known value of each field: the first non-null one by ``order`` (smallest wins; it must be total).
    One grouping, whatever the number of fields."""
    c = children.withColumn("_o", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return c.groupBy(key).agg(*[F.expr(f"min_by({f}, _o) FILTER (WHERE {f} IS NOT NULL)").alias(f) for f in fields])


def representative(children: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first child of each parent by ``order``, with all its columns."""
    w = Window.partitionBy(key).orderBy(*order)
    return children.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def child_rollup(children: DataFrame, key: str, active: str, source: str, first: str, last: str) -> DataFrame:
    return children.groupBy(key).agg(F.bool_or(active).alias("any_active"), F.count("*").alias("n_children"), F.countDistinct(source).alias("n_sources"), F.min(first).alias("first_seen"), F.max(last).alias("last_seen"))


def amenities(children: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Three-valued OR: true if any child says so, false if one says no and none yes, null if none says anything."""
    return children.groupBy(key).agg(*[F.bool_or(f).alias(f) for f in flags])


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row that ``order`` (descending, nulls last spelled by the caller) puts first, per key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def with_latest(df: DataFrame, history: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each row with its newest history row's columns (null without one): aggregated before the join."""
    last = history.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    return df.join(last, key, "left").select(*df.columns, *[F.col(f"_last.{c}").alias(f"latest_{c}") for c in columns])


def merge_chain(merges: DataFrame, child: str = "merged_id", parent: str = "into_id", depth: int = 20) -> DataFrame:
    """(node, survivor) of merge chains, followed for ``depth`` merges at most: a longer chain, or a ring, gives the node that
    many steps on. By pointer doubling, so that it takes two joins for each binary digit of ``depth``."""
    step = merges.select(F.col(child).alias("node"), F.col(parent).alias("survivor")).distinct()

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        on = second.select(F.col("node").alias("_n"), F.col("survivor").alias("_s"))
        return first.join(on, F.col("survivor") == F.col("_n"), "left").select("node", F.coalesce("_s", "survivor").alias("survivor"))

    out = None
    while depth:
        if depth & 1:
            out = step if out is None else then(out, step)
        depth >>= 1
        if depth:
            step = then(step, step)
    return out


def apply_ledger(members: DataFrame, ledger: DataFrame, key: str = "property_id") -> DataFrame:
    """Members with their parent after all merges that weren't undone."""
    live = merge_chain(ledger.where("NOT undone"))
    j = members.join(live.select(F.col("node").alias(key), "survivor"), key, "left")
    return j.withColumn(key, F.coalesce("survivor", key)).drop("survivor")


def ledger_groups(ledger: DataFrame) -> DataFrame:
    """Per merge group: rows, whether all are undone, the ids merged in order."""
    return ledger.groupBy("group_id").agg(F.count("*").alias("n"), F.bool_and("undone").alias("all_undone"), F.sort_array(F.collect_set("merged_id")).alias("merged"))


def dominant_label(df: DataFrame, key: str, label: str, share: float = 0.6) -> DataFrame:
    """The most frequent label of each key where its share is at least ``share``; ties go to the smaller label."""
    n = df.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    r = n.withColumn("_total", F.sum("n").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.desc("n"), F.asc(label))))
    return r.where((F.col("_rn") == 1) & (F.col("n") >= share * F.col("_total"))).select(key, label, F.round(F.col("n") / F.col("_total"), 4).alias("share"))


def carry_operator_state(state: DataFrame, mapping: DataFrame, key: str, values: list[str]) -> DataFrame:
    """State rows re-pointed to survivors, one row per (survivor, values), null-safely."""
    j = state.join(mapping.select(F.col("node").alias(key), "survivor"), key, "left")
    return j.withColumn(key, F.coalesce("survivor", key)).select(key, *values).distinct()


def most_advanced(cards: DataFrame, key: str, terminal: str, position: str, at: str, card: str) -> DataFrame:
    """Of a survivor's cards: live beats terminal, then the farther position, then the newer, then the larger id."""
    return cards.groupBy(key).agg(F.max_by(F.struct(card, position, terminal), F.struct((~F.col(terminal)).alias("a"), F.col(position).alias("b"), F.col(at).alias("c"), F.col(card).alias("d"))).alias("_b")).select(key, "_b.*")


def fill_from_siblings(df: DataFrame, group: str, score: str, genuine: str, order: list[str]) -> DataFrame:
    """Missing scores take the best genuine sibling's (the newest by ``order``); adds propagated."""
    best = df.where(F.col(genuine) & F.col(score).isNotNull()).groupBy(group).agg(F.max_by(score, F.struct(*order)).alias("_best"))
    j = df.join(best, group, "left")
    return j.withColumn("propagated", F.col(score).isNull() & F.col("_best").isNotNull()).withColumn(score, F.coalesce(score, "_best")).drop("_best")


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], preserve: list[str] = (), once: list[str] = ()) -> DataFrame:
    """Current rows replaced by the batch's: columns in ``preserve`` keep their value where the batch has null, columns in
    ``once`` keep the first value ever set."""
    b = batch.select(*keys, *[F.col(c).alias(f"_{c}") for c in batch.columns if c not in keys], F.lit(True).alias("_new"))
    j = current.join(b, keys, "full")

    def pick(c: str) -> Column:
        if c in keys:
            return F.col(c)
        new = F.col(f"_{c}")
        if c in once:
            return F.coalesce(F.col(c), new).alias(c)
        if c in preserve:
            return F.coalesce(new, F.col(c)).alias(c)
        return F.when(F.col("_new"), new).otherwise(F.col(c)).alias(c)

    return j.select(*[pick(c) for c in current.columns])


def update_from(current: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Current rows with ``columns`` taken from the source's row of their key, where there is one (its nulls too). The source
    must hold a key once; a key that it repeats is an error rather than a choice by chance."""
    twice = source.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").limit(1)
    if twice.count():
        raise ValueError(f"update_from: the source repeats a key of {keys}")
    s = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_here"))
    j = current.join(s, keys, "left")
    return j.select(*[F.when(F.col("_here"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns])


def mark_inactive(current: DataFrame, seen: DataFrame, keys: list[str], scope: Column, complete: bool) -> DataFrame:
    """Rows of a completely walked scope that were not seen become inactive; an incomplete walk marks nothing."""
    if not complete:
        return current
    j = current.join(seen.select(*keys).distinct().withColumn("_seen", F.lit(True)), keys, "left")
    return j.withColumn("is_active", F.when(scope & F.col("_seen").isNull(), False).otherwise(F.col("is_active"))).drop("_seen")
