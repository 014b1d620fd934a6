"""Data quality and pipeline health: completeness, drift, ladders, queues, funnels, scorecards, costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def completeness(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Long form (field, filled, n, pct) from one grouping."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count(f).alias(f"_c_{f}") for f in fields])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_c_{f}").alias("filled")) for f in fields]))
    return g.select(*keys, "n", rows.alias("_r")).select(*keys, "_r.*", "n").withColumn("pct", F.round(100 * F.col("filled") / F.nullif(F.col("n"), F.lit(0)), 2))


def drift(df: DataFrame, keys: list[str], fields: list[str], fresh: Column) -> DataFrame:
    """Per group the field whose completeness fell most from the base to the fresh rows (points; ties to the smaller name)."""
    g = df.groupBy(*keys).agg(*[F.avg(F.when(fresh, F.col(f).isNotNull().cast("double"))).alias(f"_f_{f}") for f in fields], *[F.avg(F.when(~fresh, F.col(f).isNotNull().cast("double"))).alias(f"_b_{f}") for f in fields])
    rows = F.array(*[F.struct((-(F.col(f"_b_{f}") - F.col(f"_f_{f}"))).alias("d"), F.lit(f).alias("field")) for f in fields])
    worst = F.array_min(F.filter(rows, lambda r: r["d"].isNotNull()))
    return g.select(*keys, worst["field"].alias("worst_field"), F.round(-worst["d"] * 100, 2).alias("drift_pts"))


def ladder(value: Column, passes: float, warns: float, strict: bool = True, null: str = "warn") -> Column:
    """pass below the first bound, warn below the second, else fail; bounds themselves count if not ``strict``."""
    ok = (value < passes) if strict else (value <= passes)
    mid = (value < warns) if strict else (value <= warns)
    return F.when(value.isNull(), null).when(ok, "pass").when(mid, "warn").otherwise("fail")


#: Pass and warn bounds of health checks; cad is the cadence in minutes, negative numbers multiply it.
CHECKS = {
    "liveness": ("minutes_since_walk", -1.5, -3, True),
    "runs_completing": ("stuck_runs", 0, 1, False),
    "delisting_spike": ("max_inactive_run", 500, 2000, False),
    "delisting_latency": ("delisting_p90", 2160, 4320, True),
    "error_rate": ("error_pct", 5, 15, True),
    "snapshot_churn": ("churn", 0.5, 1.5, True),
    "stale_active": ("stale_active", 50, 500, True),
    "field_null_drift": ("drift_pts", 5, 15, True),
    "fetch_failures": ("fetch_failures", 1000, 5000, True),
    "detail_queue_backlog": ("backlog", 2000, 10000, True),
    "detail_queue_lag": ("queue_lag_p90", -1.5, -3, True),
    "property_attach_lag": ("attach_oldest", 30, 90, True),
    "e2e_latency": ("e2e", 90, 240, True),
    "data_freshness": ("minutes_since_freshest", -1, -3, True),
    "index_completeness": ("max_gap_pct", 2, 5, True),
}
#: Checks for which no data is a pass.
NULL_PASSES = ("delisting_latency", "field_null_drift", "detail_queue_lag", "property_attach_lag")


def health_checks(measures: DataFrame, key: str, cadence: str = "cadence") -> DataFrame:
    """Long form (check, value, status) from one row of measures per source; measures the frame lacks give no check."""
    cad = F.coalesce(F.col(cadence), F.lit(60)) if cadence in measures.columns else F.lit(60)
    rows = []
    for name, (column, p, w, strict) in CHECKS.items():
        if column in measures.columns:
            v = F.col(column).cast("double")
            bound = lambda b: cad * -b if b < 0 else F.lit(b)
            status = ladder(v, bound(p), bound(w), strict, "pass" if name in NULL_PASSES else "warn")
            rows.append(F.struct(F.lit(name).alias("check"), v.alias("value"), status.alias("status")))
    if "new_24h" in measures.columns:
        rows.append(F.struct(F.lit("new_listings").alias("check"), F.col("new_24h").cast("double").alias("value"), F.when(F.col("new_24h") > 0, "pass").otherwise("warn").alias("status")))
    return measures.select(key, F.explode(F.array(*rows)).alias("_r")).select(key, "_r.*")


def transitions(status: DataFrame, keys: list[str], at: str, state: str) -> DataFrame:
    """Rows at which the state differs from the one before; first rows are none."""
    w = Window.partitionBy(*keys).orderBy(at)
    return status.withColumn("before", F.lag(state).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(state)))


def queue_lag(df: DataFrame, keys: list[str], enqueued: str, done: str) -> DataFrame:
    """n and the 50th and 90th percentile of minutes between two times."""
    m = (F.unix_timestamp(done) - F.unix_timestamp(enqueued)) / 60.0
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.bround(F.percentile(m, 0.5), 2).alias("p50_min"), F.bround(F.percentile(m, 0.9), 2).alias("p90_min"))


def coverage(df: DataFrame, keys: list[str], tests: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(100.0 * F.count(F.when(c, 1)) / F.nullif(F.count("*"), F.lit(0)), 2).alias(f"{n}_pct") for n, c in tests.items()])


def classify(text: Column, patterns: list[tuple[str, str]], otherwise: str = "other") -> Column:
    """The name of the first pattern that matches."""
    (first, p), *rest = patterns
    return reduce(lambda w, x: w.when(text.rlike(x[1]), x[0]), rest, F.when(text.rlike(p), first)).otherwise(otherwise)


def costs(df: DataFrame, unit: str, at: str, keys: list[str], amount: str) -> DataFrame:
    return df.groupBy(F.date_trunc(unit, at).alias(unit), *keys).agg(F.count("*").alias("calls"), F.round(F.sum(amount), 4).alias("cost"))


def zero_filled(daily: DataFrame, days: DataFrame, day: str, columns: list[str]) -> DataFrame:
    j = days.join(daily, day, "left")
    return j.select(day, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns])


def snapshot_density(snap: DataFrame, key: str, most: int = 10) -> DataFrame:
    """How many series have 1, 2, ... snapshots; the last bucket holds all beyond."""
    return snap.groupBy(key).agg(F.count("*").alias("_n")).groupBy(F.least("_n", F.lit(most)).cast("int").alias("snapshots")).agg(F.count("*").alias("series"))


def last_of_day(df: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    return df.groupBy(*keys, F.to_date(at).alias("day")).agg(*[F.max_by(c, F.struct(at, *columns)).alias(c) for c in columns])


def funnel(df: DataFrame, keys: list[str], stages: list[tuple[str, Column]], id_: str) -> DataFrame:
    """Distinct ids that satisfy each stage and all before it."""
    cum, out = F.lit(True), []
    for name, c in stages:
        cum = cum & c
        out.append(F.countDistinct(F.when(cum, F.col(id_))).alias(name))
    return df.groupBy(*keys).agg(*out) if keys else df.agg(*out)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row on two raters: pairs, exact and within one (per cent), mean absolute difference, bias, disagreements over two."""
    d = F.col(a) - F.col(b)
    p = df.where(d.isNotNull())
    return p.agg(
        F.count("*").alias("n"),
        F.bround(100 * F.avg((d == 0).cast("double")), 2).alias("exact_pct"),
        F.bround(100 * F.avg((F.abs(d) <= 1).cast("double")), 2).alias("within1_pct"),
        F.bround(F.avg(F.abs(d).cast("double")), 4).alias("mean_abs"),
        F.bround(F.avg(d.cast("double")), 4).alias("bias"),
        F.count(F.when(F.abs(d) > 2, 1)).alias("hard"),
    )


def scorecard(df: DataFrame, keys: list[str], truth: str, asserted: str) -> DataFrame:
    """Precision among asserted rows and yield among determinable ones (those with a truth)."""
    known, said = F.col(truth).isNotNull(), F.col(asserted).isNotNull()
    hit = known & said & (F.col(truth) == F.col(asserted))
    c = lambda x: F.count(F.when(x, 1))
    return df.groupBy(*keys).agg(c(known).alias("determinable"), c(said & known).alias("asserted"), c(hit).alias("matches"), F.round(100.0 * c(hit) / F.nullif(c(said & known), F.lit(0)), 2).alias("precision_pct"), F.round(100.0 * c(hit) / F.nullif(c(known), F.lit(0)), 2).alias("yield_pct"))


def load_assertions(now: DataFrame, before: DataFrame, low: float = 0.9, high: float = 1.5, slack: int = 100) -> DataFrame:
    """(name, n, was, verdict) of row counts (name, n) against the load before: missing, shrunk, grown, new or ok."""
    j = now.select("name", F.col("n").cast("long").alias("n")).join(before.select("name", F.col("n").cast("long").alias("was")), "name", "full")
    n, was = F.col("n"), F.col("was")
    verdict = F.when(n.isNull(), "missing").when(was.isNull(), "new").when(n + slack < low * was, "shrunk").when(n > high * was + slack, "grown").otherwise("ok")
    return j.withColumn("verdict", verdict)


def top_spenders(df: DataFrame, key: str, amount: str, most: int = 10) -> DataFrame:
    """The keys with the largest sums, with their share of the whole."""
    total = df.agg(F.sum(amount).alias("_total"))
    g = df.groupBy(key).agg(F.round(F.sum(amount), 4).alias("spent"), F.count("*").alias("calls"))
    return g.join(F.broadcast(total)).select(key, "spent", "calls", F.round(F.col("spent") / F.col("_total"), 6).alias("share")).orderBy(F.desc("spent"), key).limit(most)


def storage_projection(daily: DataFrame, day: str, size: str, days: int) -> DataFrame:
    """One row: days seen, mean bytes a day, and the bytes that ``days`` more would add at that rate."""
    one = daily.agg(F.count(day).alias("days"), F.avg(F.col(size).cast("double")).alias("_mean"))
    return one.select("days", F.bround("_mean", 2).alias("bytes_a_day"), F.bround(F.col("_mean") * days, 0).cast("long").alias("projected"))


def failures(df: DataFrame, keys: list[str], at: str, ok: str) -> DataFrame:
    """Per group: failures, the first and last of them, and the latest conclusion."""
    bad = ~F.col(ok)
    return df.groupBy(*keys).agg(F.count(F.when(bad, 1)).alias("failures"), F.min(F.when(bad, F.col(at))).alias("first_failure"), F.max(F.when(bad, F.col(at))).alias("last_failure"), F.max_by(ok, F.struct(at, ok)).alias("latest_ok"))


def burn_rate(daily: DataFrame, keys: list[str], day: str, amount: str, days: int = 7) -> DataFrame:
    """Trailing sum over the last ``days`` rows of each key's daily series."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(1 - days, 0)
    return daily.withColumn(f"burn_{days}d", F.round(F.sum(amount).over(w), 4))


def quality_buckets(radius: Column, kind: Column) -> Column:
    """none, precise, area or approximate from an uncertainty radius and the kind of source."""
    return F.when(radius.isNull(), "none").when(kind.isin("registry", "pin") & (radius <= 30), "precise").when(kind.isin("centroid", "area"), "area").when(radius <= 300, "approximate").otherwise("area")


def version_cap(df: DataFrame, keys: list[str], ok: str, seq: str, id_: str, cap: int) -> DataFrame:
    """Versions to keep: successes first, newest first."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ok), F.col(seq).desc_nulls_last(), F.desc(id_))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def epoch_changes(before: DataFrame, now: DataFrame, keys: list[str], state: str) -> DataFrame:
    """Keys whose state differs between two aggregates, appearing and vanishing ones included."""
    a, b = before.select(*keys, F.col(state).alias("before")), now.select(*keys, F.col(state).alias("now"))
    return a.join(b, keys, "full").where(~F.col("before").eqNullSafe(F.col("now")))


def windowed_counts(df: DataFrame, keys: list[str], ids: list[str], at: str, as_of: Column, days: tuple[int, ...] = (7, 30), sums: tuple[str, ...] = ()) -> DataFrame:
    """Per group the distinct values of each of ``ids`` seen in the last so many days, and the sums of ``sums``: columns like id_7d.
    A value counts in a window if it was seen last within it, so a single grouping by value serves all windows; nulls don't count,
    and rows older than the longest window are left out."""
    kinds = [F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value"), *[(F.col(s) if i == 0 else F.lit(None)).cast("double").alias(s) for s in sums]) for i, c in enumerate(ids)]
    since = lambda d: as_of - F.make_dt_interval(days=F.lit(d))
    rows = df.where(F.col(at) >= since(max(days))).select(*keys, F.col(at).alias("_at"), F.explode(F.array(*kinds)).alias("_r")).select(*keys, "_at", "_r.*")
    parts = [F.sum(F.when(F.col("_at") >= since(d), F.col(s))).alias(f"_{s}_{d}") for s in sums for d in days]
    g = rows.groupBy(*keys, "kind", "value").agg(F.max("_at").alias("_at"), *parts)
    counts = [F.count(F.when((F.col("kind") == c) & F.col("value").isNotNull() & (F.col("_at") >= since(d)), 1)).alias(f"{c}_{d}d") for c in ids for d in days]
    totals = [F.round(F.coalesce(F.sum(f"_{s}_{d}"), F.lit(0.0)), 4).alias(f"{s}_{d}d") for s in sums for d in days]
    return g.groupBy(*keys).agg(*counts, *totals)


def resolutions(audit: DataFrame, keys: list[str], as_of: Column, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """The funnel's outcomes: of audited pairs (id, run_at, left_property, left_listing, right_property, right_listing) the distinct
    pairs, and the distinct properties and listings of either side, by ``keys`` and window."""
    sides = F.explode(F.array(*[F.struct(F.col(f"{s}_property").alias("properties"), F.col(f"{s}_listing").alias("listings")) for s in ("left", "right")]))
    rows = audit.select(*keys, "run_at", F.col("id").alias("pairs"), sides.alias("_s")).select(*keys, "run_at", "pairs", "_s.*")
    return windowed_counts(rows, keys, ["pairs", "properties", "listings"], "run_at", as_of, days)


def flow_counters(runs: DataFrame, counters: list[str], gauges: list[str], at: str, id_: str, as_of: Column, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """One row: runs and the sums of their counters by window, and the gauges of the latest run that has the first of them (a
    gauge is a state, never summed)."""
    since = lambda d: F.col(at) >= as_of - F.make_dt_interval(days=F.lit(d))
    sums = [F.coalesce(F.sum(F.when(since(d), F.col(c))), F.lit(0)).alias(f"{c}_{d}d") for c in counters for d in days]
    latest = [F.max_by(F.when(F.col(gauges[0]).isNotNull(), F.struct(*gauges)), F.when(F.col(gauges[0]).isNotNull(), F.col(id_))).alias("_g")] if gauges else []
    out = runs.agg(*[F.count(F.when(since(d), 1)).alias(f"runs_{d}d") for d in days], *sums, *latest)
    return out.select(*[c for c in out.columns if c != "_g"], *[F.col(f"_g.{g}").alias(g) for g in gauges])


def unattributed(ledger: DataFrame, linked: DataFrame, key: str, call: str, cost: str) -> DataFrame:
    """Per kind of call the whole cost, the part whose calls are linked to a category, and the rest."""
    known = linked.where(F.col(call).isNotNull()).select(call).distinct().withColumn("_known", F.lit(True))
    j = ledger.join(known, call, "left").groupBy(key).agg(F.round(F.sum(cost), 4).alias("total"), F.round(F.coalesce(F.sum(F.when(F.col("_known"), F.col(cost))), F.lit(0.0)), 4).alias("attributed"))
    return j.withColumn("unattributed", F.round(F.col("total") - F.col("attributed"), 4))
