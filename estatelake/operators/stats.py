"""Cohort statistics: distributions, boxes, bands, velocity, freshness and confidence."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..storage import forget, written

BOX = (0.25, 0.5, 0.75)
#: Cut points of the seven price bands.
BAND_CUTS = (0.10, 0.25, 0.45, 0.55, 0.75, 0.90)


def rounded_percentile(column: str | Column, p: float) -> Column:
    """Interpolated percentile as a whole number, halves to even."""
    return F.bround(F.percentile(column, p), 0).cast("long")


def points(column: str | Column, at: tuple[float, ...]) -> Column:
    """Interpolated percentiles as an array, from one pass over one map of values."""
    return F.percentile(column, list(at))


def global_points(df: DataFrame, columns: dict[str, Column], at: tuple[float, ...]) -> dict[str, list[float | None]]:
    """Exact interpolated percentiles of a whole frame's columns, as numbers: counts per value are dealt out by ranges of the
    value, the ranges' sums (one a partition and column) say which range holds each rank, and only these ranges are summed up
    value by value. One scan, and no task holds all values. Nones for a column without values."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, c in columns.items()]))
    counts = df.select(each.alias("e")).select("e.*").where("v is not null and not isnan(v)").groupBy("name", "v").agg(F.count("*").alias("n"))
    dealt = written(counts.repartitionByRange("name", "v").withColumn("part", F.spark_partition_id()), "counts")
    sums = dealt.groupBy("name", "part").agg(F.sum("n").alias("n")).orderBy("name", "part").collect()
    out: dict[str, list[float | None]] = {n: [None] * len(at) for n in columns}
    needed, ranks = [], {}
    for name in columns:
        mine, total = [], 0
        for r in sums:
            if r["name"] == name:
                mine.append((total, r["part"], r["n"]))
                total += r["n"]
        ranks[name] = [(total - 1) * p for p in at] if total else []
        wanted = sorted({int(k) for r in ranks[name] for k in (math.floor(r), math.ceil(r))})
        needed += [(name, part, first, [k for k in wanted if first <= k < first + n]) for first, part, n in mine if any(first <= k < first + n for k in wanted)]
    if needed:
        # a row for each rank at most, on either side
        of = df.sparkSession.createDataFrame(needed, "name string, part int, first long, wanted array<long>")
        summed = dealt.join(F.broadcast(of), ["name", "part"]).withColumn("upto", F.col("first") + F.sum("n").over(Window.partitionBy("name", "part").orderBy("v")))
        hit = F.exists("wanted", lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("n")))
        found = sorted((r["name"], r["upto"], r["v"]) for r in summed.where(hit).select("name", "upto", "v").collect())
        for name, rs in ranks.items():
            at_rank = lambda k: next(v for n, end, v in found if n == name and k < end)  # noqa: B023, E731
            if rs:
                out[name] = [(math.ceil(r) - r) * at_rank(math.floor(r)) + (r - math.floor(r)) * at_rank(math.ceil(r)) if r != int(r) else at_rank(int(r)) for r in rs]
    forget(dealt)
    return out


def distribution(df: DataFrame, field: str, keys: list[str]) -> DataFrame:
    """Per group: n, min, max, mean, median; from five values on also p10, p25, p75, p90, sample deviation and iqr."""
    v = F.col(field).cast("double")
    g = df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), points(v, (0.5, 0.1, 0.25, 0.75, 0.9)).alias("_p"), F.stddev_samp(v).alias("_s"))
    many = F.col("n") >= 5
    at = {n: F.when(many, F.col("_p")[i]).alias(n) for i, n in ((1, "p10"), (2, "p25"), (3, "p75"), (4, "p90"))}
    return g.select(*keys, "n", "min", "max", "mean", F.col("_p")[0].alias("median"), *at.values(), F.when(many, F.col("_s")).alias("stddev"), F.when(many, F.col("_p")[3] - F.col("_p")[2]).alias("iqr"))


def outliers(df: DataFrame, field: str, keys: list[str], need_spread: bool = False) -> DataFrame:
    """Rows farther from their group's median than 1.5 iqr (strictly); groups of under five have none. ``need_spread``
    leaves out groups whose iqr is 0. Adds median and iqr."""
    d = distribution(df, field, keys).select(*[F.col(k).alias(f"_{k}") for k in keys], "median", "iqr")
    on = [df[k].eqNullSafe(d[f"_{k}"]) for k in keys]
    out = df.join(d, on).where(F.abs(F.col(field).cast("double") - F.col("median")) > 1.5 * F.col("iqr"))
    out = out.where("iqr > 0") if need_spread else out
    return out.drop(*[f"_{k}" for k in keys])


def outlier_reasons(found: DataFrame, field: str, failures: DataFrame, history: DataFrame, key: str, long_days: int = 90) -> DataFrame:
    """Outliers with their deviation in iqr units, direction and reasons: statistical_outlier always, fetch_failures where
    ``failures`` (key, attempts) has some, stairstep_dropping and long_time_on_market by ``history`` (key, pattern, tom_days)."""
    j = found.join(failures.select(key, "attempts"), key, "left").join(history.select(key, "pattern", "tom_days"), key, "left")
    off = F.when(F.col("iqr") > 0, (F.col(field) - F.col("median")) / F.col("iqr")).otherwise(0.0)
    reasons = [F.lit("statistical_outlier"), F.when(F.col("attempts") > 0, "fetch_failures"), F.when(F.col("pattern") == "stairstep_dropping", "stairstep_dropping"), F.when(F.col("tom_days") > long_days, "long_time_on_market")]
    out = j.withColumn("deviation", F.round(off, 4)).withColumn("direction", F.when(F.col(field) > F.col("median"), "high").otherwise("low"))
    return out.withColumn("reasons", F.array_compact(F.array(*reasons))).drop("attempts", "pattern", "tom_days")


def whole(point: Column) -> Column:
    """A percentile as a whole number, halves to even."""
    return F.bround(point, 0).cast("long")


def boxes(df: DataFrame, field: str, keys: list[str], least: int = 1) -> DataFrame:
    """Quartiles as whole numbers per group of at least ``least`` values."""
    v = F.col(field)
    g = df.groupBy(*keys).agg(F.count(v).alias("n"), points(v, BOX).alias("_p")).where(F.col("n") >= least)
    return g.select(*keys, "n", *[whole(F.col("_p")[i]).alias(f"p{int(p * 100)}") for i, p in enumerate(BOX)])


def browse_stats(df: DataFrame, as_of: datetime) -> DataFrame:
    """One row: total, new in 7 and 30 days, quartiles of price and of price per m2."""
    first, ppm = F.col("first_seen_at"), values.price_per_m2(F.col("price_czk"), F.col("area_m2"))
    new = lambda days, name: F.count(F.when(first >= F.lit(as_of) - F.make_dt_interval(days=F.lit(days)), 1)).alias(name)
    boxes_ = global_points(df, {"price": F.col("price_czk"), "ppm": ppm}, BOX)
    one = df.agg(F.count("*").alias("total"), new(7, "new_7d"), new(30, "new_30d"))
    return one.select("*", *[whole(F.lit(v).cast("double")).alias(f"{n}_p{int(p * 100)}") for n, at in boxes_.items() for p, v in zip(BOX, at, strict=True)])


def price_band_velocity(df: DataFrame, price: str = "price_czk", tom: str = "tom_days") -> DataFrame:
    """Seven bands cut at percentiles of price: n, share, price range and the box of time on market. A price on a cut
    belongs to the lower band; empty bands keep a row."""
    priced = df.where(F.col(price).isNotNull())
    cuts = [c for c in global_points(priced, {"price": F.col(price)}, BAND_CUTS)["price"] if c is not None]
    band = sum((F.when(F.col(price) > c, 1).otherwise(0) for c in cuts), F.lit(1))
    total = priced.count()
    agg = priced.groupBy(band.alias("band")).agg(
        F.count("*").alias("n"),
        F.round(F.count("*") / F.lit(total), 4).alias("share"),
        F.min(price).alias("price_min"),
        F.max(price).alias("price_max"),
        points(tom, BOX).alias("_tom"),
    )
    agg = agg.select("band", "n", "share", "price_min", "price_max", *[whole(F.col("_tom")[i]).alias(f"tom_p{int(p * 100)}") for i, p in enumerate(BOX)])
    bands = df.sparkSession.range(1, len(BAND_CUTS) + 2).select(F.col("id").cast("int").alias("band"))
    return bands.join(agg, "band", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def mix(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Shares of each value within the group, four decimals; null is a value."""
    n = df.groupBy(*keys, column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), 4))


def mix_map(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """The mix as one map a group."""
    m = mix(df, column, keys).where(F.col(column).isNotNull())
    return m.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "share")))).alias("mix"))


def market_velocity(df: DataFrame, keys: list[str], as_of: datetime, split_days: int = 7) -> DataFrame:
    """Per group of rows with tom_days and first_seen_at: n, mean, percentiles (for any n), and the medians of rows first seen
    within the last ``split_days`` and before."""
    recent = F.col("first_seen_at") > F.lit(as_of) - F.make_dt_interval(days=F.lit(split_days))
    t = F.col("tom_days").cast("double")
    at = (0.1, 0.25, 0.5, 0.75, 0.9)
    g = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.bround(F.avg(t), 2).alias("mean"),
        points(t, at).alias("_p"),
        F.bround(F.percentile(F.when(recent, t), 0.5), 2).alias("recent_median"),
        F.bround(F.percentile(F.when(~recent, t), 0.5), 2).alias("older_median"),
    )
    return g.select(*keys, "n", "mean", *[F.bround(F.col("_p")[i], 2).alias(f"p{int(p * 100)}") for i, p in enumerate(at)], "recent_median", "older_median")


def listing_velocity(df: DataFrame, key: str, peers: list[str], tom: str = "tom_days") -> DataFrame:
    """Each row's mid-rank percentile of time on market among its peers (itself aside) and its class. Ranks come from a
    count per value, so a peer group is never gathered in rows."""
    counts = df.groupBy(*peers, tom).agg(F.count("*").alias("_eq"))
    w = Window.partitionBy(*peers).orderBy(tom)
    ranked = counts.withColumn("_lt", F.sum("_eq").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_n", F.sum("_eq").over(Window.partitionBy(*peers)))
    joined = df.join(ranked, [*peers, tom])
    n, lt, eq = F.col("_n") - 1, F.coalesce("_lt", F.lit(0)), F.col("_eq") - 1
    pct = F.when(n > 0, F.bround(100 * (lt + 0.5 * eq) / n, 2))
    return joined.select(key, *peers, tom, n.alias("n_peers"), pct.alias("percentile"), velocity_class(pct).alias("class"))


def velocity_class(pct: Column) -> Column:
    return F.when(pct >= 90, "stuck").when(pct >= 75, "slow").when(pct <= 25, "fast").when(pct.isNotNull(), "typical")


def freshness(df: DataFrame, keys: list[str], age: str = "age_days", verified: str = "verified_at") -> DataFrame:
    """Per group: least, median and greatest age, and rows never verified."""
    return df.groupBy(*keys).agg(F.min(age).alias("min_age"), F.bround(F.percentile(age, 0.5), 2).alias("median_age"), F.max(age).alias("max_age"), F.count(F.when(F.col(verified).isNull(), 1)).alias("unverified"))


def confidence(n: Column, iqr: Column, median: Column, median_age: Column, stale_share: Column) -> Column:
    """high, medium or low; a stale cohort is one level lower, one that is stale for the most part low."""
    spread = F.try_divide(iqr, median)
    level = F.when((n >= 20) & (spread < 0.25), 2).when((n >= 10) & (spread.isNull() | (spread < 0.4)), 1).otherwise(0)
    level = F.when(stale_share > 0.5, 0).when(median_age > 14, F.greatest(level - 1, F.lit(0))).otherwise(level)
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), level.cast("int") + 1)


def _confidence_of(n: Column, p: Column) -> Column:
    return confidence(n, F.when(n < 5, None).otherwise(p[2] - p[0]), p[1], F.col("_age"), F.col("_stale"))


def _aged(df: DataFrame, value: Column, keys: list[str]) -> DataFrame:
    """Per group: n, quartiles of a value, and the median and greatest age and the share of rows beyond 14 days."""
    return df.withColumn("_v", value).groupBy(*keys).agg(F.count("_v").alias("n"), points("_v", BOX).alias("_p"), F.percentile("age_days", 0.5).alias("_age"), F.max("age_days").alias("_oldest"), F.avg(F.when(F.col("age_days") > 14, 1.0).otherwise(0.0)).alias("_stale"))


def estimate(df: DataFrame, keys: list[str], subject_area: float) -> DataFrame:
    """Comparable-based estimate per group: median price per m2 scaled to the subject's area, its range and confidence."""
    base = _aged(df, values.price_per_m2(F.col("price_czk"), F.col("area_m2")), keys)
    money = lambda i: F.bround(F.col("_p")[i] * subject_area, 0).cast("long")
    return base.select(*keys, "n", money(0).alias("low"), money(1).alias("estimate"), money(2).alias("high"), _confidence_of(F.col("n"), F.col("_p")).alias("confidence"))


#: What an estimate warns of, in this order.
WARNINGS = ("small sample", "cohort data is stale", "more than half of comparables have not been seen in over 14 days", "oldest comparable is over 30 days old", "comparables verified during this estimate")


def estimate_yield(sales: DataFrame, rents: DataFrame, keys: list[str], subject_area: float, verified: Column | None = None) -> DataFrame:
    """Per group a price and a rent from comparables for sale and for rent, both as ``estimate`` gives them, the gross yield of
    the two, the confidence of the rent's comparables and what they warn of. A group without either side has nulls there.
    ``verified``: a condition on rents that were looked at again for this estimate.
    """
    p = estimate(sales, keys, subject_area).select(*keys, F.col("n").alias("n_sales"), F.col("estimate").alias("price"))
    ppm = values.price_per_m2(F.col("price_czk"), F.col("area_m2"))
    seen = rents.withColumn("_seen", F.lit(False) if verified is None else verified)
    r = _aged(seen, ppm, keys).join(seen.groupBy(*keys).agg(F.count(F.when(F.col("_seen"), 1)).alias("_verified")), keys)
    money = lambda i: F.bround(F.col("_p")[i] * subject_area, 0).cast("long")
    raised = (F.col("n") < 10, F.col("_age") > 14, F.col("_stale") > 0.5, F.col("_oldest") > 30, F.col("_verified") > 0)
    warnings = F.array_compact(F.array(*[F.when(c, w) for c, w in zip(raised, WARNINGS, strict=True)]))
    r = r.select(*keys, F.col("n").alias("n_rents"), money(0).alias("rent_low"), money(1).alias("rent"), money(2).alias("rent_high"), _confidence_of(F.col("n"), F.col("_p")).alias("confidence"), warnings.alias("warnings"))
    return p.join(r, keys, "full").withColumn("yield_pct", values.gross_yield_pct(F.col("rent"), F.col("price")))


def relaxation_counts(df: DataFrame, steps: list[tuple[str, Column]], least: int = 5) -> DataFrame:
    """For a ladder of predicates (name, condition) in one scan: each step's count and whether it is the first that reaches
    ``least`` (or the last)."""
    counts = df.agg(*[F.count(F.when(c, 1)).alias(f"_{i}") for i, (_, c) in enumerate(steps)])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"_{i}").alias("n")) for i, (name, _) in enumerate(steps)]))
    ladder = counts.select(rows.alias("r")).select("r.*")
    first = F.min(F.when((F.col("n") >= least) | (F.col("step") == len(steps) - 1), F.col("step"))).over(Window.partitionBy(F.lit(0)))
    return ladder.withColumn("chosen", F.col("step") == first)
