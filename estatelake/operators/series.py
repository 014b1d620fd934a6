"""Monthly price series: growth, yields, weighted averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import gross_yield_pct, month_index


def with_month_index(df: DataFrame) -> DataFrame:
    return df.withColumn("m", month_index(F.col("year"), F.col("month")))


def cagr(start: Column, end: Column, months: Column, least_months: float = 12) -> Column:
    """Yearly growth in per cent, two decimals; null under ``least_months`` or for a start that isn't positive."""
    return F.when((months >= least_months) & (start > 0), F.bround((F.pow(end / start, 12 / F.nullif(months, F.lit(0))) - 1) * 100, 2))


def growth(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per series (keys + year, month, price, active_count): endpoints, months between, CAGR, least active count at the ends."""
    s = with_month_index(df).where("price is not null")
    g = s.groupBy(*keys).agg(
        F.min_by(F.struct("m", "price", "active_count"), "m").alias("_s"),
        F.max_by(F.struct("m", "price", "active_count"), "m").alias("_e"),
    )
    months = F.col("_e.m") - F.col("_s.m")
    return g.select(
        *keys,
        F.col("_s.price").alias("start_price"),
        F.col("_e.price").alias("end_price"),
        months.alias("months"),
        cagr(F.col("_s.price"), F.col("_e.price"), months).alias("cagr_pct"),
        F.least(F.col("_s.active_count"), F.col("_e.active_count")).alias("min_active"),
    )


def window_cagr(df: DataFrame, keys: list[str], years: int | None) -> DataFrame:
    """CAGR over the trailing window that ends with the newest month, and the least active count in it; null under a year."""
    s = with_month_index(df).where("price is not null")
    last = s.groupBy(*keys).agg(F.max("m").alias("_last"))
    s = s.join(last, keys)
    s = s if years is None else s.where(F.col("m") >= F.col("_last") - 12 * years)
    g = s.groupBy(*keys).agg(F.min_by("price", "m").alias("_p0"), F.max_by("price", "m").alias("_p1"), (F.max("m") - F.min("m")).alias("months"), F.min("active_count").alias("min_active"))
    return g.select(*keys, "months", cagr(F.col("_p0"), F.col("_p1"), F.col("months")).alias("cagr_pct"), "min_active")


def sale_and_rent(df: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """Monthly pivot: sale and rent price side by side with the gross yield of the month."""
    p = lambda k: F.max(F.when(F.col(kind) == k, F.col("price")))
    m = df.groupBy(*keys, "year", "month").agg(p("sale").alias("sale_price"), p("rent").alias("rent_price"))
    return m.withColumn("gross_yield_pct", gross_yield_pct(F.col("rent_price"), F.col("sale_price")))


def yield_drift(df: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """Yields at the endpoints of both series and their drift in points a year; needs all four ends and a span of 12 months."""
    g = growth(df, [*keys, kind])
    part = lambda k: g.where(F.col(kind) == k).select(*keys, *[F.col(c).alias(f"{k}_{c}") for c in ("start_price", "end_price", "months")])
    j = part("sale").join(part("rent"), keys, "full")
    months = F.greatest("sale_months", "rent_months")
    y0, y1 = gross_yield_pct(F.col("rent_start_price"), F.col("sale_start_price")), gross_yield_pct(F.col("rent_end_price"), F.col("sale_end_price"))
    return j.select(*keys, y0.alias("yield_start"), y1.alias("yield_end"), F.when(months >= 12, F.bround((y1 - y0) / (months / 12), 2)).alias("drift_pp_year"))


def weighted_months(df: DataFrame, keys: list[str]) -> DataFrame:
    """Average of entities per month, weighted by their active count (a missing or zero count weighs one)."""
    w = F.when(F.col("active_count") > 0, F.col("active_count")).otherwise(1)
    g = df.where("price is not null").groupBy(*keys, "year", "month").agg(F.sum(F.col("price") * w).alias("_pw"), F.sum(w).alias("weight"), F.count("*").alias("entities"))
    return g.select(*keys, "year", "month", F.round((F.col("_pw") / F.col("weight")).cast("decimal(28,8)"), 2).cast("double").alias("price"), "weight", "entities")


def reference_rent(df: DataFrame, fine: DataFrame, coarse: DataFrame, fine_key: str, coarse_key: str, fields: list[str]) -> DataFrame:
    """Alternative-key lookup: where the fine dimension has a row all fields come from it, else from the coarse one."""
    f = fine.select(fine_key, F.struct(*fields).alias("_f"))
    c = coarse.select(coarse_key, F.struct(*fields).alias("_c"))
    j = df.join(f, fine_key, "left").join(c, coarse_key, "left")
    picked = F.when(F.col("_f").isNotNull(), F.col("_f")).otherwise(F.col("_c"))
    return j.withColumn("_p", picked).select(*df.columns, *[F.col(f"_p.{x}").alias(x) for x in fields], F.when(F.col("_f").isNotNull(), "fine").when(F.col("_c").isNotNull(), "coarse").alias("matched"))


def latest_revision(df: DataFrame, revision: str = "revision") -> DataFrame:
    """Rows of the newest revision: one value, met by a one-row join."""
    top = df.agg(F.max(revision).alias("_r"))
    return df.join(F.broadcast(top), F.col(revision) == F.col("_r")).drop("_r")


def choropleth(df: DataFrame, keys: list[str], kind: str, kinds: list, value: str) -> DataFrame:
    return df.groupBy(*keys).pivot(kind, kinds).agg(F.max(value))
