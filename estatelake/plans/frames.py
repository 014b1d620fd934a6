"""Stand-in frames over the driver's tables, and the same frames as SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values

AS_OF = datetime(2001, 8, 1)
AS_OF_SQL = "TIMESTAMP '2001-08-01 00:00:00'"
DISPOSITIONS = [f"{n}+{k}" for n in range(1, 6) for k in ("kk", "1")]
FURNISHED = ["ano", "ne", "castecne", None, "jine"]
BUILDINGS = ["cihla", "panel", "smisena", "skelet", "drevo", "kamen", "montovana", None]


def of(values: list, number) -> F.Column:
    """The entry of a short list that a number points at, by its remainder."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (number % len(values) + 1).cast("int"))


def of_sql(values: list, number: str) -> str:
    items = ", ".join("CAST(NULL AS VARCHAR)" if v is None else f"'{v}'" for v in values)
    return f"list_extract([{items}], CAST({number} % {len(values)} + 1 AS INT))"


class Frames:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def listing(self) -> DataFrame:
        k = F.col("o_orderkey")
        places = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
        people = self.table("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows at any scale
        j = self.table("orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
        return j.select(
            k.alias("id"),
            F.col("o_custkey").alias("property_id"),
            F.col("o_totalprice").alias("price_czk"),
            (20 + k % 130).cast("int").alias("area_m2"),
            F.col("c_mktsegment").alias("category_main"),
            F.col("o_orderpriority").alias("source"),
            F.col("n_name").alias("district"),
            F.col("r_name").alias("region"),
            (48.5 + (F.col("o_custkey") * 37 % 250) / 100.0).alias("lat"),
            (12.1 + (F.col("o_custkey") * 53 % 670) / 100.0).alias("lng"),
            F.col("o_orderdate").alias("first_seen_at"),
            (F.col("o_orderdate") + F.make_dt_interval(days=(k % 200).cast("int"))).alias("last_seen_at"),
            (F.col("o_orderstatus") == "O").alias("is_active"),
            of(DISPOSITIONS, k).alias("disposition"),
            (k % 9).cast("int").alias("floor"),
            of(FURNISHED, k).alias("furnished"),
            of(BUILDINGS, k).alias("building_type"),
            F.when(k % 7 != 0, k % 7).cast("int").alias("parking_lots"),
            F.when(k % 4 != 3, k % 4 == 0).alias("has_lift"),
            ((k % 41) - 20).cast("double").alias("total_price_change_pct"),
            (k % 5).cast("int").alias("price_changes"),
            (k % 2).cast("int").alias("price_changes_30d"),
            (k % 3).cast("int").alias("price_changes_90d"),
            (k % 4).cast("int").alias("price_changes_365d"),
            (k % 40).cast("int").alias("age_days"),
            F.when(k % 6 != 0, F.col("o_orderdate")).alias("verified_at"),
        )

    @cached_property
    def listing_np(self) -> DataFrame:
        """Every eleventh listing has no price, every thirteenth no area."""
        return self.listing.withColumn("price_czk", F.when(F.col("id") % 11 != 0, F.col("price_czk"))).withColumn("area_m2", F.when(F.col("id") % 13 != 0, F.col("area_m2")).otherwise(0))

    @cached_property
    def snapshot(self) -> DataFrame:
        s = self.table("lineitem").select(F.col("l_partkey").alias("listing_id"), F.col("l_shipdate").alias("scraped_at"), F.col("l_orderkey").alias("o1"), F.col("l_linenumber").alias("o2"), values.round_binary(values.ratio(F.col("l_extendedprice"), F.col("l_quantity")), 2).alias("price"), F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"))
        return s.withColumn("price", F.when(F.col("o1") % 17 != 0, values.floor_double(F.col("price") / 50) * 50.0))

    @cached_property
    def child(self) -> DataFrame:
        """Children of properties: part by supplier."""
        s = F.col("l_suppkey")
        return (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("property_id"), s.alias("child_id"))
            .agg(F.max("l_shipdate").alias("last_seen"), F.min("l_shipdate").alias("first_seen"), F.max("l_quantity").alias("qty"))
            .withColumn("trust", (F.col("child_id") % 10).cast("int"))
            .withColumn("active", F.col("child_id") % 3 == 0)
            .withColumn("source", F.concat(F.lit("s"), (F.col("child_id") % 4).cast("string")))
            .withColumn("area", F.when(F.col("child_id") % 5 != 0, F.col("qty")))
            .withColumn("street", F.when(F.col("child_id") % 7 != 0, F.concat(F.lit("street "), (F.col("child_id") % 6).cast("string"))))
            .withColumn("lift", F.when(F.col("child_id") % 3 != 2, F.col("child_id") % 3 == 0))
        )

    @cached_property
    def monthly(self) -> DataFrame:
        """Monthly series by nation and kind; rents are a thousandth of the even orders' prices."""
        o = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        o = o.withColumn("kind", F.when(F.col("o_orderkey") % 2 == 0, "rent").otherwise("sale"))
        value = F.when(F.col("kind") == "rent", F.col("o_totalprice") / 300).otherwise(F.col("o_totalprice"))
        return o.groupBy(F.col("c_nationkey").alias("entity"), "kind", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.round(F.avg(value).cast("decimal(28,8)"), 2).cast("double").alias("price"), F.count("*").alias("active_count"))

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def tags(self) -> DataFrame:
        return self.events.select("user_id", F.to_date("ts").alias("day"), "event_type").distinct()

    @cached_property
    def centres(self) -> DataFrame:
        """Fixed towns: every fiftieth customer's place."""
        c = F.col("c_custkey")
        return self.table("customer").where(c % 50 == 0).select(c.alias("rid"), (48.5 + (c * 37 % 250) / 100.0).alias("rlat"), (12.1 + (c * 53 % 670) / 100.0).alias("rlng"), F.col("c_acctbal").alias("pop"), (c % 97).alias("jobs"))

    @cached_property
    def people(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.table("customer").select(c.alias("id"), (48.5 + (c * 37 % 250) / 100.0).alias("lat"), (12.1 + (c * 53 % 670) / 100.0).alias("lng"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))


LISTING = f"""listing AS (
  SELECT o_orderkey AS id, o_custkey AS property_id, o_totalprice AS price_czk, CAST(20 + o_orderkey % 130 AS INT) AS area_m2, c_mktsegment AS category_main,
    o_orderpriority AS source, n_name AS district, r_name AS region, 48.5 + (o_custkey * 37 % 250) / 100.0 AS lat, 12.1 + (o_custkey * 53 % 670) / 100.0 AS lng,
    o_orderdate AS first_seen_at, o_orderdate + to_days(CAST(o_orderkey % 200 AS INT)) AS last_seen_at, o_orderstatus = 'O' AS is_active,
    {of_sql(DISPOSITIONS, "o_orderkey")} AS disposition, CAST(o_orderkey % 9 AS INT) AS floor, {of_sql(FURNISHED, "o_orderkey")} AS furnished,
    {of_sql(BUILDINGS, "o_orderkey")} AS building_type, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 7 AS INT) END AS parking_lots,
    CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 4 = 0 END AS has_lift, CAST(o_orderkey % 41 - 20 AS DOUBLE) AS total_price_change_pct,
    o_orderkey % 5 AS price_changes, o_orderkey % 2 AS price_changes_30d, o_orderkey % 3 AS price_changes_90d, o_orderkey % 4 AS price_changes_365d,
    CAST(o_orderkey % 40 AS INT) AS age_days, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS verified_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
LISTING_NP = f"""{LISTING}, listing_np AS (
  SELECT * REPLACE (CASE WHEN id % 11 <> 0 THEN price_czk END AS price_czk, CASE WHEN id % 13 <> 0 THEN area_m2 ELSE 0 END AS area_m2) FROM listing)"""
SNAPSHOT = """snapshot AS (
  SELECT listing_id, scraped_at, o1, o2, CASE WHEN o1 % 17 <> 0 THEN floor(price / 50) * 50.0 END AS price, supplier, flag, state FROM (
  SELECT l_partkey AS listing_id, l_shipdate AS scraped_at, l_orderkey AS o1, l_linenumber AS o2, round(l_extendedprice / l_quantity, 2) AS price,
    l_suppkey AS supplier, l_returnflag AS flag, l_linestatus AS state FROM lineitem))"""
CHILD = """child AS (
  SELECT l_partkey AS property_id, l_suppkey AS child_id, max(l_shipdate) AS last_seen, min(l_shipdate) AS first_seen, max(l_quantity) AS qty,
    CAST(l_suppkey % 10 AS INT) AS trust, l_suppkey % 3 = 0 AS active, 's' || (l_suppkey % 4) AS source,
    CASE WHEN l_suppkey % 5 <> 0 THEN max(l_quantity) END AS area, CASE WHEN l_suppkey % 7 <> 0 THEN 'street ' || (l_suppkey % 6) END AS street,
    CASE WHEN l_suppkey % 3 <> 2 THEN l_suppkey % 3 = 0 END AS lift
  FROM lineitem GROUP BY ALL)"""
CHILD = CHILD.replace("GROUP BY ALL", "GROUP BY l_partkey, l_suppkey")
MONTHLY = """monthly AS (
  SELECT entity, kind, year, month, CAST(round(CAST(avg(v) AS DECIMAL(28, 8)), 2) AS DOUBLE) AS price, count(*) AS active_count FROM (
    SELECT c_nationkey AS entity, CASE WHEN o_orderkey % 2 = 0 THEN 'rent' ELSE 'sale' END AS kind, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
      CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 300 ELSE o_totalprice END AS v FROM orders JOIN customer ON o_custkey = c_custkey)
  GROUP BY entity, kind, year, month)"""
TAGS = "tags AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events)"
_POINT = "48.5 + (c_custkey * 37 % 250) / 100.0 AS {0}lat, 12.1 + (c_custkey * 53 % 670) / 100.0 AS {0}lng"
CENTRES = f"centres AS (SELECT c_custkey AS rid, {_POINT.format('r')}, c_acctbal AS pop, c_custkey % 97 AS jobs FROM customer WHERE c_custkey % 50 = 0)"
PEOPLE = f"people AS (SELECT c_custkey AS id, {_POINT.format('')}, c_nationkey AS nation, c_mktsegment AS segment FROM customer)"
DISTANCE = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"


class Family:
    """Collects a module's queries and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, make: Callable[[Frames], DataFrame], sql: str | None = None, *frames: str) -> None:
        self.queries[name] = lambda spark, sf_dir: make(Frames(spark, sf_dir))
        if sql is not None:
            self.sql[name] = ("WITH " + ", ".join(frames) + " " if frames else "") + sql
