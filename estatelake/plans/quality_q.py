"""Queries of data quality, health, entity resolution, text functions and sources."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import geo, text, values
from ..operators import quality, resolution
from ..sources import readers
from .frames import AS_OF_SQL, CHILD, LISTING, LISTING_NP, MONTHLY, SNAPSHOT, Family, Frames, of, of_sql

family = Family()
add = family.add

# quality and health
_FIELDS = ["price_czk", "furnished", "building_type", "parking_lots", "has_lift"]
add("a35_completeness", lambda f: quality.completeness(f.listing_np, ["district"], _FIELDS), " UNION ALL ".join(f"SELECT district, '{c}' AS field, count({c}) AS filled, count(*) AS n, round(100.0 * count({c}) / count(*), 2) AS pct FROM listing_np GROUP BY district" for c in _FIELDS), LISTING_NP)
_FRESH = "first_seen_at >= TIMESTAMP '2001-01-01'"
add(
    "a35_drift",
    lambda f: quality.drift(f.listing_np, ["district"], _FIELDS, F.col("first_seen_at") >= F.lit("2001-01-01").cast("timestamp")),
    "SELECT district, arg_min(field, (-d, field)) FILTER (WHERE d IS NOT NULL) AS worst_field, round(max(d) * 100, 2) AS drift_pts FROM (" + " UNION ALL ".join(f"SELECT district, '{c}' AS field, avg(CASE WHEN NOT {_FRESH} THEN CAST({c} IS NOT NULL AS INT) END) - avg(CASE WHEN {_FRESH} THEN CAST({c} IS NOT NULL AS INT) END) AS d FROM listing_np GROUP BY district" for c in _FIELDS) + ") GROUP BY district",
    LISTING_NP,
)


#: What each check is fed with, from listings and events: name, Spark expression, SQL expression.
_FED = {
    "minutes_since_walk": "min(age_days) * 10 + count(*) % 50",
    "stuck_runs": "count(*) % 3",
    "max_inactive_run": "count(CASE WHEN NOT is_active THEN 1 END)",
    "delisting_p90": "percentile_90(date_diff('minute', first_seen_at, last_seen_at) / 60.0)",
    "error_pct": "round(100.0 * count(CASE WHEN floor = 0 THEN 1 END) / count(*), 2)",
    "churn": "round(1.0 * sum(price_changes) / count(*), 4)",
    "stale_active": "count(CASE WHEN age_days > 35 THEN 1 END)",
    "drift_pts": "round(100.0 * count(CASE WHEN has_lift IS NULL THEN 1 END) / count(*), 2)",
    "fetch_failures": "count(CASE WHEN price_changes = 4 THEN 1 END)",
    "backlog": "count(CASE WHEN verified_at IS NULL THEN 1 END)",
    "queue_lag_p90": "percentile_90(age_days * 7.0)",
    "attach_oldest": "max(age_days)",
    "e2e": "percentile_90(age_days * 6.0)",
    "minutes_since_freshest": "min(age_days) + 61",
    "max_gap_pct": "round(100.0 * count(CASE WHEN parking_lots IS NULL THEN 1 END) / count(*), 2)",
    "new_24h": "count(CASE WHEN first_seen_at >= TIMESTAMP '2001-07-25 00:00:00' THEN 1 END)",
    "cadence": "CASE WHEN count(*) % 2 = 0 THEN 60 END",
}


def _measures(f: Frames):
    """One row a district with a measure for each of the sixteen checks, from one grouping."""
    sql = {n: re.sub(r"date_diff\('minute', (\w+), (\w+)\)", r"floor((unix_timestamp(\2) - unix_timestamp(\1)) / 60)", e) for n, e in _FED.items()}
    return f.listing.groupBy("district").agg(*[F.expr(re.sub(r"percentile_90\((.*)\)$", r"percentile(\1, 0.9)", e)).alias(n) for n, e in sql.items()])


_M = "m AS (SELECT district, " + ", ".join(f"{re.sub(r'percentile_90[(](.*)[)]$', r'quantile_cont(CAST(\1 AS DOUBLE), 0.9)', e)} AS {n}" for n, e in _FED.items()) + " FROM listing GROUP BY district)"
_CAD = "coalesce(cadence, 60)"


def _check_sql(name: str, column: str, passes: str, warns: str, strict: bool, null: str) -> str:
    op = "<" if strict else "<="
    v = f"CAST({column} AS DOUBLE)"
    return f"SELECT district, '{name}' AS \"check\", {v} AS value, CASE WHEN {column} IS NULL THEN '{null}' WHEN {v} {op} {passes} THEN 'pass' WHEN {v} {op} {warns} THEN 'warn' ELSE 'fail' END AS status FROM m"


#: The ladders as the inventory of checks states them, written out for SQL.
_LADDERS = [
    ("liveness", "minutes_since_walk", f"1.5 * {_CAD}", f"3 * {_CAD}", True, "warn"),
    ("runs_completing", "stuck_runs", "0", "1", False, "warn"),
    ("delisting_spike", "max_inactive_run", "500", "2000", False, "warn"),
    ("delisting_latency", "delisting_p90", "2160", "4320", True, "pass"),
    ("error_rate", "error_pct", "5", "15", True, "warn"),
    ("snapshot_churn", "churn", "0.5", "1.5", True, "warn"),
    ("stale_active", "stale_active", "50", "500", True, "warn"),
    ("field_null_drift", "drift_pts", "5", "15", True, "pass"),
    ("fetch_failures", "fetch_failures", "1000", "5000", True, "warn"),
    ("detail_queue_backlog", "backlog", "2000", "10000", True, "warn"),
    ("detail_queue_lag", "queue_lag_p90", f"1.5 * {_CAD}", f"3 * {_CAD}", True, "pass"),
    ("property_attach_lag", "attach_oldest", "30", "90", True, "pass"),
    ("e2e_latency", "e2e", "90", "240", True, "warn"),
    ("data_freshness", "minutes_since_freshest", _CAD, f"3 * {_CAD}", True, "warn"),
    ("index_completeness", "max_gap_pct", "2", "5", True, "warn"),
]
_NEW = "SELECT district, 'new_listings', CAST(new_24h AS DOUBLE), CASE WHEN new_24h > 0 THEN 'pass' ELSE 'warn' END FROM m"
add("a31_o09_health_ladder", lambda f: quality.health_checks(_measures(f), "district"), " UNION ALL ".join([*(_check_sql(*x) for x in _LADDERS), _NEW]), LISTING, _M)
add(
    "a32_single_pass_rollup",
    lambda f: f.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), *[F.count(F.when(F.col("event_type") == t, 1)).alias(t) for t in ("click", "error", "purchase")], F.countDistinct("user_id").alias("users")).withColumn("day", F.col("day").cast("string")),
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
)


def _zero(f: Frames):
    days = f.spark.sql("SELECT explode(sequence(DATE '2024-01-20', DATE '2024-02-05')) AS day")
    daily = f.events.where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return quality.zero_filled(daily, days, "day", ["n"]).withColumn("day", F.col("day").cast("string"))


add("a32_zero_filled_days", _zero, "SELECT CAST(d AS VARCHAR) AS day, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-20', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) ON day = d")
add("a32_snapshot_density", lambda f: quality.snapshot_density(f.snapshot, "listing_id", 25), "SELECT CAST(least(n, 25) AS INT) AS snapshots, count(*) AS series FROM (SELECT listing_id, count(*) AS n FROM snapshot GROUP BY listing_id) GROUP BY 1", SNAPSHOT)
add("a33_last_of_day", lambda f: quality.last_of_day(f.events, ["event_type"], "ts", ["event_id", "value"]).select("event_type", F.col("day").cast("string").alias("day"), "event_id"), "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_max(event_id, (ts, event_id, value)) AS event_id FROM events GROUP BY event_type, CAST(ts AS DATE)")
add("a33_k11_hourly", lambda f: f.events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n")), "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
add("a34_coverage", lambda f: quality.coverage(f.listing_np, ["source"], {"price": F.col("price_czk").isNotNull(), "area": F.col("area_m2") > 0, "known_furnished": F.col("furnished").isin("ano", "ne", "castecne")}), "SELECT source, count(*) AS n, round(100.0 * count(price_czk) / count(*), 2) AS price_pct, round(100.0 * count(*) FILTER (WHERE area_m2 > 0) / count(*), 2) AS area_pct, round(100.0 * count(*) FILTER (WHERE furnished IN ('ano', 'ne', 'castecne')) / count(*), 2) AS known_furnished_pct FROM listing_np GROUP BY source", LISTING_NP)
add("a36_queue_lag", lambda f: quality.queue_lag(f.listing, ["source"], "first_seen_at", "last_seen_at"), "SELECT source, count(*) AS n, round_even(quantile_cont(m, 0.5), 2) AS p50_min, round_even(quantile_cont(m, 0.9), 2) AS p90_min FROM (SELECT source, (epoch(last_seen_at) - epoch(first_seen_at)) / 60.0 AS m FROM listing) GROUP BY source", LISTING)
add("a37_reconciliation_gap", lambda f: f.events.select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k")).groupBy("user_id").agg(F.max(F.round(100.0 * (100 - F.col("k")) / 100, 2)).alias("max_gap")), "SELECT user_id, max(round(100.0 * (100 - CAST(props ->> '$.k' AS INT)) / 100, 2)) AS max_gap FROM events GROUP BY user_id")
add("a38_failure_classes", lambda f: f.table("part").groupBy(quality.classify(F.col("p_name"), [("first", r"[Gg]reen"), ("second", r"\d*[05]$"), ("third", "^p")]).alias("class")).agg(F.count("*").alias("n")), "SELECT CASE WHEN regexp_matches(p_name, '[Gg]reen') THEN 'first' WHEN regexp_matches(p_name, '[0-9]*[05]$') THEN 'second' WHEN regexp_matches(p_name, '^p') THEN 'third' ELSE 'other' END AS class, count(*) AS n FROM part GROUP BY 1")
add("a39_costs_daily", lambda f: quality.costs(f.events, "day", "ts", ["event_type"], "value"), "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS calls, round(sum(value), 4) AS cost FROM events GROUP BY 1, 2")
add("a39_costs_hourly", lambda f: quality.costs(f.events.where("event_type = 'error'"), "hour", "ts", [], "value"), "SELECT date_trunc('hour', ts) AS hour, count(*) AS calls, round(sum(value), 4) AS cost FROM events WHERE event_type = 'error' GROUP BY 1")
add("a40_funnel", lambda f: quality.funnel(f.events, [], [("seen", F.lit(True)), ("valued", F.col("value") > 20), ("clicked", F.col("event_type").isin("click", "purchase")), ("bought", F.col("event_type") == "purchase")], "event_id"), "SELECT count(DISTINCT event_id) AS seen, count(DISTINCT event_id) FILTER (WHERE value > 20) AS valued, count(DISTINCT event_id) FILTER (WHERE value > 20 AND event_type IN ('click', 'purchase')) AS clicked, count(DISTINCT event_id) FILTER (WHERE value > 20 AND event_type = 'purchase') AS bought FROM events")


def _building(f: Frames):
    """Quartiles of each unit (part and source), summed over the units of a building (part); null where no unit has any."""
    units = f.child.groupBy("property_id", "source").agg(F.percentile("area", [0.25, 0.5, 0.75]).alias("p"))
    return units.groupBy("property_id").agg(F.count("*").alias("units"), *[F.round(F.sum(F.col("p")[i]), 4).alias(n) for i, n in enumerate(("p25", "p50", "p75"))])


add("a41_building_rollup", _building, "SELECT property_id, count(*) AS units, " + ", ".join(f"round(sum(p{n}), 4) AS p{n}" for n in (25, 50, 75)) + " FROM (SELECT property_id, source, " + ", ".join(f"quantile_cont(area, 0.{n}) AS p{n}" for n in (25, 50, 75)) + " FROM child GROUP BY property_id, source) GROUP BY property_id", CHILD)
add("o10_top_spenders", lambda f: quality.top_spenders(f.events, "user_id", "value", 12), "SELECT user_id, round(sum(value), 4) AS spent, count(*) AS calls, round(round(sum(value), 4) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY user_id ORDER BY spent DESC, user_id LIMIT 12")
add("o12_storage_projection", lambda f: quality.storage_projection(f.table("pages").groupBy((F.col("page_id") % 30).alias("day")).agg(F.sum(F.octet_length("html")).alias("size")), "day", "size", 365), "SELECT count(day) AS days, round_even(avg(size), 2) AS bytes_a_day, CAST(round_even(avg(size) * 365, 0) AS BIGINT) AS projected FROM (SELECT page_id % 30 AS day, CAST(sum(strlen(html)) AS DOUBLE) AS size FROM pages GROUP BY 1)")
_RATE = "SELECT event_id, CAST(event_id % 6 AS INT) AS a, CAST(CASE WHEN event_id % 11 <> 0 THEN user_id % 6 END AS INT) AS b FROM events"
add("o06_agreement", lambda f: quality.agreement(f.events.select((F.col("event_id") % 6).cast("int").alias("a"), F.when(F.col("event_id") % 11 != 0, F.col("user_id") % 6).cast("int").alias("b")), "a", "b"), f"SELECT count(*) AS n, round_even(100 * avg(CAST(a = b AS INT)), 2) AS exact_pct, round_even(100 * avg(CAST(abs(a - b) <= 1 AS INT)), 2) AS within1_pct, round_even(avg(abs(a - b)), 4) AS mean_abs, round_even(avg(a - b), 4) AS bias, count(*) FILTER (WHERE abs(a - b) > 2) AS hard FROM ({_RATE}) WHERE b IS NOT NULL")
add("a52_scorecard", lambda f: quality.scorecard(f.events.select("event_type", F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 3).alias("truth"), F.when(F.col("event_id") % 7 != 0, F.col("user_id") % 3).alias("said")), ["event_type"], "truth", "said"), "SELECT event_type, count(t) AS determinable, count(*) FILTER (WHERE t IS NOT NULL AND s IS NOT NULL) AS asserted, count(*) FILTER (WHERE t = s) AS matches, round(100.0 * count(*) FILTER (WHERE t = s) / count(*) FILTER (WHERE t IS NOT NULL AND s IS NOT NULL), 2) AS precision_pct, round(100.0 * count(*) FILTER (WHERE t = s) / count(t), 2) AS yield_pct FROM (SELECT event_type, CASE WHEN event_id % 5 <> 0 THEN event_id % 3 END AS t, CASE WHEN event_id % 7 <> 0 THEN user_id % 3 END AS s FROM events) GROUP BY event_type")
add("a51_quality_buckets", lambda f: f.listing.select(quality.quality_buckets(F.when(F.col("id") % 9 != 0, F.col("area_m2") * 4.0), F.element_at(F.array(F.lit("registry"), F.lit("pin"), F.lit("centroid"), F.lit("name")), (F.col("id") % 4 + 1).cast("int"))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")), "SELECT CASE WHEN r IS NULL THEN 'none' WHEN k IN ('registry', 'pin') AND r <= 30 THEN 'precise' WHEN k = 'centroid' THEN 'area' WHEN r <= 300 THEN 'approximate' ELSE 'area' END AS bucket, count(*) AS n FROM (SELECT CASE WHEN id % 9 <> 0 THEN area_m2 * 4.0 END AS r, list_extract(['registry', 'pin', 'centroid', 'name'], CAST(id % 4 + 1 AS INT)) AS k FROM listing) GROUP BY 1", LISTING)
add("o04_failures", lambda f: quality.failures(f.events.withColumn("ok", F.col("event_type") != "error"), ["user_id"], "ts", "ok"), "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failures, min(ts) FILTER (WHERE event_type = 'error') AS first_failure, max(ts) FILTER (WHERE event_type = 'error') AS last_failure, arg_max(event_type <> 'error', (ts, event_type <> 'error')) AS latest_ok FROM events GROUP BY user_id")
add("o09_transitions", lambda f: quality.transitions(f.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type"), "SELECT user_id, event_id, event_type, before FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NOT NULL AND before <> event_type")
add("o10_burn_rate", lambda f: quality.burn_rate(f.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 2).alias("spent")), ["event_type"], "day", "spent").withColumn("day", F.col("day").cast("string")), "SELECT event_type, CAST(day AS VARCHAR) AS day, spent, round(sum(spent) OVER (PARTITION BY event_type ORDER BY day ROWS 6 PRECEDING), 4) AS burn_7d FROM (SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value), 2) AS spent FROM events GROUP BY 1, 2)")
add("o11_success_ratio", lambda f: f.events.groupBy("user_id").agg(F.round(F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)), 4).alias("ok")), "SELECT user_id, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 4) AS ok FROM events GROUP BY user_id")
add("o01_o02_recent_runs", lambda f: f.events.where(F.col("ts") >= F.lit("2024-01-29").cast("timestamp")).select("event_id", F.floor((F.unix_timestamp(F.lit("2024-02-01").cast("timestamp")) - F.unix_timestamp("ts")) / 60).alias("age_min")), "SELECT event_id, CAST(floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 60) AS BIGINT) AS age_min FROM events WHERE ts >= TIMESTAMP '2024-01-29'")
add("o03_unpublished", lambda f: f.listing.agg(F.count(F.when(F.col("verified_at").isNull(), 1)).alias("unpublished"), F.min(F.when(F.col("verified_at").isNull(), F.col("first_seen_at"))).alias("oldest"), F.count(F.when(F.col("is_active"), 1)).alias("active")), "SELECT count(*) FILTER (WHERE verified_at IS NULL) AS unpublished, min(first_seen_at) FILTER (WHERE verified_at IS NULL) AS oldest, count(*) FILTER (WHERE is_active) AS active FROM listing", LISTING)
add("o12_churn_cohorts", lambda f: f.snapshot.groupBy("listing_id").agg(F.count("*").alias("n"), F.countDistinct("price").alias("d"), F.min("scraped_at").alias("t")).groupBy(F.year("t").alias("cohort")).agg(F.count("*").alias("series"), F.round(F.avg(F.col("d") / F.col("n")), 4).alias("change_rate"), F.bround(F.percentile("n", 0.5), 1).alias("median_n")), "SELECT CAST(year(t) AS INT) AS cohort, count(*) AS series, round(avg(d / n), 4) AS change_rate, round_even(quantile_cont(n, 0.5), 1) AS median_n FROM (SELECT listing_id, count(*) AS n, count(DISTINCT price) AS d, min(scraped_at) AS t FROM snapshot GROUP BY listing_id) GROUP BY 1", SNAPSHOT)
add("o13_archive_shares", lambda f: f.listing.groupBy(F.when(F.col("source").isin("1-URGENT", "2-HIGH"), F.col("source")).otherwise("other").alias("cohort")).agg(F.count("*").alias("n"), F.round(100.0 * F.count("verified_at") / F.count("*"), 2).alias("covered_pct")), "SELECT CASE WHEN source IN ('1-URGENT', '2-HIGH') THEN source ELSE 'other' END AS cohort, count(*) AS n, round(100.0 * count(verified_at) / count(*), 2) AS covered_pct FROM listing GROUP BY 1", LISTING)
add("o19_group_audit", lambda f: f.child.groupBy("property_id").agg(F.concat_ws(",", F.sort_array(F.collect_set("source"))).alias("sources"), F.count(F.when(F.col("active"), 1)).alias("active")), "SELECT property_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) FILTER (WHERE active) AS active FROM child GROUP BY property_id", CHILD)
add("o21_tag_counts", lambda f: f.table("customer").join(f.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.countDistinct("event_type").alias("tags")), "c_custkey", "left").select("c_custkey", F.coalesce("tags", F.lit(0)).alias("tags")), "SELECT c_custkey, (SELECT count(DISTINCT event_type) FROM events WHERE user_id = c_custkey) AS tags FROM customer")
add("o24_stuck", lambda f: f.listing.where(F.col("is_active") & (F.col("last_seen_at") < F.lit("2000-06-01").cast("timestamp"))).select("id"), "SELECT id FROM listing WHERE is_active AND last_seen_at < TIMESTAMP '2000-06-01'", LISTING)
add("k13_epoch_changes", lambda f: quality.epoch_changes(*[f.snapshot.where(w).groupBy("listing_id").agg(F.max("flag").alias("flag")) for w in ("scraped_at < '1998-06-01'", "scraped_at >= '1998-06-01'")], ["listing_id"], "flag"), "SELECT listing_id, a.flag AS before, b.flag AS now FROM (SELECT listing_id, max(flag) AS flag FROM snapshot WHERE scraped_at < '1998-06-01' GROUP BY listing_id) a FULL JOIN (SELECT listing_id, max(flag) AS flag FROM snapshot WHERE scraped_at >= '1998-06-01' GROUP BY listing_id) b USING (listing_id) WHERE a.flag IS DISTINCT FROM b.flag", SNAPSHOT)

# entity resolution: identities are customers, names and contacts drawn from few values by remainders
_ID = "identities AS (SELECT *, coalesce(firm < 5, FALSE) AS franchise FROM (SELECT c_custkey AS identity, 'name ' || (c_custkey % 375) AS name_key, CASE WHEN c_custkey % 9 <> 0 THEN CASE WHEN c_custkey % 375 % 2 = 0 THEN c_custkey % 375 % 60 ELSE c_custkey * 31 % 60 END END AS firm, c_custkey % 13 <> 0 AS mergeable FROM customer)), known AS (SELECT *, CASE WHEN identity % 7 <> 0 THEN firm END AS primary_firm FROM identities)"
_CT = _ID + ", contacts AS (SELECT c_custkey AS identity, k AS kind, CASE WHEN c_custkey % 10 <> k THEN k || '-' || (c_custkey % (750 - 625 * k)) END AS value, name_key, mergeable FROM customer JOIN identities ON identity = c_custkey, (VALUES (0), (1)) t(k))"


def _identities(f: Frames):
    c = F.col("c_custkey")
    firm = F.when(c % 9 != 0, F.when(c % 375 % 2 == 0, c % 375 % 60).otherwise(c * 31 % 60))
    i = f.table("customer").select(c.alias("identity"), F.concat(F.lit("name "), (c % 375).cast("string")).alias("name_key"), firm.alias("firm"), (c % 13 != 0).alias("mergeable"))
    return i.withColumn("franchise", F.coalesce(F.col("firm") < 5, F.lit(False))).withColumn("primary_firm", F.when(F.col("identity") % 7 != 0, F.col("firm")))


def _contacts(f: Frames):
    i = _identities(f).withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1))))
    c, k = F.col("identity"), F.col("kind")
    return i.select("identity", "kind", F.when(c % 10 != k, F.concat(k.cast("string"), F.lit("-"), (c % (750 - 625 * k)).cast("string"))).alias("value"), "name_key", "mergeable")


_GOOD = "good AS (SELECT kind, value FROM contacts WHERE value IS NOT NULL GROUP BY kind, value HAVING count(DISTINCT name_key) = 1)"
add("e02_discriminating", lambda f: resolution.discriminating(_contacts(f)), "SELECT kind, value FROM good", _CT, _GOOD)
add("e03_contact_edges", lambda f: resolution.contact_edges(_contacts(f)), "SELECT DISTINCT a, identity AS b FROM (SELECT identity, min(identity) OVER (PARTITION BY kind, value, name_key) AS a FROM contacts JOIN good USING (kind, value) WHERE mergeable) WHERE identity <> a", _CT, _GOOD)
_FIRM = "named AS (SELECT * FROM identities WHERE mergeable AND firm IS NOT NULL AND NOT franchise AND name_key IN (SELECT name_key FROM identities WHERE firm IS NOT NULL GROUP BY name_key HAVING count(DISTINCT firm) = 1)), vals AS (SELECT n.name_key, n.firm, kind, n.identity, value FROM named n JOIN contacts c ON c.identity = n.identity AND value IS NOT NULL), clash AS (SELECT DISTINCT x.name_key, x.firm FROM vals x JOIN vals y ON x.name_key = y.name_key AND x.firm = y.firm AND x.kind = y.kind AND x.identity < y.identity WHERE NOT EXISTS (SELECT 1 FROM vals p JOIN vals q ON p.value = q.value WHERE p.identity = x.identity AND q.identity = y.identity AND p.kind = x.kind AND q.kind = x.kind))"
add("e04_firm_edges", lambda f: resolution.firm_edges(_identities(f), _contacts(f)), "SELECT a, identity AS b FROM (SELECT *, min(identity) OVER (PARTITION BY name_key, firm) AS a FROM named n WHERE NOT EXISTS (SELECT 1 FROM clash c WHERE c.name_key = n.name_key AND c.firm = n.firm)) WHERE identity <> a", _CT, _FIRM)


def _edges(f: Frames):
    """The evidence of the two steps before, over all identities."""
    return resolution.contact_edges(_contacts(f)).unionByName(resolution.firm_edges(_identities(f), _contacts(f)))


def _kept_apart(f: Frames):
    """Suppressed pairs, few of them edges."""
    i = _identities(f)
    pairs = i.where("identity % 40 = 0").select(F.col("identity").alias("a"), (F.col("identity") + 750).alias("b"))
    return pairs.join(i.select(F.col("identity").alias("b")), "b", "left_semi").select("a", "b")


#: Small, so that the driver's tables have components on either side of it.
_CAP = 3
_CUT = "cut AS (SELECT identity AS a, identity + 750 AS b FROM identities WHERE identity % 40 = 0 AND identity + 750 IN (SELECT identity FROM identities))"
_EDGE = "edges AS (SELECT DISTINCT a, identity AS b FROM (SELECT identity, min(identity) OVER (PARTITION BY kind, value, name_key) AS a FROM contacts JOIN good USING (kind, value) WHERE mergeable) WHERE identity <> a UNION SELECT a, identity AS b FROM (SELECT *, min(identity) OVER (PARTITION BY name_key, firm) AS a FROM named n WHERE NOT EXISTS (SELECT 1 FROM clash c WHERE c.name_key = n.name_key AND c.firm = n.firm)) WHERE identity <> a)"
_REACH = "sides AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), reach AS (SELECT a AS node, a AS other FROM sides UNION SELECT r.node, b.b FROM reach r JOIN sides b ON r.other = b.a), comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"
_STATE = f"state AS (SELECT component, count(*) > {_CAP} AS large, component IN (SELECT x.component FROM cut JOIN comp x ON x.node = cut.a JOIN comp y ON y.node = cut.b WHERE x.component = y.component) AS split FROM comp GROUP BY component)"
_WALK = (f"RECURSIVE {_CT}", _GOOD, _FIRM, _EDGE, _REACH, _CUT, _STATE)
add("e06_components", lambda f: resolution.components(_edges(f)), "SELECT node, component FROM comp", *_WALK)
add("e05_e06_resolve_groups", lambda f: resolution.resolve(_edges(f), _kept_apart(f), _CAP)[0], "SELECT node, component FROM comp JOIN state USING (component) WHERE NOT large AND NOT split", *_WALK)
add("e06_review_pairs", lambda f: resolution.resolve(_edges(f), _kept_apart(f), _CAP)[1], "SELECT a, b FROM (SELECT x.node AS a, y.node AS b FROM comp x JOIN comp y ON x.component = y.component AND x.node < y.node JOIN state s ON s.component = x.component WHERE split AND NOT large UNION SELECT least(a, b), greatest(a, b) FROM edges JOIN comp ON node = a JOIN state USING (component) WHERE large) WHERE (a, b) NOT IN (SELECT a, b FROM cut)", *_WALK)
add("e07_review_pairs", lambda f: resolution.review_pairs(_identities(f), _contacts(f), resolution.resolve(_edges(f), _kept_apart(f), _CAP)[0], _kept_apart(f)), "SELECT DISTINCT x.identity AS a, y.identity AS b FROM contacts x JOIN contacts y ON x.kind = y.kind AND x.value = y.value AND x.name_key = y.name_key AND x.identity < y.identity JOIN known i ON i.identity = x.identity AND i.mergeable JOIN known j ON j.identity = y.identity AND j.mergeable WHERE (i.primary_firm IS NULL OR i.primary_firm IS DISTINCT FROM j.primary_firm) AND (SELECT count(DISTINCT c.name_key) FROM contacts c WHERE c.kind = x.kind AND c.value = x.value) >= 2 AND NOT EXISTS (SELECT 1 FROM comp p JOIN comp q ON p.component = q.component JOIN state s ON s.component = p.component WHERE p.node = x.identity AND q.node = y.identity AND NOT large AND NOT split) AND NOT EXISTS (SELECT 1 FROM cut WHERE cut.a = x.identity AND cut.b = y.identity)", *_WALK)
add("e10_apply_components", lambda f: resolution.apply_components(resolution.resolve(_edges(f), _kept_apart(f), _CAP)[0], _identities(f).select("identity", (F.col("identity") % 600).alias("owner")), 4))
add("e08_candidate_groups", lambda f: resolution.candidate_groups(_identities(f)), "SELECT name_key, firm, count(*) AS n, min(identity) AS first FROM identities WHERE firm IS NOT NULL GROUP BY name_key, firm HAVING count(*) >= 2", _ID)
add("e09_unmerge_suppression", lambda f: resolution.unmerge_suppression(f.child.select(F.col("property_id").alias("group"), F.col("source").alias("owner"), F.col("child_id").alias("identity"))), "SELECT DISTINCT x.child_id AS a, y.child_id AS b FROM child x JOIN child y ON x.property_id = y.property_id AND x.child_id < y.child_id AND x.source <> y.source", CHILD)
add("e11_block_pairs", lambda f: resolution.block_pairs(f.listing.withColumn("cell", geo.listing_cell_key(F.col("lat"), F.col("lng"), F.col("category_main"))), "cell", "id"), "SELECT x.id AS a, y.id AS b FROM listing x JOIN listing y ON x.lat = y.lat AND x.lng = y.lng AND x.category_main = y.category_main AND x.id < y.id", LISTING)
_CATS = ["byt", "dum", "komercni", "pozemek"]
add("e12_compatible", lambda f: f.table("customer").select(F.col("c_custkey").alias("id"), of(_CATS, F.col("c_custkey")).alias("x"), of(_CATS, F.floor(F.col("c_custkey") / 4)).alias("y")).where(resolution.compatible("x", "y")), f"SELECT * FROM (SELECT c_custkey AS id, {of_sql(_CATS, 'c_custkey')} AS x, {of_sql(_CATS, '(c_custkey // 4)')} AS y FROM customer) WHERE x = y OR (x IN ('dum', 'komercni') AND y IN ('dum', 'komercni'))")


def _candidates(f: Frames):
    return f.table("lineitem").select(F.col("l_orderkey").alias("claim"), (F.col("l_partkey") % 50).alias("unit"), F.element_at(F.array(*[F.lit(s) for s in (100, 90, 70, 60, 55, 45, 35, 25)]), (F.col("l_suppkey") % 8 + 1).cast("int")).alias("score"))


add(
    "e14_location_ladder",
    lambda f: resolution.ladder(_candidates(f)).withColumn("candidates", F.concat_ws(",", F.transform("candidates", lambda x: x.cast("string")))),
    "SELECT claim, arg_min(unit, (-score, unit)) AS unit, CAST(max(score) AS INT) AS score, count(*) > 1 AND max(score) - list_extract(list(score ORDER BY score DESC, unit), 2) < 5 AS ambiguous, string_agg(unit, ',' ORDER BY score DESC, unit) AS candidates FROM (SELECT l_orderkey AS claim, l_partkey % 50 AS unit, max(list_extract([100, 90, 70, 60, 55, 45, 35, 25], CAST(l_suppkey % 8 + 1 AS INT))) AS score FROM lineitem GROUP BY 1, 2) GROUP BY claim",
)
_POL = [("street", "s1", "%", 1, None), ("street", "%", "mined", 3, 20), ("street", "%", "%", 2, None), ("area", "%", "%", 1, 30)]


def _survive(f: Frames):
    policy = f.spark.createDataFrame(_POL, "field string, source_pattern string, method_pattern string, rank int, max_age_days int")
    c = f.child.withColumn("method", F.when(F.col("child_id") % 2 == 0, "mined").otherwise("declared")).withColumn("age_days", (F.col("child_id") % 45).cast("int"))
    rows = F.explode(F.array(F.struct(F.lit("street").alias("field"), F.col("street").alias("value")), F.struct(F.lit("area").alias("field"), F.col("area").cast("int").cast("string").alias("value"))))
    claims = c.select(F.col("property_id").alias("listing"), "source", "method", "age_days", rows.alias("r")).select("listing", "source", "method", "age_days", "r.*")
    return resolution.survivorship(claims, policy)


add(
    "e15_survivorship",
    _survive,
    "SELECT listing, field, value, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY listing, field ORDER BY rank, age_days, value, source) AS rn FROM (SELECT c.*, p.rank FROM (SELECT property_id AS listing, source, CASE WHEN child_id % 2 = 0 THEN 'mined' ELSE 'declared' END AS method, CAST(child_id % 45 AS INT) AS age_days, field, CASE WHEN field = 'street' THEN street ELSE CAST(CAST(area AS INT) AS VARCHAR) END AS value FROM child, (VALUES ('street'), ('area')) t(field)) c JOIN (VALUES ('street', 's1', '%', 1, NULL), ('street', '%', 'mined', 3, 20), ('street', '%', '%', 2, NULL), ('area', '%', '%', 1, 30)) p(f, sp, mp, rank, age) ON c.field = p.f AND c.source LIKE sp AND c.method LIKE mp AND (age IS NULL OR age_days <= age) WHERE value IS NOT NULL)) WHERE rn = 1",
    CHILD,
)

# scalar functions over the customers' strings: the entry of a list that the key points at, with a number of the key for #
_NAMES = ["Ing. Jan Novák", "Novák Jan", "JAN  NOVÁK, Ph.D.", "Mgr. et Mgr. Věra Šťastná-Bílá", "Ing.", "", "O'Neil José", "Dvořák #", "J. Novák"]
_STREETS = ["ul. Hlavní #", "Hlavní", "Vinohradská třída 160/#b", "náměstí Míru", "Náměstí", "tř. 28. října # 679 61", "  Na   Výsluní ", "", "Nábřeží #a", "Zámecká 12/#/3"]
_FLOORS = ["#. NP", "#.PP", "#. patro", "zvýšené přízemí", "suterén", "patrový dům", "60. NP", "7", "v #. nadzemním podlaží", "v #. podzemním podlaží domu, 2. NP"]
_CONTACTS = [" Jan#@Example.COM ", "@x.cz", "jan@", "jan@nodot", "+420 777 123 4#", "777123456", "12345", "00420777123456"]
_PSC = ["110 #", "98765", "98766", "00000", "-1", "1100", "abcde", "602#"]
_FREE = ["write to jan.novak#@example.com now", "call +420 777 123 456", "nothing here #", "a@b.cz, c@d.example.org."]


def literal(strings: list[str], make):
    def query(f: Frames):
        c = F.col("c_custkey")
        return f.table("customer").select(c.alias("i"), F.replace(of(strings, c), F.lit("#"), (c % 97).cast("string")).alias("s")).select("i", *make())

    return query


def literal_sql(strings: list[str], columns: str, also: str = "") -> str:
    s = of_sql([r.replace("'", "''") for r in strings], "c_custkey")
    return f"SELECT i, {columns} FROM (SELECT *{also} FROM (SELECT c_custkey AS i, replace({s}, '#', CAST(c_custkey % 97 AS VARCHAR)) AS s FROM customer))"


def _in(values_: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values_) + "]"


_FOLD = ", trim(regexp_replace(lower(strip_accents(s)), '\\s+', ' ', 'g')) AS d"
add("x01_fold", literal(_NAMES, lambda: [text.fold("s").alias("folded"), text.match_key("s").alias("key")]), literal_sql(_NAMES, "d AS folded, trim(regexp_replace(d, '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key", _FOLD))
_KIND = f"list_contains({_in(text.STREET_WORDS)}, rtrim(w[i], '.'))"
_PART = "(length(regexp_replace(p, '[a-z]$', '')) BETWEEN 1 AND 4 AND translate(regexp_replace(p, '[a-z]$', ''), '0123456789', '') = '')"
_NUMBER = f"(len(string_split(w[i], '/')) <= 2 AND len(list_filter(string_split(w[i], '/'), lambda p: NOT {_PART})) = 0)"
_TELLING = lambda test: f"list_filter(generate_series(1, len(w)), lambda i: NOT ({test}))"
add(
    "x02_street_key",
    literal(_STREETS, lambda: [text.street_key("s").alias("key")]),
    f"SELECT i, nullif(CASE WHEN last >= first THEN array_to_string(w[first:last], ' ') ELSE d END, '') AS key FROM (SELECT *, list_min({_TELLING(_KIND)}) AS first, list_max({_TELLING(f'{_KIND} OR {_NUMBER}')}) AS last FROM (SELECT i, d, string_split(d, ' ') AS w FROM ({literal_sql(_STREETS, 'd', _FOLD)})) t)".replace("SELECT i, d, string_split", "SELECT i, d, string_split"),
)
_SAID = lambda g: f"regexp_extract_all(d, '([0-9]+)[.] *([a-z]+)(?: ([a-z]+))?', {g})"
_HIT = lambda test: f"TRY_CAST(list_extract(list_filter(list_zip({_SAID(1)}, {_SAID(2)}, {_SAID(3)}), lambda x: {test}), 1)[1] AS INT)"
_UP, _DOWN, _PATRO = _HIT("x[2] = 'np' OR (starts_with(x[2], 'nadzemni') AND x[3] = 'podlazi')"), _HIT("x[2] = 'pp' OR (starts_with(x[2], 'podzemni') AND x[3] = 'podlazi')"), _HIT(f"list_contains({_in(text.UPSTAIRS)}, x[2])")
_IN = lambda x: f"CASE WHEN {x} BETWEEN -3 AND 40 THEN {x} END"
add("x04_floor", literal(_FLOORS, lambda: [text.floor_number("s").alias("floor")]), f"SELECT i, CASE WHEN up IS NOT NULL THEN {_IN('up - 1')} WHEN down IS NOT NULL THEN {_IN('-down')} WHEN patro IS NOT NULL THEN {_IN('patro')} WHEN contains(d, 'prizem') THEN 0 WHEN contains(d, 'suteren') THEN -1 END AS floor FROM ({literal_sql(_FLOORS, f'd, {_UP} AS up, {_DOWN} AS down, {_PATRO} AS patro', _FOLD)})")
_PD = ", regexp_replace(s, '\\s+', '', 'g') AS d"
add("x06_post_code", literal(_PSC, lambda: [text.post_code("s")["psc"].alias("psc"), text.post_code("s")["country"].alias("country"), text.post_code("s")["rejection"].alias("rejection")]), literal_sql(_PSC, "CASE WHEN regexp_full_match(d, '[0-9]{5}') AND d NOT IN ('00000', '98765', '98766') THEN d END AS psc, CASE d WHEN '98765' THEN 'SK' WHEN '98766' THEN 'XX' END AS country, CASE WHEN d IN ('-1', '0', '00000') THEN 'psc_sentinel' WHEN d IN ('98765', '98766') THEN 'psc_portal_bucket' WHEN NOT regexp_full_match(d, '[0-9]{5}') THEN 'psc_malformed' END AS rejection", _PD))
add("x07_contacts", literal(_CONTACTS, lambda: [text.email("s").alias("email"), text.phone("s").alias("phone")]), literal_sql(_CONTACTS, "CASE WHEN strpos(e, '@') > 1 AND NOT ends_with(e, '@') AND contains(substr(e, strpos(e, '@') + 1), '.') THEN e END AS email, CASE WHEN length(g) = 9 THEN '420' || g WHEN length(g) > 9 THEN g END AS phone", ", lower(trim(s)) AS e, regexp_replace(s, '[^0-9]', '', 'g') AS g"))
_CHUNKS = "string_split(trim(regexp_replace(lower(strip_accents(s)), '[,;\\s]+', ' ', 'g')), ' ')"
_BARE = f"list_filter({_CHUNKS}, lambda t: NOT list_contains({_in(text.TITLES)}, regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')))"
_TOKENS = f"list_filter(flatten(list_transform({_BARE}, lambda t: string_split(trim(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '))), lambda t: t <> '' AND NOT list_contains({_in(text.TITLES)}, t))"
_SAYS = f"list_sort(list_distinct(list_filter(tokens, lambda t: length(t) > 1 AND NOT regexp_full_match(t, '[0-9]+') AND NOT list_contains({_in(text.TITLE_LEFTOVERS)}, t))))"
add(
    "x08_name_key",
    literal(_NAMES, lambda: [text.person_key("s").alias("key"), text.same_person(F.col("s"), F.lit("Jan Novák")).alias("relation")]),
    f"SELECT i, nullif(array_to_string(list_sort(tokens), ' '), '') AS key, CASE WHEN len({_SAYS}) = 0 THEN 'unknown' WHEN {_SAYS} = ['jan', 'novak'] THEN 'same' WHEN list_has_any({_SAYS}, ['jan', 'novak']) THEN 'unknown' ELSE 'different' END AS relation FROM ({literal_sql(_NAMES, f'{_TOKENS} AS tokens')})",
)
_GRAMS = lambda x: f"list_distinct(flatten(list_transform(string_split(trim(regexp_replace(lower(strip_accents({x})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: list_transform(generate_series(1, length(w) + 1), lambda k: substr('  ' || w || ' ', CAST(k AS INT), 3)))))"
add("x09_trigram", lambda f: f.table("part").select("p_partkey", F.round(text.trigram_similarity(F.col("p_name"), F.lit("Part 12")), 4).alias("sim")), f"SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 4) AS sim FROM (SELECT p_partkey, {_GRAMS('p_name')} AS a, {_GRAMS(chr(39) + 'Part 12' + chr(39))} AS b FROM part)")
add("x19_hamming", lambda f: f.events.select("event_id", values.hamming(F.col("event_id") * 2654435761, F.col("user_id") * 40503).alias("bits")), "SELECT event_id, CAST(bit_count(xor(event_id * 2654435761, user_id * 40503)) AS INT) AS bits FROM events")
add("x10_haversine", lambda f: f.people.select("id", F.round(geo.haversine(F.col("lat"), F.col("lng"), F.lit(50.08), F.lit(14.43)), 1).alias("m")), "SELECT id, round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(50.08 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(50.08)) * pow(sin(radians(14.43 - lng) / 2), 2)))), 1) AS m FROM (SELECT c_custkey AS id, 48.5 + (c_custkey * 37 % 250) / 100.0 AS lat, 12.1 + (c_custkey * 53 % 670) / 100.0 AS lng FROM customer)")
_RANKS = {f"portal {c}": n for n, c in enumerate("abcdefghi", 1)}
_PORTALS = ["portal a", "portal i", "portal e", "nobody", None]
add("x14_trust_rank", lambda f: f.table("customer").select(F.col("c_custkey").alias("i"), values.source_trust(of(_PORTALS, F.col("c_custkey")), _RANKS).cast("int").alias("rank")), f"SELECT i, CASE s WHEN 'portal a' THEN 1 WHEN 'portal i' THEN 9 WHEN 'portal e' THEN 5 ELSE 10 END AS rank FROM (SELECT c_custkey AS i, {of_sql(_PORTALS, 'c_custkey')} AS s FROM customer)")
add("x16_content_hash", lambda f: f.table("nation").select("n_nationkey", values.content_hash(["n_name", "n_regionkey", "n_nationkey"], ("n_nationkey",)).alias("h")), """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS h FROM nation""")
add("x18_fingerprint", lambda f: f.table("nation").select("n_nationkey", values.json_sha(F.col("n_name"), F.col("n_regionkey"), F.lit(None)).alias("h")), """SELECT n_nationkey, sha256('["' || n_name || '","' || n_regionkey || '",null]') AS h FROM nation""")
add("x21_cosine", lambda f: _cosine(f), "SELECT a.vec_id, b.vec_id AS other, round(1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS d FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) a JOIN (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1")


def _cosine(f: Frames):
    e = f.table("embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("e2"))
    return e.join(other, "vec_id").select("vec_id", "other", F.round(values.cosine_distance(F.col("embedding"), F.col("e2")), 6).alias("d"))


def _zero_shot(f: Frames):
    """Labels' mean vectors stand for the texts; at most a vector a label is sent around."""
    dims = 64
    means = f.table("embeddings").groupBy("label").agg(F.array(*[F.avg(F.col("embedding")[i]) for i in range(dims)]).alias("t"))
    packed = means.agg(F.sort_array(F.collect_list(F.struct("label", "t"))).alias("texts"))
    j = f.table("embeddings").join(F.broadcast(packed))
    scores = F.transform("texts", lambda x: 100.0 * values.dot(F.col("embedding"), x["t"]))
    p = values.softmax(scores)
    return j.select("vec_id", p.alias("p"), F.transform("texts", lambda x: x["label"]).alias("labels")).select("vec_id", F.element_at("labels", F.array_position("p", F.array_max("p")).cast("int")).alias("label"), F.round(F.array_max("p"), 4).alias("score"))


_TEXTS = "texts AS (SELECT label, list(a ORDER BY i) AS t FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS a FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY label, i) GROUP BY label)"
add("x20_zero_shot", _zero_shot, "SELECT vec_id, arg_max(label, (s, -label)) AS label, round(1 / sum(exp(s - top)), 4) AS score FROM (SELECT *, max(s) OVER (PARTITION BY vec_id) AS top FROM (SELECT vec_id, t.label, 100.0 * list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), t.t) AS s FROM embeddings, texts t)) GROUP BY vec_id", _TEXTS)
add("x22_clamps", lambda f: f.listing.select("id", values.clamp_int(F.col("price_czk") * 10000).alias("price"), values.placeholder_area(F.col("area_m2") % 5).alias("area")), "SELECT id, CASE WHEN price_czk * 10000 BETWEEN -2147483648 AND 2147483647 THEN price_czk * 10000 END AS price, CASE WHEN area_m2 % 5 > 0 THEN area_m2 % 5 END AS area FROM listing", LISTING)
add("x24_size_class", literal(["1+kk", "2+1", "0", "4+1", "9+2", "atyp", ""], lambda: [text.size_class("s").alias("class")]), literal_sql(["1+kk", "2+1", "0", "4+1", "9+2", "atyp", ""], "CASE WHEN s LIKE '0%' OR s LIKE '1%' THEN 1 WHEN s LIKE '2%' THEN 2 WHEN s LIKE '3%' THEN 3 WHEN regexp_matches(s, '^[4-9]') THEN 4 END AS class"))
_DATES = ["2024-05-01T10:00", "#.5.2024", "31. 12. 2023", "nonsense", "30.2.2024", "", "2024-02-#", "1. #. 2022 late"]
add(
    "x25_dates",
    literal(_DATES, lambda: [text.czech_date("s").cast("string").alias("date")]),
    literal_sql(_DATES, "CAST(coalesce(CASE WHEN regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(substr(s, 1, 10) AS DATE) END, CAST(try_strptime(regexp_replace(regexp_extract(s, '^[0-9]{1,2}[.] *[0-9]{1,2}[.] *[0-9]{4}'), ' ', '', 'g'), '%d.%m.%Y') AS DATE)) AS VARCHAR) AS date"),
)
_REDACTED = f"regexp_replace(regexp_replace(s, '{text.ADDRESS}', '[redacted]', 'g'), '(?:\\+\\d{{1,3}}[ -]?)?\\(?\\d{{3}}\\)?[ -]?\\d{{3}}[ -]?\\d{{3,4}}', '[redacted]', 'g')"
add("p08_x32_redact", literal(_FREE, lambda: [text.redact("s").alias("t")]), literal_sql(_FREE, f"{_REDACTED} AS t"))
add("p09_masked_search", lambda f: literal(_FREE, lambda: [text.redact("s").alias("m")])(f).where(F.col("m").ilike("%novak%") | F.col("m").ilike("%redacted%")).select("i"), f"SELECT i FROM ({literal_sql(_FREE, f'{_REDACTED} AS m')}) WHERE m ILIKE '%novak%' OR m ILIKE '%redacted%'")
_RAW = ["-", " 602 0#", "n/a", "Praha #", "obec Brno", "11000", "0"]
add("x31_transforms", literal(_RAW, lambda: [text.TRANSFORMS["sentinel_drop"]("s").alias("kept"), text.TRANSFORMS["psc_normalise"]("s").alias("psc"), text.strip_prefix("s", "obec ").alias("bare")]), literal_sql(_RAW, "CASE WHEN trim(s) NOT IN ('', '-', '-1', '0', 'n/a', 'null') THEN s END AS kept, CASE WHEN regexp_full_match(replace(s, ' ', ''), '[0-9]{5}') AND replace(s, ' ', '') NOT IN ('00000', '98765', '98766') THEN replace(s, ' ', '') END AS psc, CASE WHEN starts_with(s, 'obec ') THEN trim(substr(s, 6)) ELSE s END AS bare"))
_HN = ["#/45a", "12", "ev. #", "č.p.", "", "ev. č. 12", "č.ev. #", "evidenční číslo 7", "128 / # B", "č.p. #/3", "1234567"]
_PLAIN = "trim(regexp_replace(replace(lower(strip_accents(s)), '.', ' '), '\\s+', ' ', 'g'))"
_MARKED = "'\\b((?:(?:evidencni|evid|ev|cislo|e|c) )+)([0-9]+)'"
_SET = f"list_has_any(string_split(regexp_extract(d, {_MARKED}, 1), ' '), ['evidencni', 'evid', 'ev', 'e'])"
add(
    "x05_house_number",
    literal(_HN, lambda: [text.house_number("s")[c].alias(c) for c in ("cp", "co", "sign", "ev")]),
    f"SELECT i, CASE WHEN length(head) BETWEEN 1 AND 6 THEN head END AS cp, CASE WHEN length(co) BETWEEN 1 AND 5 THEN co END AS co, nullif(regexp_extract(tail, '^/[0-9]+ ?([a-z])', 1), '') AS sign, ev FROM (SELECT *, regexp_extract(tail, '^/([0-9]+)', 1) AS co FROM (SELECT *, substr(rest, strpos(rest, head) + length(head)) AS tail FROM (SELECT *, regexp_extract(rest, '[0-9]+') AS head FROM (SELECT i, CASE WHEN {_SET} THEN nullif(regexp_extract(d, {_MARKED}, 2), '') END AS ev, regexp_replace(CASE WHEN {_SET} THEN regexp_replace(d, {_MARKED}, ' ') ELSE d END, ' */ *', '/', 'g') AS rest FROM ({literal_sql(_HN, 'd', f', {_PLAIN} AS d')})))))",
)
_RAWS = ["MasarykovaNová 12", "Jesenická", " (Hlavní 128/4a), ", "ul. Krátká", "12", "", "Dlouhá prodej bytu"]
add("x03_clean_street", literal(_RAWS, lambda: [text.clean_street("s", ("ul", "ulice"), ("prodej", "bytu", "byt")).alias("street")]))
_LOCAL = ["Hlavní #, Brno", "Brno # - Líšeň", "Praha 5", "Krátká, Praha", "Brno"]
add("x03_street_of_locality", literal(_LOCAL, lambda: [text.street_of_locality("s", F.lit("Brno")).alias("street")]))

# sources


def _payloads(f: Frames):
    """The monthly series of sales as the JSON arrays they arrive in, one a nation, with a broken one and an empty one."""
    rows = F.to_json(F.collect_list(F.struct("year", "month", "price", F.col("active_count").cast("int").alias("active_count"))))
    good = f.monthly.where("kind = 'sale'").groupBy("entity").agg(rows.alias("payload"))
    return good.unionByName(f.spark.createDataFrame([(-1, "broken"), (-2, "[]"), (-3, '[{"year":2020,"month":13,"price":1}]')], "entity int, payload string"))


add("s05_statistics_json", lambda f: readers.statistics(_payloads(f), "payload", ["entity"]).select("entity", "year", "month", "price", "active_count"), "SELECT entity, year, month, price, CAST(active_count AS INT) AS active_count FROM monthly WHERE kind = 'sale'", MONTHLY)
_CUBE = '{"id":["area","sex"],"size":[2,3],"dimension":{"area":{"category":{"index":{"A":0,"B":1}}},"sex":{"category":{"index":{"m":0,"f":1,"t":2}}}},"value":[1,2,3,4,5,6]}'
add("s10_json_stat", lambda f: readers.json_stat(f.spark.createDataFrame([(1, _CUBE)], "k int, payload string"), "payload", ["k"]).select("k", F.col("codes")["area"].alias("area"), F.col("codes")["sex"].alias("sex"), "value"), "SELECT 1 AS k, area, sex, CAST(row_number() OVER (ORDER BY a, b) AS DOUBLE) AS value FROM (VALUES ('A', 0), ('B', 1)) x(area, a), (VALUES ('m', 0), ('f', 1), ('t', 2)) y(sex, b)")
add("s01_walk_summary", lambda f: readers.walk_summary(f.table("lineitem").select(F.col("l_returnflag").alias("scope"), F.col("l_partkey").alias("native_id"), F.lit(2000).alias("expected")), ["scope"], "expected"), "SELECT l_returnflag AS scope, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_ids, 2000 AS expected, count(DISTINCT l_partkey) >= 2000 AS complete FROM lineitem GROUP BY l_returnflag")
add("s02_delta_probe", lambda f: readers.new_keys(f.table("lineitem").select("l_partkey").distinct(), f.table("lineitem").where("l_quantity > 46").select("l_partkey"), ["l_partkey"]), "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 46)")
add("s04_json_adapter", lambda f: readers.listing_from_json(f.events.select("event_id", "props"), "props", {"k": "$.k", "missing": "$.x.y"}), "SELECT event_id, props ->> '$.k' AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
add("s04_html_adapter", lambda f: readers.html_fields(f.table("pages").select("page_id", "html"), "html", {"lang": '<html lang="([a-z]+)"', "price": "price=([0-9]+)"}), """SELECT page_id, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang, nullif(regexp_extract(html, 'price=([0-9]+)', 1), '') AS price FROM pages""")
add("s13_archive_keys", lambda f: readers.archive_bodies(f.table("pages").select("page_id", "html"), "html").select("page_id", "digest", "object_key"), "SELECT page_id, h AS digest, substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h AS object_key FROM (SELECT page_id, sha256(html) AS h FROM pages)")
add("s16_outbox", lambda f: readers.outbox(f.events.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("last_attempt_at"), (F.col("event_id") % 5).alias("attempts"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("sent_at")), "2024-01-20 00:00:00", 60, 4).select("event_id"), "SELECT event_id FROM events WHERE (event_id % 3 = 0 OR ts <= TIMESTAMP '2024-01-20' - INTERVAL 60 MINUTE) AND event_id % 5 < 4 AND event_id % 2 <> 0")
del AS_OF_SQL
