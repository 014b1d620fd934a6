"""Queries of joins, spatial operators, sets, sorts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import paging, spatial
from ..sources import readers
from .frames import AS_OF_SQL, CENTRES, CHILD, DISTANCE, LISTING, LISTING_NP, PEOPLE, SNAPSHOT, TAGS, Family, Frames

family = Family()
add = family.add
D = DISTANCE.format("lat", "lng", "rlat", "rlng")

add("j01_inner", lambda f: f.snapshot.join(f.table("part"), F.col("listing_id") == F.col("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("n"), F.max("price").alias("top")), "SELECT p_brand, count(*) AS n, max(price) AS top FROM snapshot JOIN part ON listing_id = p_partkey GROUP BY p_brand", SNAPSHOT)


def _stitch(f: Frames):
    o = f.table("orders").where("o_orderdate >= '2000-01-01'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    e = f.events.groupBy("user_id").agg(F.count("*").alias("events"))
    c = f.table("customer").join(F.broadcast(f.table("nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").join(e, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", "n_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("events", F.lit(0)).alias("events"))


add("j02_j03_left_stitch", _stitch, "SELECT c_custkey, n_name, coalesce(n, 0) AS n, coalesce(events, 0) AS events FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= '2000-01-01' GROUP BY o_custkey) ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS events FROM events GROUP BY user_id) ON user_id = c_custkey")
add("j06_conditional_pick", lambda f: _pick(f), "SELECT p.id, coalesce(a.rid, b.rid) AS rid, CASE WHEN a.rid IS NOT NULL THEN 'own' WHEN b.rid IS NOT NULL THEN 'near' END AS how FROM people p LEFT JOIN (SELECT nation, min(rid) AS rid FROM (SELECT rid, c_nationkey AS nation FROM centres JOIN customer ON rid = c_custkey WHERE rid % 100 = 0) GROUP BY nation) a ON a.nation = p.nation LEFT JOIN (SELECT id, arg_min(rid, (d, rid)) AS rid FROM (SELECT id, rid, " + D + " AS d FROM people, centres) WHERE d <= 30000 GROUP BY id) b ON b.id = p.id", PEOPLE, CENTRES)


def _pick(f: Frames):
    own = f.table("customer").where("c_custkey % 100 = 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.min("c_custkey").alias("own"))
    near = spatial.nearest_within(f.people.select("id", "lat", "lng", "nation"), f.centres, 30_000)
    j = near.join(own, "nation", "left")
    return j.select("id", F.coalesce("own", "nearest_id").alias("rid"), F.when(F.col("own").isNotNull(), "own").when(F.col("nearest_id").isNotNull(), "near").alias("how"))


add("j07_semi", lambda f: f.table("customer").join(f.table("orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
add("j08_anti", lambda f: f.table("customer").join(f.table("orders").where("o_orderdate >= '2001-01-01'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= '2001-01-01')")
add("j10_one_row_bounds", lambda f: f.listing.join(F.broadcast(f.listing.agg(F.avg("price_czk").alias("m"))), F.col("price_czk") > 1.9 * F.col("m")).select("id"), "SELECT id FROM listing WHERE price_czk > 1.9 * (SELECT avg(price_czk) FROM listing)", LISTING)
add("j12_radius_join", lambda f: spatial.radius_join(f.people.select("id", "lat", "lng"), f.centres.select("rid", "rlat", "rlng"), 15_000).select("id", "rid", F.round("distance", 1).alias("distance")), f"SELECT id, rid, round({D}, 1) AS distance FROM people, centres WHERE {D} <= 15000", PEOPLE, CENTRES)
add("j13_nearest", lambda f: spatial.nearest(f.people.select("id", "lat", "lng"), f.centres.select("rid", "rlat", "rlng")).select("id", "nearest_id", F.round("nearest_m", 1).alias("nearest_m")), f"SELECT id, arg_min(rid, (d, rid)) AS nearest_id, round(min(d), 1) AS nearest_m FROM (SELECT id, rid, {D} AS d FROM people, centres) GROUP BY id", PEOPLE, CENTRES)
add("a59_proximity", lambda f: spatial.proximity_maxima(f.people.select("id", "lat", "lng"), f.centres, ["pop", "jobs"], {"5km": 5_000, "15km": 15_000}), f"SELECT id, max(pop) FILTER (WHERE d <= 5000) AS near_pop_5km, max(pop) FILTER (WHERE d <= 15000) AS near_pop_15km, max(jobs) FILTER (WHERE d <= 5000) AS near_jobs_5km, max(jobs) FILTER (WHERE d <= 15000) AS near_jobs_15km FROM (SELECT *, {D} AS d FROM people, centres) WHERE d <= 15000 GROUP BY id", PEOPLE, CENTRES)


def _squares(f: Frames):
    """Four squares that leave gaps between them, with their middles."""
    rows = []
    for u, (y, x) in enumerate([(48.605, 12.205), (48.605, 15.505), (49.805, 12.205), (49.805, 15.505)], 1):
        ring = [(y, x), (y, x + 3.11), (y + 1.09, x + 3.11), (y + 1.09, x), (y, x)]
        rows.append((u, [{"lat": a, "lng": b} for a, b in ring]))
    return f.spark.createDataFrame(rows, "unit int, ring array<struct<lat: double, lng: double>>")


def _admin(f: Frames):
    centres = f.centres.select("rid", "rlat", "rlng")
    return spatial.admin_unit(f.people.select("id", "lat", "lng"), _squares(f).withColumn("unit", F.col("unit").cast("long")), centres, 20_000).select("id", "unit", "method")


_SQ = "squares AS (SELECT * FROM (VALUES (1, 48.605, 12.205), (2, 48.605, 15.505), (3, 49.805, 12.205), (4, 49.805, 15.505)) t(unit, y, x))"
add(
    "j14_containment_with_fallback",
    _admin,
    f"SELECT p.id, coalesce(h.unit, n.rid) AS unit, CASE WHEN h.unit IS NOT NULL THEN 'contained' WHEN n.rid IS NOT NULL THEN 'nearest' END AS method FROM people p LEFT JOIN (SELECT id, min(unit) AS unit FROM people, squares WHERE lat > y AND lat < y + 1.09 AND lng > x AND lng < x + 3.11 GROUP BY id) h ON h.id = p.id LEFT JOIN (SELECT id, arg_min(rid, (d, rid)) AS rid FROM (SELECT id, rid, {D} AS d FROM people, centres) WHERE d <= 20000 GROUP BY id) n ON n.id = p.id",
    PEOPLE,
    CENTRES,
    _SQ,
)


def _corridor(f: Frames):
    seg = f.spark.createDataFrame([("A", 49.0, 12.5, 49.6, 14.0), ("A", 49.6, 14.0, 50.2, 16.0), ("B", 50.5, 13.0, 48.9, 17.5)], "line string, alat double, alng double, blat double, blng double")
    return spatial.corridor(f.people.select("id", "lat", "lng"), seg, 4_000).select("id", "line", F.round("distance", 1).alias("distance"))


add(
    "j15_w05_c03_corridor",
    _corridor,
    """SELECT id, line, round(d, 1) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, line) AS rn FROM (
    SELECT id, line, sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)) AS d FROM (SELECT *, greatest(0.0, least(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM (
    SELECT id, line, (alng - lng) * k AS ax, (alat - lat) * 111000 AS ay, (blng - alng) * k AS dx, (blat - alat) * 111000 AS dy FROM (SELECT *, cos(radians(lat)) * 111000 AS k FROM people,
    (VALUES ('A', 49.0, 12.5, 49.6, 14.0), ('A', 49.6, 14.0, 50.2, 16.0), ('B', 50.5, 13.0, 48.9, 17.5)) s(line, alat, alng, blat, blng))))) WHERE d <= 4000) WHERE rn = 1""",
    PEOPLE,
)
add("j16_tree", lambda f: f.table("customer").join(F.broadcast(f.table("nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(f.table("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", F.concat_ws(" > ", "r_name", "n_name").alias("path")), "SELECT c_custkey, r_name || ' > ' || n_name AS path FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
add("j18_parallel_arrays", lambda f: f.spark.sql("SELECT array(1L, 2L, 3L) AS ids, array(10.5D, 20.5D, 30.5D) AS drops").select(F.explode(F.arrays_zip("ids", "drops")).alias("d")).select("d.*").join(f.table("part"), F.col("ids") == F.col("p_partkey")).select("ids", "drops", "p_name"), "SELECT ids, drops, p_name FROM (SELECT unnest([1::BIGINT, 2, 3]) AS ids, unnest([10.5::DOUBLE, 20.5, 30.5]) AS drops) JOIN part ON ids = p_partkey")
add("j19_json_lateral", lambda f: f.events.select("event_id", F.explode(F.from_json("props", "map<string, int>")).alias("key", "v")).groupBy("key").agg(F.count("*").alias("n"), F.sum("v").alias("total")), "SELECT 'k' AS key, count(*) AS n, CAST(sum(CAST(props ->> '$.k' AS INT)) AS BIGINT) AS total FROM events")
add("j20_unpivot", lambda f: f.listing_np.selectExpr("id", "stack(3, 'price', cast(price_czk as double), 'area', cast(area_m2 as double), 'floor', cast(floor as double)) as (field, value)").groupBy("field").agg(F.count("value").alias("filled"), F.count("*").alias("n")), "SELECT field, count(v) AS filled, count(*) AS n FROM (SELECT 'price' AS field, price_czk AS v FROM listing_np UNION ALL SELECT 'area', area_m2 FROM listing_np UNION ALL SELECT 'floor', floor FROM listing_np) GROUP BY field", LISTING_NP)
add("j22_pair_both_sides", lambda f: f.table("lineitem").select("l_orderkey", F.explode(F.array(F.struct(F.lit("part").alias("side"), F.col("l_partkey").alias("id")), F.struct(F.lit("supplier").alias("side"), F.col("l_suppkey").alias("id")))).alias("s")).select("l_orderkey", "s.*").groupBy("side", "id").agg(F.countDistinct("l_orderkey").alias("pairs")), "SELECT side, id, count(DISTINCT l_orderkey) AS pairs FROM (SELECT l_orderkey, 'part' AS side, l_partkey AS id FROM lineitem UNION ALL SELECT l_orderkey, 'supplier', l_suppkey FROM lineitem) GROUP BY side, id")


def _lookup(f: Frames):
    req = f.spark.createDataFrame([("1-URGENT", 1), ("1-URGENT", 4), ("5-LOW", 7), ("2-HIGH", 32), ("none", -5)], "source string, id long")
    return readers.portal_lookup(req, f.listing, ["source", "id"], ["price_czk"])


add("j24_s14_lookup", _lookup, "SELECT source, r.id, l.id IS NOT NULL AS found, price_czk FROM (VALUES ('1-URGENT', 1), ('1-URGENT', 4), ('5-LOW', 7), ('2-HIGH', 32), ('none', -5)) r(source, id) LEFT JOIN listing l USING (source, id)".replace("r.id, l.id", "id, l.o").replace("listing l", "(SELECT *, id AS o FROM listing) l"), LISTING)


def _mode(f: Frames):
    """For each polygon the district that most of the points in it belong to; ties go to the smaller name."""
    p = f.people.select("id", "lat", "lng", "nation")
    n = spatial.contained_in(p, _squares(f)).groupBy("unit", "nation").agg(F.count("*").alias("n"))
    return n.withColumn("rn", _rn(["unit"], [F.desc("n"), F.asc("nation")])).where("rn = 1").select("unit", "nation", "n")


add("j25_w09_mode_match", _mode, "SELECT unit, nation, n FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY n DESC, nation) AS rn FROM (SELECT unit, nation, count(*) AS n FROM people, squares WHERE lat > y AND lat < y + 1.09 AND lng > x AND lng < x + 3.11 GROUP BY unit, nation)) WHERE rn = 1", PEOPLE, _SQ)


def _rn(keys, order):
    from pyspark.sql import Window

    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def _walk(f: Frames):
    amenities = f.centres.withColumn("category", F.when(F.col("rid") % 3 == 0, "school").when(F.col("rid") % 3 == 1, "shop").otherwise("stop"))
    return spatial.walk_score(spatial.near_by_category(f.people, amenities, 40_000), {"school": 3.0, "shop": 2.0, "stop": 1.0}, 40_000)


add("a49_walkability", _walk, f"SELECT id, round_even(sum(round_even(100 * greatest(0.0, 1 - d / 40000), 0) * w) / 6.0, 1) AS score, CAST(sum(n) AS BIGINT) AS amenities FROM (SELECT id, min(d) AS d, count(*) AS n, CASE rid % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM (SELECT *, {D} AS d FROM people, centres) WHERE d <= 40000 GROUP BY id, rid % 3) GROUP BY id", PEOPLE, CENTRES)
_KIND = "CASE rid % 3 WHEN 0 THEN 'school' WHEN 1 THEN 'shop' ELSE 'stop' END"


def _anchors(f: Frames):
    c = f.centres.withColumn("category", F.when(F.col("rid") % 3 == 0, "school").when(F.col("rid") % 3 == 1, "shop").otherwise("stop"))
    return spatial.radius_join(f.people.select("id", "lat", "lng"), c, 25_000).groupBy("id", "category").agg(F.count("*").alias("n"), F.min_by("rid", F.struct("distance", "rid")).alias("nearest"), F.round(F.min("distance"), 1).alias("metres"))


add("a50_anchors", _anchors, f"SELECT id, category, count(*) AS n, arg_min(rid, (d, rid)) AS nearest, round(min(d), 1) AS metres FROM (SELECT *, {_KIND} AS category, {D} AS d FROM people, centres) WHERE d <= 25000 GROUP BY id, category", PEOPLE, CENTRES)


def _pins(f: Frames):
    p = F.col("o_custkey")
    return f.table("orders").select(F.col("o_orderpriority").alias("source"), F.concat_ws("|", (p * 37 % 25).cast("string"), (p * 53 % 67).cast("string")).alias("cell"), F.concat(F.lit("st"), (F.col("o_orderkey") % 3).cast("string")).alias("street_key"), (F.col("o_orderkey") % 5 == 0).alias("foreign"), (p % 400).cast("double").alias("near_centre_m"))


add(
    "e11_pin_collisions",
    lambda f: spatial.collisions(_pins(f), 12, 2, F.col("source") == "1-URGENT").withColumn("foreign_share", F.round("foreign_share", 4)),
    "SELECT source, cell, n, streets, round(fs, 4) AS foreign_share, near_m, CASE WHEN n < 2 THEN 'normal' WHEN fs >= 0.5 THEN 'foreign_resort_centroid' WHEN n >= 12 AND streets >= 2 THEN CASE WHEN near_m <= 150 THEN 'town_centroid_suspect' ELSE 'parser_collapse_suspect' END WHEN source = '1-URGENT' AND n < 12 THEN 'legitimate_multiunit' WHEN streets <= 1 THEN 'building_1_to_many' ELSE 'normal' END AS class FROM (SELECT o_orderpriority AS source, (o_custkey * 37 % 25) || '|' || (o_custkey * 53 % 67) AS cell, count(*) AS n, count(DISTINCT o_orderkey % 3) AS streets, avg(CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE 0.0 END) AS fs, CAST(min(o_custkey % 400) AS DOUBLE) AS near_m FROM orders GROUP BY 1, 2)",
)
add("a19_density", lambda f: spatial.density(f.listing, ["district"], 78.5), "SELECT district, count(*) AS n, round(count(*) / 78.5, 4) AS per_km2 FROM listing GROUP BY district", LISTING)

# sorts, limits, pages
_ORD = [("price_czk", True), ("id", False)]
add("t03_keyset_page_1", lambda f: paging.page(f.listing_np, _ORD, 50).select("id", "price_czk"), "SELECT id, price_czk FROM listing_np ORDER BY price_czk DESC NULLS LAST, id LIMIT 50", LISTING_NP)
add("t03_keyset_page_2", lambda f: paging.page(f.listing_np, _ORD, 50, [300000.0, 10]).select("id", "price_czk"), "SELECT id, price_czk FROM listing_np WHERE price_czk < 300000 OR price_czk IS NULL OR (price_czk = 300000 AND id > 10) ORDER BY price_czk DESC NULLS LAST, id LIMIT 50", LISTING_NP)
add("t03_keyset_null_phase", lambda f: paging.page(f.listing_np, _ORD, 50, [None, 5000]).select("id", "price_czk"), "SELECT id, price_czk FROM listing_np WHERE price_czk IS NULL AND id > 5000 ORDER BY id LIMIT 50", LISTING_NP)
add("t04_cursor", lambda f: paging.page(f.listing, [("first_seen_at", True), ("id", True)], 40, [*_decoded()]).select("id"), "SELECT id FROM listing WHERE (first_seen_at, id) < (TIMESTAMP '2000-06-01', 9000) ORDER BY first_seen_at DESC, id DESC LIMIT 40", LISTING)


def _decoded():
    from datetime import datetime

    at, id_ = paging.from_cursor(paging.cursor(["2000-06-01T00:00:00", 9000]))
    return datetime.fromisoformat(at), id_


add("t05_p05_feed_key", lambda f: f.listing.select("id", paging.feed_key(F.unix_timestamp("first_seen_at"), F.col("id")).alias("key")).orderBy(F.desc("key")).limit(100), "SELECT id, lpad(CAST(CAST(epoch(first_seen_at) AS BIGINT) AS VARCHAR), 12, '0') || lpad(CAST(id AS VARCHAR), 19, '0') AS key FROM listing ORDER BY key DESC LIMIT 100", LISTING)
add("t06_a28_leaderboard", lambda f: paging.leaderboard(f.listing, ["property_id"], {"n": F.count("*"), "active": F.count(F.when(F.col("is_active"), 1)), "volume": F.round(F.sum("price_czk"), 2)}, "volume", 25), "SELECT property_id, count(*) AS n, count(*) FILTER (WHERE is_active) AS active, round(sum(price_czk), 2) AS volume FROM listing GROUP BY property_id ORDER BY volume DESC NULLS LAST, property_id LIMIT 25", LISTING)
add("t07_stalest", lambda f: paging.stalest(f.listing, "verified_at", "id", 100, F.col("verified_at") < F.lit("2000-01-01").cast("timestamp")).select("id"), "SELECT id FROM listing WHERE verified_at IS NULL OR verified_at < '2000-01-01' ORDER BY verified_at NULLS FIRST, id LIMIT 100", LISTING)
add("t08_k10_queue_claim", lambda f: paging.claim_queue(f.events.select(F.col("event_id").alias("id"), (F.col("event_id") % 3).alias("priority"), F.col("ts").alias("enqueued_at"), (F.col("event_id") % 7).alias("attempts"), F.when(F.col("event_id") % 4 == 0, F.col("ts")).alias("claimed_at")), 60).select("id", "priority"), "SELECT event_id AS id, event_id % 3 AS priority FROM events WHERE event_id % 7 < 5 AND event_id % 4 <> 0 ORDER BY event_id % 3 DESC, ts, event_id LIMIT 60")
add("t10_top_clusters", lambda f: f.listing.groupBy("district", "disposition").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "district", "disposition").limit(12), "SELECT district, disposition, count(*) AS n FROM listing GROUP BY district, disposition ORDER BY n DESC, district, disposition LIMIT 12", LISTING)
add("t11_o08_sample", lambda f: f.listing.sample(0.1, seed=7).select("id"))
add("t12_newest_unsampled", lambda f: f.listing.join(f.events.where("event_type = 'signup'").select(F.col("user_id").alias("property_id")), "property_id", "left_anti").orderBy(F.desc("first_seen_at"), F.desc("id")).limit(30).select("id"), "SELECT id FROM listing WHERE property_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup') ORDER BY first_seen_at DESC, id DESC LIMIT 30", LISTING)
add("t13_collated_sort", lambda f: f.table("customer").select(F.lower("c_name").alias("k"), "c_custkey").orderBy("k", "c_custkey").limit(20), "SELECT lower(c_name) AS k, c_custkey FROM customer ORDER BY k, c_custkey LIMIT 20")
add("w07_stratified", lambda f: paging.stratified_sample(f.listing, ["region"], "price_czk", "id", "x", 5).select("region", "band", "id", "rank"), "SELECT region, CAST(band AS INT) AS band, id, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY region, band ORDER BY md5('x' || id), id) AS rn FROM (SELECT *, ntile(4) OVER (PARTITION BY region ORDER BY price_czk, id) AS band FROM listing)) WHERE rn <= 5", LISTING)
add("w06_first_per_source", lambda f: _first_per_source(f), "SELECT property_id, source, child_id, CAST(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY property_id) AS BIGINT) AS n_sources, min(first_seen) OVER (PARTITION BY property_id) AS since FROM (SELECT *, row_number() OVER (PARTITION BY property_id, source ORDER BY first_seen, child_id) AS rn FROM child)", CHILD)


def _first_per_source(f: Frames):
    from pyspark.sql import Window

    p = Window.partitionBy("property_id")
    c = f.child.withColumn("rn", _rn(["property_id", "source"], [F.asc("first_seen"), F.asc("child_id")]))
    return c.select("property_id", "source", "child_id", F.sum(F.when(F.col("rn") == 1, 1).otherwise(0)).over(p).alias("n_sources"), F.min("first_seen").over(p).alias("since"))


add("w10_o15_version_cap", lambda f: _cap(f), "SELECT listing_id, o1, o2, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY (flag = 'N') DESC, price DESC NULLS LAST, o1 DESC, o2 DESC) AS rn FROM snapshot) WHERE rn <= 3", SNAPSHOT)


def _cap(f: Frames):
    from ..operators.quality import version_cap

    s = f.snapshot.withColumn("ok", F.col("flag") == "N").withColumn("v", F.struct("o1", "o2"))
    return version_cap(s, ["listing_id"], "ok", "price", "v", 3).select("listing_id", "o1", "o2", "rank")


add("w12_renumber", lambda f: f.table("nation").select("n_nationkey", _rn([F.lit(1)], [F.desc("n_name")]).alias("position")), "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_name DESC) AS INT) AS position FROM nation")
add("a31_facets", lambda f: paging.facets(f.listing, ["district", "building_type", "has_lift"]), "SELECT 'district' AS facet, district AS value, count(*) AS n FROM listing GROUP BY district UNION ALL SELECT 'building_type', building_type, count(*) FROM listing GROUP BY building_type UNION ALL SELECT 'has_lift', CAST(has_lift AS VARCHAR), count(*) FROM listing GROUP BY has_lift", LISTING)

# sets
add("u01_union_all", lambda f: f.table("customer").select(F.col("c_nationkey").alias("k")).unionByName(f.table("supplier").select(F.col("s_nationkey").alias("k"))).groupBy("k").agg(F.count("*").alias("n")), "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")
add("u02_preference_union", lambda f: f.table("part").join(f.table("lineitem").where("l_quantity > 49").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_suppkey").alias("a")), "p_partkey", "left").join(f.table("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("b")), "p_partkey", "left").select("p_partkey", F.coalesce("a", "b").alias("supplier")), "SELECT p_partkey, coalesce((SELECT max(l_suppkey) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49), (SELECT min(l_suppkey) FROM lineitem WHERE l_partkey = p_partkey)) AS supplier FROM part")
add("u03_shadowed_union", lambda f: _shadow(f), "SELECT user_id, day, 1 AS rank FROM tags WHERE event_type = 'click' UNION ALL SELECT user_id, day, 2 FROM tags b WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM tags a WHERE a.event_type = 'click' AND a.user_id = b.user_id AND a.day = b.day)", TAGS)


def _shadow(f: Frames):
    a, b = (f.tags.where(F.col("event_type") == t).select("user_id", "day") for t in ("click", "view"))
    return a.withColumn("rank", F.lit(1)).unionByName(b.join(a, ["user_id", "day"], "left_anti").withColumn("rank", F.lit(2)))


_SETS = {"u04_intersect": ("intersect", "INTERSECT"), "u05_except": ("subtract", "EXCEPT")}
for _n, (_m, _s) in _SETS.items():
    add(_n, lambda f, m=_m: getattr(f.tags.where("event_type = 'click'").select("user_id", "day"), m)(f.tags.where("event_type = 'purchase'").select("user_id", "day")), f"SELECT user_id, day FROM tags WHERE event_type = 'click' {_s} SELECT user_id, day FROM tags WHERE event_type = 'purchase'", TAGS)
add("u06_symmetric_difference", lambda f: _symmetric(f), "SELECT user_id, CAST(count(*) FILTER (WHERE a = 1 AND b = 0) AS INT) AS only_a, CAST(count(*) FILTER (WHERE b = 1 AND a = 0) AS INT) AS only_b FROM (SELECT user_id, event_type, max(CASE WHEN day < DATE '2024-01-04' THEN 1 ELSE 0 END) AS a, max(CASE WHEN day > DATE '2024-01-26' THEN 1 ELSE 0 END) AS b FROM tags GROUP BY user_id, event_type) GROUP BY user_id", TAGS)


def _symmetric(f: Frames):
    early, late = F.col("day") < "2024-01-04", F.col("day") > "2024-01-26"
    g = f.tags.groupBy("user_id").agg(F.collect_set(F.when(early, F.col("event_type"))).alias("a"), F.collect_set(F.when(late, F.col("event_type"))).alias("b"))
    return g.select("user_id", F.size(F.array_except("a", "b")).alias("only_a"), F.size(F.array_except("b", "a")).alias("only_b"))


# projections
_TOM = f"CAST(greatest(0, floor((epoch(CASE WHEN is_active THEN {AS_OF_SQL} ELSE last_seen_at END) - epoch(first_seen_at)) / 86400)) AS BIGINT)"


def _browse(f: Frames):
    from ..functions import values
    from .frames import AS_OF

    tom = values.tom_days(F.col("first_seen_at"), F.col("last_seen_at"), F.col("is_active"), F.lit(AS_OF))
    ppm = values.price_per_m2(F.col("price_czk"), F.col("area_m2"), 2)
    return f.listing_np.select("id", tom.alias("tom_days"), ppm.alias("price_per_m2"), values.days_between(F.col("last_seen_at"), F.lit(AS_OF)).alias("data_age_days"), F.concat_ws(" ", "district", "region", "disposition").alias("place_search_text"))


add("p01_p04_browse_projection", _browse, f"SELECT id, {_TOM} AS tom_days, CASE WHEN area_m2 > 0 THEN CAST(round(CAST(price_czk / area_m2 AS DECIMAL(28, 10)), 2) AS DOUBLE) END AS price_per_m2, CAST(floor((epoch({AS_OF_SQL}) - epoch(last_seen_at)) / 86400) AS BIGINT) AS data_age_days, concat_ws(' ', district, region, disposition) AS place_search_text FROM listing_np", LISTING_NP)
add("p06_public_view", lambda f: f.table("customer").select("c_custkey", "c_mktsegment", F.lit(None).cast("string").alias("phone"), F.col("c_name").isNotNull().alias("has_name")), "SELECT c_custkey, c_mktsegment, CAST(NULL AS VARCHAR) AS phone, c_name IS NOT NULL AS has_name FROM customer")
add("s15_geojson", lambda f: f.people.select("id", readers.geojson(F.col("lat"), F.col("lng")).alias("geometry")).select("id", F.get_json_object("geometry", "$.coordinates[0]").cast("double").alias("lng"), F.get_json_object("geometry", "$.type").alias("type")), "SELECT id, CAST(round(lng, 5) AS DOUBLE) AS lng, 'Point' AS type FROM people", PEOPLE)
add("x11_cell_key", lambda f: f.people.select("id", geo.cell_key(F.col("lat"), F.col("lng")).alias("cell")), "SELECT id, CAST(CAST(lat AS DECIMAL(9, 4)) AS VARCHAR) || ',' || CAST(CAST(lng AS DECIMAL(9, 4)) AS VARCHAR) AS cell FROM people", PEOPLE)
