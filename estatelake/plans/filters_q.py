"""Queries of the filter registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as R
from .frames import AS_OF, AS_OF_SQL, CENTRES, DISTANCE, LISTING, LISTING_NP, TAGS, Family, Frames

family = Family()
TARGET = {"lat": 49.5, "lng": 14.5, "area_m2": 80, "floor": 3, "disposition": "2+kk"}


def spec(name: str, value: dict, where: str, frame: str = "listing", target: dict | None = None) -> None:
    def make(f: Frames):
        return getattr(f, frame).where(R.compile_filters(value, AS_OF, target)).select("id")

    family.add(name, make, f"SELECT id FROM {frame} WHERE {where}", LISTING if frame == "listing" else LISTING_NP)


spec("f01_equality", {"category_main": "BUILDING", "has_lift": True}, "category_main = 'BUILDING' AND has_lift")
spec("f02_multi_select", {"portals": ["1-URGENT", "2-HIGH"], "dispositions": []}, "source IN ('1-URGENT', '2-HIGH')")
spec("f03_unknown_sentinel", {"furnished": ["ano", R.UNKNOWN]}, "furnished = 'ano' OR furnished IS NULL OR furnished NOT IN ('ano', 'ne', 'castecne')")
spec("f04_ranges", {"min_area_m2": 50, "max_area_m2": 90, "min_parking_lots": 2}, "area_m2 BETWEEN 50 AND 90 AND parking_lots >= 2")
spec("f05_price_with_missing", {"min_price_czk": 100000, "max_price_czk": 200000, "include_no_price": True}, "price_czk IS NULL OR price_czk BETWEEN 100000 AND 200000", "listing_np")
spec("f05_price_without_missing", {"min_price_czk": 100000, "include_no_price": False}, "price_czk >= 100000", "listing_np")
spec("f06_price_per_m2", {"min_price_per_m2": 1000, "max_price_per_m2": 3000}, "area_m2 > 0 AND price_czk / area_m2 BETWEEN 1000 AND 3000", "listing_np")
spec("f07_bands", {"area_band_pct": 0.25, "floor_band": 1}, "area_m2 BETWEEN 60 AND 100 AND floor BETWEEN 2 AND 4", target=TARGET)
spec("f08_disposition_loose", {"disposition_match": "loose"}, "disposition IN ('2+kk', '2+1')", target=TARGET)
spec("f08_disposition_exact", {"disposition_match": "exact"}, "disposition = '2+kk'", target=TARGET)
spec("f09_lifecycle_active", {"lifecycle": "active", "max_age_days": 400}, f"is_active AND last_seen_at >= {AS_OF_SQL} - INTERVAL 400 DAY")
spec("f09_lifecycle_delisted", {"lifecycle": "delisted"}, "NOT is_active")
spec("f10_days_ago", {"recently_added_days": 365, "last_seen_min_days": 30}, f"first_seen_at >= {AS_OF_SQL} - INTERVAL 365 DAY AND last_seen_at <= {AS_OF_SQL} - INTERVAL 30 DAY")
_TOM = f"greatest(0, floor((epoch(CASE WHEN is_active THEN {AS_OF_SQL} ELSE last_seen_at END) - epoch(first_seen_at)) / 86400))"
spec("f11_tom", {"tom_days_min": 30, "tom_days_max": 120}, f"{_TOM} BETWEEN 30 AND 120")
spec("f12_radius", {"radius_m": 60000}, f"{DISTANCE.format('lat', 'lng', '49.5', '14.5')} <= 60000", target=TARGET)
family.add("f13_bbox", lambda f: f.listing.where(F.col("lat").between(49.0, 49.4) & F.col("lng").between(13.0, 14.0)).select("id"), "SELECT id FROM listing WHERE lat BETWEEN 49.0 AND 49.4 AND lng BETWEEN 13.0 AND 14.0", LISTING)
spec("f14_location_chips", {"location": [{"column": "region", "id": "EUROPE"}, {"text": "an_d", "columns": ["district"]}, {"text": "ina", "columns": ["district", "region"]}, {"column": "district", "id": "FRANCE", "exclude": True}]}, "(region = 'EUROPE' OR contains(lower(district), 'an_d') OR contains(lower(district), 'ina') OR contains(lower(region), 'ina')) AND district <> 'FRANCE'")
family.add("f15_all_tags", lambda f: R.with_all_tags(f.tags, ["user_id", "day"], "event_type", ["click", "purchase", "error"]), "SELECT user_id, day FROM tags WHERE event_type IN ('click', 'purchase', 'error') GROUP BY user_id, day HAVING count(DISTINCT event_type) = 3", TAGS)
family.add("f16_exists", lambda f: R.prefiltered(f.listing, "property_id", [f.events.where("event_type = 'purchase'").select("user_id")]).select("id"), "SELECT id FROM listing WHERE property_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')", LISTING)
family.add("f17_not_exists", lambda f: R.without(f.listing, "property_id", f.events.where("event_type = 'error'").select("user_id")).select("id"), "SELECT id FROM listing l WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.user_id = l.property_id)", LISTING)
family.add("f18_exclude_ids", lambda f: f.listing.select(F.when(F.col("id") % 5 != 0, F.col("id")).alias("k"), "price_czk").where(R.exclude_ids("k", [1, 2, 3, 4])).groupBy().agg(F.count("*").alias("n"), F.count("k").alias("known")), "SELECT count(*) AS n, count(k) AS known FROM (SELECT CASE WHEN id % 5 <> 0 THEN id END AS k FROM listing) WHERE k IS NULL OR k NOT IN (1, 2, 3, 4)", LISTING)
_RULES = [{"index": "click", "op": ">=", "value": 5}, {"index": "error", "op": "<", "value": 15}, {"index": "purchase", "op": "!=", "value": 12}]
_EAV = "eav AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)"
family.add(
    "f19_rules_all",
    lambda f: R.holding_all_rules(f.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")), "user_id", "event_type", "n", _RULES),
    "SELECT DISTINCT user_id FROM eav e WHERE EXISTS (SELECT 1 FROM eav x WHERE x.user_id = e.user_id AND event_type = 'click' AND n >= 5) AND EXISTS (SELECT 1 FROM eav x WHERE x.user_id = e.user_id AND event_type = 'error' AND n < 15) AND EXISTS (SELECT 1 FROM eav x WHERE x.user_id = e.user_id AND event_type = 'purchase' AND n <> 12)",
    _EAV,
)


def _near(f: Frames):
    from ..operators import spatial

    good = f.centres.where("jobs >= 50 and pop > 0")
    near = spatial.radius_join(f.people.select("id", "lat", "lng"), good, 20_000).select("id").distinct()
    return f.people.join(near, "id", "left_semi").select("id")


family.add("f20_near_city", _near, f"SELECT id FROM people WHERE EXISTS (SELECT 1 FROM centres WHERE jobs >= 50 AND pop > 0 AND {DISTANCE.format('lat', 'lng', 'rlat', 'rlng')} <= 20000)", "people AS (SELECT c_custkey AS id, 48.5 + (c_custkey * 37 % 250) / 100.0 AS lat, 12.1 + (c_custkey * 53 % 670) / 100.0 AS lng FROM customer)", CENTRES)
spec("f22_change_window", {"price_change_count_min": 2, "price_change_window_days": 90}, "price_changes_90d >= 2")
spec("f23_total_change_fall", {"total_price_change_pct": -10}, "total_price_change_pct <= -10")
spec("f23_total_change_rise", {"total_price_change_pct": 10}, "total_price_change_pct >= 10")
spec("f25_material", {"building_material": ["ostatni", "panel"]}, "building_type IN ('panel', 'skelet', 'drevo', 'kamen', 'montovana', 'nizkoenergeticka')")
family.add("f26_prefilters", lambda f: R.prefiltered(f.listing, "property_id", [f.events.where("event_type = 'purchase'").select("user_id"), None, f.events.where("value > 90").select("user_id")]).select("id"), "SELECT id FROM listing WHERE property_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') AND property_id IN (SELECT user_id FROM events WHERE value > 90)", LISTING)
family.add("f28_hidden_by_price", lambda f: R.hidden_by_price(f.listing_np, {"min_price_czk": 1, "category_main": "BUILDING"}, AS_OF), "SELECT count(*) AS hidden FROM listing_np WHERE category_main = 'BUILDING' AND price_czk IS NULL", LISTING_NP)
family.add("f29_distinct_from", lambda f: f.listing_np.withColumn("old", F.when(F.col("id") % 3 != 0, F.col("price_czk"))).where(R.changed("old", "price_czk")).select("id"), "SELECT id FROM (SELECT *, CASE WHEN id % 3 <> 0 THEN price_czk END AS old FROM listing_np) WHERE old IS DISTINCT FROM price_czk", LISTING_NP)


def _changed(f: Frames):
    from ..functions.values import price_changed

    return f.listing_np.select("id", price_changed(F.col("price_czk"), F.col("price_czk") + F.when(F.col("id") % 4 != 0, F.col("id") % 9 * 1000), 2.0).alias("changed"))


family.add("f31_relative_change", _changed, "SELECT id, CASE WHEN p IS NULL AND q IS NULL THEN FALSE WHEN p IS NULL OR q IS NULL THEN TRUE WHEN p = 0 THEN q <> 0 ELSE abs(q - p) / abs(p) * 100 > 2 END AS changed FROM (SELECT id, price_czk AS p, price_czk + CASE WHEN id % 4 <> 0 THEN id % 9 * 1000 END AS q FROM listing_np)", LISTING_NP)
family.add(
    "f32_image_gate",
    lambda f: R.image_gate(f.listing.withColumnRenamed("id", "listing_id"), f.events.select(F.col("user_id").alias("listing_id"), (F.col("event_type") == "click").alias("stored")), AS_OF, 24 * 1500, 24 * 700).select("listing_id"),
    f"SELECT id AS listing_id FROM listing l LEFT JOIN (SELECT user_id, bool_or(event_type = 'click') AS stored FROM events GROUP BY user_id) i ON l.id = i.user_id WHERE coalesce(stored, FALSE) OR epoch({AS_OF_SQL}) - epoch(first_seen_at) >= 1500 * 86400 OR (epoch({AS_OF_SQL}) - epoch(first_seen_at) >= 700 * 86400 AND stored IS NULL)",
    LISTING,
)
spec("f33_combined_surface", {"category_main_in": ["BUILDING", "MACHINERY"], "status": "active", "min_price_czk": 50000, "max_area_m2": 100}, "category_main IN ('BUILDING', 'MACHINERY') AND is_active AND price_czk >= 50000 AND area_m2 <= 100")
