"""Queries of cohort statistics, history, golden records and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import filters, golden, history, series, stats
from .frames import AS_OF, AS_OF_SQL, CHILD, LISTING, LISTING_NP, MONTHLY, SNAPSHOT, Family, Frames

family = Family()
add = family.add
TOM_SQL = f"CAST(greatest(0, floor((epoch(CASE WHEN is_active THEN {AS_OF_SQL} ELSE last_seen_at END) - epoch(first_seen_at)) / 86400)) AS BIGINT)"


def with_tom(df):
    return df.withColumn("tom_days", values.tom_days(F.col("first_seen_at"), F.col("last_seen_at"), F.col("is_active"), F.lit(AS_OF)))


def rounded(df, names, places=2):
    return df.select(*[F.round(F.col(c).cast("decimal(28,8)"), places).cast("double").alias(c) if c in names else c for c in df.columns])


add(
    "flagship_segment_price_box",
    lambda f: stats.boxes(f.listing_np.where(filters.compile_filters({"status": "active", "min_price_czk": 20000, "min_area_m2": 30}, AS_OF)), "price_czk", ["category_main"]),
    "SELECT category_main, count(price_czk) AS n, CAST(quantile_cont(price_czk, 0.25) AS BIGINT) AS p25, CAST(quantile_cont(price_czk, 0.5) AS BIGINT) AS p50, CAST(quantile_cont(price_czk, 0.75) AS BIGINT) AS p75 FROM listing_np WHERE is_active AND price_czk >= 20000 AND area_m2 >= 30 GROUP BY category_main",
    LISTING_NP,
)
_DIST = ["min", "max", "mean", "median", "p10", "p25", "p75", "p90", "stddev", "iqr"]
add(
    "a01_distribution",
    lambda f: rounded(stats.distribution(f.listing_np, "price_czk", ["district", "disposition"]), _DIST, 4),
    "SELECT district, disposition, n, CAST(round(CAST(min AS DECIMAL(28, 8)), 4) AS DOUBLE) AS min, CAST(round(CAST(max AS DECIMAL(28, 8)), 4) AS DOUBLE) AS max, CAST(round(CAST(mean AS DECIMAL(28, 8)), 4) AS DOUBLE) AS mean, CAST(round(CAST(median AS DECIMAL(28, 8)), 4) AS DOUBLE) AS median, " + ", ".join(f"CASE WHEN n >= 5 THEN CAST(round(CAST({c} AS DECIMAL(28, 8)), 4) AS DOUBLE) END AS {c}" for c in _DIST[4:]) + " FROM (SELECT district, disposition, count(p) AS n, min(p) AS min, max(p) AS max, avg(p) AS mean, quantile_cont(p, 0.5) AS median, quantile_cont(p, 0.1) AS p10, quantile_cont(p, 0.25) AS p25, quantile_cont(p, 0.75) AS p75, quantile_cont(p, 0.9) AS p90, stddev_samp(p) AS stddev, quantile_cont(p, 0.75) - quantile_cont(p, 0.25) AS iqr FROM (SELECT *, price_czk AS p FROM listing_np) GROUP BY district, disposition)",
    LISTING_NP,
)
_DEAR = "SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_orderkey % 50 = 0 THEN 4 * l_extendedprice ELSE l_extendedprice END AS price FROM lineitem"
add(
    "a44_outliers",
    lambda f: stats.outliers(f.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_orderkey") % 50 == 0, 4 * F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("price")), "price", ["l_returnflag"], need_spread=True).select("l_orderkey", "l_linenumber", "l_returnflag", "price"),
    "SELECT l_orderkey, l_linenumber, l.l_returnflag, price FROM dear l JOIN (SELECT l_returnflag, quantile_cont(price, 0.5) AS m, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS i FROM dear GROUP BY l_returnflag HAVING count(price) >= 5) d ON l.l_returnflag = d.l_returnflag WHERE abs(price - m) > 1.5 * i AND i > 0",
    f"dear AS ({_DEAR})",
)
add("a19_boxes_having_5", lambda f: stats.boxes(f.listing, "price_czk", ["district", "disposition", "building_type"], least=5), "SELECT district, disposition, building_type, count(price_czk) AS n, CAST(quantile_cont(price_czk, 0.25) AS BIGINT) AS p25, CAST(quantile_cont(price_czk, 0.5) AS BIGINT) AS p50, CAST(quantile_cont(price_czk, 0.75) AS BIGINT) AS p75 FROM listing GROUP BY district, disposition, building_type HAVING count(price_czk) >= 5", LISTING)
add("a04_conditional_counts", lambda f: f.listing.groupBy("district").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_active"), 1)).alias("active"), F.count(F.when(F.col("price_czk") > 150000, 1)).alias("dear")), "SELECT district, count(*) AS n, count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE price_czk > 150000) AS dear FROM listing GROUP BY district", LISTING)
add("a05_distinct_counts", lambda f: f.listing.groupBy("region").agg(F.countDistinct("property_id").alias("properties"), F.countDistinct(F.struct("district", "disposition")).alias("pairs"), F.countDistinct(F.coalesce(F.when(F.col("property_id") % 3 != 0, F.col("property_id")), -F.col("id"))).alias("surrogate")), "SELECT region, count(DISTINCT property_id) AS properties, count(DISTINCT district || '|' || disposition) AS pairs, count(DISTINCT coalesce(CASE WHEN property_id % 3 <> 0 THEN property_id END, -id)) AS surrogate FROM listing GROUP BY region", LISTING)


def _levels(f: Frames):
    level = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(c).alias("unit")) for n, c in (("region", "region"), ("district", "district"), ("segment", "category_main"))]))
    return f.listing.select("price_czk", "property_id", level.alias("l")).groupBy("l.level", "l.unit").agg(F.count("*").alias("n"), F.countDistinct("property_id").alias("properties"), F.round(F.avg("price_czk"), 2).alias("mean"))


_LEVEL = "SELECT '{0}' AS level, {1} AS unit, count(*) AS n, count(DISTINCT property_id) AS properties, round(avg(price_czk), 2) AS mean FROM listing GROUP BY {1}"
add("a08_level_rollup", _levels, " UNION ALL ".join(_LEVEL.format(n, c) for n, c in (("region", "region"), ("district", "district"), ("segment", "category_main"))), LISTING)
add(
    "a15_browse_stats",
    lambda f: stats.browse_stats(f.listing_np, AS_OF),
    f"SELECT count(*) AS total, count(*) FILTER (WHERE first_seen_at >= {AS_OF_SQL} - INTERVAL 7 DAY) AS new_7d, count(*) FILTER (WHERE first_seen_at >= {AS_OF_SQL} - INTERVAL 30 DAY) AS new_30d, " + ", ".join(f"CAST(quantile_cont({c}, {q}) AS BIGINT) AS {n}_p{int(q * 100)}" for n, c in (("price", "price_czk"), ("ppm", "CASE WHEN area_m2 > 0 THEN price_czk / area_m2 END")) for q in (0.25, 0.5, 0.75)) + " FROM listing_np",
    LISTING_NP,
)
_CUT = " + ".join(f"CASE WHEN price_czk > c[{i}] THEN 1 ELSE 0 END" for i in range(1, 7))
add(
    "a16_price_bands",
    lambda f: stats.price_band_velocity(with_tom(f.listing_np)),
    f"SELECT CAST(b AS INT) AS band, coalesce(n, 0) AS n, share, price_min, price_max, tom_p25, tom_p50, tom_p75 FROM range(1, 8) r(b) LEFT JOIN (SELECT 1 + {_CUT} AS band, count(*) AS n, round(count(*) / max(total), 4) AS share, min(price_czk) AS price_min, max(price_czk) AS price_max, CAST(quantile_cont(t, 0.25) AS BIGINT) AS tom_p25, CAST(quantile_cont(t, 0.5) AS BIGINT) AS tom_p50, CAST(quantile_cont(t, 0.75) AS BIGINT) AS tom_p75 FROM (SELECT price_czk, {TOM_SQL} AS t FROM listing_np WHERE price_czk IS NOT NULL), (SELECT quantile_cont(price_czk, [0.10, 0.25, 0.45, 0.55, 0.75, 0.90]) AS c, count(*) AS total FROM listing_np WHERE price_czk IS NOT NULL) GROUP BY 1) x ON x.band = r.b",
    LISTING_NP,
)
add(
    "a17_region_stats",
    lambda f: with_tom(f.listing).groupBy("region").agg(F.count("*").alias("n"), *[stats.rounded_percentile("price_czk", p).alias(f"p{int(p * 100)}") for p in stats.BOX], F.bround(F.percentile(F.when(~F.col("is_active"), F.col("tom_days")), 0.5), 1).alias("delisted_tom")),
    f"SELECT region, count(*) AS n, CAST(quantile_cont(price_czk, 0.25) AS BIGINT) AS p25, CAST(quantile_cont(price_czk, 0.5) AS BIGINT) AS p50, CAST(quantile_cont(price_czk, 0.75) AS BIGINT) AS p75, round_even(quantile_cont(CASE WHEN NOT is_active THEN {TOM_SQL} END, 0.5), 1) AS delisted_tom FROM listing GROUP BY region",
    LISTING,
)


def _by_day(f: Frames):
    days = f.spark.sql("SELECT explode(sequence(DATE '2001-05-01', DATE '2001-07-31')) AS day")
    return history.active_by_day(f.listing, "first_seen_at", "last_seen_at", days, ["region"]).select("region", F.col("day").cast("string").alias("day"), "active", "new")


add(
    "a18_active_by_day",
    _by_day,
    "SELECT r.region, CAST(d.day AS VARCHAR) AS day, count(l.id) AS active, count(l.id) FILTER (WHERE CAST(first_seen_at AS DATE) = d.day) AS new FROM (SELECT DISTINCT region FROM listing) r CROSS JOIN (SELECT CAST(unnest(generate_series(TIMESTAMP '2001-05-01', TIMESTAMP '2001-07-31', INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN listing l ON l.region = r.region AND d.day BETWEEN CAST(first_seen_at AS DATE) AND CAST(last_seen_at AS DATE) GROUP BY r.region, d.day",
    LISTING,
)
add("a19_mix", lambda f: stats.mix(f.listing, "building_type", ["region"]), "SELECT region, building_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY region), 4) AS share FROM listing GROUP BY region, building_type", LISTING)
add("a19_mix_map", lambda f: stats.mix_map(f.listing, "disposition", ["region"]).select("region", F.size("mix").alias("n"), F.col("mix")["2+kk"].alias("two_kk")), "SELECT region, CAST(count(*) AS INT) AS n, max(CASE WHEN disposition = '2+kk' THEN share END) AS two_kk FROM (SELECT region, disposition, round(count(*) / sum(count(*)) OVER (PARTITION BY region), 4) AS share FROM listing GROUP BY region, disposition) GROUP BY region", LISTING)
_Q = lambda p, c="t": f"round_even(quantile_cont({c}, {p}), 2)"
_REC = f"first_seen_at > {AS_OF_SQL} - INTERVAL 200 DAY"
add(
    "a42_market_velocity",
    lambda f: stats.market_velocity(with_tom(f.listing), ["district"], AS_OF, split_days=200),
    f"SELECT district, count(*) AS n, round_even(avg(t), 2) AS mean, {', '.join(f'{_Q(p)} AS p{int(p * 100)}' for p in (0.1, 0.25, 0.5, 0.75, 0.9))}, {_Q(0.5, 'CASE WHEN r THEN t END')} AS recent_median, {_Q(0.5, 'CASE WHEN NOT r THEN t END')} AS older_median FROM (SELECT district, CAST({TOM_SQL} AS DOUBLE) AS t, {_REC} AS r FROM listing) GROUP BY district",
    LISTING,
)
add(
    "a43_listing_velocity",
    lambda f: stats.listing_velocity(with_tom(f.listing), "id", ["district", "disposition"]),
    f"SELECT id, district, disposition, tom_days, n_peers, percentile, CASE WHEN percentile >= 90 THEN 'stuck' WHEN percentile >= 75 THEN 'slow' WHEN percentile <= 25 THEN 'fast' WHEN percentile IS NOT NULL THEN 'typical' END AS class FROM (SELECT id, district, disposition, t AS tom_days, n - 1 AS n_peers, CASE WHEN n > 1 THEN round_even(100 * (lt + 0.5 * (eq - 1)) / (n - 1), 2) END AS percentile FROM (SELECT id, district, disposition, t, count(*) OVER (PARTITION BY district, disposition) AS n, count(*) OVER (PARTITION BY district, disposition, t) AS eq, rank() OVER (PARTITION BY district, disposition ORDER BY t) - 1 AS lt FROM (SELECT *, {TOM_SQL} AS t FROM listing)))",
    LISTING,
)
add("a47_freshness", lambda f: stats.freshness(f.listing, ["district"]), "SELECT district, min(age_days) AS min_age, round_even(quantile_cont(age_days, 0.5), 2) AS median_age, max(age_days) AS max_age, count(*) FILTER (WHERE verified_at IS NULL) AS unverified FROM listing GROUP BY district", LISTING)
add(
    "a48_c05_estimate",
    lambda f: stats.estimate(f.listing_np, ["district", "disposition"], 70.0),
    """SELECT district, disposition, n, CAST(q1 * 70.0 AS BIGINT) AS low, CAST(q2 * 70.0 AS BIGINT) AS estimate, CAST(q3 * 70.0 AS BIGINT) AS high,
    CASE WHEN stale > 0.5 THEN 'low' ELSE list_extract(['low', 'medium', 'high'], 1 + CASE WHEN age > 14 THEN greatest(lvl - 1, 0) ELSE lvl END) END AS confidence
    FROM (SELECT *, CASE WHEN n >= 20 AND s < 0.25 THEN 2 WHEN n >= 10 AND (s IS NULL OR s < 0.4) THEN 1 ELSE 0 END AS lvl FROM (SELECT *, CASE WHEN n >= 5 THEN (q3 - q1) / q2 END AS s FROM (
    SELECT district, disposition, count(m) AS n, quantile_cont(m, 0.25) AS q1, quantile_cont(m, 0.5) AS q2, quantile_cont(m, 0.75) AS q3, quantile_cont(age_days, 0.5) AS age, avg(CASE WHEN age_days > 14 THEN 1.0 ELSE 0.0 END) AS stale
    FROM (SELECT *, CASE WHEN area_m2 > 0 THEN price_czk / area_m2 END AS m FROM listing_np) GROUP BY district, disposition)))""",
    LISTING_NP,
)


def _ladder(f: Frames):
    from ..functions.geo import within

    near = lambda m: within(F.col("lat"), F.col("lng"), 49.5, 14.5, m)
    area = lambda p: F.col("area_m2").between(80 * (1 - p), 80 * (1 + p))
    d = lambda m: filters.disposition("2+kk", m)
    lifted = {"condition": F.col("furnished") == "ano", "building": F.col("building_type") == "cihla", "energy": F.col("parking_lots") == 2, "floor": F.col("floor").between(1, 5)}
    steps = []
    for name, metres, band, match, kept in _STEPS:
        test = near(metres) & area(band) & (d(match) if match != "any" else F.lit(True))
        for k in kept:
            test = test & F.coalesce(lifted[k], F.lit(False))
        steps.append((name, test))
    return stats.relaxation_counts(f.listing, steps)


_H = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(49.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(49.5)) * pow(sin(radians(14.5 - lng) / 2), 2))))"
_ALL = ("condition", "building", "energy", "floor")
#: The steps of the ladder: radius, area band, disposition, and the filters that still hold.
_STEPS = [
    ("base", 15000, 0.1, "exact", _ALL),
    ("radius_x1.5", 22500, 0.1, "exact", _ALL),
    ("area_band_+0.10", 22500, 0.2, "exact", _ALL),
    ("disposition_loose", 22500, 0.2, "loose", _ALL),
    ("radius_x2", 30000, 0.2, "loose", _ALL),
    ("area_band_+0.20", 30000, 0.3, "loose", _ALL),
    ("disposition_any", 30000, 0.3, "any", _ALL),
    ("drop_condition", 30000, 0.3, "any", ("building", "energy", "floor")),
    ("drop_building_type", 30000, 0.3, "any", ("energy", "floor")),
    ("drop_energy_rating", 30000, 0.3, "any", ("floor",)),
    ("drop_floor_band", 30000, 0.3, "any", ()),
]
_LIFTED = {"condition": "furnished = 'ano'", "building": "building_type = 'cihla'", "energy": "parking_lots = 2", "floor": "floor BETWEEN 1 AND 5"}
_MATCH = {"exact": "disposition = '2+kk'", "loose": "disposition IN ('2+kk', '2+1')", "any": "TRUE"}
_STEP_SQL = " UNION ALL ".join(f"SELECT {i} AS step, '{n}' AS name, count(*) AS n FROM listing WHERE {_H} <= {r} AND area_m2 BETWEEN 80 * (1 - {a}) AND 80 * (1 + {a}) AND {_MATCH[m]}" + "".join(f" AND {_LIFTED[k]}" for k in kept) for i, (n, r, a, m, kept) in enumerate(_STEPS))
add("c02_relaxation_ladder", _ladder, f"SELECT step, name, n, step = min(CASE WHEN n >= 5 OR step = {len(_STEPS) - 1} THEN step END) OVER () AS chosen FROM ({_STEP_SQL})", LISTING)
add("c01_comparables", lambda f: _comparables(f), f"SELECT id, price_czk, round(d, 1) AS distance FROM (SELECT *, {_H} AS d FROM listing WHERE is_active AND area_m2 BETWEEN 80 * 0.8 AND 80 * 1.2 AND {_H} <= 80000) ORDER BY d, id LIMIT 500", LISTING)


def _comparables(f: Frames):
    from ..functions.geo import haversine

    d = haversine(F.col("lat"), F.col("lng"), F.lit(49.5), F.lit(14.5))
    target = {"lat": 49.5, "lng": 14.5, "area_m2": 80}
    hits = f.listing.where(filters.compile_filters({"status": "active", "area_band_pct": 0.2, "radius_m": 80000}, AS_OF, target)).withColumn("d", d)
    return hits.orderBy("d", "id").limit(500).select("id", "price_czk", F.round("d", 1).alias("distance"))


_RENT = "category_main IN ('FURNITURE', 'BUILDING')"


def _yields(f: Frames):
    """Two segments stand for flats to let, at a three-hundredth of the price."""
    rents = f.listing_np.where(_RENT).withColumn("price_czk", F.col("price_czk") / 300)
    out = stats.estimate_yield(f.listing_np.where(f"NOT {_RENT}"), rents, ["district", "disposition"], 70.0, F.col("id") % 400 == 0)
    return out.withColumn("warnings", F.array_join("warnings", "; "))


_SIDE = "SELECT district, disposition, count(m) AS n, quantile_cont(m, 0.25) AS q1, quantile_cont(m, 0.5) AS q2, quantile_cont(m, 0.75) AS q3, quantile_cont(age_days, 0.5) AS age, max(age_days) AS oldest, avg(CASE WHEN age_days > 14 THEN 1.0 ELSE 0.0 END) AS stale, count(*) FILTER (WHERE id % 400 = 0) AS verified FROM (SELECT *, CASE WHEN area_m2 > 0 THEN price_czk / {0} / area_m2 END AS m FROM listing_np WHERE {1}) GROUP BY district, disposition"
_WARN = ", ".join(f"CASE WHEN {c} THEN '{w}' END" for c, w in zip(("r.n < 10", "r.age > 14", "r.stale > 0.5", "r.oldest > 30", "r.verified > 0"), stats.WARNINGS, strict=True))
add(
    "c05_estimate_yield",
    _yields,
    f"""SELECT coalesce(p.district, r.district) AS district, coalesce(p.disposition, r.disposition) AS disposition, p.n AS n_sales, CAST(round_even(p.q2 * 70.0, 0) AS BIGINT) AS price, r.n AS n_rents,
    CAST(round_even(r.q1 * 70.0, 0) AS BIGINT) AS rent_low, CAST(round_even(r.q2 * 70.0, 0) AS BIGINT) AS rent, CAST(round_even(r.q3 * 70.0, 0) AS BIGINT) AS rent_high,
    CASE WHEN r.district IS NULL THEN NULL WHEN r.stale > 0.5 THEN 'low' ELSE list_extract(['low', 'medium', 'high'], 1 + CASE WHEN r.age > 14 THEN greatest(lvl - 1, 0) ELSE lvl END) END AS confidence,
    CASE WHEN r.district IS NOT NULL THEN concat_ws('; ', {_WARN}) END AS warnings,
    CASE WHEN round_even(p.q2 * 70.0, 0) > 0 THEN round_even(12 * CAST(round_even(r.q2 * 70.0, 0) AS BIGINT) / CAST(round_even(p.q2 * 70.0, 0) AS BIGINT) * 100, 2) END AS yield_pct
    FROM ({_SIDE.format('1', f'NOT {_RENT}')}) p FULL JOIN (SELECT *, CASE WHEN n >= 20 AND s < 0.25 THEN 2 WHEN n >= 10 AND (s IS NULL OR s < 0.4) THEN 1 ELSE 0 END AS lvl FROM (SELECT *, CASE WHEN n >= 5 THEN (q3 - q1) / q2 END AS s FROM ({_SIDE.format('300', _RENT)}))) r ON p.district = r.district AND p.disposition = r.disposition""",
    LISTING_NP,
)

# history
K, ORD = ["listing_id"], ["scraped_at", "o1", "o2"]
_W = "OVER (PARTITION BY listing_id ORDER BY scraped_at, o1, o2)"
LAG = f"{SNAPSHOT}, s AS (SELECT *, lag(price) {_W} AS prev, row_number() {_W} AS rn FROM snapshot)"
_MOVED = "prev IS NOT NULL AND price IS NOT NULL AND price <> prev"
add(
    "a13_price_history",
    lambda f: history.price_history(f.snapshot, "price", "scraped_at", K, ORD, AS_OF),
    f"SELECT listing_id, count(*) FILTER (WHERE {_MOVED} AND price < prev) AS drops, count(*) FILTER (WHERE {_MOVED} AND price > prev) AS rises, count(*) FILTER (WHERE {_MOVED}) AS changes, " + ", ".join(f"count(*) FILTER (WHERE {_MOVED} AND scraped_at >= {AS_OF_SQL} - INTERVAL {d} DAY) AS changes_{d}d" for d in (30, 90, 365)) + f", CAST(round(CAST(max((prev - price) / prev * 100) FILTER (WHERE {_MOVED} AND price < prev AND prev > 0) AS DECIMAL(28, 10)), 2) AS DOUBLE) AS max_drop_pct FROM s GROUP BY listing_id",
    LAG,
)
add("a14_price_span", lambda f: history.price_span(f.snapshot, "price", K, ORD), "SELECT listing_id, points, first_price, last_price, CASE WHEN points >= 2 AND first_price > 0 THEN CAST(round(CAST((last_price - first_price) / first_price * 100 AS DECIMAL(28, 10)), 2) AS DOUBLE) END AS total_change_pct FROM (SELECT listing_id, count(*) AS points, arg_min(price, (scraped_at, o1, o2)) AS first_price, arg_max(price, (scraped_at, o1, o2)) AS last_price FROM snapshot WHERE price IS NOT NULL GROUP BY listing_id)", SNAPSHOT)
add(
    "a45_patterns",
    lambda f: history.patterns(f.snapshot, "price", K, ORD),
    f"SELECT listing_id, dn + up AS changes, round(l - f, 2) AS total_change, CASE WHEN dn = 0 AND up = 0 THEN CASE WHEN l < f THEN 'single_drop' WHEN l > f THEN 'rising' ELSE 'stable' END WHEN up = 0 THEN CASE WHEN dn = 1 THEN 'single_drop' ELSE 'stairstep_dropping' END WHEN dn = 0 THEN 'rising' ELSE 'volatile' END AS pattern FROM (SELECT listing_id, count(*) FILTER (WHERE price < prev) AS dn, count(*) FILTER (WHERE price > prev) AS up, arg_min(price, (scraped_at, o1, o2)) FILTER (WHERE price IS NOT NULL) AS f, arg_max(price, (scraped_at, o1, o2)) FILTER (WHERE price IS NOT NULL) AS l FROM (SELECT *, lag(price) {_W} AS prev FROM snapshot) GROUP BY listing_id)",
    SNAPSHOT,
)
add("w01_lag", lambda f: history.with_previous(f.snapshot, "price", K, ORD).select("listing_id", "o1", "o2", "price", "prev"), "SELECT listing_id, o1, o2, price, prev FROM s", LAG)
add("w02_total_order", lambda f: f.snapshot.select("listing_id", "o1", "o2", history.total_order_rank(K, [F.col(c) for c in ORD]).alias("rn")), "SELECT listing_id, o1, o2, CAST(rn AS INT) AS rn FROM s", LAG)
add(
    "w03_k04_property_drops",
    lambda f: history.drops_within(f.snapshot, "price", "scraped_at", ["supplier"], ORD, AS_OF, 900, 5.0).select("supplier", "o1", "o2", "price", "prev", "drop_pct"),
    f"SELECT supplier, o1, o2, price, prev, CAST(round(CAST((prev - price) / prev * 100 AS DECIMAL(28, 10)), 2) AS DOUBLE) AS drop_pct FROM (SELECT *, lag(price) OVER (PARTITION BY supplier ORDER BY scraped_at, o1, o2) AS prev FROM snapshot) WHERE scraped_at >= {AS_OF_SQL} - INTERVAL 900 DAY AND prev > price AND prev > 0 AND (prev - price) / prev * 100 >= 5",
    SNAPSHOT,
)
add("w04_collection_drops", lambda f: history.drops_within(f.snapshot, "price", "scraped_at", ["supplier", "listing_id"], ORD, AS_OF, 1500).select("supplier", "listing_id", "o1", "price", "prev"), f"SELECT supplier, listing_id, o1, price, prev FROM (SELECT *, lag(price) OVER (PARTITION BY supplier, listing_id ORDER BY scraped_at, o1, o2) AS prev FROM snapshot) WHERE scraped_at >= {AS_OF_SQL} - INTERVAL 1500 DAY AND prev > price AND prev > 0", SNAPSHOT)
add("k06_snapshot_on_change", lambda f: history.on_change_only(f.snapshot, "price", K, ORD).select("listing_id", "o1", "o2", "price"), "SELECT listing_id, o1, o2, price FROM s WHERE rn = 1 OR price IS DISTINCT FROM prev", LAG)
add(
    "a46_field_changes",
    lambda f: history.field_changes(f.snapshot, ["flag", "state"], K, ORD).select("listing_id", "o1", "o2", "field", "before", "after"),
    f"SELECT listing_id, o1, o2, field, before, after FROM (SELECT listing_id, o1, o2, 'flag' AS field, lag(flag) {_W} AS before, flag AS after, row_number() {_W} AS rn FROM snapshot UNION ALL SELECT listing_id, o1, o2, 'state', lag(state) {_W}, state, row_number() {_W} FROM snapshot) WHERE rn > 1 AND before IS DISTINCT FROM after",
    SNAPSHOT,
)


def _carried(f: Frames):
    axis = f.snapshot.select("listing_id").distinct().join(f.spark.sql("SELECT explode(sequence(TIMESTAMP '1996-01-01', TIMESTAMP '2001-01-01', INTERVAL 1 YEAR)) AS scraped_at").withColumn("_k", F.lit(1)), how="cross").drop("_k")
    daily = f.snapshot.where("price is not null").groupBy("listing_id", "scraped_at").agg(F.max("price").alias("price"))
    return history.carried(axis, daily, K, "scraped_at", "price")


add("j21_as_of", _carried, "SELECT a.listing_id, a.scraped_at, d.price FROM (SELECT listing_id, scraped_at FROM (SELECT DISTINCT listing_id FROM snapshot) CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '2001-01-01', INTERVAL 1 YEAR)) AS scraped_at)) a ASOF LEFT JOIN (SELECT listing_id, scraped_at, max(price) AS price FROM snapshot WHERE price IS NOT NULL GROUP BY listing_id, scraped_at) d ON a.listing_id = d.listing_id AND a.scraped_at >= d.scraped_at", SNAPSHOT)
_ISL = f"{SNAPSHOT}, r AS (SELECT *, sum(st) OVER (PARTITION BY listing_id ORDER BY scraped_at, o1, o2 ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN row_number() {_W} > 1 AND lag(flag) {_W} IS NOT DISTINCT FROM flag THEN 0 ELSE 1 END AS st FROM snapshot))"
add("k14_c14_islands", lambda f: history.islands(f.snapshot, K, ORD, "flag"), "SELECT listing_id, CAST(run AS BIGINT) AS run, flag, min(scraped_at) AS run_from, max(scraped_at) AS run_to, count(*) AS n FROM r GROUP BY listing_id, run, flag", _ISL)
add("a53_w11_oscillation", lambda f: history.oscillation(f.snapshot, K, ORD, "flag"), "SELECT listing_id, count(*) AS runs, count(*) - 1 AS changes, count(*) - count(DISTINCT flag) AS returns FROM (SELECT DISTINCT listing_id, run, flag FROM r) GROUP BY listing_id", _ISL)

# golden records
_CO = lambda: [F.col("trust"), (~F.col("active")).cast("int"), -F.unix_timestamp("last_seen"), -F.col("child_id")]
_CS = "(trust, NOT active, -epoch(last_seen), -child_id)"
add("a09_golden_fields", lambda f: golden.survivors(f.child, "property_id", ["area", "street", "source"], _CO()), "SELECT property_id, " + ", ".join(f"arg_min({c}, {_CS}) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("area", "street", "source")) + " FROM child GROUP BY property_id", CHILD)
add("a10_three_valued_or", lambda f: golden.amenities(f.child, "property_id", ["lift"]), "SELECT property_id, bool_or(lift) AS lift FROM child GROUP BY property_id", CHILD)
add("a11_representative", lambda f: golden.representative(f.child, "property_id", [F.desc("active"), F.asc("trust"), F.col("last_seen").desc_nulls_last(), F.desc("child_id")]).select("property_id", "child_id", "trust"), "SELECT property_id, child_id, trust FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY active DESC, trust, last_seen DESC NULLS LAST, child_id DESC) AS rn FROM child) WHERE rn = 1", CHILD)
add("a12_child_rollup", lambda f: golden.child_rollup(f.child, "property_id", "active", "source", "first_seen", "last_seen"), "SELECT property_id, bool_or(active) AS any_active, count(*) AS n_children, count(DISTINCT source) AS n_sources, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM child GROUP BY property_id", CHILD)
add("j05_latest_per_row", lambda f: golden.with_latest(f.table("part").select(F.col("p_partkey").alias("listing_id")), f.snapshot, "listing_id", ORD, ["price", "flag"]), "SELECT p_partkey AS listing_id, arg_max_null(price, (scraped_at, o1, o2)) AS latest_price, arg_max(flag, (scraped_at, o1, o2)) AS latest_flag FROM part LEFT JOIN snapshot ON p_partkey = listing_id GROUP BY p_partkey", SNAPSHOT)
add("c13_latest", lambda f: golden.latest(f.snapshot, K, [F.desc("scraped_at"), F.desc("o1"), F.desc("o2")]).select("listing_id", "o1", "o2"), "SELECT listing_id, o1, o2 FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY scraped_at DESC, o1 DESC, o2 DESC) AS rn FROM snapshot) WHERE rn = 1", SNAPSHOT)
add("t09_top_n_per_group", lambda f: golden.top_n(f.child, ["property_id"], [F.asc("trust"), F.desc("qty"), F.asc("child_id")], 2).select("property_id", "child_id", "rank"), "SELECT property_id, child_id, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY trust, qty DESC, child_id) AS rn FROM child) WHERE rn <= 2", CHILD)
_MERGE = "merges AS (SELECT s_suppkey AS merged_id, s_suppkey - 7 AS into_id, 'g' || (s_suppkey % 7) AS group_id, s_suppkey % 4 = 0 AS undone FROM supplier WHERE s_suppkey > 7 AND s_suppkey % 3 <> 0)"


def _merges(f: Frames):
    s = F.col("s_suppkey")
    return f.table("supplier").where("s_suppkey > 7 and s_suppkey % 3 <> 0").select(s.alias("merged_id"), (s - 7).alias("into_id"), F.concat(F.lit("g"), (s % 7).cast("string")).alias("group_id"), (s % 4 == 0).alias("undone"))


_CHAIN = "RECURSIVE {0}, c AS (SELECT merged_id AS node, into_id AS survivor, 1 AS d FROM {1} UNION ALL SELECT c.node, m.into_id, d + 1 FROM c JOIN {1} m ON c.survivor = m.merged_id WHERE d < 20), last AS (SELECT node, arg_max(survivor, d) AS survivor FROM c GROUP BY node)"
add("j17_merge_chain", lambda f: golden.merge_chain(_merges(f)), "SELECT node, survivor FROM last", _CHAIN.format(_MERGE, "merges"))
add("c08_apply_ledger", lambda f: golden.apply_ledger(f.child.select("child_id", F.col("child_id").alias("property_id")).distinct(), _merges(f)), "SELECT child_id, coalesce(survivor, child_id) AS property_id FROM (SELECT DISTINCT l_suppkey AS child_id FROM lineitem) LEFT JOIN last ON node = child_id", _CHAIN.format(_MERGE + ", live AS (SELECT * FROM merges WHERE NOT undone)", "live"))
add("a57_o20_ledger_groups", lambda f: golden.ledger_groups(_merges(f)).withColumn("merged", F.concat_ws(",", "merged")), "SELECT group_id, count(*) AS n, bool_and(undone) AS all_undone, string_agg(merged_id, ',' ORDER BY merged_id) AS merged FROM merges GROUP BY group_id", _MERGE)
add("a30_w08_dominant_label", lambda f: golden.dominant_label(f.child, "property_id", "source", 0.35), "SELECT property_id, source, round(n / total, 4) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY property_id) AS total, row_number() OVER (PARTITION BY property_id ORDER BY n DESC, source) AS rn FROM (SELECT property_id, source, count(*) AS n FROM child GROUP BY property_id, source)) WHERE rn = 1 AND n >= 0.35 * total", CHILD)
add("o16_c09_carry_state", lambda f: golden.carry_operator_state(f.child.select(F.col("child_id").alias("k"), "lift", "source").distinct(), golden.merge_chain(_merges(f)), "k", ["lift", "source"]), f"SELECT DISTINCT coalesce(survivor, child_id) AS k, lift, source FROM (SELECT DISTINCT child_id, lift, source FROM child) LEFT JOIN last ON node = child_id", _CHAIN.format(CHILD + ", " + _MERGE, "merges"))
add("o17_most_advanced", lambda f: golden.most_advanced(f.child, "property_id", "active", "trust", "last_seen", "child_id"), "SELECT property_id, child_id, trust, active FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY active, trust DESC, last_seen DESC, child_id DESC) AS rn FROM child) WHERE rn = 1", CHILD)
add("o18_c12_sibling_fill", lambda f: golden.fill_from_siblings(f.child.withColumn("genuine", F.col("trust") < 6), "property_id", "area", "genuine", ["last_seen", "child_id"]).select("property_id", "child_id", "area", "propagated"), "SELECT c.property_id, child_id, coalesce(area, best) AS area, area IS NULL AND best IS NOT NULL AS propagated FROM child c LEFT JOIN (SELECT property_id, arg_max(area, (last_seen, child_id)) AS best FROM child WHERE trust < 6 AND area IS NOT NULL GROUP BY property_id) USING (property_id)", CHILD)


def _upsert(f: Frames):
    cur = f.child.where("property_id % 2 = 0").select("property_id", "child_id", "area", "street", "trust")
    batch = f.child.where("property_id % 3 = 0").select("property_id", "child_id", (F.col("area") + 1).alias("area"), F.when(F.col("child_id") % 2 == 0, F.lit("new")).alias("street"), (F.col("trust") + 10).alias("trust"))
    return golden.upsert(cur, batch, ["property_id", "child_id"], preserve=["street"], once=["trust"])


add("s12_upsert", _upsert, "SELECT property_id, child_id, CASE WHEN b IS NOT NULL THEN area + 1 ELSE area END AS area, CASE WHEN b IS NULL THEN street ELSE coalesce(CASE WHEN child_id % 2 = 0 THEN 'new' END, CASE WHEN a IS NOT NULL THEN street END) END AS street, CASE WHEN a IS NOT NULL THEN trust ELSE trust + 10 END AS trust FROM (SELECT *, CASE WHEN property_id % 2 = 0 THEN 1 END AS a, CASE WHEN property_id % 3 = 0 THEN 1 END AS b FROM child) WHERE a IS NOT NULL OR b IS NOT NULL", CHILD)
add("j09_mark_inactive", lambda f: golden.mark_inactive(f.child.select("property_id", "child_id", "active", "source").withColumnRenamed("active", "is_active"), f.child.where("qty > 30").select("property_id", "child_id"), ["property_id", "child_id"], F.col("source") == "s1", True), "SELECT property_id, child_id, CASE WHEN source = 's1' AND NOT qty > 30 THEN FALSE ELSE active END AS is_active, source FROM child", CHILD)

# series
_ENDS = "ends AS (SELECT entity, kind, min(m) AS m0, max(m) AS m1, arg_min(price, m) AS p0, arg_max(price, m) AS p1, arg_min(active_count, m) AS a0, arg_max(active_count, m) AS a1 FROM (SELECT *, year * 12 + month - 1 AS m FROM monthly) GROUP BY entity, kind)"
_CAGR = "CASE WHEN m1 - m0 >= 12 AND p0 > 0 THEN round_even((pow(p1 / p0, 12.0 / (m1 - m0)) - 1) * 100, 2) END"
add("a20_growth", lambda f: series.growth(f.monthly, ["entity", "kind"]), f"SELECT entity, kind, p0 AS start_price, p1 AS end_price, m1 - m0 AS months, {_CAGR} AS cagr_pct, least(a0, a1) AS min_active FROM ends", MONTHLY, _ENDS)
add("a22_a24_window_cagr", lambda f: series.window_cagr(f.monthly, ["entity", "kind"], 3), f"SELECT entity, kind, m1 - m0 AS months, {_CAGR} AS cagr_pct, mina AS min_active FROM (SELECT entity, kind, min(m) AS m0, max(m) AS m1, arg_min(price, m) AS p0, arg_max(price, m) AS p1, min(active_count) AS mina FROM (SELECT *, max(m) OVER (PARTITION BY entity, kind) AS lm FROM (SELECT *, year * 12 + month - 1 AS m FROM monthly)) WHERE m >= lm - 36 GROUP BY entity, kind)", MONTHLY)
add("a21_a23_series_pivot", lambda f: series.sale_and_rent(f.monthly, ["entity"]), "SELECT *, CASE WHEN sale_price > 0 THEN round_even(12 * rent_price / sale_price * 100, 2) END AS gross_yield_pct FROM (SELECT entity, year, month, max(CASE WHEN kind = 'sale' THEN price END) AS sale_price, max(CASE WHEN kind = 'rent' THEN price END) AS rent_price FROM monthly GROUP BY entity, year, month)", MONTHLY)
add("a20_yield_drift", lambda f: series.yield_drift(f.monthly, ["entity"]), "SELECT entity, y0 AS yield_start, y1 AS yield_end, CASE WHEN mo >= 12 THEN round_even((y1 - y0) / (mo / 12.0), 2) END AS drift_pp_year FROM (SELECT s.entity, round_even(12 * r.p0 / s.p0 * 100, 2) AS y0, round_even(12 * r.p1 / s.p1 * 100, 2) AS y1, greatest(s.m1 - s.m0, r.m1 - r.m0) AS mo FROM ends s JOIN ends r ON s.entity = r.entity AND s.kind = 'sale' AND r.kind = 'rent')", MONTHLY, _ENDS)
add("a25_weighted_months", lambda f: series.weighted_months(f.monthly, ["kind"]), "SELECT kind, year, month, CAST(round(CAST(sum(price * greatest(active_count, 1)) / sum(greatest(active_count, 1)) AS DECIMAL(28, 8)), 2) AS DOUBLE) AS price, CAST(sum(greatest(active_count, 1)) AS BIGINT) AS weight, count(*) AS entities FROM monthly GROUP BY kind, year, month", MONTHLY)


def _rent(f: Frames):
    fine = f.table("nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("nation"), (F.col("n_nationkey") * 10).alias("std"), F.lit(None).cast("int").alias("new"))
    coarse = f.table("region").where("r_regionkey <> 2").select(F.col("r_regionkey").alias("area"), F.col("r_regionkey").alias("std"), (F.col("r_regionkey") + 100).alias("new"))
    return series.reference_rent(f.table("nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("area")), fine, coarse, "nation", "area", ["std", "new"])


add("j04_a26_reference_rent", _rent, "SELECT n_nationkey AS nation, n_regionkey AS area, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 10 WHEN n_regionkey <> 2 THEN n_regionkey END AS std, CASE WHEN n_nationkey % 3 <> 0 AND n_regionkey <> 2 THEN n_regionkey + 100 END AS new, CASE WHEN n_nationkey % 3 = 0 THEN 'fine' WHEN n_regionkey <> 2 THEN 'coarse' END AS matched FROM nation")
add("p07_latest_revision", lambda f: series.latest_revision(f.monthly.withColumn("revision", F.col("year") * 100 + F.col("month"))).select("entity", "kind", "price"), "SELECT entity, kind, price FROM monthly WHERE year * 100 + month = (SELECT max(year * 100 + month) FROM monthly)", MONTHLY)
add("a56_choropleth", lambda f: series.choropleth(f.monthly, ["entity"], "kind", ["sale", "rent"], "price"), "SELECT entity, max(price) FILTER (WHERE kind = 'sale') AS sale, max(price) FILTER (WHERE kind = 'rent') AS rent FROM monthly GROUP BY entity", MONTHLY)


def _reasons(f: Frames):
    """Dear lines with the reasons that their part's failures and history give."""
    rows = f.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("listing_id"), "l_returnflag", F.when(F.col("l_orderkey") % 50 == 0, 4 * F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("price"))
    found = stats.outliers(rows, "price", ["l_returnflag"], need_spread=True)
    failures = f.events.where("event_type = 'error'").groupBy(F.col("user_id").alias("listing_id")).agg(F.count("*").alias("attempts"))
    seen = f.snapshot.groupBy("listing_id").agg(F.datediff(F.max("scraped_at"), F.min("scraped_at")).alias("tom_days"))
    past = history.patterns(f.snapshot, "price", K, ORD).join(seen, "listing_id")
    out = stats.outlier_reasons(found, "price", failures, past, "listing_id", 2000)
    return out.select("l_orderkey", "l_linenumber", F.round("deviation", 3).alias("deviation"), "direction", F.array_join("reasons", ",").alias("reasons"))


_PAST = f"past AS (SELECT listing_id, CASE WHEN up = 0 AND dn > 1 THEN 'stairstep_dropping' END AS pattern, tom FROM (SELECT listing_id, count(*) FILTER (WHERE price < prev) AS dn, count(*) FILTER (WHERE price > prev) AS up, date_diff('day', min(scraped_at), max(scraped_at)) AS tom FROM (SELECT *, lag(price) {_W} AS prev FROM snapshot) GROUP BY listing_id))"
add(
    "a44_outlier_reasons",
    _reasons,
    "SELECT l_orderkey, l_linenumber, round(round((price - m) / i, 4), 3) AS deviation, CASE WHEN price > m THEN 'high' ELSE 'low' END AS direction, concat_ws(',', 'statistical_outlier', CASE WHEN attempts > 0 THEN 'fetch_failures' END, pattern, CASE WHEN tom > 2000 THEN 'long_time_on_market' END) AS reasons FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CASE WHEN l_orderkey % 50 = 0 THEN 4 * l_extendedprice ELSE l_extendedprice END AS price FROM lineitem) l JOIN (SELECT l_returnflag, quantile_cont(price, 0.5) AS m, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS i FROM dear GROUP BY l_returnflag HAVING count(price) >= 5) d ON l.l_returnflag = d.l_returnflag LEFT JOIN (SELECT user_id, count(*) AS attempts FROM events WHERE event_type = 'error' GROUP BY user_id) e ON e.user_id = l_partkey LEFT JOIN past ON past.listing_id = l_partkey WHERE abs(price - m) > 1.5 * i AND i > 0",
    SNAPSHOT,
    _PAST,
    f"dear AS ({_DEAR})",
)
