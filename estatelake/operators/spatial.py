"""Spatial joins as equi joins on grid cells, refined by exact distance or containment.

Every join expands one side to neighbouring cells and never compares all pairs. Cells that hold very many points stay on
the unexpanded side, which skew handling can split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import DEGREE, EARTH, grid, haversine
from ..storage import written

def steps(metres: float, north: float) -> tuple[float, float]:
    """Cell height and width in degrees, so that points within ``metres`` lie in cells that touch, up to latitude ``north`` on
    either side. Columns divide the circle, so that the last one touches the first."""
    narrow = math.cos(math.radians(min(89.99, abs(north) + 2 * metres / DEGREE)))
    wide = metres / (DEGREE * narrow) * 1.001 if narrow > 0 else 360.0
    return metres / DEGREE * 1.001, 360.0 / max(1, math.floor(360.0 / wide))


def north_of(*sides: tuple[DataFrame, str]) -> float:
    """The largest latitude, on either side, of several frames' columns; one number comes to the driver."""
    tops = [df.agg(F.max(F.abs(F.col(c)))).first()[0] for df, c in sides]
    return max((float(t) for t in tops if t is not None), default=0.0)


def _column(lng: Column, step: float, off: Column | int = 0) -> Column:
    return F.pmod(grid(lng + 180.0, step) + off, F.lit(round(360.0 / step)).cast("long"))


def _around(df: DataFrame, lat: str, lng: str, step: tuple[float, float]) -> DataFrame:
    """Rows once for each of the nine cells around."""
    columns = round(360.0 / step[1])
    off = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in sorted({j % columns for j in (-1, 0, 1)})])
    d = df.withColumn("_o", F.explode(off))
    return d.withColumn("_y", grid(F.col(lat), step[0]) + F.col("_o.i")).withColumn("_x", _column(F.col(lng), step[1], F.col("_o.j"))).drop("_o")


def radius_join(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """Pairs of left (id, lat, lng) and right (rid, rlat, rlng) within ``metres``, with ``distance``. Cells are as wide as the
    data's own largest latitude needs, and go around the earth, so no pair is lost near a pole or at the date line."""
    step = steps(metres, north_of((right, "rlat")))
    a = left.withColumn("_y", grid(F.col("lat"), step[0])).withColumn("_x", _column(F.col("lng"), step[1]))
    d = haversine(F.col("lat"), F.col("lng"), F.col("rlat"), F.col("rlng"))
    return a.join(_around(right, "rlat", "rlng", step), ["_y", "_x"]).withColumn("distance", d).where(F.col("distance") <= metres).drop("_y", "_x")


def nearest_within(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """Each left row with its nearest right row within ``metres`` (ties to the smaller rid), or nulls."""
    near = radius_join(left.select("id", "lat", "lng"), right, metres).groupBy("id").agg(F.min_by(F.struct("rid", "distance"), F.struct("distance", "rid")).alias("_n"))
    return left.join(near, "id", "left").select(*left.columns, F.col("_n.rid").alias("nearest_id"), F.col("_n.distance").alias("nearest_m"))


def nearest(left: DataFrame, right: DataFrame, start: float = 5_000) -> DataFrame:
    """Nearest neighbour by growing rings: places that a radius doesn't settle go on with three times the radius, until none is
    open or the ring holds the earth. Rows of one place are settled once. Each ring is written, so none is computed twice; only
    an empty right side leaves nulls."""
    places = written(left.select("lat", "lng").distinct().withColumn("id", F.monotonically_increasing_id()), "places")
    open_, out, metres = places, None, start
    while True:
        got = written(nearest_within(open_, right, metres), "nearest")
        done = got.where("nearest_id is not null")
        out = done if out is None else out.unionByName(done)
        open_ = got.where("nearest_id is null").select("lat", "lng", "id")
        if metres > math.pi * EARTH or open_.isEmpty():
            break
        metres *= 3
    found = out.select(F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), "nearest_id", "nearest_m")
    return left.join(found, left["lat"].eqNullSafe(F.col("_lat")) & left["lng"].eqNullSafe(F.col("_lng")), "left").drop("_lat", "_lng")


def proximity_maxima(left: DataFrame, right: DataFrame, measures: list[str], radii: dict[str, float]) -> DataFrame:
    """Per left id the maxima of right-hand measures within each named radius; one join at the largest radius serves all."""
    pairs = radius_join(left.select("id", "lat", "lng"), right, max(radii.values()))
    return pairs.groupBy("id").agg(*[F.max(F.when(F.col("distance") <= r, F.col(m))).alias(f"near_{m}_{n}") for m in measures for n, r in radii.items()])


def inside(lat: Column, lng: Column, ring: Column) -> Column:
    """Ray casting over a closed ring, an array of struct(lat, lng); the first point is repeated at the end."""
    n = F.size(ring)
    edges = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    crosses = lambda e: ((e["p"]["lat"] > lat) != (e["q"]["lat"] > lat)) & (lng < (e["q"]["lng"] - e["p"]["lng"]) * (lat - e["p"]["lat"]) / F.nullif(e["q"]["lat"] - e["p"]["lat"], F.lit(0.0)) + e["p"]["lng"])
    return F.size(F.filter(edges, crosses)) % 2 == 1


def contained_in(points: DataFrame, polygons: DataFrame, cell: float = 0.1) -> DataFrame:
    """Pairs of points (id, lat, lng) and polygons (unit, ring) that hold them. A polygon stands in all cells of its box."""
    box = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    p = polygons.withColumn("_ys", F.sequence(grid(box(F.array_min, "lat"), cell), grid(box(F.array_max, "lat"), cell)))
    p = p.withColumn("_xs", F.sequence(grid(box(F.array_min, "lng"), cell), grid(box(F.array_max, "lng"), cell)))
    p = p.withColumn("_y", F.explode("_ys")).withColumn("_x", F.explode("_xs")).drop("_ys", "_xs")
    a = points.withColumn("_y", grid(F.col("lat"), cell)).withColumn("_x", grid(F.col("lng"), cell))
    return a.join(p, ["_y", "_x"]).where(inside(F.col("lat"), F.col("lng"), F.col("ring"))).drop("_y", "_x", "ring")


def admin_unit(points: DataFrame, polygons: DataFrame, centres: DataFrame, sliver_m: float = 250.0) -> DataFrame:
    """Each point's unit: the polygon that holds it (smallest unit of several), else the nearest centre within ``sliver_m``."""
    held = contained_in(points, polygons).groupBy("id").agg(F.min("unit").alias("_held"))
    near = nearest_within(points.join(held, "id", "left_anti"), centres, sliver_m).select("id", F.col("nearest_id").alias("_near"))
    j = points.join(held, "id", "left").join(near, "id", "left")
    return j.select(*points.columns, F.coalesce("_held", "_near").alias("unit"), F.when(F.col("_held").isNotNull(), "contained").when(F.col("_near").isNotNull(), "nearest").alias("method"))


def segment_distance(lat: Column, lng: Column, alat: Column, alng: Column, blat: Column, blng: Column) -> Column:
    """Metres to a segment on a local flat map."""
    k = F.cos(F.radians(lat)) * DEGREE
    ax, ay, bx, by = (alng - lng) * k, (alat - lat) * DEGREE, (blng - lng) * k, (blat - lat) * DEGREE
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(-(ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))


def corridor(points: DataFrame, segments: DataFrame, metres: float) -> DataFrame:
    """Each point (id, lat, lng) within ``metres`` of a line with its nearest line: segments are rows (line, alat, alng, blat,
    blng); ties go to the smaller line. A segment stands in every cell of its widened box."""
    sy, sx = steps(max(metres, 1_000), north_of((segments, "alat"), (segments, "blat")))
    cells = lambda a, b, step: F.sequence(grid(F.least(a, b), step) - 1, grid(F.greatest(a, b), step) + 1)
    s = segments.withColumn("_y", F.explode(cells(F.col("alat"), F.col("blat"), sy))).withColumn("_x", F.explode(cells(F.col("alng"), F.col("blng"), sx)))
    a = points.withColumn("_y", grid(F.col("lat"), sy)).withColumn("_x", grid(F.col("lng"), sx))
    d = segment_distance(*[F.col(c) for c in ("lat", "lng", "alat", "alng", "blat", "blng")])
    near = a.join(s, ["_y", "_x"]).withColumn("distance", d).where(F.col("distance") <= metres)
    return near.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy("distance", "line"))).where("_rn = 1").select(*points.columns, "line", "distance")


def density(df: DataFrame, keys: list[str], square_km: float) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.count("*") / square_km, 4).alias("per_km2"))


def walkability(pairs: DataFrame, weights: dict[str, float], radius: float) -> DataFrame:
    """Per id from pairs (id, category, distance): the weighted score of 0 to 100. A missing category adds nothing, but its
    weight counts; ids without any amenity don't appear."""
    near = pairs.where(F.col("distance") <= radius).groupBy("id", "category").agg(F.min("distance").alias("d"), F.count("*").alias("n"))
    return walk_score(near, weights, radius)


def walk_score(near: DataFrame, weights: dict[str, float], radius: float) -> DataFrame:
    """``walkability`` from the nearest distance and the count per id and category (id, category, d, n)."""
    score = F.bround(100 * F.greatest(F.lit(0.0), 1 - F.col("d") / radius), 0)
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return near.where(F.col("category").isin(list(weights))).groupBy("id").agg(F.bround(F.sum(score * weight[F.col("category")]) / sum(weights.values()), 1).alias("score"), F.sum("n").alias("amenities"))


def near_by_category(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """Per id of left (id, lat, lng) and category of right (rlat, rlng, category): the nearest distance ``d`` and the count ``n``
    within ``metres``. Distances are taken between places, each once, however many rows stand there on either side."""
    there = right.groupBy("rlat", "rlng", "category").agg(F.count("*").alias("_m"))
    here = radius_join(left.select("lat", "lng").distinct(), there, metres).groupBy("lat", "lng", "category").agg(F.min("distance").alias("d"), F.sum("_m").alias("n"))
    return left.select("id", "lat", "lng").join(here, ["lat", "lng"]).groupBy("id", "category").agg(F.min("d").alias("d"), F.sum("n").alias("n"))


def supply_class(ratio: Column) -> Column:
    return F.when(ratio < 0.5, "scarce").when(ratio < 1.5, "adequate").when(ratio.isNotNull(), "abundant")


def collisions(pins: DataFrame, threshold: int = 5, min_streets: int = 2, multiunit: Column | None = None) -> DataFrame:
    """Pins (source, cell, street_key, foreign, near_centre_m) per (source, cell) with their class, in the order of the rules.
    ``multiunit``: a condition on the source whose several pins in one cell are units of one building."""
    g = pins.groupBy("source", "cell").agg(F.count("*").alias("n"), F.countDistinct("street_key").alias("streets"), F.avg(F.when(F.col("foreign"), 1.0).otherwise(0.0)).alias("foreign_share"), F.min("near_centre_m").alias("near_m"))
    over = F.col("n") >= threshold
    many = over & (F.col("streets") >= min_streets)
    units = (F.lit(False) if multiunit is None else F.coalesce(multiunit, F.lit(False))) & ~over
    cls = (
        F.when(F.col("n") < 2, "normal")
        .when(F.col("foreign_share") >= 0.5, "foreign_resort_centroid")
        .when(many & (F.col("near_m") <= 150), "town_centroid_suspect")
        .when(many, "parser_collapse_suspect")
        .when(units, "legitimate_multiunit")
        .when(F.col("streets") <= 1, "building_1_to_many")
        .otherwise("normal")
    )
    return g.withColumn("class", cls)
