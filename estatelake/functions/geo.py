"""Distances, boxes and cells over latitude and longitude columns in degrees."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in metres, and metres a degree of latitude for boxes.
EARTH, DEGREE = 6_371_008.8, 111_000.0


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng / 2) * F.sin(dlng / 2)
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def box(lat: Column, lng: Column, metres: float) -> tuple[Column, Column, Column, Column]:
    """(south, north, west, east) around a point; wide enough for every point within ``metres``."""
    dlat = F.lit(metres / DEGREE)
    dlng = F.lit(metres) / (DEGREE * F.greatest(F.cos(F.radians(F.abs(lat) + dlat)), F.lit(0.01)))
    return lat - dlat, lat + dlat, lng - dlng, lng + dlng


def within(lat: Column, lng: Column, clat: float, clng: float, metres: float) -> Column:
    """Whether a point lies within ``metres`` of a fixed one; the box comes first, so that a scan can skip by it."""
    s, n, w, e = box(F.lit(clat), F.lit(clng), metres)
    return lat.between(s, n) & lng.between(w, e) & (haversine(lat, lng, F.lit(clat), F.lit(clng)) <= metres)


def cell_key(lat: Column, lng: Column) -> Column:
    """Four decimals, halves away from zero, "lat,lng"."""
    four = lambda c: F.format_string("%s", c.cast("decimal(20,10)").cast("decimal(9,4)"))
    return F.concat_ws(",", four(F.round(lat.cast("decimal(20,10)"), 4)), four(F.round(lng.cast("decimal(20,10)"), 4)))


def grid(degrees: Column, step: float) -> Column:
    return F.floor(degrees / F.lit(step)).cast("long")


def listing_cell_key(lat: Column, lng: Column, category: Column) -> Column:
    """Blocking key of a listing: trimmed four-decimal coordinates and the category's bucket (dum and komercni share one)."""
    bucket = F.when(category.isin("dum", "komercni"), "dum_komercni").otherwise(category)
    trimmed = lambda c: F.regexp_replace(F.regexp_replace(F.round(c.cast("decimal(20,10)"), 4).cast("decimal(9,4)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.concat(trimmed(lat), F.lit("|"), trimmed(lng), F.lit("|"), bucket)


#: The national grid's envelope (both ordinates positive, Y westward, X southward) and the country's box.
GRID_Y, GRID_X = (400_000.0, 950_000.0), (900_000.0, 1_250_000.0)
COUNTRY = (48.0, 51.5, 12.0, 19.0)
#: Fixed values of the grid's definition: Bessel's and the WGS84 ellipsoid (half axis, inverse flattening); the cone's parallels,
#: azimuth, scale and meridian; the shifts, turns (seconds) and scale (millionths) from the one datum to the other.
BESSEL, WGS84 = (6_377_397.155, 299.1528128), (6_378_137.0, 298.257223563)
CENTRE, AZIMUTH, PARALLEL, GRID_SCALE, MERIDIAN = math.radians(49.5), math.radians(30 + 17 / 60 + 17.30311 / 3600), math.radians(78.5), 0.9999, math.radians(24 + 50 / 60)
SHIFT, TURN, STRETCH = (572.213, 85.334, 461.94), (4.9732, 1.529, 5.2484), 3.5378


def _square(ellipsoid: tuple[float, float]) -> float:
    """The square of the eccentricity."""
    f = 1 / ellipsoid[1]
    return f * (2 - f)


def _cone() -> tuple[float, float, float, float]:
    """(exponent and factor of the conformal sphere, radius of the base parallel, sine of it)."""
    e2 = _square(BESSEL)
    e = math.sqrt(e2)
    s = math.sin(CENTRE)
    b = math.sqrt(1 + e2 * math.cos(CENTRE) ** 4 / (1 - e2))
    a = BESSEL[0] * math.sqrt(1 - e2) / (1 - e2 * s * s)
    on_sphere = math.asin(s / b)
    t = math.tan(math.pi / 4 + on_sphere / 2) * ((1 + e * s) / (1 - e * s)) ** (e * b / 2) / math.tan(math.pi / 4 + CENTRE / 2) ** b
    return b, t, GRID_SCALE * a / math.tan(PARALLEL), math.sin(PARALLEL)


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` over a struct of values that are computed once: an expression used twice would otherwise be written twice, and
    steps that build on each other would grow without bound."""
    return F.element_at(F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), body), 1)


def _to_space(lat: Column, lng: Column, ellipsoid: tuple[float, float]) -> dict[str, Column]:
    e2 = _square(ellipsoid)
    n = ellipsoid[0] / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return {"x": n * F.cos(lat) * F.cos(lng), "y": n * F.cos(lat) * F.sin(lng), "z": n * (1 - e2) * F.sin(lat)}


def _from_space(p: Column, ellipsoid: tuple[float, float], body: Callable[[Column], Column]) -> Column:
    """``body`` over a struct (lat, lng) in radians."""
    e2, a = _square(ellipsoid), ellipsoid[0]
    b = a * math.sqrt(1 - e2)
    around = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
    first = {"r": around, "t": F.atan2(p["z"] * a, around * b), "z": p["z"], "lng": F.atan2(p["y"], p["x"])}
    lat = lambda q: F.atan2(q["z"] + e2 / (1 - e2) * b * F.pow(F.sin(q["t"]), 3), q["r"] - e2 * a * F.pow(F.cos(q["t"]), 3))
    return _let(first, lambda q: _let({"lat": lat(q), "lng": q["lng"]}, body))


def _other_datum(p: Column, way: int) -> dict[str, Column]:
    """The seven-parameter shift to WGS84, or back for ``way`` -1 (to first order, as its parts are small)."""
    x, y, z = p["x"], p["y"], p["z"]
    rx, ry, rz = (way * math.radians(s / 3600) for s in TURN)
    m = 1 + way * STRETCH * 1e-6
    dx, dy, dz = (way * s for s in SHIFT)
    return {"x": dx + m * (x - rz * y + ry * z), "y": dy + m * (rz * x + y - rx * z), "z": dz + m * (-ry * x + rx * y + z)}


def _shifted(lat: Column, lng: Column, before: tuple[float, float], after: tuple[float, float], way: int, body: Callable[[Column], Column]) -> Column:
    return _let(_to_space(lat, lng, before), lambda p: _let(_other_datum(p, way), lambda q: _from_space(q, after, body)))


def grid_to_wgs84(y: Column, x: Column) -> Column:
    """struct(lat, lng) of national grid ordinates as published, which may come with either sign convention only as a whole:
    positive ones (Y westward, X southward), or their negatives (easting, northing). Null for ordinates outside the grid's envelope
    or of mixed signs, and where the result is outside the country's box, so that swapped ordinates don't pass for a place."""
    return F.when(F.abs(y).between(*GRID_Y) & F.abs(x).between(*GRID_X), wgs84_of(y, x, 0.0))


def wgs84_of(y: Column, x: Column, slack: float = 1e-6) -> Column:
    """``grid_to_wgs84`` without the envelope, which leaves out corners of the country's box: the inverse of ``wgs84_to_grid`` in all
    of that box. Its edge is given ``slack`` degrees, as places come back to some 5e-8."""
    b, t0, r0, n = _cone()
    e = math.sqrt(_square(BESSEL))
    down, west = F.abs(x), F.abs(y)
    south, north, left, right = COUNTRY

    def on_cone(p: Column) -> Column:
        t = 2 * (F.atan(F.pow(r0 / p["r"], 1 / n) * math.tan(math.pi / 4 + PARALLEL / 2)) - math.pi / 4)
        return _let({"t": t, "d": p["d"]}, on_sphere)

    def on_sphere(p: Column) -> Column:
        u = F.asin(math.cos(AZIMUTH) * F.sin(p["t"]) - math.sin(AZIMUTH) * F.cos(p["t"]) * F.cos(p["d"]))
        return _let({"u": u, "t": p["t"], "d": p["d"]}, on_ellipsoid)

    def on_ellipsoid(p: Column) -> Column:
        v = F.asin(F.cos(p["t"]) * F.sin(p["d"]) / F.cos(p["u"]))
        base = math.pow(t0, -1 / b) * F.pow(F.tan(p["u"] / 2 + math.pi / 4), 1 / b)
        return _let({"lat": p["u"], "base": base, "lng": MERIDIAN - v / b}, lambda q: settled(q, 4))

    def settled(p: Column, left_over: int) -> Column:  # each step gains more than two digits
        if not left_over:
            return _shifted(p["lat"], p["lng"], BESSEL, WGS84, 1, guarded)
        s = F.sin(p["lat"])
        lat = 2 * (F.atan(p["base"] * F.pow((1 + e * s) / (1 - e * s), e / 2)) - math.pi / 4)
        return _let({"lat": lat, "base": p["base"], "lng": p["lng"]}, lambda q: settled(q, left_over - 1))

    def guarded(p: Column) -> Column:
        lat, lng = F.degrees(p["lat"]), F.degrees(p["lng"])
        return F.when(lat.between(south - slack, north + slack) & lng.between(left - slack, right + slack), F.struct(lat.alias("lat"), lng.alias("lng")))

    return F.when(F.signum(x) == F.signum(y), _let({"r": F.sqrt(down * down + west * west), "d": F.atan2(west, down) / n}, on_cone))


def wgs84_to_grid(lat: Column, lng: Column) -> Column:
    """struct(y, x) of positive grid ordinates; null outside the country's box."""
    b, t0, r0, n = _cone()
    e = math.sqrt(_square(BESSEL))
    south, north, left, right = COUNTRY

    def on_sphere(p: Column) -> Column:
        s = F.sin(p["lat"])
        u = 2 * (F.atan(t0 * F.pow(F.tan(p["lat"] / 2 + math.pi / 4), b) / F.pow((1 + e * s) / (1 - e * s), e * b / 2)) - math.pi / 4)
        return _let({"u": u, "v": b * (MERIDIAN - p["lng"])}, on_cone)

    def on_cone(p: Column) -> Column:
        t = F.asin(math.cos(AZIMUTH) * F.sin(p["u"]) + math.sin(AZIMUTH) * F.cos(p["u"]) * F.cos(p["v"]))
        return _let({"t": t, "u": p["u"], "v": p["v"]}, flat)

    def flat(p: Column) -> Column:
        d = n * F.asin(F.cos(p["u"]) * F.sin(p["v"]) / F.cos(p["t"]))
        r = r0 * F.pow(math.tan(math.pi / 4 + PARALLEL / 2) / F.tan(p["t"] / 2 + math.pi / 4), n)
        return _let({"d": d, "r": r}, lambda q: F.struct((q["r"] * F.sin(q["d"])).alias("y"), (q["r"] * F.cos(q["d"])).alias("x")))

    return F.when(lat.between(south, north) & lng.between(left, right), _shifted(F.radians(lat), F.radians(lng), WGS84, BESSEL, -1, on_sphere))
