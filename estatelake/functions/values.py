"""Money, time on market, hashes, vectors and other value expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MOST = 2**31 - 1


def price_per_m2(price: Column, area: Column, places: int | None = None) -> Column:
    ppm = F.when(area > 0, price / area)
    return ppm if places is None else F.round(ppm.cast("decimal(28,10)"), places).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """Division of doubles that gives infinities and NaN for a zero, where ``/`` gives an error or null."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / F.nullif(b, F.lit(0.0)))


def round_binary(x: Column, places: int) -> Column:
    """Rounds a double as SQL on DuckDB does: times a power of ten, to a whole number, back. ``F.round`` goes by the digits that
    stand for a double, so that 2099.99 / 2 becomes 1050.0, not 1049.99."""
    return F.round(x * float(10**places), 0) / float(10**places)


def floor_double(x: Column) -> Column:
    """Floor as a double: NaN, infinities and what no long can hold stay as they are."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def days_between(start: Column, end: Column) -> Column:
    """Whole days, floored."""
    return F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 86_400)


def tom_days(first_seen: Column, last_seen: Column, active: Column, as_of: Column) -> Column:
    """Time on market: to ``as_of`` while active, else to last seen; never negative."""
    return F.greatest(F.lit(0), days_between(first_seen, F.when(active, as_of).otherwise(last_seen)))


def clamp_int(c: Column) -> Column:
    """Values that don't fit 32 bits become null."""
    return F.when(c.between(-INT_MOST - 1, INT_MOST), c)


def placeholder_area(area: Column) -> Column:
    return F.when(area > 0, area)


def source_trust(source: Column, ranks: dict[str, int], otherwise: int = 10) -> Column:
    """Trust in a source by a table of ranks (1 is best); unknown sources and null take ``otherwise``."""
    known = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return F.coalesce(known[source], F.lit(otherwise)).cast("short")


def price_changed(before: Column, now: Column, pct: float) -> Column:
    """A relative change beyond ``pct`` per cent; from or to null is a change, null to null isn't, from zero any change is."""
    both_null, one_null = before.isNull() & now.isNull(), before.isNull() | now.isNull()
    return F.when(both_null, False).when(one_null, True).when(before == 0, now != 0).otherwise(F.abs(now - before) / F.abs(before) * 100 > pct)


def content_hash(columns: list[str], volatile: tuple[str, ...] = ()) -> Column:
    """sha256 of the JSON of the columns in name order, the volatile ones aside; nulls count."""
    kept = [F.col(c) for c in sorted(columns) if c not in volatile]
    return F.sha2(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}), 256)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def softmax(scores: Column) -> Column:
    """Of an array of doubles."""
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    return F.transform(shifted, lambda x: x / total)


def month_index(year: Column, month: Column) -> Column:
    return year * 12 + month - 1


def gross_yield_pct(rent: Column, price: Column) -> Column:
    """Twelve rents by the price in per cent; null for a price that isn't positive."""
    return F.when(price > 0, F.bround(12 * rent / price * 100, 2))


def json_sha(*parts: Column) -> Column:
    """sha256 of the JSON array of the parts as text, nulls kept."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"}), 256)
