"""The filter registry: typed filter values compile to one Column predicate, prefilters to semi joins.

``compile_filters`` is the only compiler, for every surface. A value of None sets no constraint, an empty list neither.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, values
from ..functions.text import like_escaped

UNKNOWN = "__unknown__"
#: The option sets that count as known.
CANONICAL = {"furnished": ("ano", "ne", "castecne"), "ownership": ("osobni", "druzstevni", "statni")}
#: Building types of each material bucket.
MATERIAL = {"cihla": ("cihla",), "panel": ("panel",), "smisena": ("smisena",), "ostatni": ("skelet", "drevo", "kamen", "montovana", "nizkoenergeticka")}
#: Operators of city-index rules.
RULE_OPS = {">=": "__ge__", "<=": "__le__", "==": "__eq__", "!=": "__ne__", ">": "__gt__", "<": "__lt__"}
SURFACES = ("browse", "watchdog", "comparables", "estimation", "velocity", "neighborhood")


@dataclass(frozen=True)
class Context:
    """What predicates may refer to: the time, the subject of a relative filter, other filters' values, column names."""

    as_of: datetime
    target: dict[str, Any] = field(default_factory=dict)
    spec: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class FilterDef:
    """A filter: its value's kind, its column if it has one, and what compiles it (None: a modifier or a prefilter)."""

    id: str
    kind: str
    column: str | None
    compile: Callable[[Any, Context], Column | None] | None
    surfaces: tuple[str, ...] = SURFACES
    prefilter: bool = False


def _equal(column: str) -> Callable:
    return lambda v, x: F.col(column) == F.lit(v)


def _any(column: str) -> Callable:
    return lambda v, x: F.col(column).isin(list(v)) if v else None


def _at_least(column: str) -> Callable:
    return lambda v, x: F.col(column) >= F.lit(v)


def _at_most(column: str) -> Callable:
    return lambda v, x: F.col(column) <= F.lit(v)


def unknown_or(column: str, chosen: list[str], canonical: tuple[str, ...]) -> Column | None:
    """Multi-select in which UNKNOWN stands for null and for every value outside the canonical set."""
    real = [v for v in chosen if v != UNKNOWN]
    parts = [F.col(column).isin(real)] if real else []
    if UNKNOWN in chosen:
        parts.append(F.col(column).isNull() | ~F.col(column).isin(list(canonical)))
    return reduce(lambda a, b: a | b, parts) if parts else None


def disposition(target: str | None, match: str) -> Column | None:
    """exact, loose (a kitchen corner and a kitchen of the same size are one group) or any."""
    if target is None or match == "any":
        return None
    size = target[:1]
    group = [f"{size}+kk", f"{size}+1"]
    loose = match == "loose" and size in "12345" and target in group
    return F.col("disposition").isin(group if loose else [target])


def lifecycle(state: str, as_of: datetime, max_age_days: int | None = None) -> Column | None:
    """active (and seen within max_age_days), delisted or all."""
    active = F.col("is_active")
    if state == "active":
        return active if max_age_days is None else active & (F.col("last_seen_at") >= since(as_of, max_age_days))
    return ~active if state == "delisted" else None


def since(as_of: datetime, days: float) -> Column:
    return F.lit(as_of) - F.make_dt_interval(days=F.lit(int(days)))


def price_bound(lo: float | None, hi: float | None, include_no_price: bool, column: str = "price_czk") -> Column | None:
    parts = [F.col(column) >= F.lit(lo)] * (lo is not None) + [F.col(column) <= F.lit(hi)] * (hi is not None)
    if not parts:
        return None
    p = reduce(lambda a, b: a & b, parts)
    return p | F.col(column).isNull() if include_no_price else p


def ppm_bound(lo: float | None, hi: float | None) -> Column | None:
    ppm = values.price_per_m2(F.col("price_czk"), F.col("area_m2"))
    parts = [ppm >= F.lit(lo)] * (lo is not None) + [ppm <= F.lit(hi)] * (hi is not None)
    return reduce(lambda a, b: a & b, parts) if parts else None


def window_count(window_days: int | None) -> Column:
    """The price-change count of the window chosen: 30, 90, 365 or all."""
    return {30: F.col("price_changes_30d"), 90: F.col("price_changes_90d"), 365: F.col("price_changes_365d")}.get(window_days, F.col("price_changes"))


def signed_change(pct: float | None) -> Column | None:
    """A negative bound asks for at least that fall, a positive one for at least that rise; 0 and None are off."""
    if not pct:
        return None
    return F.col("total_price_change_pct") <= F.lit(pct) if pct < 0 else F.col("total_price_change_pct") >= F.lit(pct)


def exclude_ids(column: str, ids: list) -> Column | None:
    """Rows with a null id stay."""
    return F.col(column).isNull() | ~F.col(column).isin(list(ids)) if ids else None


def location(chips: list[dict]) -> Column | None:
    """Chips of {column, id} or {text, columns, within}; included ones are alternatives, excluded ones are barred."""

    def one(chip: dict) -> Column:
        if "id" in chip:
            return F.col(chip["column"]) == F.lit(chip["id"])
        term = f"%{like_escaped(chip['text'])}%"
        p = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(term), F.lit(False)) for c in chip["columns"]])
        for column, value in chip.get("within", {}).items():
            p = p & (F.col(column) == F.lit(value))
        return p

    keep = [one(c) for c in chips if not c.get("exclude")]
    bar = [F.coalesce(one(c), F.lit(False)) for c in chips if c.get("exclude")]
    parts = ([reduce(lambda a, b: a | b, keep)] if keep else []) + [~b for b in bar]
    return reduce(lambda a, b: a & b, parts) if parts else None


def _band(column: str, subject: str, relative: bool) -> Callable:
    def band(v: float, x: Context) -> Column | None:
        at = x.target.get(subject)
        if at is None:
            return None
        return F.col(column).between(at * (1 - v), at * (1 + v)) if relative else F.col(column).between(at - v, at + v)

    return band


def _days(column: str, recent: bool) -> Callable:
    return lambda v, x: (F.col(column) >= since(x.as_of, v)) if recent else (F.col(column) <= since(x.as_of, v))


def _tom(least: bool) -> Callable:
    def f(v: int, x: Context) -> Column:
        tom = values.tom_days(F.col("first_seen_at"), F.col("last_seen_at"), F.col("is_active"), F.lit(x.as_of))
        return tom >= v if least else tom <= v

    return f


def _defs() -> list[FilterDef]:
    d, both = FilterDef, ("browse", "watchdog")
    backend = SURFACES[2:]
    plain = [
        d("location", "chips", None, lambda v, x: location(v), both),
        d("districts", "list", "district", _any("district")),
        d("radius_m", "number", None, lambda v, x: geo.within(F.col("lat"), F.col("lng"), x.target["lat"], x.target["lng"], v) if "lat" in x.target else None, backend),
        d("area_band_pct", "number", None, _band("area_m2", "area_m2", True), backend),
        d("disposition_match", "enum", None, lambda v, x: disposition(x.target.get("disposition"), v), backend),
        d("floor_band", "number", None, _band("floor", "floor", False), backend),
        d("max_age_days", "number", None, None, backend),
        d("lifecycle", "enum", None, lambda v, x: lifecycle(v, x.as_of, x.spec.get("max_age_days")), backend),
        d("status", "enum", None, lambda v, x: {"active": F.col("is_active"), "inactive": ~F.col("is_active")}.get(v), both),
        d("recently_added_days", "number", None, _days("first_seen_at", True)),
        d("recently_changed_days", "number", None, _days("last_changed_at", True)),
        d("tom_days_min", "number", None, _tom(True)),
        d("tom_days_max", "number", None, _tom(False)),
        d("last_seen_min_days", "number", None, _days("last_seen_at", False)),
        d("last_seen_max_days", "number", None, _days("last_seen_at", True)),
        d("first_seen_min_days", "number", None, _days("first_seen_at", False)),
        d("first_seen_max_days", "number", None, _days("first_seen_at", True)),
        d("category_main_in", "list", "category_main", _any("category_main")),
        d("dispositions", "list", "disposition", _any("disposition")),
        d("subtype", "list", "subtype", _any("subtype")),
        d("portals", "list", "source", _any("source")),
        d("condition_match", "list", "condition", _any("condition")),
        d("building_type_match", "list", "building_type", _any("building_type")),
        d("building_material", "list", "building_type", lambda v, x: F.col("building_type").isin([t for b in v for t in MATERIAL[b]]) if v else None, both),
        d("energy_rating_match", "list", "energy_rating", _any("energy_rating")),
        d("furnished", "list", "furnished", lambda v, x: unknown_or("furnished", v, CANONICAL["furnished"])),
        d("ownership", "list", "ownership", lambda v, x: unknown_or("ownership", v, CANONICAL["ownership"])),
        d("min_price_czk", "number", "price_czk", lambda v, x: price_bound(v, x.spec.get("max_price_czk"), bool(x.spec.get("include_no_price")))),
        d("max_price_czk", "number", "price_czk", lambda v, x: price_bound(None, v, bool(x.spec.get("include_no_price"))) if x.spec.get("min_price_czk") is None else None),
        d("include_no_price", "bool", None, None),
        d("min_price_per_m2", "number", "price_per_m2", lambda v, x: ppm_bound(v, None)),
        d("max_price_per_m2", "number", "price_per_m2", lambda v, x: ppm_bound(None, v)),
        d("tags", "list", None, None, both, prefilter=True),
        d("pipeline", "bool", None, None, both, prefilter=True),
        d("with_estimates", "bool", None, None, both, prefilter=True),
        d("city_index_rules", "rules", None, None, prefilter=True),
        d("near_city_proximity", "rule", None, None, prefilter=True),
        d("price_change_count_min", "number", None, lambda v, x: window_count(x.spec.get("price_change_window_days")) >= v),
        d("price_change_window_days", "number", None, None),
        d("total_price_change_pct", "number", None, lambda v, x: signed_change(v)),
        d("include_unreliable", "bool", None, None, prefilter=True),
    ]
    equal = [d(c, "value", c, _equal(c)) for c in ("category_main", "category_type", "category_sub_cb", "locality_district_id", "locality_region_id")]
    flags = [d(c, "bool", c, _equal(c)) for c in ("has_balcony", "has_lift", "has_parking", "terrace", "cellar", "garage")]
    ranged = {"mf_gross_yield_pct": "mf_gross_yield_pct", "area_m2": "area_m2", "estate_area": "estate_area", "usable_area": "usable_area", "garden_area": "garden_area", "city_population": "home_obec_pop"}
    bounds = [d(f"{side}_{i}", "number", c, f(c)) for i, c in ranged.items() for side, f in (("min", _at_least), ("max", _at_most))]
    levels = [d(f"{c}_{side}", "number", c, f(c)) for c in ("building_condition_level", "apartment_condition_level") for side, f in (("min", _at_least), ("max", _at_most))]
    near = [d(f"near_{m}_{r}_min", "number", f"near_{m}_{r}", _at_least(f"near_{m}_{r}")) for m in ("pop", "jobs", "youth", "overall") for r in ("5km", "15km")]
    return [*plain, *equal, *flags, d("min_parking_lots", "number", "parking_lots", _at_least("parking_lots")), *bounds, *levels, *near]


REGISTRY = {f.id: f for f in _defs()}


def compile_filters(spec: dict[str, Any], as_of: datetime, target: dict[str, Any] | None = None, surface: str | None = None) -> Column:
    """All of ``spec``'s row predicates, joined by AND. Unknown ids, and ids a surface doesn't offer, are errors."""
    context = Context(as_of, target or {}, spec)
    parts = []
    for name, value in spec.items():
        f = REGISTRY.get(name)
        if f is None or surface is not None and surface not in f.surfaces:
            raise ValueError(f"no filter {name!r}" + (f" on {surface}" if surface else ""))
        if value is not None and f.compile is not None and (p := f.compile(value, context)) is not None:
            parts.append(p)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def json_schema(surface: str | None = None) -> str:
    """The registry as a JSON schema, for agents and clients."""
    kinds = {"number": {"type": "number"}, "bool": {"type": "boolean"}, "list": {"type": "array", "items": {"type": "string"}}, "enum": {"type": "string"}, "value": {}, "chips": {"type": "array"}, "rules": {"type": "array"}, "rule": {"type": "object"}}
    shown = {f.id: kinds[f.kind] for f in REGISTRY.values() if surface is None or surface in f.surfaces}
    return json.dumps({"type": "object", "properties": shown, "additionalProperties": False}, sort_keys=True)


# prefilters: each gives ids, and only their intersection goes on


def with_all_tags(tags: DataFrame, key: list[str], tag: str, wanted: list[str]) -> DataFrame:
    """Keys that carry every wanted tag (relational division)."""
    return tags.where(F.col(tag).isin(wanted)).groupBy(*key).agg(F.countDistinct(tag).alias("_n")).where(F.col("_n") == len(set(wanted))).select(*key)


def holding_all_rules(index: DataFrame, key: str, name: str, value: str, rules: list[dict]) -> DataFrame:
    """Keys whose long-form index values satisfy every rule {index, op, value}; a missing value fails its rule. One scan,
    one grouping: each rule is a conditional aggregate."""
    tests = [F.max(F.when((F.col(name) == r["index"]) & getattr(F.col(value), RULE_OPS.get(r.get("op", ">="), "__ge__"))(F.lit(r["value"])), 1).otherwise(0)).alias(f"_r{i}") for i, r in enumerate(rules)]
    if not rules:
        return index.select(key).distinct()
    held = reduce(lambda a, b: a & b, [F.col(f"_r{i}") == 1 for i in range(len(rules))])
    return index.groupBy(key).agg(*tests).where(held).select(key)


def prefiltered(df: DataFrame, key: str, id_sets: list[DataFrame | None]) -> DataFrame:
    """Rows whose key is in every active id set (None is inactive)."""
    for ids in id_sets:
        if ids is not None:
            df = df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
    return df


def without(df: DataFrame, key: str, barred: DataFrame) -> DataFrame:
    """Rows whose key is not among ``barred``; rows with a null key stay."""
    return df.join(barred.select(F.col(barred.columns[0]).alias(key)), key, "left_anti")


def hidden_by_price(df: DataFrame, spec: dict[str, Any], as_of: datetime) -> DataFrame:
    """One row (hidden): how many rows pass all but the price bound and have no price."""
    rest = {k: v for k, v in spec.items() if k not in ("min_price_czk", "max_price_czk", "include_no_price")}
    return df.where(compile_filters(rest, as_of) & F.col("price_czk").isNull()).agg(F.count("*").alias("hidden"))


def changed(before: str, now: str) -> Column:
    """IS DISTINCT FROM."""
    return ~F.col(before).eqNullSafe(F.col(now))


def image_gate(df: DataFrame, images: DataFrame, as_of: datetime, timeout_hours: int, floor_hours: int) -> DataFrame:
    """Rows to announce: with a stored image, or first seen ``timeout_hours`` ago, or ``floor_hours`` ago without any image rows."""
    state = images.groupBy("listing_id").agg(F.bool_or("stored").alias("_stored"))
    age = F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp("first_seen_at")
    joined = df.join(state, "listing_id", "left")
    ok = F.coalesce("_stored", F.lit(False)) | (age >= timeout_hours * 3600) | ((age >= floor_hours * 3600) & F.col("_stored").isNull())
    return joined.where(ok).drop("_stored")
