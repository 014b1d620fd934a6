"""Queries of portals: listings written in the nine shapes of payloads and read back, and the brokers that payloads name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import attribution
from ..operators.attribution import Rule
from ..sources import drain, portals
from .frames import LISTING, Family, Frames, of, of_sql

family = Family()
add = family.add

_SHAPES = list(portals.SHAPES)
_WORDS = {"cihla": "Cihlová", "panel": "Panelová", "smisena": "Smíšená", "skelet": "Skeletová", "drevo": "Dřevěná", "kamen": "Kamenná", "montovana": "Montovaná"}
_FITTED = {"ano": "Zařízený", "ne": "Nezařízený", "castecne": "Částečně zařízený", "jine": "jiné"}


def _swap(c: str, table: dict[str, str]) -> Column:
    return portals.coded(F.col(c), table)


def _page(rows: list[tuple[str, Column]], before: str, between: str, after: str, whole: tuple[str, str] = ("", "")) -> Column:
    """Rows of labels and values in a portal's markup; a null value has no row."""
    said = [F.concat(F.lit(f"{before}{label}:{between}"), v, F.lit(after)) for label, v in rows]
    return F.concat(F.lit(f"<html><body><h1>Listing</h1>{whole[0]}"), F.concat_ws("\n", *said), F.lit(f"{whole[1]}</body></html>"))


def _payload() -> Column:
    """A listing in the shape that the remainder of its id points at."""
    price, k = F.floor("price_czk").cast("long"), F.col("id")
    amount, area = F.concat(F.replace(F.format_number(price, 0), F.lit(","), F.lit(" ")), F.lit(" Kč")), F.concat(F.col("area_m2").cast("string"), F.lit(" m²"))
    words, fitted = _swap("building_type", _WORDS), _swap("furnished", _FITTED)
    lift = F.when(F.col("has_lift"), "Ano").when(~F.col("has_lift"), "Ne")
    storey = F.concat((F.col("floor") + 1).cast("string"), F.lit(". NP"))
    name = lambda c: F.when(c.isNotNull(), F.struct(c.alias("name")))
    codes = F.to_json(
        F.struct(
            price.alias("price_summary_czk"),
            F.col("area_m2").alias("usable_area"),
            name(F.concat(F.lit("Byt "), "disposition")).alias("category_sub_cb"),
            F.col("floor").alias("floor_number"),
            name(words).alias("building_type"),
            F.struct(_swap("furnished", {v: k for k, v in portals.FURNISHED_CODES.items()}).cast("int").alias("value")).alias("furnished"),
            F.when(lift.isNotNull(), F.struct(F.lit(1).alias("value"), lift.alias("name"))).alias("elevator"),
            F.struct(F.col("lat").alias("gps_lat"), F.col("lng").alias("gps_lon")).alias("locality"),
        )
    )
    names = F.to_json(
        F.struct(
            price.alias("price"),
            F.col("area_m2").alias("surface"),
            F.concat(F.lit("DISP_"), F.replace(F.upper("disposition"), F.lit("+"), F.lit("_"))).alias("disposition"),
            F.col("floor").alias("etage"),
            _swap("building_type", {v: k for k, v in portals.BUILDING_NAMES.items()}).alias("construction"),
            _swap("furnished", {v: k for k, v in portals.FURNISHED_NAMES.items()}).alias("equipped"),
            F.col("has_lift").alias("lift"),
            F.struct("lat", "lng").alias("gps"),
        )
    )
    thing = F.to_json(
        F.struct(
            k.alias("id"),
            price.alias("price"),
            F.col("area_m2").alias("totalArea"),
            name(F.concat(F.lit("Byt "), "disposition")).alias("type"),
            F.col("floor"),
            name(words).alias("construction"),
            F.col("has_lift").alias("lift"),
            F.struct(F.col("lat").alias("latitude"), F.col("lng").alias("longitude")).alias("point"),
        )
    )
    embedded = F.concat(F.lit("""<div><card :property="{&quot;id&quot;: -1, &quot;price&quot;: 5}"></card><main :property=\""""), F.replace(F.replace(thing, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"></main></div>'))
    facts = [("Cena", amount), ("Dispozice", F.col("disposition")), ("Vybavení", fitted), ("Výtah", lift)]
    shapes = {
        "codes": codes,
        "names": names,
        "object": embedded,
        "definitions": _page([*facts, ("Užitná plocha", area), ("Podlaží", storey), ("Konstrukce budovy", words)], "<dt>", "</dt><dd>", "</dd>", ("<dl>", "</dl>")),
        "divisions": _page([*facts, ("Celková plocha", area), ("Číslo podlaží", F.col("floor").cast("string")), ("Druh objektu", words)], '<div class="row"><div class="pd-detail-info__label">', '</div><div class="x pd-detail-info__value">', "</div></div>"),
        "items": _page([*facts, ("Celková podlahová plocha", area), ("Číslo podlaží v domě", storey), ("Druh objektu", words)], '<li class="detail-information__data-item"><span>', "</span><span>", "</span></li>", ("<ul>", "</ul>")),
        "spans": _page([*facts, ("Plocha užitná", area), ("Patro", storey), ("Konstrukce", words)], '<div class="i-info"><span class="i-info__title">', '</span><span class="i-info__value">', "</span></div>"),
        "headed": _page([*facts, ("Plocha užitná", area), ("Podlaží", F.concat(F.col("floor").cast("string"), F.lit("./9."))), ("Budova", words)], '<tr><th class="slider_label">', '</th><td class="slider_value">', "</td></tr>", ("<table>", "</table>")),
        "advert": _page([("Cena", amount), ("Výtah", lift)], "<tr><td>", "</td><td><i></i></td><td>", "</td></tr>", ("<table>", "</table>")),
    }
    free = F.concat(F.lit('<h1 class="nadpisdetail">Byt '), "disposition", F.lit(", "), area, F.lit('</h1><div class="popisdetail">'), storey, F.lit(" &amp; sklep</div>"))
    shapes["advert"] = F.replace(shapes["advert"], F.lit("<h1>Listing</h1>"), free)
    out = F.when(k % 9 == 0, shapes[_SHAPES[0]])
    for i, s in enumerate(_SHAPES[1:], 1):
        out = out.when(k % 9 == i, shapes[s])
    return out


def _read_back(f: Frames):
    rows = f.listing.select("id", of([f"portal {s}" for s in _SHAPES], F.col("id")).alias("source"), _payload().alias("payload"))
    read = portals.listings(rows, "source", "payload", "id", {f"portal {s}": s for s in _SHAPES})
    return read.select("id", "source", "price_czk", "area_m2", "disposition", "floor", "building_type", "furnished", "has_lift", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"))


_S = of_sql([f"portal {s}" for s in _SHAPES], "id")
add(
    "s04_portal_adapters",
    _read_back,
    f"SELECT id, {_S} AS source, CAST(floor(price_czk) AS BIGINT) AS price_czk, CAST(area_m2 AS DOUBLE) AS area_m2, disposition, CASE WHEN id % 9 <> 1 OR floor <> 0 THEN floor END AS floor, CASE WHEN id % 9 <> 8 THEN building_type END AS building_type, CASE WHEN id % 9 NOT IN (2, 8) AND furnished <> 'jine' THEN furnished END AS furnished, has_lift, CASE WHEN id % 9 < 3 THEN round(lat, 4) END AS lat, CASE WHEN id % 9 < 3 THEN round(lng, 4) END AS lng FROM listing",
    LISTING,
)

#: Six rules, one for each way in which portals give their brokers.
_RULES = {
    "portal a": Rule("user", "user_id", "user_name", "user_email", phones="user_phones", prefix=True, rating="broker_rating", reviews="broker_review_count"),
    "portal b": Rule("broker", "account_oid", "name", "email", "phone", watched=("agency_name",)),
    "portal c": Rule("broker", "broker_id", "name", phone="phone", prefix=True, watched=("agency_slug",)),
    "portal d": Rule("broker", "broker_id", "name", watched=("agency_id",)),
    "portal e": Rule("broker", "broker_id", "name", "email", watched=("agency_slug",)),
    "portal f": Rule("broker", "id", "name", "email", "phone", prefix=True, contacts=False),
}


def _with_brokers(f: Frames):
    """Listings whose payload names one of 97 brokers a portal; every tenth has none."""
    uid = (F.col("property_id") % 97).cast("string")
    name, mail = F.concat(F.lit("Broker "), uid, F.lit(" "), (F.col("id") % 3).cast("string")), F.when(F.col("id") % 4 != 0, F.concat(F.lit("B"), uid, F.lit("@Example.COM"))).otherwise("")
    phone = F.concat(F.lit("777 "), F.lpad(uid, 3, "0"), F.lit(" 12"), (F.col("id") % 2).cast("string"))
    out = F.lit(None).cast("string")
    for i, rule in enumerate(_RULES.values()):
        parts = [uid.alias(rule.id), name.alias(rule.name)]
        parts += [mail.alias(rule.email)] if rule.email else []
        parts += [phone.alias(rule.phone)] if rule.phone else []
        parts += [F.array(F.struct(phone.alias("phone")), F.struct(F.lit("12").alias("phone"))).alias(rule.phones)] if rule.phones else []
        parts += [(F.col("id") % 5).cast("string").alias(rule.rating), (F.col("id") % 50).cast("string").alias(rule.reviews)] if rule.rating else []
        out = F.when(F.col("id") % 6 == i, F.to_json(F.struct(F.struct(*parts).alias(rule.block)))).otherwise(out)
    return f.listing.select("id", of(list(_RULES), F.col("id")).alias("source"), F.when(F.col("id") % 10 != 0, out).otherwise("{}").alias("raw"), "first_seen_at", "last_seen_at")


_B = f"""{LISTING}, named AS (
  SELECT id, {of_sql(list(_RULES), "id")} AS source, id % 6 AS p, CAST(property_id % 97 AS VARCHAR) AS uid, 'Broker ' || (property_id % 97) || ' ' || (id % 3) AS name,
    CASE WHEN id % 6 IN (0, 1, 4, 5) AND id % 4 <> 0 THEN 'b' || (property_id % 97) || '@example.com' END AS email,
    CASE WHEN id % 6 IN (0, 2) THEN '420' ELSE '' END || '777' || lpad(CAST(property_id % 97 AS VARCHAR), 3, '0') || '12' || (id % 2) AS phone, first_seen_at, last_seen_at FROM listing WHERE id % 10 <> 0)"""
add(
    "e01_identities",
    lambda f: attribution.identities(attribution.attributed(_with_brokers(f), _RULES)),
    "SELECT source, uid, arg_max(name, (last_seen_at, id)) AS name, (list(email ORDER BY last_seen_at DESC, id DESC))[1] AS email, CASE WHEN source = 'portal a' THEN CAST(max(id % 5) FILTER (WHERE id = last) AS DOUBLE) END AS rating, CASE WHEN source = 'portal a' THEN CAST(max(id % 50) FILTER (WHERE id = last) AS INT) END AS reviews, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, count(*) AS listings FROM (SELECT *, first_value(id) OVER (PARTITION BY source, uid ORDER BY last_seen_at DESC, id DESC) AS last FROM named) GROUP BY source, uid",
    _B,
)
add(
    "e01_contacts",
    lambda f: attribution.contacts(attribution.attributed(_with_brokers(f), _RULES)),
    "SELECT source, uid, kind, value, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at FROM (SELECT source, uid, 'email' AS kind, email AS value, first_seen_at, last_seen_at FROM named WHERE email IS NOT NULL AND p <> 5 UNION ALL SELECT source, uid, 'phone', phone, first_seen_at, last_seen_at FROM named WHERE p IN (0, 1, 2)) GROUP BY source, uid, kind, value",
    _B,
)
add("e01_links", lambda f: attribution.attributed(_with_brokers(f), _RULES).select("id", "source", "uid"), "SELECT id, source, uid FROM named", _B)


# a detail queue


def _fetched(i: int) -> tuple[str, str | None]:
    """Stands for a portal's answers: some pages are gone, some fail."""
    if i % 11 == 0:
        raise OSError("no answer")
    return ("gone", None) if i % 7 == 0 else ("ok", f"detail {i}")


def _drain(f: Frames):
    """What becomes of each row of the queue when its next 3,000 open rows are worked on."""
    q = f.events.select(F.col("event_id").alias("id"), (F.col("event_id") % 3).alias("priority"), F.col("ts").alias("enqueued_at"), (F.col("event_id") % 6).alias("attempts"), F.when(F.col("event_id") % 4 == 0, F.col("ts")).alias("claimed_at"))
    details, gone, after = drain.drained(drain.reclaimed(q, "2024-01-20 00:00:00", 60), _fetched, 3000)
    state = lambda df, s, payload: df.select("id", F.lit(s).alias("state"), payload.cast("string").alias("payload"), (F.col("attempts") if s == "queued" else F.lit(None)).cast("long").alias("attempts"))
    return state(details, "detail", F.col("payload")).unionByName(state(gone, "gone", F.lit(None))).unionByName(state(after, "queued", F.when(F.col("last_error").isNotNull(), "failed")))


add(
    "s03_detail_drain",
    _drain,
    "SELECT id, CASE WHEN NOT claimed OR id % 11 = 0 THEN 'queued' WHEN id % 7 = 0 THEN 'gone' ELSE 'detail' END AS state, CASE WHEN claimed AND id % 11 = 0 THEN 'failed' WHEN claimed AND id % 7 <> 0 THEN 'detail ' || id END AS payload, CASE WHEN NOT claimed OR id % 11 = 0 THEN id % 6 + CAST(claimed AND id % 11 = 0 AS BIGINT) END AS attempts FROM (SELECT event_id AS id, coalesce(row_number() OVER (PARTITION BY open ORDER BY event_id % 3 DESC, ts, event_id) <= 3000 AND open, FALSE) AS claimed FROM (SELECT *, event_id % 6 < 5 AND (event_id % 4 <> 0 OR ts <= TIMESTAMP '2024-01-20' - INTERVAL 60 MINUTE) AS open FROM events))",
)
