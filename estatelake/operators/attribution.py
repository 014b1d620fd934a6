"""Brokers of listings: identities, their contacts and the listings' links to them, read from payloads by a rule for each portal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


@dataclass(frozen=True)
class Rule:
    """Where a portal's JSON holds its broker: the object ``block`` with the keys of the portal's own id, the name and what
    else there is. ``phones`` is a list of {phone}. ``prefix``: nine digits gain the country code. ``contacts``: whether the portal's
    contacts are worth keeping (one switchboard for all brokers isn't). ``watched``: further keys of the block whose change matters."""

    block: str
    id: str
    name: str
    email: str | None = None
    phone: str | None = None
    phones: str | None = None
    prefix: bool = False
    rating: str | None = None
    reviews: str | None = None
    contacts: bool = True
    watched: tuple[str, ...] = ()

    def keys(self) -> list[str]:
        return [k for k in (self.id, self.name, self.email, self.phone, self.phones, *self.watched) if k]


def _numbers(raw: Column, rule: Rule) -> Column:
    """Telephone numbers of one payload as digits; fewer than nine are none."""
    at = lambda key: F.get_json_object(raw, f"$.{rule.block}.{key}")
    if rule.phones:
        said = F.transform(F.from_json(at(rule.phones), "array<struct<phone: string>>"), lambda p: p["phone"])
    elif rule.phone:
        said = F.array(at(rule.phone))
    else:
        return F.array().cast("array<string>")
    digits = F.transform(F.coalesce(said, F.array().cast("array<string>")), lambda p: F.regexp_replace(F.coalesce(p, F.lit("")), "[^0-9]", ""))
    if rule.prefix:
        digits = F.transform(digits, text.phone)
    return F.array_distinct(F.filter(digits, lambda d: F.length(d) >= 9))


def attributed(listings: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Listings (id, source, raw, first_seen_at, last_seen_at) of portals with a rule whose payload names a broker: the portal's
    own id ``uid``, name, email, rating, reviews, phones, and a hash of what a change of broker shows in. One projection for all
    portals, so the payloads are read once."""

    def by_source(make: Callable[[Rule], Column | None], kind: str) -> Column:
        chain = F.when(F.lit(False), F.lit(None).cast(kind))
        for source, rule in rules.items():
            c = make(rule)
            if c is not None:
                chain = chain.when(F.col("source") == source, c.cast(kind))
        return chain

    raw = F.col("raw")
    at = lambda rule, key: F.get_json_object(raw, f"$.{rule.block}.{key}") if key else None
    filled = lambda rule, key: F.nullif(at(rule, key), F.lit("")) if key else None
    rows = listings.select(
        "id",
        "source",
        "first_seen_at",
        "last_seen_at",
        by_source(lambda r: at(r, r.id), "string").alias("uid"),
        by_source(lambda r: filled(r, r.name), "string").alias("name"),
        by_source(lambda r: F.lower(filled(r, r.email)) if r.email else None, "string").alias("email"),
        by_source(lambda r: filled(r, r.rating).try_cast("double") if r.rating else None, "double").alias("rating"),
        by_source(lambda r: filled(r, r.reviews).try_cast("int") if r.reviews else None, "int").alias("reviews"),
        by_source(lambda r: F.lit(r.contacts), "boolean").alias("contacts"),
        by_source(lambda r: _numbers(raw, r), "array<string>").alias("phones"),
        by_source(lambda r: F.sha2(F.to_json(F.array(*[at(r, k) for k in sorted(r.keys())]), {"ignoreNullFields": "false"}), 256), "string").alias("fingerprint"),
    )
    return rows.where("uid is not null")


def identities(found: DataFrame) -> DataFrame:
    """A row for each (source, uid) of ``attributed``: name, email, rating and reviews of the listing seen last (of several, the
    one of greatest id), when it was seen first and last, and the number of its listings."""
    newest = F.max_by(F.struct("name", "email", "rating", "reviews"), F.struct("last_seen_at", "id")).alias("_n")
    g = found.groupBy("source", "uid").agg(newest, F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.count("*").alias("listings"))
    return g.select("source", "uid", "_n.*", "first_seen_at", "last_seen_at", "listings")


def contacts(found: DataFrame) -> DataFrame:
    """A row for each (source, uid, kind, value): when the contact was seen first and last."""
    mail = F.when(F.col("email").isNotNull(), F.array(F.struct(F.lit("email").alias("kind"), F.col("email").alias("value")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    phones = F.transform("phones", lambda p: F.struct(F.lit("phone").alias("kind"), p.alias("value")))
    rows = found.where("contacts").select("source", "uid", "first_seen_at", "last_seen_at", F.explode(F.concat(mail, phones)).alias("_c"))
    return rows.select("source", "uid", "_c.*", "first_seen_at", "last_seen_at").groupBy("source", "uid", "kind", "value").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


def upserted(known: DataFrame, found: DataFrame) -> DataFrame:
    """Known identities with those just found: what was seen last wins, found rows in a tie, as to name, email, rating and
    reviews; the span of sight covers both. ``listings`` is that of the rows just found."""
    both = known.withColumn("_new", F.lit(0)).unionByName(found.withColumn("_new", F.lit(1)))
    newest = F.max_by(F.struct("name", "email", "rating", "reviews"), F.struct("last_seen_at", "_new")).alias("_n")
    g = both.groupBy("source", "uid").agg(newest, F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max(F.when(F.col("_new") == 1, F.col("listings"))).alias("listings"))
    return g.select("source", "uid", "_n.*", "first_seen_at", "last_seen_at", "listings")
