"""Entity resolution: discriminating contacts, name-firm evidence, suppressed pairs, components, review pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .graph import components

#: Components above this size are not merged without review.
CAP = 20


def discriminating(contacts: DataFrame) -> DataFrame:
    """Contact values (kind, value) carried under exactly one name key; rows are (identity, kind, value, name_key). The test
    runs over the whole corpus, never over a filtered part."""
    return contacts.where("value is not null").groupBy("kind", "value").agg(F.countDistinct("name_key").alias("_names")).where("_names = 1").select("kind", "value")


def contact_edges(contacts: DataFrame) -> DataFrame:
    """Stars: mergeable carriers of a discriminating value with one name are tied to the least of them."""
    good = contacts.join(discriminating(contacts), ["kind", "value"], "left_semi").where("mergeable and name_key is not null")
    least = good.groupBy("kind", "value", "name_key").agg(F.min("identity").alias("a"))
    return good.join(least, ["kind", "value", "name_key"]).where("identity <> a").select("a", F.col("identity").alias("b")).distinct()


def firm_edges(identities: DataFrame, contacts: DataFrame) -> DataFrame:
    """Stars among same-name identities of one firm: the name occurs at that firm only, the firm is no franchise, there are two
    at least, and they are not contradicted: no kind of contact has value sets of two of them without a common value."""
    named = identities.where("mergeable and name_key is not null")
    at_one = identities.where("name_key is not null and firm is not null").groupBy("name_key").agg(F.countDistinct("firm").alias("_f")).where("_f = 1").select("name_key")
    g = named.where("firm is not null and not franchise").join(at_one, "name_key", "left_semi")
    sizes = g.groupBy("name_key", "firm").agg(F.count("*").alias("_n"), F.min("identity").alias("a")).where("_n >= 2")
    members = g.join(sizes, ["name_key", "firm"]).select("name_key", "firm", "a", "identity")
    held = contacts.where("value is not null").select("identity", "kind", "value").distinct().join(members.select("name_key", "firm", "identity"), "identity")
    many = held.groupBy("name_key", "firm", "kind").agg(F.countDistinct("identity").alias("_m"))
    x, y = held.withColumnRenamed("identity", "_x"), held.withColumnRenamed("identity", "_y")
    # pairs that share a value; where they are fewer than all pairs, two have none in common
    agreed = x.join(y, ["name_key", "firm", "kind", "value"]).where("_x < _y").groupBy("name_key", "firm", "kind").agg(F.countDistinct("_x", "_y").alias("_pairs"))
    contradicted = many.join(agreed, ["name_key", "firm", "kind"], "left").where("coalesce(_pairs, 0) < _m * (_m - 1) / 2").select("name_key", "firm").distinct()
    return members.join(contradicted, ["name_key", "firm"], "left_anti").where("identity <> a").select("a", F.col("identity").alias("b")).distinct()


def _pairs_within(groups: DataFrame, key: str, id_: str) -> DataFrame:
    """All pairs a < b of one group."""
    a, b = groups.select(key, F.col(id_).alias("a")), groups.select(key, F.col(id_).alias("b"))
    return a.join(b, key).where("a < b").select("a", "b").distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def resolve(edges: DataFrame, suppressed: DataFrame, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(groups to merge (node, component), pairs to review (a, b)).

    Components are those of all edges, suppressed ones too. A component above ``cap``, or one that holds a suppressed pair,
    even one that is no edge, isn't merged. All pairs of such a component go to review while it is within ``cap``, and only
    its edges beyond; suppressed pairs never do.
    """
    e, no = _ordered(edges), _ordered(suppressed)
    comp = written(components(e), "resolved")
    sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
    of = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    split = no.join(of("a"), "a").join(of("b"), "b").where("_a = _b").select(F.col("_a").alias("component")).distinct().withColumn("_split", F.lit(True))
    state = sizes.join(split, "component", "left").select("component", (F.col("size") > cap).alias("large"), F.coalesce("_split", F.lit(False)).alias("split"))
    groups = comp.join(state.where("not large and not split").select("component"), "component", "left_semi")
    small = _pairs_within(comp.join(state.where("not large and split").select("component"), "component", "left_semi"), "component", "node")
    real = e.join(of("a"), "a").join(state.where("large"), F.col("_a") == F.col("component"), "left_semi").select("a", "b")
    return groups, small.unionByName(real).join(no, ["a", "b"], "left_anti")


def review_pairs(identities: DataFrame, contacts: DataFrame, groups: DataFrame | None = None, suppressed: DataFrame | None = None) -> DataFrame:
    """Pairs a < b to ask about: mergeable identities of one name that share a contact value which stands under two names or
    more, unless both have the same known primary firm (these are a candidate group of their own), are one group of
    ``groups`` (node, component) already, or are suppressed. All pairs are given, however many carry a value.
    """
    named = contacts.where("value is not null and name_key is not null").groupBy("kind", "value").agg(F.countDistinct("name_key").alias("_names")).where("_names >= 2")
    of = identities.where("mergeable and name_key is not null").select("identity", "name_key", "primary_firm")
    c = contacts.where("value is not null").select("kind", "value", "identity").join(named, ["kind", "value"], "left_semi").join(of, "identity").distinct()
    left = c.select("kind", "value", "name_key", F.col("identity").alias("a"), F.col("primary_firm").alias("_fa"))
    right = c.select("kind", "value", "name_key", F.col("identity").alias("b"), F.col("primary_firm").alias("_fb"))
    out = left.join(right, ["kind", "value", "name_key"]).where("a < b and not coalesce(_fa = _fb, false)").select("a", "b").distinct()
    if groups is not None:
        of = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
        out = out.join(of("a"), "a", "left").join(of("b"), "b", "left").where("not coalesce(_a = _b, false)").select("a", "b")
    return out if suppressed is None else out.join(_ordered(suppressed), ["a", "b"], "left_anti")


def apply_components(groups: DataFrame, owners: DataFrame, bound: int = CAP) -> DataFrame:
    """Merges of owners from groups of identities (node, component) and their owners (identity, owner): rows (owner, survivor,
    applied). Owners that share a group are one component; its least owner survives, and it is applied only while it has at
    most ``bound`` owners."""
    j = groups.join(owners.select(F.col("identity").alias("node"), "owner"), "node").groupBy("component", "owner").agg(F.count("*").alias("_n"))
    least = j.groupBy("component").agg(F.min("owner").alias("a"))
    comp = written(components(j.join(least, "component").select("a", F.col("owner").alias("b"))), "owners")
    sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
    return comp.join(sizes, "component").where("node <> component").select(F.col("node").alias("owner"), F.col("component").alias("survivor"), (F.col("size") <= bound).alias("applied"))


def candidate_groups(identities: DataFrame) -> DataFrame:
    """Identities of one name and firm, two at least."""
    return identities.where("name_key is not null and firm is not null").groupBy("name_key", "firm").agg(F.count("*").alias("n"), F.min("identity").alias("first")).where("n >= 2")


def compatible(a: str, b: str):
    """Categories that may describe one property: equal ones, and houses with commercial ones."""
    x, y = F.col(a), F.col(b)
    return (x == y) | (x.isin("dum", "komercni") & y.isin("dum", "komercni"))


def block_links(df: DataFrame, key: str, id_: str) -> DataFrame:
    """A block's members tied to its least id: n - 1 links that make the block one component."""
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_).alias("a"))
    return df.join(least, key).where(F.col(id_) != F.col("a")).select("a", F.col(id_).alias("b"), key)


def block_pairs(df: DataFrame, key: str, id_: str) -> DataFrame:
    """Candidate pairs a < b: all pairs of a block."""
    return _pairs_within(df.where(F.col(key).isNotNull()).select(key, id_).distinct(), key, id_)


def unmerge_suppression(members: DataFrame) -> DataFrame:
    """All pairs a < b of a former group's identities (group, owner, identity) that belong to different owners now: suppressing
    them keeps the owners apart, whichever identities meet."""
    a, b = (members.where("owner is not null").select("group", F.col("owner").alias(f"_{c}"), F.col("identity").alias(c)) for c in ("a", "b"))
    return a.join(b, "group").where("a < b and _a <> _b").select("a", "b").distinct()


def ladder(candidates: DataFrame, margin: int = 5) -> DataFrame:
    """Location candidates (claim, unit, score): the best unit of each claim, whether it is ambiguous (another unit within
    ``margin``), and all candidates, best first."""
    best = candidates.groupBy("claim", "unit").agg(F.max("score").alias("score"))
    g = best.groupBy("claim").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "unit"))).alias("_c"))
    top = F.col("_c")[0]
    return g.select("claim", top["unit"].alias("unit"), (-top["s"]).alias("score"), F.coalesce((F.size("_c") > 1) & (F.try_element_at("_c", F.lit(2))["s"] - top["s"] < margin), F.lit(False)).alias("ambiguous"), F.transform("_c", lambda x: x["unit"]).alias("candidates"))


def survivorship(claims: DataFrame, policy: DataFrame, max_age: bool = True) -> DataFrame:
    """Claims (listing, field, source, method, value, age_days) against a policy (field, source_pattern, method_pattern, rank,
    max_age_days): the allowed value of least rank, then the youngest, then the least value, per listing and field."""
    p = policy.select(F.col("field").alias("_f"), "source_pattern", "method_pattern", "rank", "max_age_days")
    ok = (F.col("field") == F.col("_f")) & F.like("source", "source_pattern") & F.like("method", "method_pattern")
    if max_age:
        ok = ok & (F.col("max_age_days").isNull() | (F.col("age_days") <= F.col("max_age_days")))
    few = p.limit(10_001).count() <= 10_000  # a policy is a short table; one that isn't is not sent around
    j = claims.join(F.broadcast(p) if few else p, ok).where("value is not null")
    return j.groupBy("listing", "field").agg(F.min_by(F.struct("value", "source", "rank"), F.struct("rank", "age_days", "value", "source")).alias("_w")).select("listing", "field", "_w.*")
