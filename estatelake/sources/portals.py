"""Portals' adapters: a portal is declared by where its payload holds each fact; all give listings with one set of columns.

A payload is JSON, or a page with labelled facts, or a page with JSON in an attribute. Facts in JSON are read by path in
built-in functions. Pages go through the standard library's parser once, in Arrow batches, and become a map of labels to values;
from there on all is built-in functions again."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Elements that are never closed.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end where one of these begins.
ENDED = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "li": ("li",)}
#: Keys of the map that no label has: free text, and JSON found in the page.
FREE, EMBEDDED = "@text", "@json"
COLUMNS = {
    "price_czk": "long", "area_m2": "double", "usable_area": "double", "estate_area": "double", "garden_area": "double", "disposition": "string",
    "locality": "string", "lat": "double", "lng": "double", "floor": "int", "total_floors": "int", "building_type": "string", "condition": "string",
    "ownership": "string", "furnished": "string", "energy_rating": "string", "has_balcony": "boolean", "has_parking": "boolean", "has_lift": "boolean",
    "terrace": "boolean", "cellar": "boolean", "garage": "boolean", "parking_lots": "int",
}

#: Labels of facts on pages, folded, in order of preference.
LABELS = {
    "price_czk": ("cena",),
    "area_m2": ("uzitna plocha", "plocha uzitna", "podlahova plocha", "plocha podlahova", "celkova plocha", "plocha"),
    "usable_area": ("uzitna plocha", "plocha uzitna"),
    "estate_area": ("plocha pozemku", "plocha parcely", "vymera pozemku"),
    "garden_area": ("plocha zahrady",),
    "disposition": ("dispozice", "dispozice bytu"),
    "locality": ("lokalita",),
    "floor": ("cislo podlazi v dome", "podlazi", "patro", "cislo podlazi"),
    "total_floors": ("pocet podlazi budovy", "pocet podlazi objektu", "pocet podlazi v objektu", "pocet podlazi", "podlazi v dome"),
    "building_type": ("konstrukce budovy", "druh objektu", "konstrukce", "typ stavby", "stavba", "budova"),
    "condition": ("stav bytu", "stav domu", "stav objektu", "stav budovy", "stav nemovitosti"),
    "ownership": ("vlastnictvi",),
    "furnished": ("vybaveni", "vybaveni domu", "vybaveno"),
    "energy_rating": ("penb", "energeticka narocnost", "energeticka narocnost budovy"),
    "has_balcony": ("balkon", "balkony", "lodzie"),
    "has_parking": ("parkovani", "parkovaci stani", "garaz"),
    "has_lift": ("vytah",),
    "terrace": ("terasa",),
    "cellar": ("sklep",),
    "garage": ("garaz", "dvojgaraz"),
    "parking_lots": ("pocet parkovacich mist",),
}
#: Codes of listings' facts by a portal's words, folded.
BUILDINGS = {"panelova": "panel", "cihlova": "cihla", "zdena": "cihla", "smisena": "smisena", "skeletova": "skelet", "drevena": "drevo", "drevostavba": "drevo", "kamenna": "kamen", "montovana": "montovana", "nizkoenergeticka": "nizkoenergeticka"}
CONDITIONS = ("novostavba", "velmi_dobry", "dobry", "po_rekonstrukci", "pred_rekonstrukci", "ve_vystavbe", "projekt", "v_rekonstrukci", "spatny", "k_demolici")
CONDITION_WORDS = {"bezvadny": "velmi_dobry", "k_rekonstrukci": "pred_rekonstrukci", "rozestaveny": "ve_vystavbe", "v_puvodnim_stavu": "dobry"}
OWNERSHIPS = {"osobni": "osobni", "soukrome": "osobni", "druzstevni": "druzstevni", "statni": "statni", "obecni": "statni"}
#: Numbers and names that two interfaces use for the same codes.
FURNISHED_CODES, OWNERSHIP_CODES = {"1": "ano", "2": "ne", "3": "castecne"}, {"1": "osobni", "2": "druzstevni", "3": "statni"}
FURNISHED_NAMES, OWNERSHIP_NAMES = {"VYBAVENY": "ano", "NEVYBAVENY": "ne", "CASTECNE": "castecne"}, {"OSOBNI": "osobni", "DRUZSTEVNI": "druzstevni", "OBECNI": "statni"}
BUILDING_NAMES = {"BRICK": "cihla", "PANEL": "panel", "MIXED": "smisena", "SKELET": "skelet", "STONE": "kamen", "WOOD": "drevo", "PREFAB": "montovana"}
CONDITION_NAMES = {
    "VERY_GOOD": "velmi_dobry", "GOOD": "dobry", "BAD": "spatny", "CONSTRUCTION": "ve_vystavbe", "PROJECT": "projekt", "NEW": "novostavba", "DEMOLITION": "k_demolici",
    "BEFORE_RECONSTRUCTION": "pred_rekonstrukci", "AFTER_RECONSTRUCTION": "po_rekonstrukci", "AFTER_PARTIAL_RECONSTRUCTION": "po_rekonstrukci", "IN_RECONSTRUCTION": "v_rekonstrukci",
}
#: The box that coordinates must lie in.
LATITUDES, LONGITUDES = (48.0, 51.5), (12.0, 19.0)


@dataclass(frozen=True)
class Page:
    """A page of labelled facts. ``label`` and ``value`` are "tag" or "tag.class"; with ``row``, a row's first cell is the label
    and its last one the value. ``free`` names the elements of free text (title, description), from which area, disposition
    and floor are read where no label gives them. ``embedded``: an attribute that holds JSON; then facts are read by ``paths``.
    ``orders``: labels of columns that this portal prefers in another order."""

    label: str = ""
    value: str = ""
    row: str = ""
    free: tuple[str, ...] = ("h1",)
    embedded: str = ""
    orders: dict[str, tuple[str, ...]] = field(default_factory=dict)
    paths: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


class _Facts(HTMLParser):
    """Collects labelled facts of one page."""

    def __init__(self, page: Page) -> None:
        super().__init__(convert_charrefs=True)
        self.page, self.stack, self.open = page, [], []  # open: [what, depth, parts]
        self.cells: list[str] | None = None
        self.row_depth, self.label, self.found, self.free, self.json = 0, "", {}, [], []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        of, p = dict(attrs), self.page
        names = {tag, *(f"{tag}.{c}" for c in (of.get("class") or "").split())}
        if p.embedded and of.get(p.embedded):
            self.json.append(of[p.embedded])
        for cell in self.open:  # a tick or a cross stands for a word
            marks = " ".join(names)
            cell[2].append(" ano " if "icon--check" in marks else " ne " if any(f"icon--{m}" in marks for m in ("cross", "times", "close")) else "")
            cell[2].append(" " if tag in VOID else "")
        if tag in VOID:
            return
        while self.stack and self.stack[-1] in ENDED.get(tag, ()):
            self.handle_endtag(self.stack[-1])
        self.stack.append(tag)
        depth = len(self.stack)
        if p.row and p.row in names:
            self.cells, self.row_depth = [], depth
        elif p.row and self.cells is not None and p.value in names and not any(c[0] == "cell" for c in self.open):
            self.open.append(["cell", depth, []])
        elif not p.row and p.label and p.label in names:
            self.open.append(["label", depth, []])
        elif not p.row and p.value and p.value in names:
            self.open.append(["value", depth, []])
        if names & set(p.free):
            self.open.append(["free", depth, []])

    def handle_data(self, data: str) -> None:
        if self.open and not (self.stack and self.stack[-1] in ("script", "style")):
            for cell in self.open:
                cell[2].append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        while self.stack:
            closed = self.stack.pop()
            depth = len(self.stack) + 1
            for cell in [c for c in self.open if c[1] >= depth]:
                self.open.remove(cell)
                self._take(cell[0], " ".join("".join(cell[2]).split()))
            if self.cells is not None and depth <= self.row_depth:
                if len(self.cells) > 1:
                    self._fact(self.cells[0], self.cells[-1])
                self.cells = None
            if closed == tag:
                break

    def _take(self, what: str, said: str) -> None:
        if what == "cell":
            self.cells = [*(self.cells or []), said]
        elif what == "label":
            self.label = said
        elif what == "value":
            self._fact(self.label, said)
            self.label = ""
        elif said:
            self.free.append(said)

    def _fact(self, label: str, value: str) -> None:
        plain = "".join(c for c in unicodedata.normalize("NFKD", label.lower()) if not unicodedata.combining(c))
        key = " ".join(plain.split()).rstrip(": ")
        if key and value:
            self.found.setdefault(key, value)


def _embedded(found: list[str], native_id: str | None) -> str | None:
    """Of a page's JSON objects that of the listing itself, or else the largest."""
    known = []
    for raw in found:
        try:
            obj = json.loads(raw)
        except ValueError:
            continue
        if isinstance(obj, dict) and "id" in obj:
            if native_id is not None and str(obj["id"]) == native_id:
                return raw
            known.append(raw)
    return max(known, key=len, default=None)


def page_facts(html: str | None, page: Page, native_id: str | None = None) -> dict[str, str]:
    """Labels of one page, folded, and their values, the first of each; null and empty pages have none."""
    if not html:
        return {}
    p = _Facts(page)
    p.feed(html)
    p.close()
    if p.stack:
        p.handle_endtag(p.stack[0])  # what the page leaves open ends with it
    extra = {FREE: "\n".join(p.free) or None, EMBEDDED: _embedded(p.json, native_id)}
    return p.found | {k: v for k, v in extra.items() if v is not None}


def facts(pages: dict[str, Page]) -> Callable[[Column, Column, Column], Column]:
    """(source, payload, native id) to map<string, string>, empty for sources that have no page."""

    @F.pandas_udf("map<string,string>")
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, payloads, ids in batches:
            yield pd.Series([page_facts(h, pages[s], i) if s in pages else {} for s, h, i in zip(sources, payloads, ids, strict=True)], dtype=object)

    return read


# readers of a value's text


def coded(c: Column, table: dict[str, str]) -> Column:
    """The code that a table has for a value; others are null."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def _digits(c: Column) -> Column:
    """Digits without the blanks between thousands, of any kind and width."""
    return F.regexp_replace(c, r"[\s\p{Z}​⁠]", "")


def price(c: Column) -> Column:
    """The first amount; null for a price on request, a price per square metre, and what is beyond 32 bits."""
    amount = r"([0-9][0-9\s\p{Z}​⁠]*)"
    by_metre = c.rlike(rf"^[^0-9]*{amount}Kč\s*(/|za)\s*m")
    asked = text.fold(c).rlike("dohodou|vyzadani|poptavce|info o cene|neuvedena")
    value = _digits(F.regexp_extract(c, amount, 1)).try_cast("long")
    return F.when(~asked & ~by_metre & (value > 0) & (value <= 2**31 - 1), value)


def area(c: Column) -> Column:
    """Square metres: the first number with its unit."""
    number = r"(?<![0-9+.,])([0-9]{1,3}(?:[\s\p{Z}​⁠][0-9]{3})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?)\s*m\s*[2²]"
    return F.replace(_digits(F.regexp_extract(c, number, 1)), F.lit(","), F.lit(".")).try_cast("double")


def integer(c: Column) -> Column:
    return F.regexp_extract(c, "([0-9]+)", 1).try_cast("int")


def storey(c: Column) -> Column:
    """Words for a storey, "3./6." (the third of six), or a bare number."""
    bare = F.regexp_extract(c, r"^\s*(-?[0-9]+)\s*(?:[.]?\s*/.*)?$", 1).try_cast("int")
    return F.coalesce(text.floor_number(c), F.when(bare.between(text.FLOOR_LEAST, text.FLOOR_MOST), bare))


def disposition(c: Column) -> Column:
    found = F.lower(F.regexp_replace(F.regexp_extract(c, r"(?i)\b([0-9]\s*\+\s*(?:kk|[0-9]))\b", 1), r"\s", ""))
    return F.nullif(found, F.lit(""))


def said(c: Column) -> Column:
    """An amenity's value: no where it begins with "ne", yes for any other; null where there is no such label."""
    return F.when(F.length(F.trim(c)) > 0, ~text.fold(c).startswith("ne"))


def building(c: Column) -> Column:
    folded = text.fold(c)
    return F.coalesce(coded(folded, BUILDINGS), F.when(folded.isin(*dict.fromkeys(BUILDINGS.values())), folded))


def condition(c: Column) -> Column:
    """A code of the fixed list; a sale's state in its place ("prodano") and other words are null."""
    key = F.replace(F.regexp_replace(text.fold(c), r" stav$", ""), F.lit(" "), F.lit("_"))
    key = F.coalesce(coded(key, CONDITION_WORDS), key)
    return F.when(key.isin(*CONDITIONS), key)


def furnished(c: Column) -> Column:
    t = text.fold(c)
    no = t.contains("nezar") | t.contains("neza") | t.contains("nevyb") | (t == "ne")
    return F.when(no, "ne").when(t.contains("castec"), "castecne").when(t.contains("zariz") | t.contains("vybav") | t.startswith("ano"), "ano")


def energy(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\b([A-G])\b", 1), F.lit(""))


READERS: dict[str, Callable[[Column], Column]] = {
    "price_czk": price, "area_m2": area, "usable_area": area, "estate_area": area, "garden_area": area, "disposition": disposition,
    "locality": text.collapse, "floor": storey, "total_floors": integer, "building_type": building, "condition": condition,
    "ownership": lambda c: coded(text.fold(c), OWNERSHIPS), "furnished": furnished, "energy_rating": energy, "has_balcony": said, "has_parking": said,
    "has_lift": said, "terrace": said, "cellar": said, "garage": said, "parking_lots": integer,
}

# readers of JSON


def at(*paths: str) -> Callable[[Column], Column]:
    """The first of the paths that holds something, as text."""
    return lambda j: F.coalesce(*[F.nullif(F.trim(F.get_json_object(j, p)), F.lit("")) for p in paths])


def number(*paths: str) -> Callable[[Column], Column]:
    """The first number above zero."""
    read = lambda j, p: F.replace(F.get_json_object(j, p), F.lit(","), F.lit(".")).try_cast("double")
    return lambda j: F.coalesce(*[F.when(read(j, p) > 0, read(j, p)) for p in paths], F.lit(None))


def whole(path: str, least: int | None = None) -> Callable[[Column], Column]:
    def read(j: Column) -> Column:
        v = F.get_json_object(j, path).try_cast("double").cast("int")
        return v if least is None else F.when(v >= least, v)

    return read


def flag(*paths: str) -> Callable[[Column], Column]:
    """Whether any of the paths holds something that isn't false, zero or empty; null where none is there."""
    one = lambda j, p: ~F.lower(F.get_json_object(j, p)).isin("false", "0", "0.0", "", "[]", "{}")
    known = lambda j: reduce(lambda a, b: a | b, [F.get_json_object(j, p).isNotNull() for p in paths])
    return lambda j: F.when(known(j), reduce(lambda a, b: a | b, [F.coalesce(one(j, p), F.lit(False)) for p in paths]))


def place(path: str, bounds: tuple[float, float]) -> Callable[[Column], Column]:
    v = lambda j: F.get_json_object(j, path).try_cast("double")
    return lambda j: F.when(v(j).between(*bounds), v(j))


def joined(first: str, second: str) -> Callable[[Column], Column]:
    """'town - quarter', or the one that is there, or the one that both are."""
    a, b = at(first), at(second)
    return lambda j: F.nullif(F.array_join(F.array_distinct(F.array_compact(F.array(a(j), b(j)))), " - "), F.lit(""))


def then(read: Callable[[Column], Column], reader: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda j: reader(read(j))


def _listed(*words: str) -> Callable[[Column], Column]:
    """Whether the list of accessories names one of the words; null where it doesn't."""
    names = lambda j: F.from_json(F.get_json_object(j, "$.accessories"), "array<struct<name: string>>")
    return lambda j: F.when(F.exists(names(j), lambda a: reduce(lambda x, y: x | y, [text.fold(a["name"]).contains(w) for w in words])), True)


#: An interface whose enumerations are {name, value} objects with numbers.
CODES = {
    "price_czk": lambda j: number("$.price_summary_czk", "$.price_czk")(j).cast("long"), "area_m2": number("$.usable_area"), "usable_area": number("$.usable_area"),
    "estate_area": number("$.estate_area"), "garden_area": number("$.garden_area"),
    "disposition": lambda j: F.coalesce(disposition(at("$.category_sub_cb.name")(j)), disposition(at("$.advert_name")(j))),
    "locality": joined("$.locality.city", "$.locality.citypart"), "lat": place("$.locality.gps_lat", (-90.0, 90.0)), "lng": place("$.locality.gps_lon", (-180.0, 180.0)),
    "floor": whole("$.floor_number"), "total_floors": whole("$.floors"), "building_type": then(at("$.building_type.name"), building),
    "condition": then(at("$.building_condition.name"), condition), "ownership": lambda j: coded(at("$.ownership.value")(j), OWNERSHIP_CODES),
    "furnished": lambda j: coded(at("$.furnished.value")(j), FURNISHED_CODES), "energy_rating": then(at("$.energy_efficiency_rating_cb.name"), energy),
    "has_balcony": flag("$.balcony", "$.terrace", "$.loggia"), "has_parking": flag("$.parking_lots", "$.garage", "$.parking"),
    "has_lift": lambda j: F.when(at("$.elevator.value")(j) != "0", F.when(text.fold(at("$.elevator.name")(j)).startswith("ano"), True).when(text.fold(at("$.elevator.name")(j)).startswith("ne"), False)),
    "terrace": flag("$.terrace"), "cellar": flag("$.cellar"), "garage": flag("$.garage"), "parking_lots": whole("$.parking"),
}
#: An interface whose enumerations are names, and whose zero says that nothing was given.
NAMES = {
    "price_czk": lambda j: number("$.price")(j).cast("long"), "area_m2": number("$.surface"), "usable_area": number("$.surface"), "estate_area": number("$.surfaceLand"),
    "garden_area": number("$.frontGarden"),
    "disposition": lambda j: F.when(at("$.disposition")(j) == "GARSONIERA", "1+kk").otherwise(F.nullif(F.regexp_replace(F.regexp_replace(F.regexp_extract(at("$.disposition")(j), "^DISP_([0-9]_(KK|1|IZB))$", 1), "_KK$", "+kk"), "_(1|IZB)$", "+1"), F.lit(""))),
    "locality": joined("$.city", "$.cityDistrict"), "lat": place("$.gps.lat", (-90.0, 90.0)), "lng": place("$.gps.lng", (-180.0, 180.0)),
    "floor": lambda j: F.when(whole("$.etage")(j) != 0, whole("$.etage")(j)), "total_floors": whole("$.totalFloors", 1), "building_type": lambda j: coded(at("$.construction")(j), BUILDING_NAMES),
    "condition": lambda j: coded(at("$.condition")(j), CONDITION_NAMES), "ownership": lambda j: coded(at("$.ownership")(j), OWNERSHIP_NAMES),
    "furnished": lambda j: coded(at("$.equipped")(j), FURNISHED_NAMES), "energy_rating": lambda j: F.when(at("$.penb")(j).rlike("^[A-G]$"), at("$.penb")(j)),
    "has_balcony": flag("$.balconySurface", "$.terraceSurface", "$.loggiaSurface"), "has_parking": lambda j: F.coalesce(flag("$.parking", "$.garage")(j), F.lit(False)),
    "has_lift": flag("$.lift"), "terrace": flag("$.terraceSurface"), "cellar": flag("$.cellarSurface"), "garage": flag("$.garage"),
}
#: An object in an attribute of the page, whose enumerations are {name} objects in words.
OBJECT = {
    "price_czk": lambda j: number("$.price")(j).cast("long"), "area_m2": number("$.totalArea", "$.usableArea"), "usable_area": number("$.usableArea"), "estate_area": number("$.landArea", "$.plotArea"),
    "garden_area": number("$.gardenArea"), "disposition": lambda j: F.coalesce(disposition(at("$.type.name")(j)), disposition(at("$.title")(j))), "locality": at("$.city", "$.district"),
    "lat": place("$.point.latitude", LATITUDES), "lng": place("$.point.longitude", LONGITUDES), "floor": whole("$.floor"),
    "total_floors": lambda j: F.when(at("$.overgroundFloors", "$.undergroundFloors")(j).isNotNull(), F.coalesce(whole("$.overgroundFloors")(j), F.lit(0)) + F.coalesce(whole("$.undergroundFloors")(j), F.lit(0))),
    "building_type": lambda j: F.coalesce(building(at("$.construction.name")(j)), F.when(text.fold(at("$.construction.name")(j)) == "cihla", "cihla")),
    "condition": then(at("$.condition.name"), condition), "ownership": lambda j: coded(text.fold(at("$.ownership.name")(j)), OWNERSHIPS), "energy_rating": then(at("$.energyClassification.code"), energy),
    "has_balcony": _listed("balkon", "lodzie"), "has_parking": lambda j: F.coalesce(F.when(whole("$.parkingPlaces", 1)(j).isNotNull(), True), _listed("parkov", "garaz")(j)),
    "has_lift": flag("$.lift"), "terrace": _listed("terasa"), "cellar": lambda j: F.coalesce(flag("$.cellar")(j), _listed("sklep")(j)), "garage": _listed("garaz"), "parking_lots": whole("$.parkingPlaces"),
}

#: The nine shapes that payloads come in, by a name of their own; a portal's name is the caller's.
SHAPES: dict[str, Page | dict] = {
    "codes": CODES,
    "names": NAMES,
    "object": Page(embedded=":property", paths=OBJECT),
    "definitions": Page("dt", "dd"),
    "divisions": Page("div.pd-detail-info__label", "div.pd-detail-info__value"),
    "items": Page("span", "span", row="li.detail-information__data-item", orders={"area_m2": ("celkova podlahova plocha", "uzitna plocha", "podlahova plocha", "plocha")}),
    "spans": Page("span.i-info__title", "span.i-info__value", orders={"floor": ("patro", "podlazi")}),
    "headed": Page("th.slider_label", "td.slider_value", orders={"area_m2": ("plocha uzitna", "uzitna plocha", "plocha podlahova", "podlahova plocha")}),
    "advert": Page("td", "td", row="tr", free=("h1.nadpisdetail", "div.popisdetail")),
}


def listings(df: DataFrame, source: str, payload: str, native_id: str, portals: dict[str, str]) -> DataFrame:
    """Rows with COLUMNS added, in place of the payload, read as the shape of SHAPES that ``portals`` names for their source. What
    isn't there or can't be read is null, and so is all of an unknown source, an empty payload or broken JSON. One scan for
    all portals; only pages are sent to Python. Columns of ``df`` that clash with COLUMNS give way to what is read."""
    pages = {p: SHAPES[s] for p, s in portals.items() if isinstance(SHAPES[s], Page)}
    of, raw = F.col(source), F.col(payload)
    seen = df.withColumn("_facts", facts(pages)(of, F.when(of.isin(*pages), raw), F.col(native_id).cast("string"))) if pages else df.withColumn("_facts", F.lit(None).cast("map<string,string>"))
    label = lambda names: F.coalesce(*[F.col("_facts")[n] for n in names])

    by_label = [p for p, page in pages.items() if not page.paths]

    def from_page(column: str) -> Column:
        """Each portal's order of labels picks the text, which is read once."""
        picked = F.when(F.lit(False), F.lit(None).cast("string"))
        for portal in by_label:
            if column in pages[portal].orders:
                picked = picked.when(of == portal, label(pages[portal].orders[column]))
        read = READERS[column](picked.otherwise(label(LABELS[column])))
        free = {"area_m2": area, "disposition": disposition, "floor": text.floor_number}.get(column)
        return F.coalesce(read, free(label((FREE,)))) if free else read

    out = []
    for column, kind in COLUMNS.items():
        chain = F.when(F.lit(False), F.lit(None).cast(kind))
        for portal, shape in portals.items():
            rules, j = (SHAPES[shape].paths, label((EMBEDDED,))) if portal in pages else (SHAPES[shape], raw)
            if column in rules:
                chain = chain.when(of == portal, rules[column](j).cast(kind))
        if by_label and column in READERS:
            chain = chain.when(of.isin(*by_label), from_page(column).cast(kind))
        out.append(chain.alias(column))
    kept = [c for c in df.columns if c != payload and c not in COLUMNS]
    return seen.select(*kept, *out)

