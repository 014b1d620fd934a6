"""Edge cases on small frames."""

import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from estatelake.functions import axes, geo, text, values
from estatelake.operators import attribution, clustering, filters, golden, history, paging, quality, resolution, series, spatial, stats
from estatelake.sources import drain, portals, readers, shapes

AS_OF = datetime(2024, 1, 31)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_distribution_suppresses_percentiles_of_small_groups(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(4)] + [("b", 5.0)] * 6 + [("c", None)], "k string, v double")
    got = {r["k"]: r for r in stats.distribution(df, "v", ["k"]).collect()}
    assert got["a"]["p25"] is None and got["a"]["median"] == 1.5
    assert got["b"]["iqr"] == 0.0 and got["c"]["n"] == 0 and got["c"]["median"] is None


def test_zero_spread_flags_every_other_value_unless_spread_is_needed(spark):
    df = spark.createDataFrame([("a", 5.0)] * 9 + [("a", 6.0)], "k string, v double")
    assert stats.outliers(df, "v", ["k"]).count() == 1
    assert stats.outliers(df, "v", ["k"], need_spread=True).count() == 0


@pytest.mark.parametrize(
    ("prices", "pattern"),
    [([5.0], "stable"), ([5.0, 5.0], "stable"), ([5.0, 4.0], "single_drop"), ([5.0, 4.0, 3.0], "stairstep_dropping"), ([1.0, 2.0], "rising"), ([1.0, 2.0, 1.0], "volatile"), ([5.0, None, 4.0], "single_drop"), ([None, None], "stable")],
)
def test_patterns(spark, prices, pattern):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(prices)], "k int, t int, p double")
    assert history.patterns(df, "p", ["k"], ["t"]).first()["pattern"] == pattern


def test_series_of_exactly_twelve_months_has_growth_and_a_shorter_one_none(spark):
    df = spark.createDataFrame([(1, 2020, 1, 100.0, 5), (1, 2021, 1, 110.0, 4), (2, 2020, 1, 1.0, 1), (2, 2020, 12, 2.0, 1), (3, 2020, 5, 7.0, 1)], "k int, year int, month int, price double, active_count int")
    got = {r["k"]: (r["months"], r["cagr_pct"], r["min_active"]) for r in series.growth(df, ["k"]).collect()}
    assert got == {1: (12, 10.0, 4), 2: (11, None, 1), 3: (0, None, 1)}


def test_filters_unknown_ids_nulls_and_surfaces(spark):
    df = spark.createDataFrame([(1, "ano", None), (2, None, 5), (3, "other", 7)], "id int, furnished string, x int")
    assert rows(df.where(filters.unknown_or("furnished", [filters.UNKNOWN], filters.CANONICAL["furnished"])).select("id")) == [(2,), (3,)]
    assert rows(df.where(filters.exclude_ids("x", [5])).select("id")) == [(1,), (3,)]
    with pytest.raises(ValueError):
        filters.compile_filters({"nothing": 1}, AS_OF)
    with pytest.raises(ValueError):
        filters.compile_filters({"radius_m": 5}, AS_OF, surface="browse")
    assert len(filters.REGISTRY) >= 77 and '"lifecycle"' in filters.json_schema("velocity") and '"lifecycle"' not in filters.json_schema("browse")
    assert rows(df.where(filters.compile_filters({"portals": [], "min_area_m2": None}, AS_OF)).select("id")) == [(1,), (2,), (3,)]


def test_disposition_groups(spark):
    df = spark.createDataFrame([(d,) for d in ("2+kk", "2+1", "3+1", "atyp")], "disposition string")
    assert df.where(filters.disposition("2+kk", "loose")).count() == 2
    assert df.where(filters.disposition("atyp", "loose")).count() == 1
    assert filters.disposition("2+kk", "any") is None


def test_keyset_pages_cover_everything_once_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i % 3)) for i in range(23)], "id int, p double")
    for desc in (True, False):
        order, last, seen = [("p", desc), ("id", False)], None, []
        while got := paging.page(df, order, 5, last).collect():
            seen += [r["id"] for r in got]
            last = [got[-1]["p"], got[-1]["id"]]
        assert sorted(seen) == list(range(23)) and len(seen) == 23
    assert paging.from_cursor(paging.cursor([None, 3])) == [None, 3]


def test_merge_chain_of_many_steps(spark):
    m = spark.createDataFrame([(i + 1, i) for i in range(18)], "merged_id int, into_id int")
    assert {r["survivor"] for r in golden.merge_chain(m).collect()} == {0}


def test_components_paths_stars_and_nothing(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)], "a long, b long")
    got = {r["node"]: r["component"] for r in resolution.components(e).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(31)} == {100}
    assert resolution.components(e.limit(0)).count() == 0


def test_component_of_twenty_merges_and_of_twenty_one_goes_to_review(spark):
    e = spark.createDataFrame([(0, i) for i in range(1, 20)] + [(100, 100 + i) for i in range(1, 21)], "a long, b long")
    groups, review = resolution.resolve(e, e.limit(0))
    assert {r["component"] for r in groups.collect()} == {0} and review.count() == 20
    groups, review = resolution.resolve(e.where("a = 0"), spark.createDataFrame([(0, 5)], "a long, b long"))
    # a barred component within the cap: all its pairs but the suppressed one, not its edges alone
    assert groups.count() == 0 and review.count() == 20 * 19 // 2 - 1
    chain = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert rows(resolution.resolve(chain, spark.createDataFrame([(1, 3)], "a long, b long"))[1]) == [(1, 2), (2, 3)]


def test_review_pairs_of_the_residue(spark):
    people = [(i, "jan novak", i % 2 == 0 and 7 or None, True) for i in range(1, 26)] + [(30, "petr maly", 1, True), (31, "jan novak", 7, False), (32, None, None, True)]
    identities = spark.createDataFrame(people, "identity long, name_key string, primary_firm long, mergeable boolean")
    contacts = spark.createDataFrame([(i, "phone", "777", n) for i, n, _, _ in people], "identity long, kind string, value string, name_key string")
    got = set(rows(resolution.review_pairs(identities, contacts)))
    # 25 carriers of an ambiguous value: all pairs but those of one known firm; none across names, none that can't merge
    want = {(a, b) for a in range(1, 26) for b in range(a + 1, 26) if a % 2 or b % 2}
    assert got == want
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node long, component long")
    fewer = set(rows(resolution.review_pairs(identities, contacts, groups, spark.createDataFrame([(5, 4)], "a long, b long"))))
    assert fewer == want - {(1, 2), (4, 5)}
    alone = contacts.where("identity <= 25")  # a value under one name is no question
    assert resolution.review_pairs(identities, alone).count() == 0


def test_unmerge_keeps_all_pairs_of_owners_apart(spark):
    m = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, "y", 3), (1, "y", 4), (2, "x", 9), (1, None, 5)], "group int, owner string, identity int")
    assert rows(resolution.unmerge_suppression(m)) == [(1, 3), (1, 4), (2, 3), (2, 4)]
    assert rows(resolution.block_pairs(spark.createDataFrame([("k", 1), ("k", 2), ("k", 3), (None, 4)], "key string, id int"), "key", "id")) == [(1, 2), (1, 3), (2, 3)]


def test_owners_of_merged_groups_within_a_bound(spark):
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)], "node long, component long")
    owners = spark.createDataFrame([(1, 10), (2, 11), (3, 11), (4, 12), (5, 20), (6, 21)], "identity long, owner long")
    assert rows(resolution.apply_components(groups, owners, 2)) == [(11, 10, False), (12, 10, False), (21, 20, True)]


def test_house_numbers_floors_and_dates_in_free_text(spark):
    numbers = {"128/40a": ("128", "40", "a", None), "č.p. 12": ("12", None, None, None), "ev. č. 12": (None, None, None, "12"), "č. ev. 7": (None, None, None, "7"), "EVIDENČNÍ ČÍSLO 33": (None, None, None, "33"), "e.č. 5": (None, None, None, "5"), "5, ev. 6": ("5", None, None, "6"), "": (None,) * 4}
    df = spark.createDataFrame([(k,) for k in numbers], "s string")
    got = {r["s"]: tuple(r["n"]) for r in df.select("s", text.house_number("s").alias("n")).collect()}
    assert got == numbers
    floors = {"ve 3. patře": 3, "Přízemí": 0, "1. podzemní podlaží": -1, "2. nadzemního podlaží": 1, "12.NP": 11, "suterén domu": -1, "100. NP": None, "patro": None}
    df = spark.createDataFrame([(k,) for k in floors], "s string")
    assert {r["s"]: r["f"] for r in df.select("s", text.floor_number("s").alias("f")).collect()} == floors
    streets = {"MasarykovaNabízíme 12": "Masarykova Nabízíme", "Jesenická": "Jesenická", "ul. Krátká 5/3b": "Krátká", " (Hlavní), ": "Hlavní", "": None, "Dlouhá byt": "Dlouhá"}
    df = spark.createDataFrame([(k,) for k in streets], "s string")
    assert {r["s"]: r["f"] for r in df.select("s", text.clean_street("s", ("ul", "ulice"), ("byt",)).alias("f")).collect()} == streets
    places = {"Hlavní 5, Brno": "Hlavní", "Brno 5 - Líšeň": None, "Brno": None, "Krátká, Praha": "Krátká"}
    df = spark.createDataFrame([(k,) for k in places], "s string")
    assert {r["s"]: r["f"] for r in df.select("s", text.street_of_locality("s", F.lit("Brno")).alias("f")).collect()} == places


def test_radius_join_near_the_pole_and_across_the_date_line(spark):
    import math
    import random as random_

    rng = random_.Random(4)
    pts = [(i, rng.choice([rng.uniform(78, 84), rng.uniform(-70, 70)]), rng.choice([rng.uniform(179.5, 180), rng.uniform(-180, -179.5)])) for i in range(120)]
    a = spark.createDataFrame(pts, "id int, lat double, lng double")
    b = a.select(F.col("id").alias("rid"), F.col("lat").alias("rlat"), F.col("lng").alias("rlng"))

    def metres(p, q):
        h = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371008.8 * math.asin(min(1, math.sqrt(h)))

    got = sorted((r["id"], r["rid"]) for r in spatial.radius_join(a, b, 60_000).collect())
    assert got == sorted((p[0], q[0]) for p in pts for q in pts if metres(p, q) <= 60_000)
    far = spatial.nearest(spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "id int, lat double, lng double"), spark.createDataFrame([(7, 1.0, 179.0)], "rid int, rlat double, rlng double"))
    assert [r["nearest_id"] for r in far.collect()] == [7, 7]


def test_merge_chain_stops_at_its_depth(spark):
    m = spark.createDataFrame([(i + 1, i) for i in range(40)], "merged_id int, into_id int")
    got = {r["node"]: r["survivor"] for r in golden.merge_chain(m, depth=20).collect()}
    assert got == {i: max(0, i - 20) for i in range(1, 41)}


def test_names_and_streets(spark):
    names = spark.createDataFrame([("Ing. Jan Novák", "Novák Jan"), ("J. Novák", "Jan Novák"), ("Petr Malý", "Jan Novák"), (None, "x"), ("Ing.", "Ing.")], "a string, b string")
    assert [r[0] for r in names.select(text.same_person("a", "b")).collect()] == ["same", "unknown", "different", "unknown", "unknown"]
    keys = [r[0] for r in names.select(text.person_key("a")).collect()]
    assert keys[0] == "jan novak" and keys[3] is None and keys[4] is None
    streets = spark.createDataFrame([("ul. Koterovská 12",), ("Náměstí",), (None,)], "s string")
    assert [r[0] for r in streets.select(text.street_key("s")).collect()] == ["koterovska", "namesti", None]
    sim = spark.createDataFrame([("Praha", "Praha"), ("Praha", "Brno"), ("", "")], "a string, b string").select(text.trigram_similarity("a", "b"))
    got = [r[0] for r in sim.collect()]
    assert got[0] == 1.0 and got[1] < 0.2 and got[2] == 0.0


def test_price_changed_nulls_and_zero(spark):
    df = spark.createDataFrame([(None, None), (None, 1.0), (0.0, 0.0), (0.0, 1.0), (100.0, 101.0), (100.0, 105.0)], "a double, b double")
    assert [r[0] for r in df.select(values.price_changed(F.col("a"), F.col("b"), 2.0)).collect()] == [False, True, False, True, False, True]


def test_points_on_cell_borders_are_found(spark):
    a = spark.createDataFrame([(i, 49.0 + i * 0.01, 14.0) for i in range(20)], "id int, lat double, lng double")
    b = a.select(F.col("id").alias("rid"), F.col("lat").alias("rlat"), F.col("lng").alias("rlng"))
    got = {(r["id"], r["rid"]) for r in spatial.radius_join(a, b, 1200).collect()}
    assert got == {(i, j) for i in range(20) for j in range(20) if abs(i - j) <= 1}


def test_upsert_preserves_and_sets_once(spark):
    cur = spark.createDataFrame([(1, "a", 1, 10)], "k int, street string, seq int, price int")
    new = spark.createDataFrame([(1, None, 2, None), (2, "b", 3, 20)], "k int, street string, seq int, price int")
    assert rows(golden.upsert(cur, new, ["k"], ["street"], ["seq"])) == [(1, "a", 1, None), (2, "b", 3, 20)]


def test_load_assertions(spark):
    now, before = (spark.createDataFrame(list(d.items()), "name string, n long") for d in ({"a": 50, "c": 9000, "d": 101, "e": 1}, {"a": 1000, "b": 1, "c": 100, "d": 100}))
    got = {r["name"]: r["verdict"] for r in quality.load_assertions(now, before).collect()}
    assert got == {"a": "shrunk", "b": "missing", "c": "grown", "d": "ok", "e": "new"}


def test_majority_votes_and_leases(spark):
    votes = spark.createDataFrame([("h", "x"), ("h", "y"), ("h", "y"), ("g", "b"), ("g", "a"), ("g", None)], "head string, vote string")
    assert rows(clustering.majority(votes, ["head"], "vote")) == [("g", "a", 1), ("h", "y", 2)]
    with pytest.raises(ValueError):
        golden.update_from(votes, votes, ["head"], ["vote"])


def test_registry_csv_checks_its_header(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("kod;nazev\n1;Žďár\n2;\n".encode("cp1250"))
    got = readers.registry_csv(spark, str(tmp_path / "r.csv"), "kod int, nazev string")
    assert rows(got.fillna("-")) == [(1, "Žďár"), (2, "-")]
    with pytest.raises(ValueError):
        readers.registry_csv(spark, str(tmp_path / "r.csv"), "kod int, other string")


def test_workbook_reader_finds_its_header():
    buffer = io.BytesIO()
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="inlineStr"><is><t>title</t></is></c></row><row><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="C2" t="s"><v>2</v></c></row><row><c r="A3"><v>5</v></c><c r="C3"><v>7.5</v></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>code</t></si><si><t>name</t></si><si><t>rent</t></si></sst>'
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/sharedStrings.xml", shared)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    assert readers.rent_map_workbook(buffer.getvalue()) == [{"code": "5", "name": "", "rent": "7.5"}]


def test_change_feed_and_staging(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<r><unit><code>1</code><name>a</name></unit><unit><code>2</code><name>b</name></unit></r>")
    df = readers.change_feed(spark, str(tmp_path / "feed.xml"), "unit", "code int, name string")
    readers.stage(df, str(tmp_path / "out"))
    readers.stage(df, str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(1, "a"), (2, "b")]


def test_queries_without_sql_cover_whole_tables(spark):
    from estatelake import plans

    sf = "/root/testdata/sf0.01"
    q = plans.queries()
    parts, vectors = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("part", "embeddings"))
    assert q["x09_trigram"](spark, sf).count() == parts.count()
    assert q["a55_greedy_phrases"](spark, sf).agg({"count": "sum"}).first()[0] == parts.count()
    got = {r["label"] for r in q["x20_zero_shot"](spark, sf).select("label").distinct().collect()}
    assert got - {r["label"] for r in vectors.where("label < 5").select("label").distinct().collect()}


@pytest.mark.parametrize("n", [0, 1, 5, 400])
def test_global_percentiles_equal_numpy(spark, n):
    import numpy as np

    v = np.round(np.random.default_rng(n).normal(size=n) * 20) / 2  # many ties
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double").repartition(3)
    got = stats.global_points(df, {"x": F.col("v"), "none": F.lit(None), "y": -F.col("v")}, (0.0, 0.1, 0.37, 0.5, 1.0))
    assert got["none"] == [None] * 5
    for name, sign in (("x", 1), ("y", -1)):
        assert got[name] == ([None] * 5 if not n else pytest.approx(np.percentile(sign * v, [0, 10, 37, 50, 100]).tolist()))


def test_positions_and_quartiles_equal_a_plain_sort(spark):
    import random as random_

    rng = random_.Random(2)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, 3.0]), i) for i in range(211)]
    df = spark.createDataFrame(data, "k string, price double, id int").repartition(4)
    got = {r["id"]: (r["_position"], r["_size"]) for r in paging.positions(df, ["k"], ["price", "id"]).collect()}
    for k in ("a", "b", None):
        mine = sorted((x for x in data if x[0] == k), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert [got[x[2]] for x in mine] == [(i + 1, len(mine)) for i in range(len(mine))]
    want = df.selectExpr("id", "ntile(4) over (partition by k order by price, id) as band")
    q = paging.stratified_sample(df, ["k"], "price", "id", "s", 10_000)
    assert rows(q.select("id", "band")) == rows(want)


def test_national_grid_and_back(spark):
    known = spark.createDataFrame([(744384.54, 1042569.73)], "y double, x double")
    for y, x in (("y", "x"), ("-y", "-x")):
        p = known.select(geo.grid_to_wgs84(F.expr(y), F.expr(x)).alias("p")).first()["p"]
        assert abs(p["lat"] - 50.089480) * 111_000 < 5 and abs(p["lng"] - 14.398606) * 71_000 < 5
    wrong = spark.createDataFrame([(1042569.73, 744384.54), (744384.54, -1042569.73), (1.0, 2.0), (None, 1e6), (500_000.0, 940_000.0)], "y double, x double")
    assert [r["p"] is None for r in wrong.select(geo.grid_to_wgs84(F.col("y"), F.col("x")).alias("p")).collect()][:4] == [True] * 4
    places = spark.createDataFrame([(48.6, 16.9), (50.1, 12.5), (49.8, 18.5), (51.0, 15.0), (60.0, 15.0)], "lat double, lng double")
    g = places.select("lat", "lng", geo.wgs84_to_grid(F.col("lat"), F.col("lng")).alias("g"))
    for r in g.select("lat", "lng", "g", geo.grid_to_wgs84(F.col("g.y"), F.col("g.x")).alias("p")).collect():
        if r["lat"] > 51.5:
            assert r["g"] is None and r["p"] is None
        else:
            assert abs(r["p"]["lat"] - r["lat"]) * 111_000 < 1 and abs(r["p"]["lng"] - r["lng"]) * 71_000 < 1


def _shapefile(shapes, names):
    import struct

    body = b""
    for i, rings in enumerate(shapes):
        if rings is None:
            rec = struct.pack("<i", 0)
        else:
            pts = [p for r in rings for p in r]
            starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
            rec = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(pts)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        body += struct.pack(">2i", i + 1, len(rec) // 2) + rec
    fields = [(b"KOD", 8), (b"NAZEV", 12)]
    head = struct.pack("<4BIHH20x", 3, 1, 1, 1, len(names), 32 + 32 * len(fields) + 1, 1 + sum(n for _, n in fields))
    head += b"".join(n.ljust(11, b"\0") + b"C" + bytes(4) + bytes([size]) + bytes(15) for n, size in fields) + b"\r"
    return bytes(100) + body, head + b"".join(b" " + c.encode().ljust(8) + n.encode("cp1250").ljust(12) for c, n in names)


def test_shapefile_layer_with_broken_records(spark, tmp_path):
    square = [(-744000.0, -1042000.0), (-743000.0, -1042000.0), (-743000.0, -1043000.0), (-744000.0, -1042000.0)]
    hole = [(-743500.0, -1042300.0), (-743400.0, -1042300.0), (-743400.0, -1042400.0), (-743500.0, -1042300.0)]
    shp, dbf = _shapefile([[square, hole], None, [square], [square]], [("11", "Žďár"), ("12", "none"), ("x", "no code"), ("14", "")])
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "OBCE_P.shp").write_bytes(shp)
    (tmp_path / "a" / "OBCE_P.dbf").write_bytes(dbf)
    (tmp_path / "OBCE_small.shp").write_bytes(bytes(100))
    got = shapes.read_layer(spark, str(tmp_path), "obce")
    assert rows(got.select("code", "name", F.size("rings"), "usable").where("code is not null")) == [(11, "Žďár", 2, True), (12, "none", 0, False), (14, "14", 1, True)]
    assert got.where("code is null").count() == 1
    turned = shapes.in_degrees(got).where("code = 11").first()
    assert turned["usable"] and abs(turned["rings"][0][0]["lat"] - 50.09) < 0.02 and abs(turned["rings"][0][0]["lng"] - 14.4) < 0.02


def test_portals_pages_give_first_labels_ticks_free_text_and_survive_anything():
    page = portals.SHAPES["definitions"]
    html = "<dl><dt><a>Výtah</a>:</dt><dd><i class='icon icon--check'></i></dd><dt>Sklep</dt><dd><span class='icon icon--cross'></span><dt>Cena</dt><dd>1&nbsp;000&nbsp;Kč<br>dohoda</dd><dt>Cena</dt><dd>2</dd><script>x</script>"
    assert portals.page_facts(html, page) == {"vytah": "ano", "sklep": "ne", "cena": "1 000 Kč dohoda"}
    assert portals.page_facts(None, page) == portals.page_facts("", page) == {}
    assert portals.page_facts("<dt>a<dd>b</p></x><dl>", page) == {"a": "b"}
    assert portals.page_facts("<div>" * 20_000 + "<dt>a</dt><dd>b</dd>", page) == {"a": "b"}
    advert = portals.page_facts("<h1 class='nadpisdetail'>Byt 2 + kk</h1><table><tr><td>Lokalita:</td><td><img></td><td><b>110 00</b> Praha</td></tr><tr><td>alone</td></tr></table>", portals.SHAPES["advert"])
    assert advert == {"lokalita": "110 00 Praha", portals.FREE: "Byt 2 + kk"}
    two = """<a :property='{"id": 7, "price": 1}'></a><a :property='{"id": 8, "price": 2, "title": "longer"}'></a><a :property='{broken'></a>"""
    facts = [portals.page_facts(two, portals.SHAPES["object"], i)[portals.EMBEDDED] for i in ("7", "nobody")]
    assert '"price": 1' in facts[0] and '"price": 2' in facts[1]


@pytest.mark.parametrize(
    ("reader", "said", "value"),
    [
        ("price", "4 990 000 Kč", 4_990_000),
        ("price", "4 990 000 Kč, dříve 5 200 000 Kč", 4_990_000),
        ("price", "Cena dohodou", None),
        ("price", "1 200 Kč/m²", None),
        ("price", "99 999 999 999 Kč", None),
        ("price", None, None),
        ("area", "1 250,5 m²", 1250.5),
        ("area", "Byt 3+1 78 m2", 78.0),
        ("area", "78", None),
        ("storey", "2. patro (3. NP)", 2),
        ("storey", "3./6.", 3),
        ("storey", "-1", -1),
        ("storey", "přízemí", 0),
        ("storey", "99", None),
        ("disposition", "Prodej bytu 3 + KK", "3+kk"),
        ("disposition", "atypický", None),
        ("said", "4 m2", True),
        ("said", "Ne", False),
        ("said", " ", None),
        ("building", "Zděná", "cihla"),
        ("building", "neuvedeno", None),
        ("condition", "velmi dobrý stav", "velmi_dobry"),
        ("condition", "Prodáno", None),
        ("condition", "K rekonstrukci", "pred_rekonstrukci"),
        ("furnished", "částečně zařízený", "castecne"),
        ("furnished", "Nevybavený", "ne"),
        ("furnished", "jiné", None),
        ("energy", "Třída G - mimořádně nehospodárná", "G"),
    ],
)
def test_portals_readers(spark, reader, said, value):
    df = spark.createDataFrame([(said,)], "s string")
    assert df.select(getattr(portals, reader)(F.col("s")).alias("v")).first()["v"] == value


def test_portals_json_empty_broken_unknown_and_clashing_columns(spark):
    named = '{"price": 0, "surface": 55, "disposition": "GARSONIERA", "etage": 0, "balconySurface": 0, "terraceSurface": 3, "city": "Brno", "cityDistrict": "Brno", "penb": "X", "lift": false}'
    coded = '{"price_summary_czk": 0, "price_czk": 5, "furnished": {"value": 0}, "building_condition": {"name": "Rezervováno"}, "elevator": {"value": 0, "name": "Ano"}, "balcony": 0}'
    data = [("n", 1, named, 9.0), ("c", 2, coded, 9.0), ("n", 3, "{", 9.0), ("n", 4, None, 9.0), ("who", 5, named, 9.0), (None, 6, named, 9.0), ("d", 7, "<dt>Cena</dt><dd>7 Kč</dd>", 9.0)]
    df = spark.createDataFrame(data, "source string, id int, payload string, area_m2 double")
    got = {r["id"]: r for r in portals.listings(df, "source", "payload", "id", {"n": "names", "c": "codes", "d": "definitions"}).collect()}
    assert (got[1]["price_czk"], got[1]["area_m2"], got[1]["disposition"], got[1]["floor"], got[1]["has_balcony"], got[1]["locality"], got[1]["energy_rating"], got[1]["has_lift"]) == (None, 55.0, "1+kk", None, True, "Brno", None, False)
    assert (got[2]["price_czk"], got[2]["furnished"], got[2]["condition"], got[2]["has_lift"], got[2]["has_balcony"]) == (5, None, None, None, False)
    assert all(got[i][c] is None for i in (3, 4, 5, 6) for c in portals.COLUMNS if c != "has_parking") and got[7]["price_czk"] == 7
    assert portals.listings(df.limit(0), "source", "payload", "id", {"n": "names"}).count() == 0


def test_attribution_newest_wins_contacts_are_normalised_and_switchboards_left_out(spark):
    rules = {"a": attribution.Rule("user", "i", "n", "m", phones="p", prefix=True, rating="r"), "b": attribution.Rule("broker", "i", "n", phone="p", contacts=False)}
    data = [
        (1, "a", '{"user": {"i": 5, "n": "Old", "m": "X@Y.cz", "p": [{"phone": "777 123 456"}, {"phone": "12"}, {}], "r": "4.5"}}', 1, 2),
        (2, "a", '{"user": {"i": 5, "n": "New", "m": "", "p": null}}', 1, 3),
        (3, "a", '{"user": {"n": "no id"}}', 1, 1),
        (4, "b", '{"broker": {"i": "k", "n": "", "p": "777123456"}}', 1, 1),
        (5, "c", '{"user": {"i": 5}}', 1, 1),
        (6, "a", None, 1, 1),
    ]
    df = spark.createDataFrame(data, "id int, source string, raw string, first_seen_at int, last_seen_at int")
    found = attribution.attributed(df, rules)
    assert rows(attribution.identities(found).select("source", "uid", "name", "email", "rating", "listings")) == [("a", "5", "New", None, None, 2), ("b", "k", None, None, None, 1)]
    assert rows(attribution.contacts(found)) == [("a", "5", "email", "x@y.cz", 1, 2), ("a", "5", "phone", "420777123456", 1, 2)]
    prints = {r["id"]: r["fingerprint"] for r in found.collect()}
    assert prints[1] != prints[2] and set(prints) == {1, 2, 4}
    known = spark.createDataFrame([("a", "5", "Known", "k@y.cz", 1.0, 3, 0, 9, 4), ("z", "1", "Z", None, None, None, 0, 1, 1)], attribution.identities(found).schema)
    assert rows(attribution.upserted(known, attribution.identities(found)).select("source", "uid", "name", "first_seen_at", "last_seen_at")) == [("a", "5", "Known", 0, 9), ("b", "k", None, 1, 1), ("z", "1", "Z", 0, 1)]


def test_drain_fetches_once_keeps_failures_and_frees_stale_claims(spark, tmp_path):
    at, old = datetime(2024, 1, 1, 12), datetime(2024, 1, 1, 1)
    data = [(1, 0, at, 0, None), (2, 0, at, 0, None), (3, 0, at, 0, None), (4, 0, at, 5, None), (5, 0, at, 0, at), (6, 9, at, 1, old), (7, -1, at, 0, None)]
    queue = spark.createDataFrame(data, "id long, priority int, enqueued_at timestamp_ntz, attempts int, claimed_at timestamp_ntz")
    asked = str(tmp_path / "asked")

    def fetch(i):
        with open(asked, "a") as f:
            f.write(f"{i}\n")
        if i == 2:
            raise OSError("down")
        return ("gone", None) if i == 3 else ("odd", None) if i == 1 else ("ok", f"p{i}")

    details, gone, after = drain.drained(drain.reclaimed(queue, "2024-01-01 12:30:00", 60), fetch, 4, tasks=2)
    for _ in range(2):
        assert rows(details) == [(6, "p6")] and rows(gone) == [(3,)]
        assert rows(after.select("id", "attempts", F.col("last_error").isNotNull())) == [(1, 1, False), (2, 1, True), (4, 5, False), (5, 0, False), (7, 0, False)]
    assert sorted(open(asked).read().split()) == ["1", "2", "3", "6"]
    assert [x.count() for x in drain.drained(queue.limit(0), fetch, 4)] == [0, 0, 0]


def test_windowed_counts_nulls_edges_and_empty_groups(spark):
    day = lambda d: datetime(2024, 1, d)
    df = spark.createDataFrame([("a", 1, day(30), 1.0), ("a", 1, day(2), 2.0), ("a", None, day(30), 4.0), ("b", None, day(24), None), ("c", 5, datetime(2023, 1, 1), 1.0)], "k string, x int, at timestamp, cost double")
    got = rows(quality.windowed_counts(df, ["k"], ["x"], "at", F.lit("2024-01-31").cast("timestamp"), (7, 30), ("cost",)).select("k", "x_7d", "x_30d", "cost_7d", "cost_30d"))
    assert got == [("a", 1, 1, 5.0, 7.0), ("b", 0, 0, 0.0, 0.0)]
    linked = spark.createDataFrame([(1,), (1,), (None,)], "call int")
    ledger = spark.createDataFrame([("k", 1, 2.0), ("k", None, 1.0), ("m", 9, 4.0)], "kind string, call int, cost double")
    assert rows(quality.unattributed(ledger, linked, "kind", "call", "cost")) == [("k", 3.0, 2.0, 1.0), ("m", 4.0, 0.0, 4.0)]


@pytest.mark.parametrize(
    ("start", "end", "unit", "step", "ticks"),
    [
        (datetime(2024, 1, 1, 10, 3), datetime(2024, 1, 1, 10, 9), "minute", 1, [datetime(2024, 1, 1, 10, m) for m in range(3, 10)]),
        (datetime(2024, 1, 1, 10, 3), datetime(2024, 1, 1, 10, 3), "minute", 1, [datetime(2024, 1, 1, 10, 3)]),
        (datetime(2024, 1, 1, 10, 3, 1), datetime(2024, 1, 1, 10, 3, 9), "minute", 1, [datetime(2024, 1, 1, 10, 3, 1), datetime(2024, 1, 1, 10, 3, 9)]),
        (datetime(2024, 1, 3, 5), datetime(2024, 2, 10), "day", 7, [datetime(2024, 1, d) for d in (8, 15, 22, 29)] + [datetime(2024, 2, 5)]),
        (datetime(2023, 11, 20), datetime(2025, 3, 1), "month", 3, [datetime(2024, m, 1) for m in (1, 4, 7, 10)] + [datetime(2025, 1, 1)]),
        (datetime(1989, 6, 1), datetime(2024, 1, 1), "year", 10, [datetime(y, 1, 1) for y in (1990, 2000, 2010, 2020)]),
        (datetime(2024, 1, 2), datetime(2024, 1, 1), None, None, None),
        (None, datetime(2024, 1, 1), None, None, None),
    ],
)
def test_time_axis(spark, start, end, unit, step, ticks):
    df = spark.createDataFrame([(start, end)], "a timestamp_ntz, b timestamp_ntz")
    got = df.select(axes.time_axis(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert (got is None) == (unit is None) and (got is None or (got["unit"], got["step"], got["ticks"]) == (unit, step, ticks))


def test_value_axis_flat_null_and_whole(spark):
    df = spark.createDataFrame([(3.0, 3.0), (0.12, 0.57), (None, None), (9.0, -4.0)], "a double, b double")
    got = [r["x"] for r in df.select(axes.value_axis(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[1]["ticks"] == [0.1, 0.2, 0.3, 0.4, 0.5, 0.6] and got[0]["low"] <= 2.7 and got[0]["high"] >= 3.3
    assert (got[2]["low"], got[2]["high"], got[3]["low"], got[3]["high"]) == (-1.0, 1.0, -5.0, 10.0)
    assert df.limit(1).select(axes.value_axis(F.col("a"), F.col("b"), 5, True, True).alias("x")).first()["x"]["ticks"] == [0.0, 1.0, 2.0, 3.0]
