"""Queries and operators on rows where they once differed from their SQL."""

import math
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from estatelake import plans
from estatelake.functions import geo
from estatelake.operators import spatial


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_box_comes_back_from_the_grid(spark):
    places = spark.createDataFrame([(48.51, 18.59), (48.0, 12.0), (48.0, 19.0), (51.5, 12.0), (51.5, 19.0), (47.9, 15.0)], "lat double, lng double")
    g = places.select("lat", "lng", geo.wgs84_to_grid(F.col("lat"), F.col("lng")).alias("g"))
    got = g.select("lat", "lng", "g", geo.wgs84_of(F.col("g.y"), F.col("g.x")).alias("p"), geo.grid_to_wgs84(F.col("g.y"), F.col("g.x")).alias("published")).collect()
    for r in got[:5]:
        assert abs(r["p"]["lat"] - r["lat"]) < 1e-6 and abs(r["p"]["lng"] - r["lng"]) < 1e-6
    assert got[5]["g"] is None and got[5]["p"] is None
    assert got[0]["published"] is None  # south of the envelope, which still guards published ordinates
    swapped = spark.createDataFrame([(1042569.73, 744384.54), (744384.54, -1042569.73)], "y double, x double")
    assert [r["p"] for r in swapped.select(geo.wgs84_of(F.col("y"), F.col("x")).alias("p")).collect()] == [None, None]


def test_round_trip_of_a_place_outside_the_envelope(spark, tmp_path):
    customers = spark.createDataFrame([(973, 1, "BUILDING", 1.0)], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    assert rows(plans.queries()["x27_grid_round_trip"](spark, str(tmp_path))) == [(973, True, True)]


def test_rows_of_one_place_make_no_pairs(spark, monkeypatch):
    """Counts and nearest distances as from all pairs (a repeated id and a null place too), from pairs of places."""
    people = spark.createDataFrame([(i, 49.0 + i % 3 / 10, 15.0) for i in range(60)] + [(7, 49.0, 15.3), (99, None, 15.0)], "id long, lat double, lng double")
    kinds = ["school", "shop", "stop"]
    amenities = spark.createDataFrame([(i, 49.0 + i % 2 / 10, 15.0, kinds[i % 3]) for i in range(90)] + [(90, None, 15.0, "stop")], "rid long, rlat double, rlng double, category string")
    join, pairs = spatial.radius_join, []
    weights = {"school": 3.0, "shop": 2.0, "stop": 1.0}
    want = rows(spatial.walkability(join(people, amenities, 40_000), weights, 40_000))
    monkeypatch.setattr(spatial, "radius_join", lambda *a: pairs.append(join(*a)) or pairs[-1])
    assert rows(spatial.walk_score(spatial.near_by_category(people, amenities, 40_000), weights, 40_000)) == want
    assert len(want) == 60 and pairs[0].count() <= 4 * 6  # four places by two places of three categories, not 61 by 90 rows


T = [datetime(2001, m, 1) for m in range(1, 7)]
INF, NAN = float("inf"), float("nan")
# key of the series, supplier, time, order, line, extended price, quantity; 2099.99 / 2 rounds down, as a double
ODD = {
    "half": [(1, 5, T[0], 1, 1, 4000.0, 2.0), (1, 5, T[1], 2, 1, 2099.99, 2.0), (1, 5, T[2], 3, 1, 2100.0, 2.0)],
    "no time": [(1, 5, None, 1, 1, 9000.0, 2.0), (1, 5, T[1], 2, 1, 4000.0, 2.0), (1, 5, T[2], 3, 1, 3000.0, 2.0)],
    "no key": [(None, None, T[0], 1, 1, 9000.0, 2.0), (None, None, T[1], 2, 1, 4000.0, 2.0), (2, 5, T[2], 3, 1, 3000.0, 2.0)],
    "no time before": [(1, 5, None, 1, 1, 9000.0, 2.0)],
    "no quantity": [(1, 5, datetime(1997, 1, 1), 1, 1, 9000.0, 0.0), (2, 5, datetime(1997, 1, 1), 2, 1, 0.0, 0.0), (3, 5, datetime(1997, 1, 1), 3, 1, -5.0, 0.0)],
    "no number": [(1, 5, datetime(1997, 1, 1), 1, 1, NAN, 2.0), (2, 5, datetime(1997, 1, 1), 2, 1, INF, 2.0), (3, 5, datetime(1997, 1, 1), 3, 1, -90.0, 2.0)],
    "early half": [(1, 5, datetime(1997, 1, 1), 1, 1, 2099.99, 2.0), (2, 5, datetime(1997, 1, 1), 2, 1, -2099.99, 2.0)],
}


@pytest.mark.parametrize(
    ("name", "case"),
    [
        *(("a13_price_history", c) for c in ("half", "no time", "no key")),
        *(("j21_as_of", c) for c in ("early half", "no time before", "no key", "no quantity", "no number")),
        *(("w03_k04_property_drops", c) for c in ("half", "no time", "no key")),
    ],
)
def test_odd_snapshots_as_in_sql(spark, tmp_path, name, case):
    df = spark.createDataFrame(ODD[case], "l_partkey long, l_suppkey long, l_shipdate timestamp_ntz, l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double")
    df.selectExpr("*", "'N' as l_returnflag", "'O' as l_linestatus").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    rel = con.execute(plans.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    plain = lambda v: v.replace(tzinfo=None) if isinstance(v, datetime) else "NaN" if isinstance(v, float) and math.isnan(v) else v
    want = sorted(repr([plain(v) for v in r]) for r in rel.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in plans.queries()[name](spark, str(tmp_path)).collect()) == want
