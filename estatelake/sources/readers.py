"""Sources: what arrives as JSON, CSV, XML, HTML or workbook becomes rows with a declared schema."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTING = "source string, source_id_native string, category_main string, category_type string, price_czk long, area_m2 decimal(7,1), disposition string, locality string, lat double, lng double, floor int, is_active boolean, first_seen_at timestamp, last_seen_at timestamp"
STATISTICS = "array<struct<year:int,month:int,price:double,active_count:int,new_count:int,deleted_count:int>>"


def statistics(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """JSON arrays of monthly statistics as rows; what doesn't parse gives none, and months outside 1 to 12 are left out."""
    rows = F.explode(F.from_json(payload, STATISTICS))
    return df.select(*keys, rows.alias("_r")).select(*keys, "_r.*").where(F.col("month").between(1, 12) & F.col("year").isNotNull())


def registry_csv(spark: SparkSession, path: str, schema: str, encoding: str = "windows-1250") -> DataFrame:
    """Semicolon-separated registry with a header that must match the schema's names; blanks are null. Encodings beyond
    Spark's short list are switched on for the session, which decodes them in the scan."""
    if not encoding.lower().startswith(("utf", "iso-8859-1", "us-ascii")):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    wanted = T._parse_datatype_string(schema).names
    head = spark.read.csv(path, sep=";", header=True, encoding=encoding).columns
    if head != wanted:
        raise ValueError(f"{path}: header {head} is not {wanted}")
    return spark.read.csv(path, sep=";", header=True, encoding=encoding, schema=schema, emptyValue=None, nullValue="")


def json_stat(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """Cubes {id, size, dimension: {d: {category: {index: {code: place}}}}, value: [...]} as rows (keys, codes, value): codes
    maps each dimension to its category. A value's place in the array gives its categories by index arithmetic."""
    cube = F.from_json(payload, "id array<string>, size array<int>, dimension map<string, struct<category: struct<index: map<string,int>>>>, value array<double>")
    c = df.select(*keys, cube.alias("c")).select(*keys, "c.*", F.posexplode("c.value").alias("_at", "_v"))
    stride = lambda i: F.aggregate(F.slice("size", i + 2, F.greatest(F.size("size") - i - 1, F.lit(0))), F.lit(1), lambda a, x: a * x)
    code = lambda d, i: F.element_at(F.map_keys(F.map_filter(F.col("dimension")[d]["category"]["index"], lambda k, v: v == F.floor(F.col("_at") / stride(i)) % F.col("size")[i])), 1)
    return c.select(*keys, F.map_from_entries(F.transform("id", lambda d, i: F.struct(d, code(d, i)))).alias("codes"), F.col("_v").alias("value"))


def rent_map_workbook(data: bytes) -> list[dict[str, str]]:
    """Rows of the first sheet of an XLSX file by header; the header is the first row with three filled cells at least. A
    workbook is one small file, so it is read at the edge."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = ElementTree.fromstring(z.read(sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]))
    rows: list[dict[str, str]] = []
    for row in sheet.iter(f"{{{ns['m']}}}row"):
        cells = {}
        for c in row.findall("m:c", ns):
            v, inline = c.find("m:v", ns), c.find("m:is/m:t", ns)
            text = shared[int(v.text)] if c.get("t") == "s" and v is not None else v.text if v is not None else inline.text if inline is not None else None
            if text not in (None, ""):
                cells[re.sub(r"\d", "", c.get("r", ""))] = text
        rows.append(cells)
    at = next((i for i, r in enumerate(rows) if len(r) >= 3), None)
    if at is None:
        return []
    return [{name: r.get(col, "") for col, name in rows[at].items()} for r in rows[at + 1 :] if r]


def change_feed(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Daily XML delta: one row per element."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def new_keys(landed: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Delta probe: landed rows whose key is not known yet."""
    return landed.join(known.select(*keys).distinct(), keys, "left_anti")


def walk_summary(index: DataFrame, keys: list[str], expected: str) -> DataFrame:
    """Per walked scope: rows, distinct ids, whether the walk is complete (as many ids as the portal claims)."""
    return index.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.countDistinct("native_id").alias("n_ids"), F.max(expected).alias("expected")).withColumn("complete", F.col("n_ids") >= F.col("expected"))


def listing_from_json(df: DataFrame, payload: str, mapping: dict[str, str]) -> DataFrame:
    """A portal's JSON by declared pointers: {column: "$.path"}."""
    return df.select(*[c for c in df.columns if c != payload], *[F.get_json_object(payload, p).alias(c) for c, p in mapping.items()])


def html_fields(df: DataFrame, html: str, patterns: dict[str, str]) -> DataFrame:
    """Fields of HTML by patterns with one group; what isn't there is null."""
    return df.select(*[c for c in df.columns if c != html], *[F.nullif(F.regexp_extract(html, p, 1), F.lit("")).alias(c) for c, p in patterns.items()])


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def portal_lookup(requests: DataFrame, listings: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each request with its listing's columns and ``found``; a miss keeps its row."""
    hit = listings.select(*keys, *columns, F.lit(True).alias("_hit"))
    return requests.join(hit, keys, "left").select(*requests.columns, F.coalesce("_hit", F.lit(False)).alias("found"), *columns)


def geojson(lat: Column, lng: Column) -> Column:
    """Point geometry, five decimals."""
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.round(lng, 5), F.round(lat, 5)).alias("coordinates")))


def archive_bodies(df: DataFrame, body: str) -> DataFrame:
    """Content-addressed placement: digest, object key, and whether the row is the first with its body."""
    d = F.sha2(F.col(body), 256)
    return df.withColumn("digest", d).withColumn("object_key", F.concat_ws("/", F.substr("digest", F.lit(1), F.lit(2)), F.substr("digest", F.lit(3), F.lit(2)), "digest"))


def stage(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Staging write; a rerun replaces what it wrote before."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def outbox(df: DataFrame, now: str, retry_minutes: int, most_attempts: int) -> DataFrame:
    """Messages to deliver: never tried, or tried long enough ago and not too often."""
    due = F.col("last_attempt_at").isNull() | (F.col("last_attempt_at") <= F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.lit(retry_minutes)))
    return df.where(due & (F.col("attempts") < most_attempts) & F.col("sent_at").isNull())
