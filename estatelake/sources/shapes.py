"""Polygon layers in shapefiles: geometry and attributes of one layer as rows, in grid ordinates or degrees."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import grid_to_wgs84

#: Fixed values of the format: its shape types that hold areas, and the lengths of its headers.
AREAS, SHP_HEAD, DBF_HEAD, DBF_FIELD = (5, 15, 25), 100, 32, 32
RINGS = "array<array<struct<x: double, y: double>>>"


def areas(shp: bytes) -> Iterator[list[list[tuple[float, float]]] | None]:
    """The rings of each record, None where it holds no area (or a broken one)."""
    at = SHP_HEAD
    while at + 8 <= len(shp):
        (words,) = struct.unpack_from(">i", shp, at + 4)
        body, at = shp[at + 8 : at + 8 + 2 * words], at + 8 + 2 * words
        if len(body) < 44 or struct.unpack_from("<i", body)[0] not in AREAS:
            yield None
            continue
        parts, points = struct.unpack_from("<2i", body, 36)
        if not 0 < parts <= points or len(body) < 44 + 4 * parts + 16 * points:
            yield None
            continue
        starts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
        xy = struct.unpack_from(f"<{2 * points}d", body, 44 + 4 * parts)
        rings = [list(zip(xy[2 * a : 2 * b : 2], xy[2 * a + 1 : 2 * b : 2], strict=True)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        yield [r for r in rings if len(r) >= 4] or None


def attributes(dbf: bytes, encoding: str) -> Iterator[dict[str, str]]:
    """The attributes of each record by lower-case name, deleted records too, for they have a shape."""
    rows, head, width = struct.unpack_from("<IHH", dbf, 4)
    fields, at = [], 1
    for i in range(DBF_HEAD, head - 1, DBF_FIELD):
        name, size = dbf[i : i + 11].split(b"\0")[0].decode("ascii", "replace").lower(), dbf[i + 16]
        fields.append((name, at, size))
        at += size
    for k in range(rows):
        row = dbf[head + k * width : head + (k + 1) * width]
        yield {n: row[a : a + size].decode(encoding, "replace").strip() for n, a, size in fields}


def read_layer(spark: SparkSession, folder: str, layer: str, code: tuple[str, ...] = ("kod",), name: tuple[str, ...] = ("nazev",), encoding: str = "windows-1250") -> DataFrame:
    """Rows (code, name, rings, usable) of the layer below ``folder`` whose file name holds ``layer``, case aside; of several the
    one with the largest geometry file. Records without an area, or a numeric code, are kept and not usable. A layer's two
    files (of 2 GB at most, by their format) are parsed by one task; layers are independent. Rings are in the file's ordinates.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{shp,dbf,SHP,DBF}").load(folder)
    stem = F.regexp_extract("path", r"([^/]*)\.[A-Za-z]+$", 1)
    files = files.select(stem.alias("stem"), F.lower(F.regexp_extract("path", r"([A-Za-z]+)$", 1)).alias("kind"), "length", "content").where(F.lower("stem").contains(layer.lower()))
    largest = files.where("kind = 'shp'").agg(F.max_by("stem", F.struct("length", "stem")).alias("stem"))

    def parse(pdf: pd.DataFrame) -> pd.DataFrame:
        of = {k: bytes(c) for k, c in zip(pdf["kind"], pdf["content"], strict=True)}
        rows = []
        for rings, row in zip(areas(of["shp"]), attributes(of["dbf"], encoding) if "dbf" in of else iter(()), strict=False):
            number = next((row[c] for c in code if row.get(c)), "")
            label = next((row[c] for c in name if row.get(c)), number)
            whole = number.split(".")[0].lstrip("-")
            ok = rings is not None and whole.isdigit()
            rows.append((int(number.split(".")[0]) if whole.isdigit() else None, label, [[{"x": x, "y": y} for x, y in r] for r in rings or []], ok))
        return pd.DataFrame(rows, columns=["code", "name", "rings", "usable"]).astype({"code": "Int64"})

    return files.join(F.broadcast(largest), "stem").groupBy("stem").applyInPandas(parse, f"code long, name string, rings {RINGS}, usable boolean")


def in_degrees(layer: DataFrame) -> DataFrame:
    """Rings of grid ordinates as rings of (lat, lng); a ring with a point outside the grid makes its record not usable."""
    turned = F.transform("rings", lambda ring: F.transform(ring, lambda p: grid_to_wgs84(p["x"], p["y"])))
    whole = F.forall(turned, lambda ring: F.forall(ring, lambda p: p.isNotNull()))
    return layer.withColumns({"rings": turned, "usable": F.col("usable") & whole})
