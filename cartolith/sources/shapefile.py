"""ESRI shapefiles: a reader of .shp geometry and .dbf records, and a Spark data source over it (format "shapefile")."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from cartolith.functions.geometry import Geometry, locate
from cartolith.functions.text import canonical, write_feature

SCHEMA = "line_no long, feature string"
NO_DATA = -1e38  # measures below are none


def _ring_area(ring: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def _polygons(rings: list, compat: bool) -> Geometry:
    """Outer rings run clockwise; each hole goes to the outer ring that holds it. compat: all rings in one polygon."""
    outers = [[r] for r in rings if _ring_area(r) <= 0]
    if compat or len(outers) <= 1:
        return ("Polygon", rings)
    for hole in (r for r in rings if _ring_area(r) > 0):
        home = next((o for o in outers if locate([[p[:2] for p in o[0]]], (hole[0][0], hole[0][1])) >= 0), outers[0])
        home.append(hole)
    return ("MultiPolygon", outers)


def _points(raw: bytes, at: int, n: int, kind: int, compat: bool) -> list[list[float]]:
    """n points from at on, each with its z and, where it has one, its m, which stand in arrays of their own behind the points. compat: m, then z."""
    v = struct.unpack_from(f"<{2 * n}d", raw, at)
    out = [[v[2 * i], v[2 * i + 1]] for i in range(n)]
    if kind < 10:
        return out
    at += 16 * n
    z = None
    if kind // 10 == 1 or kind == 31:
        z = struct.unpack_from(f"<{n}d", raw, at + 16)
        at += 16 + 8 * n
    m = struct.unpack_from(f"<{n}d", raw, at + 16) if len(raw) >= at + 16 + 8 * n else [10 * NO_DATA] * n  # the measures are optional
    return [_with(p, z[i] if z else None, m[i], compat) for i, p in enumerate(out)]


def _with(p: list[float], z: float | None, m: float, compat: bool) -> list[float]:
    if compat:
        return [*p, m] if z is None else [*p, m, z]
    return [*p, *([] if z is None else [z]), *([m] if m >= NO_DATA else [])]


def shape(raw: bytes, compat: bool = False) -> Geometry:
    """The geometry of a record's content: points are [x, y, z(, m)] or [x, y(, m)], under compat [x, y, m, z] or [x, y, m]."""
    kind = struct.unpack_from("<i", raw)[0]
    if kind == 0:
        return ("Polygon", [])
    family = kind % 10
    if family == 1:
        p = list(struct.unpack_from("<2d", raw, 4))
        if kind < 10:
            return ("Point", p)
        z = struct.unpack_from("<d", raw, 20)[0] if kind == 11 else None
        at = 20 if z is None else 28
        return ("Point", _with(p, z, struct.unpack_from("<d", raw, at)[0] if len(raw) >= at + 8 else 10 * NO_DATA, compat))
    if family == 8:
        n = struct.unpack_from("<i", raw, 36)[0]
        return ("MultiPoint", _points(raw, 40, n, kind, compat))
    if family not in (3, 5) and kind != 31:
        raise ValueError(f"shape type {kind}")
    parts, n = struct.unpack_from("<2i", raw, 36)
    first = [*struct.unpack_from(f"<{parts}i", raw, 44), n]
    points = _points(raw, 44 + 4 * parts * (2 if kind == 31 else 1), n, kind, compat)
    rings = [points[a:b] for a, b in zip(first, first[1:], strict=False)]
    return ("MultiLineString", rings) if family == 3 else _polygons(rings, compat or kind == 31)


def field(kind: str, raw: bytes) -> object:
    """A record's value: text, number, truth, date as Y-M-D without padding, or null."""
    text = raw.decode("utf-8", "replace").strip("\0 ")
    if kind in "CM":
        return text
    if kind in "BO" and len(raw) == 8:
        v = struct.unpack("<d", raw)[0]
    elif kind == "I" and len(raw) == 4:
        return struct.unpack("<i", raw)[0]
    elif kind == "Y" and len(raw) == 8:
        return struct.unpack("<q", raw)[0] / 10_000
    elif kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    elif kind == "D":
        return f"{int(text[:4])}-{int(text[4:6])}-{int(text[6:8])}" if len(text) == 8 and text.isdigit() else None
    elif kind in "NF":
        if not text or set(text) == {"*"}:
            return None
        v = float(text)
    else:
        raise ValueError(f"a field of type {kind}")
    if not math.isfinite(v):
        raise ValueError("a number that is not finite")
    return v


def records(dbf: bytes) -> Iterator[dict]:
    n, head, size = struct.unpack_from("<IHH", dbf, 4)
    fields, at = [], 32
    while at + 32 <= head and dbf[at] != 13:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("utf-8", "replace"), chr(dbf[at + 11]), dbf[at + 16]))
        at += 32
    for i in range(n):
        at = head + i * size + 1
        row = {}
        for name, kind, width in fields:
            row[name] = field(kind, dbf[at : at + width])
            at += width
        yield row


def features(shp: bytes, dbf: bytes | None, compat: bool = False) -> Iterator[str]:
    """GeoJSON Features of a shapefile's parts."""
    if len(shp) < 100 or struct.unpack_from(">i", shp)[0] != 9994:
        raise ValueError("not a shapefile")
    rows = records(dbf) if dbf else iter(())
    at = 100
    while at + 8 <= len(shp):
        words = struct.unpack_from(">i", shp, at + 4)[0]
        yield write_feature(shape(shp[at + 8 : at + 8 + 2 * words], compat), canonical(next(rows, {})))
        at += 8 + 2 * words


class ShapefileSource(DataSource):
    """spark.read.format("shapefile").load(path): one Feature per row, for entities.parse. Read by one task: a file is one sequence of records."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("compat", "false").lower() == "true")


class _Reader(DataSourceReader):
    def __init__(self, path: str, compat: bool):
        self.path, self.compat = path, compat

    def read(self, partition: object) -> Iterator[tuple]:
        base = self.path[:-4] if self.path.lower().endswith(".shp") else self.path
        with open(base + ".shp", "rb") as f:
            shp = f.read()
        try:
            with open(base + ".dbf", "rb") as f:
                dbf = f.read()
        except FileNotFoundError:
            dbf = None
        yield from enumerate(features(shp, dbf, self.compat))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileSource)
