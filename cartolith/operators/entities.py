"""Lines to entities: format detection (native), parsing, and the text forms of entities.

An entity row: line_no, part_no, kind, raw, gtype, lon and lat (points), box (its bounds), wkb (null where the point or cell says
all), props (canonical JSON), h3 (index), error. One line may give several entities, or none.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.functions import geohash, h3bits
from cartolith.functions.geometry import Geometry, box, cell_polygon, from_wkb, line_wkb, to_wkb
from cartolith.functions.numbers import json_number, plain_number
from cartolith.functions.text import plain_line, read_geojson, read_wkt, write_geometry, write_wkt

# The patterns that tell the formats apart, in order.
LATLON = r"^-?[0-9]+\.?[0-9]*[,\t]-?[0-9]+\.?[0-9]*$"
H3 = r"^(?i)0?[0-9a-f]{15,16}$"
GEOHASH = r"^(?i)[0-9a-z&&[^ailo]]+$"
GEOJSON = r"\{"
WKT = r"(?i)^\s*(point|linestring|polygon|multipoint|multilinestring|multipolygon|geometrycollection)"
WKT_COMPAT = r"(?i)^point|linestring|polygon|multipoint|multilinestring|multipolygon"

BOX_TYPE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")])
_KINDS = {"kind": T.StringType(), "raw": T.StringType(), "gtype": T.StringType(), "lon": T.DoubleType(), "lat": T.DoubleType(), "box": BOX_TYPE, "wkb": T.BinaryType(), "props": T.StringType(), "h3": T.LongType(), "error": T.StringType()}
PART_TYPE = T.StructType([T.StructField(c, t) for c, t in _KINDS.items()])
COLUMNS = tuple(_KINDS)


def detect(line: Column, compat: bool = False) -> Column:
    """LatLon, H3, Geohash, GeoJSON, WKT, or null. compat: keywords of WKT may stand anywhere in the line."""
    return (
        F.when(line.rlike(LATLON), "LatLon")
        .when(line.rlike(H3), "H3")
        .when(line.rlike(GEOHASH), "Geohash")
        .when(line.rlike(GEOJSON), "GeoJSON")
        .when(line.rlike(WKT_COMPAT if compat else WKT), "WKT")
    )


def _part(kind: str, raw: str, g: Geometry | None, props: str = "{}", error: str | None = None, compat: bool = False) -> dict:
    """A part's columns; its box is a tuple."""
    b = box(g, compat) if g else None
    point = g is not None and g[0] == "Point" and len(g[1]) > 0
    return {
        "kind": kind, "raw": raw, "gtype": g[0] if g else None, "lon": g[1][0] if point else None, "lat": g[1][1] if point else None,
        "box": b, "wkb": to_wkb(g) if g and not point else None, "props": props, "h3": None, "error": error,
    }


def _line_part(raw: str, flat: list[float]) -> dict:
    """_part of a line, from its numbers."""
    xs, ys = flat[::2], flat[1::2]
    return {"kind": "WKT", "raw": raw, "gtype": "LineString", "lon": None, "lat": None, "box": (min(xs), min(ys), max(xs), max(ys)), "wkb": line_wkb(flat), "props": "{}", "h3": None, "error": None}


def parse_text(kind: str, line: str, compat: bool = False) -> list[dict]:
    """Entities of a GeoJSON or WKT line; one with an error where it can't be read. compat: a collection's box also holds the origin."""
    try:
        if kind == "WKT":
            if found := plain_line(line):
                return [_line_part(*found)]
            return [_part("WKT", write_wkt(g), g, compat=compat) for g in read_wkt(line)]
        return [_part(k, line if raw is None else raw, g, props, error, compat) for k, g, props, raw, error in read_geojson(line)]
    except (ValueError, RecursionError) as e:
        return [_part(kind, line, None, error=f"Invalid{'Wkt' if kind == 'WKT' else 'GeoJson'}: {e}")]


ARROW_BOX = pa.struct([(c, pa.float64()) for c in ("xmin", "ymin", "xmax", "ymax")])
ARROW_PART = pa.struct(
    [("kind", pa.string()), ("raw", pa.string()), ("gtype", pa.string()), ("lon", pa.float64()), ("lat", pa.float64()), ("box", ARROW_BOX), ("wkb", pa.binary()), ("props", pa.string()), ("h3", pa.int64()), ("error", pa.string())]
)


def _box_array(boxes: list[tuple | None]) -> pa.Array:
    sides = zip(*((b or (None,) * 4) for b in boxes), strict=True) if boxes else [[]] * 4
    return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in sides], fields=list(ARROW_BOX), mask=pa.array([b is None for b in boxes], pa.bool_()))


def _parser(compat: bool):
    @F.arrow_udf(T.ArrayType(PART_TYPE))
    def parse_lines(kind: pa.Array, line: pa.Array) -> pa.Array:
        """Column by column: values of nested rows would cost more to convert than the lines to parse."""
        columns, ends = {c: [] for c in COLUMNS}, [0]
        add = [(c, x.append) for c, x in columns.items()]
        for k, text in zip(kind.to_pylist(), line.to_pylist(), strict=True):
            for part in () if text is None else parse_text(k, text, compat):
                for c, append in add:
                    append(part[c])
            ends.append(len(columns["kind"]))
        arrays = [_box_array(columns[f.name]) if f.name == "box" else pa.array(columns[f.name], f.type) for f in ARROW_PART]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(ARROW_PART)), mask=line.is_null())

    return parse_lines


def parse(lines: DataFrame, column: str = "value", mode: str = "PERMISSIVE", compat: bool = False) -> DataFrame:
    """Entities of a column of text lines. A line_no column is kept; without one all is 0. mode FAILFAST: a line that can't be read
    ends the query; PERMISSIVE: it gives a row with error and no geometry."""
    line = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    df = lines.withColumn("_line", line).withColumn("_kind", detect(F.col("_line"), compat))
    line, kind = F.col("_line"), F.col("_kind")
    sides = F.split(line, "[,\t]")
    lat, lon = F.try_element_at(sides, F.lit(1)).cast("double"), F.try_element_at(sides, F.lit(2)).cast("double")
    cell = h3bits.from_text(line)
    none = {c: F.lit(None) for c in COLUMNS}

    def part(**given: Column) -> Column:
        return F.array(F.struct(*((none | given)[c].alias(c) for c in COLUMNS))).cast(T.ArrayType(PART_TYPE))

    bad_hash = ~geohash.is_geohash(line)
    parts = (
        F.when(kind == "LatLon", part(kind=kind, raw=line, gtype=F.lit("Point"), lon=lon, lat=lat, box=F.struct(lon, lat, lon, lat), props=F.lit("{}")))
        .when((kind == "Geohash") & bad_hash, part(kind=kind, raw=line, props=F.lit("{}"), error=F.lit("a geohash has at most 12 characters")))
        .when(kind == "Geohash", part(kind=kind, raw=line, gtype=F.lit("Polygon"), box=geohash.bbox(line), props=F.lit("{}")))
        .when((kind == "H3") & ~h3bits.is_valid(cell), part(kind=kind, raw=line, props=F.lit("{}"), error=F.lit("InvalidInput: not an H3 cell")))
        .when(
            kind == "H3",
            part(
                kind=kind, raw=h3bits.to_text(cell), h3=cell,
                props=F.concat(F.lit('{"id":"'), h3bits.to_text(cell), F.lit('","index":'), cell.cast("string"), F.lit(',"resolution":'), h3bits.resolution(cell).cast("string"), F.lit("}")),
            ),
        )
        .when(kind.isNull(), part(raw=line, error=F.concat(F.lit("InvalidInput: Unable to parse single-line input: "), line)))
        .otherwise(_parser(compat)(kind, F.when(kind.isin("GeoJSON", "WKT"), line)))
    )
    keep = [c for c in lines.columns if c != column and c not in COLUMNS and c != "part_no"]
    if "line_no" not in keep:
        df, keep = df.withColumn("line_no", F.lit(0).cast("long")), ["line_no", *keep]
    out = df.select(*keep, F.posexplode(parts).alias("part_no", "_p")).select(*keep, F.col("part_no").cast("long").alias("part_no"), *(F.col(f"_p.{c}").alias(c) for c in COLUMNS))
    if mode == "FAILFAST":
        # a filter, for a column that nothing selects would never be worked out
        out = out.where(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("boolean")).otherwise(F.lit(True)))
    return out


def geometry(lon: float | None, lat: float | None, b: tuple | None, wkb: bytes | None) -> Geometry | None:
    """The geometry that an entity row says."""
    if wkb is not None:
        return from_wkb(bytes(wkb))
    if lon is not None and lon == lon:
        return ("Point", [lon, lat])
    return cell_polygon(b) if b is not None and b[0] == b[0] and b[0] is not None else None


def geometry_columns(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}lon"), F.col(f"{prefix}lat"), *(F.col(f"{prefix}box.{c}") for c in ("xmin", "ymin", "xmax", "ymax")), F.col(f"{prefix}wkb")]


def rows_of(*columns: pd.Series) -> list[Geometry | None]:
    lon, lat, x0, y0, x1, y1, wkb = columns
    return [geometry(a, b, (c, d, e, f), w) for a, b, c, d, e, f, w in zip(lon, lat, x0, y0, x1, y1, wkb, strict=True)]


def _texts(wkb: pa.Array, write: Callable[[Geometry], str]) -> pa.Array:
    if wkb.null_count == len(wkb):
        return pa.nulls(len(wkb), pa.string())
    return pa.array([None if w is None else write(from_wkb(w)) for w in wkb.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _wkt(wkb: pa.Array) -> pa.Array:
    return _texts(wkb, write_wkt)


@F.arrow_udf(T.StringType())
def _geojson(wkb: pa.Array) -> pa.Array:
    return _texts(wkb, write_geometry)


def _ring(number, sep: str, left: str, right: str) -> Column:
    corners = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin")]
    return F.concat_ws(",", *(F.concat(F.lit(left), number(F.col(f"box.{x}")), F.lit(sep), number(F.col(f"box.{y}")), F.lit(right)) for x, y in corners))


def wkt() -> Column:
    """Well-known text of an entity: native for points and cells, else from its binary form."""
    point = F.concat(F.lit("POINT("), plain_number(F.col("lon")), F.lit(" "), plain_number(F.col("lat")), F.lit(")"))
    cell = F.concat(F.lit("POLYGON(("), _ring(plain_number, " ", "", ""), F.lit("))"))
    return F.when(F.col("lon").isNotNull(), point).when(F.col("wkb").isNull() & F.col("box").isNotNull(), cell).otherwise(_wkt("wkb"))


def geojson() -> Column:
    """GeoJSON geometry of an entity, keys sorted."""
    point = F.concat(F.lit('{"coordinates":['), json_number(F.col("lon")), F.lit(","), json_number(F.col("lat")), F.lit('],"type":"Point"}'))
    cell = F.concat(F.lit('{"coordinates":[['), _ring(json_number, ",", "[", "]"), F.lit(']],"type":"Polygon"}'))
    return F.when(F.col("lon").isNotNull(), point).when(F.col("wkb").isNull() & F.col("box").isNotNull(), cell).otherwise(_geojson("wkb"))


def feature(geom: Column | None = None, props: Column | None = None) -> Column:
    """GeoJSON Feature of an entity: geometry and properties only."""
    return F.concat(F.lit('{"geometry":'), geojson() if geom is None else geom, F.lit(',"properties":'), F.col("props") if props is None else props, F.lit(',"type":"Feature"}'))


def label() -> Column:
    """The debugging form: kind and text."""
    h3 = F.concat(F.lit("H3 Cell: "), F.col("raw"), F.lit(" at resolution "), h3bits.resolution(F.col("h3")).cast("string"))
    return F.when(F.col("kind") == "H3", h3).otherwise(F.concat(F.col("kind"), F.lit(": "), F.col("raw")))
