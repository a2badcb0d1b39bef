"""JSON objects to GeoJSON Features: the geometry comes from latitude and longitude keys, else from text or object keys."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.functions.geometry import Geometry
from cartolith.functions.text import canonical, geometry_of, read_wkt, write_feature

# The keys that are tried, in order.
LAT = ("latitude", "lat")
LON = ("longitude", "lon", "lng")
WKT_KEYS = ("geometry", "wkt")
GEOJSON_KEYS = ("geometry", "geojson")


def _axis(row: dict, keys: tuple[str, ...]) -> tuple[str, float] | None:
    """The first key with a number or a text; a text that is no number ends the search."""
    for k in keys:
        v = row.get(k)
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return k, float(v)
        if isinstance(v, str):
            try:
                return k, float(v)
            except ValueError:
                return None
    return None


def _first(row: dict, keys: tuple[str, ...], kind: type) -> str | None:
    return next((k for k in keys if isinstance(row.get(k), kind)), None)


def find_geometry(row: dict) -> tuple[Geometry, set[str]] | None:
    """The object's geometry and the keys that give it."""
    lat, lon = _axis(row, LAT), _axis(row, LON)
    if lat and lon:
        return ("Point", [lon[1], lat[1]]), {lat[0], lon[0]}
    for keys, kind, read in ((WKT_KEYS, str, lambda v: read_wkt(v)[0]), (GEOJSON_KEYS, str, lambda v: geometry_of(json.loads(v))), (GEOJSON_KEYS, dict, geometry_of)):
        k = _first(row, keys, kind)
        if k is not None:
            try:
                return read(row[k]), {k}
            except ValueError:
                continue
    return None


def munge_line(line: str) -> tuple[str | None, str | None]:
    """(feature, error)."""
    try:
        row = json.loads(line)
    except ValueError as e:
        return None, f"JSONParseError: {e}"
    found = find_geometry(row) if isinstance(row, dict) else None
    if found is None:
        return None, "InvalidJSONType"
    g, used = found
    return write_feature(g, canonical({k: v for k, v in row.items() if k not in used})), None


def munge(lines: DataFrame, column: str = "value", mode: str = "PERMISSIVE") -> DataFrame:
    """lines with feature and error. mode FAILFAST: the first line without a geometry ends the query."""

    @F.pandas_udf("struct<feature: string, error: string>")
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None else munge_line(x) for x in text], columns=["feature", "error"], dtype=object)

    out = lines.withColumn("_m", run(F.col(column))).withColumns({"feature": F.col("_m.feature"), "error": F.col("_m.error")}).drop("_m")
    if mode == "FAILFAST":
        # a filter, for a column that nothing selects would never be worked out
        out = out.where(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("boolean")).otherwise(F.lit(True)))
    return out
