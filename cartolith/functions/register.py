"""SQL names (prefix geo_) for a session: Arrow kernels over well-known text, native SQL functions of geohashes and H3 cells, and a table
function of coverings."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.functions import geohash
from cartolith.functions import geometry as G
from cartolith.functions.text import geometry_of, read_wkt, write_geometry, write_wkt
from cartolith.operators.transform import cell_box, cells_of


def _wkt(x: str | None) -> G.Geometry | None:
    return None if x is None else read_wkt(x)[0]


# Native functions: name and parameters, type, SQL. H3 cells are bigint; a digit has three bits, resolution 15's the lowest.
_COLUMN = "least(floor((lon + 180) * power(2, ceil(level * 5 / 2)) / 360), power(2, ceil(level * 5 / 2)) - 1)"
_ROW = "least(floor((lat + 90) * power(2, floor(level * 5 / 2)) / 180), power(2, floor(level * 5 / 2)) - 1)"
_BIT = f"IF((5 * i + b) % 2 = 0, floor({_COLUMN} / power(2, ceil(level * 5 / 2) - 1 - (5 * i + b) div 2)), floor({_ROW} / power(2, floor(level * 5 / 2) - 1 - (5 * i + b) div 2))) % 2"
_VALUE = f"aggregate(sequence(0, 4), 0, (v, b) -> 2 * v + CAST({_BIT} AS INT))"
_RES = "CAST(shiftright(cell, 52) & 15 AS INT)"
_UNUSED = "shiftleft(CAST(1 AS BIGINT), 3 * (15 - res)) - 1"
_AT = "(cell & ~shiftleft(CAST(15 AS BIGINT), 52) | shiftleft(CAST(res AS BIGINT), 52))"
NATIVE = {
    "geo_geohash(lon DOUBLE, lat DOUBLE, level INT)": (
        "STRING",
        "CASE WHEN lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND level BETWEEN 0 AND 12 THEN "
        f"IF(level = 0, '', concat_ws('', transform(sequence(0, greatest(level, 1) - 1), i -> substring('{geohash.ALPHABET}', 1 + {_VALUE}, 1)))) END",
    ),
    "geo_geohash_children(gh STRING)": ("ARRAY<STRING>", f"IF(gh IS NULL, NULL, transform(split('{geohash.ALPHABET}', ''), c -> concat(gh, c)))"),
    "geo_h3_cell(text STRING)": ("BIGINT", "CAST(conv(text, 16, 10) AS BIGINT)"),
    "geo_h3_text(cell BIGINT)": ("STRING", "lower(hex(cell))"),
    "geo_h3_resolution(cell BIGINT)": ("INT", _RES),
    "geo_h3_base_cell(cell BIGINT)": ("INT", "CAST(shiftright(cell, 45) & 127 AS INT)"),
    "geo_h3_parent(cell BIGINT, res INT)": ("BIGINT", f"IF(res >= 0 AND res < {_RES}, {_AT} | ({_UNUSED}), NULL)"),
}


class Covering:
    """Rows (out_no, gh): the geohash cells of a level that a geometry (well-known text) touches, in descending order."""

    def eval(self, wkt: str, level: int):
        if wkt is not None and level is not None:
            yield from enumerate(cells_of(_wkt(wkt), level))


def register(spark: SparkSession) -> list[str]:
    """Register the functions; their names. Geometries are well-known text. geo_covering(wkt, level) is a table function."""

    @F.pandas_udf(T.BooleanType())
    def geo_intersects(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else G.intersects(_wkt(x), _wkt(y)) for x, y in zip(a, b, strict=True)], dtype=object)

    @F.pandas_udf(T.BooleanType())
    def geo_contains(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else G.contains_any(_wkt(x), _wkt(y)) for x, y in zip(a, b, strict=True)], dtype=object)

    @F.pandas_udf(T.DoubleType())
    def geo_distance(lon: pd.Series, lat: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else G.distance((a, b), _wkt(x)) for a, b, x in zip(lon, lat, g, strict=True)], dtype=float)

    @F.pandas_udf(T.LongType())
    def geo_coord_count(g: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else G.coord_count(_wkt(x)) for x in g], dtype="Int64")

    @F.pandas_udf(T.StringType())
    def geo_simplify(g: pd.Series, epsilon: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else write_wkt(G.simplify(_wkt(x), e)) for x, e in zip(g, epsilon, strict=True)], dtype=object)

    @F.pandas_udf(T.StringType())
    def geo_centroid(g: pd.Series) -> pd.Series:
        found = [None if x is None else G.centroid(_wkt(x)) for x in g]
        return pd.Series([None if p is None else write_wkt(("Point", list(p))) for p in found], dtype=object)

    @F.pandas_udf(T.StringType())
    def geo_geojson(g: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else write_geometry(_wkt(x)) for x in g], dtype=object)

    @F.pandas_udf(T.StringType())
    def geo_from_geojson(text: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else write_wkt(geometry_of(json.loads(x))) for x in text], dtype=object)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def geo_bbox(g: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else list(G.box(_wkt(x))) for x in g], dtype=object)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def geo_geohash_bbox(gh: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else list(cell_box(x)) for x in gh], dtype=object)

    found = {f.__name__: f for f in (geo_intersects, geo_contains, geo_distance, geo_coord_count, geo_simplify, geo_centroid, geo_geojson, geo_from_geojson, geo_bbox, geo_geohash_bbox)}
    for name, f in found.items():
        spark.udf.register(name, f)
    for head, (kind, sql) in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {sql}")
    spark.udtf.register("geo_covering", F.udtf(Covering, returnType="out_no: int, gh: string"))
    return sorted([*found, *(head.partition("(")[0] for head in NATIVE), "geo_covering"])
