"""Geometry to geometry or number, one entity at a time."""

from __future__ import annotations

import json
import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.functions import geohash
from cartolith.functions import geometry as G
from cartolith.functions.numbers import json_number, plain_number
from cartolith.functions.text import canonical, write_feature, write_geometry
from cartolith.operators.entities import geometry, geometry_columns, rows_of


def _native_point() -> Column:
    return F.col("lon").isNotNull()


@F.pandas_udf(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))
def _centroid(lon: pd.Series, lat: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, wkb: pd.Series) -> pd.DataFrame:
    found = [G.centroid(g) if g else None for g in rows_of(lon, lat, x0, y0, x1, y1, wkb)]
    return pd.DataFrame([(None, None) if p is None else p for p in found], columns=["lon", "lat"], dtype=float)


def centroid(df: DataFrame) -> DataFrame:
    """df with centroid_lon and centroid_lat; rows of types without a centroid are left out."""
    cell = F.col("wkb").isNull() & F.col("lon").isNull() & F.col("box").isNotNull()
    middle = F.struct(((F.col("box.xmin") + F.col("box.xmax")) / 2).alias("lon"), ((F.col("box.ymin") + F.col("box.ymax")) / 2).alias("lat"))
    general = _centroid(*geometry_columns())
    out = df.withColumn("_c", F.when(_native_point(), F.struct("lon", "lat")).when(cell, middle).otherwise(general))
    return out.withColumns({"centroid_lon": F.col("_c.lon"), "centroid_lat": F.col("_c.lat")}).drop("_c").where("centroid_lon is not null and not isnan(centroid_lon)")


def point_geojson(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit('{"coordinates":['), json_number(lon), F.lit(","), json_number(lat), F.lit('],"type":"Point"}'))


def box_geojson(b: str = "box") -> Column:
    """A box as a GeoJSON polygon, from its upper right corner counter-clockwise."""
    corners = [("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax")]
    ring = F.concat_ws(",", *(F.concat(F.lit("["), json_number(F.col(f"{b}.{x}")), F.lit(","), json_number(F.col(f"{b}.{y}")), F.lit("]")) for x, y in corners))
    return F.concat(F.lit('{"coordinates":[['), ring, F.lit(']],"type":"Polygon"}'))


def box_feature(geom: Column, b: str = "box") -> Column:
    """A Feature with its bbox member."""
    ends = F.concat_ws(",", *(json_number(F.col(f"{b}.{c}")) for c in ("xmin", "ymin", "xmax", "ymax")))
    return F.concat(F.lit('{"bbox":['), ends, F.lit('],"geometry":'), geom, F.lit(',"properties":'), F.col("props"), F.lit(',"type":"Feature"}'))


@F.pandas_udf(T.LongType())
def _count(wkb: pd.Series) -> pd.Series:
    return wkb.map(lambda w: None if w is None else G.coord_count(G.from_wkb(bytes(w))))


def coord_count() -> Column:
    """Vertices of an entity, ring closers included."""
    return F.when(_native_point(), F.lit(1).cast("long")).when(F.col("wkb").isNotNull(), _count("wkb")).when(F.col("box").isNotNull(), F.lit(5).cast("long"))


@F.pandas_udf(T.StringType())
def _with_count(props: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else canonical(json.loads(p) | {"coord_count": int(k)}) for p, k in zip(props, n, strict=True)], dtype=object)


def coord_count_props() -> Column:
    return _with_count("props", coord_count())


def distance_to(lon: float, lat: float, steps: int | None = None) -> Column:
    """Metres from a point to an entity: the nearest place in the plane, measured on the ellipsoid; null where the formula doesn't converge, or with steps its value after so many."""

    @F.pandas_udf("double")
    def measure(lon_: pd.Series, lat_: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, wkb: pd.Series) -> pd.Series:
        return pd.Series([G.distance((lon, lat), g, steps) if g else None for g in rows_of(lon_, lat_, x0, y0, x1, y1, wkb)], dtype=float)

    return measure(*geometry_columns())


def distance_line(metres: Column) -> Column:
    return F.concat(plain_number(metres), F.lit("\t"), F.col("raw"))


def simplify(df: DataFrame, epsilon: float, to_coord_count: int | None = None) -> DataFrame:
    """df with feature, the simplified entity as a GeoJSON Feature, and its coord_count."""

    @F.arrow_udf("struct<feature: string, coord_count: long>")
    def thin(props: pa.Array, lon: pa.Array, lat: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array, wkb: pa.Array) -> pa.Array:
        features, counts, wkb = [], [], wkb.to_pylist()
        lines = G.thin_lines([w or b"" for w in wkb], epsilon, to_coord_count)
        for p, line, a, b, w, *ends in zip(props.to_pylist(), lines, lon.to_pylist(), lat.to_pylist(), wkb, *(v.to_pylist() for v in (x0, y0, x1, y1)), strict=True):
            g = ("LineString", line) if line else geometry(a, b, tuple(ends), w)
            if g and not line:
                g = G.simplify_to(g, epsilon, to_coord_count)
            features.append(write_feature(g, p) if g else None)
            counts.append(G.coord_count(g) if g else 0)
        return pa.StructArray.from_arrays([pa.array(features, pa.string()), pa.array(counts, pa.int64())], ["feature", "coord_count"])

    thin = thin.asNondeterministic()  # else the optimizer may copy the call for each of its two members
    return df.withColumn("_s", thin("props", *geometry_columns())).withColumns({"feature": F.col("_s.feature"), "coord_count": F.col("_s.coord_count")}).drop("_s")


def covering(df: DataFrame, level: int, max_cells: int = 1_000_000) -> DataFrame:
    """df exploded to gh, the geohash cells of a level that an entity touches, in descending order (out_no). Boxes and points are native;
    other geometries test the cells of their bounds. An entity whose bounds touch more than max_cells cells is an error."""
    width, height = 360.0 / 2 ** -(-5 * level // 2), 180.0 / 2 ** (5 * level // 2)

    @F.arrow_udf("array<string>")
    def touched(cells: pa.Array, wkb: pa.Array) -> pa.Array:
        out = []
        for names, w in zip(cells.to_pylist(), wkb.to_pylist(), strict=True):
            g = None if w is None else G.from_wkb(w)
            out.append(None if g is None or names is None else [n for n in names if G.intersects(g, G.cell_polygon(cell_box(n)))])
        return pa.array(out, pa.list_(pa.string()))

    touched = touched.asNondeterministic()  # else the optimizer copies the call into a filter of the generator
    ends = [F.col(f"box.{c}") for c in ("xmin", "ymin", "xmax", "ymax")]
    size = ((ends[2] - ends[0]) / width + 2) * ((ends[3] - ends[1]) / height + 2)
    cells = F.when(size > max_cells, F.raise_error(F.lit("a covering of too many cells"))).otherwise(geohash.covering_box(*ends, level))
    out = df.where("box is not null").withColumn("_cells", cells.cast("array<string>"))
    out = out.withColumn("_cells", F.when(F.col("wkb").isNull(), F.col("_cells")).otherwise(touched("_cells", "wkb")))
    return out.select(*df.columns, F.posexplode("_cells").alias("out_no", "gh"))


def cell_box(name: str) -> tuple[float, float, float, float]:
    """Bounds of a geohash cell, in Python."""
    lo, hi = [-180.0, -90.0], [180.0, 90.0]
    axis = 0
    for c in name.lower():
        v = geohash.ALPHABET.index(c)
        for bit in (16, 8, 4, 2, 1):
            middle = (lo[axis] + hi[axis]) / 2
            if v & bit:
                lo[axis] = middle
            else:
                hi[axis] = middle
            axis = 1 - axis
    return (lo[0], lo[1], hi[0], hi[1])


def cell_name(ix: int, iy: int, level: int) -> str:
    """The geohash of column ix and row iy of a level, in Python."""
    wide, high, v = -(-5 * level // 2), 5 * level // 2, 0
    for k in range(5 * level):
        v = v << 1 | (iy >> high - 1 - k // 2 if k % 2 else ix >> wide - 1 - k // 2) & 1
    return "".join(geohash.ALPHABET[v >> 5 * i & 31] for i in reversed(range(level)))


def cells_of(g: G.Geometry, level: int, max_cells: int = 1_000_000) -> list[str]:
    """covering() of one geometry, in Python."""
    b = G.box(g)
    if b is None:
        return []
    spans = []
    for lo, hi, half, bits in ((b[0], b[2], 180, -(-5 * level // 2)), (b[1], b[3], 90, 5 * level // 2)):
        n = 1 << bits
        spans.append(range(max(math.ceil((lo + half) * n / (2 * half)) - 1, 0), min(math.floor((hi + half) * n / (2 * half)), n - 1) + 1))
    if len(spans[0]) * len(spans[1]) > max_cells:
        raise ValueError("a covering of too many cells")
    names = sorted((cell_name(x, y, level) for x in spans[0] for y in spans[1]), reverse=True)
    return [n for n in names if G.intersects(g, G.cell_polygon(cell_box(n)))]


def collection_of(features: Column) -> Column:
    return F.concat(F.lit('{"features":['), features, F.lit('],"type":"FeatureCollection"}'))


__all__ = ["box_feature", "box_geojson", "centroid", "collection_of", "coord_count", "coord_count_props", "covering", "distance_line", "distance_to", "point_geojson", "simplify", "write_geometry"]
