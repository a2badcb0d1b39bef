"""H3 operators that need the icosahedron's tables: point to cell, boundaries, disks and coverings.

They need the optional public package h3 (version 4) on the workers; without it they raise at once. All that the index's bits alone tell is in h3bits.
"""

from __future__ import annotations

import importlib.util

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.functions import geometry as G
from cartolith.functions.geometry import Geometry


def available() -> bool:
    return importlib.util.find_spec("h3") is not None


def _need() -> None:
    if not available():
        raise RuntimeError("this H3 operator needs the optional package h3")


def _check(res: int) -> int:
    if not 0 <= res <= 15:
        raise ValueError("a resolution is 0 to 15")
    return res


def point(lon: Column, lat: Column, res: int) -> Column:
    """Cell of a point, as bigint."""
    _need()
    _check(res)

    @F.pandas_udf(T.LongType())
    def cell(x: pd.Series, y: pd.Series) -> pd.Series:
        import h3.api.numpy_int as h3

        return pd.Series([None if a is None or a != a else int(h3.latlng_to_cell(b, a, res)) for a, b in zip(x, y, strict=True)], dtype="Int64")

    return cell(lon, lat)


def hierarchy(df: DataFrame) -> DataFrame:
    """Cells of a point at every resolution, one row each (out_no): each from the point itself, for parents do not nest exactly."""
    cells = F.array(*(point(F.col("lon"), F.col("lat"), r) for r in range(16)))
    return df.select(*df.columns, F.posexplode(cells).alias("out_no", "cell"))


def grid_disk(cell: Column, k: int = 1) -> Column:
    """Cells within k steps, ascending."""
    _need()

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def disk(cells: pa.Array) -> pa.Array:
        import h3.api.basic_int as h3

        return pa.array([None if c is None else sorted(h3.grid_disk(c, k)) for c in cells.to_pylist()], pa.list_(pa.int64()))

    return disk(cell)


def boundary(cell: int) -> Geometry:
    """A cell's boundary as a polygon."""
    import h3.api.basic_int as h3

    ring = [[lon, lat] for lat, lon in h3.cell_to_boundary(cell)]
    return ("Polygon", [[*ring, ring[0]]])


def cover(g: Geometry, res: int) -> list[int]:
    """Cells of a geometry: of points their cells, of lines all cells met from the first vertex on through neighbours, of polygons the cells whose
    centre lies inside. Ascending; parts of multi-lines and multi-points keep their repeats. Other types are an error."""
    import h3.api.basic_int as h3

    kind, c = g
    if kind == "Point":
        return [h3.latlng_to_cell(c[1], c[0], res)]
    if kind == "MultiPoint":
        return [h3.latlng_to_cell(p[1], p[0], res) for p in c]
    if kind == "LineString":
        start = h3.latlng_to_cell(c[0][1], c[0][0], res)
        seen, todo = {start}, [start]
        while todo:
            for n in h3.grid_disk(todo.pop(), 1):
                if n not in seen and G.intersects(boundary(n), g):
                    seen.add(n)
                    todo.append(n)
        return sorted(seen)
    if kind == "MultiLineString":
        return [x for line in c for x in cover(("LineString", line), res)]
    if kind in ("Polygon", "MultiPolygon"):
        shapes = [c] if kind == "Polygon" else c
        found: set[int] = set()
        for rings in shapes:
            outer, *holes = [[(p[1], p[0]) for p in r[:-1]] for r in rings]
            found |= set(h3.h3shape_to_cells(h3.LatLngPoly(outer, *holes), res))
        return sorted(found)
    raise ValueError("InvalidInput: no covering of this type")


def covering(df: DataFrame, res: int, compat: bool = False) -> DataFrame:
    """df exploded to cell. compat: entities without a covering give no row instead of an error."""
    from cartolith.operators.entities import geometry_columns, rows_of

    _need()
    _check(res)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def cells(lon: pd.Series, lat: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, wkb: pd.Series) -> pd.Series:
        out = []
        for g in rows_of(lon, lat, x0, y0, x1, y1, wkb):
            try:
                out.append(cover(g, res) if g else None)
            except ValueError:
                if not compat:
                    raise
                out.append(None)
        return pd.Series(out, dtype=object)

    return df.select(*df.columns, F.posexplode(cells.asNondeterministic()(*geometry_columns())).alias("out_no", "cell"))
