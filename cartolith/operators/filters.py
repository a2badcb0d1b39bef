"""Spatial filters: which entities meet, lie in, or are near any geometry of a query set.

A filter looks at a row's geometry alone, so rows need no number, repeated rows are treated alike, and rows without a geometry (and so those with an
error) are in neither the filter's result nor its negation's.

The query set is measured first. Up to SMALL_ROWS geometries of SMALL_BYTES it goes to the workers and every row is decided where it is: no shuffle, and the
same on a stream. Points and cells against boxes are native expressions, if the boxes are few; other pairs are tested by bounds, then exactly.

A larger query set is joined: both sides get geohash cells of their bounds, each at the finest level (up to FINEST) at which it touches at most CELLS cells,
and the cells' ancestors. Two bounds can only meet if a cell of one is a cell or an ancestor of a cell of the other, so the join is an equi-join on
cells, own cells with all and ancestors with own ones only; pairs are checked against the bounds, and those left are decided exactly. The geometries that
are hit are known by their hashes, and rows are kept by a semi or anti join on these. This needs a static df.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions import geohash
from cartolith.functions import geometry as G
from cartolith.operators.entities import geometry, geometry_columns, rows_of

FINEST, CELLS = 6, 16
SMALL_ROWS, SMALL_BYTES = 20_000, 16 << 20
NATIVE_ROWS = 64
ENDS = ("xmin", "ymin", "xmax", "ymax")


def _clip(b: Column) -> list[Column]:
    low, high = (-180.0, -90.0), (180.0, 90.0)
    return [F.greatest(F.lit(low[i % 2]), F.least(F.lit(high[i % 2]), b[c])) for i, c in enumerate(ENDS)]


def _cells(df: DataFrame, b: str = "box") -> DataFrame:
    """df exploded to (cell, own): its cells, and their ancestors with own false."""
    ends = _clip(F.col(b))
    chosen = None
    for level in range(FINEST, 0, -1):
        width, height = 360.0 / 2 ** -(-5 * level // 2), 180.0 / 2 ** (5 * level // 2)
        few = (F.floor((ends[2] - ends[0]) / width) + 2) * (F.floor((ends[3] - ends[1]) / height) + 2) <= CELLS
        cells = geohash.covering_box(*ends, level)
        chosen = F.when(few, cells) if chosen is None else chosen.when(few, cells)
    own = chosen.otherwise(F.array(F.lit("")))
    parents = F.array_distinct(F.flatten(F.transform(own, lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0))), lambda n: F.substring(c, F.lit(1), n)))))
    both = F.concat(F.transform(own, lambda c: F.struct(c.alias("cell"), F.lit(True).alias("own"))), F.transform(F.array_except(parents, own), lambda c: F.struct(c.alias("cell"), F.lit(False).alias("own"))))
    return df.withColumn("_x", F.explode(both)).withColumns({"cell": F.col("_x.cell"), "own": F.col("_x.own")}).drop("_x")


def _boxes_meet(a: str, b: str) -> Column:
    x, y = F.col(a), F.col(b)
    return (x["xmin"] <= y["xmax"]) & (y["xmin"] <= x["xmax"]) & (x["ymin"] <= y["ymax"]) & (y["ymin"] <= x["ymax"])


def _pairs(df: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidate pairs (columns of df with l_, of queries with r_), each once."""
    left = _cells(df.select(*(F.col(c).alias(f"l_{c}") for c in ("_id", "lon", "lat", "box", "wkb"))), "l_box").withColumnRenamed("own", "l_own")
    right = _cells(queries.select(*(F.col(c).alias(f"r_{c}") for c in ("_id", "lon", "lat", "box", "wkb", "search"))).where("r_search is not null"), "r_search").withColumnRenamed("own", "r_own")
    met = left.where("l_own").join(right, "cell").union(left.where("not l_own").join(right.where("r_own"), "cell"))
    return met.where(_boxes_meet("l_box", "r_search")).drop("cell", "l_own", "r_own").dropDuplicates(["l__id", "r__id"])


def _exact(test):
    @F.pandas_udf("boolean")
    def decide(
        a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series, g: pd.Series, h: pd.Series, i: pd.Series, j: pd.Series, k: pd.Series, m: pd.Series, n: pd.Series, o: pd.Series
    ) -> pd.Series:
        return pd.Series([bool(test(x, y)) for x, y in zip(rows_of(a, b, c, d, e, f, g), rows_of(h, i, j, k, m, n, o), strict=True)], dtype=bool)

    return decide


def _any(test, found: list[tuple[G.Geometry, tuple]]):
    """Whether a row's geometry passes the test with any of (geometry, bounds to search); rows without bounds are not looked at."""
    geometries, bounds = [g for g, _ in found], np.array([b for _, b in found], float).reshape(-1, 4)

    @F.pandas_udf("boolean")
    def decide(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series, g: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        own = np.stack([x.to_numpy(float, na_value=np.nan) for x in (c, d, e, f)], axis=1)
        step = max(1, (1 << 22) // max(1, len(bounds)))
        for lo in range(0, len(a), step):
            o = own[lo : lo + step, None]
            rows, which = np.nonzero((o[..., 0] <= bounds[:, 2]) & (bounds[:, 0] <= o[..., 2]) & (o[..., 1] <= bounds[:, 3]) & (bounds[:, 1] <= o[..., 3]))
            kept, last = None, -1
            for r, q in zip((rows + lo).tolist(), which.tolist(), strict=True):
                if out[r]:
                    continue
                if r != last:
                    kept, last = geometry(*(x.iat[r] for x in (a, b)), tuple(own[r]), g.iat[r]), r
                out[r] = bool(test(kept, geometries[q]))
        return pd.Series(out)

    return decide


def _small(queries: DataFrame) -> list[tuple[G.Geometry, tuple]] | None:
    """(geometry, bounds to search) of all queries, or None beyond SMALL_ROWS or SMALL_BYTES."""
    parts = queries.select("lon", "lat", *(F.col(f"box.{c}").alias(c) for c in ENDS), "wkb", *(F.col(f"search.{c}").alias(f"s_{c}") for c in ENDS)).where("s_xmin is not null")
    n, size = parts.agg(F.count("*"), F.sum(F.coalesce(F.length("wkb"), F.lit(0)))).first()
    if n > SMALL_ROWS or (size or 0) > SMALL_BYTES:
        return None
    return [(geometry(r["lon"], r["lat"], tuple(r[c] for c in ENDS), r["wkb"]), tuple(r[f"s_{c}"] for c in ENDS)) for r in parts.collect()]


def _filter(df: DataFrame, queries: DataFrame, test, negate: bool, native=None, pairs: Column | None = None) -> DataFrame:
    """Rows of df with a geometry that passes the test with any query (or, negated, with none). native: from all queries, an expression that decides a row by
    itself or is null, or None; pairs: the same for a pair of the join."""
    df = df.where("box is not null")
    found = _small(queries)
    if found is not None:
        own = native(found) if native else None
        columns = geometry_columns()
        if own is None:
            hit = _any(test, found)(*columns)
        else:
            open_ = own.isNull()
            hit = F.coalesce(own, _any(test, found)(*(F.when(open_, c) for c in columns)))
        return df.where(~hit if negate else hit)
    if df.isStreaming:
        raise ValueError(f"on a stream a query set holds at most {SMALL_ROWS} geometries of {SMALL_BYTES} bytes")
    digest = F.struct(F.xxhash64("lon", "lat", "box", "wkb").alias("a"), F.hash("wkb", "box", "lat", "lon").alias("b"))
    keyed = df.withColumn("_id", digest)
    exact = _exact(test)(*geometry_columns("l_"), *geometry_columns("r_"))
    decide = exact if pairs is None else F.coalesce(pairs, exact)
    met = _pairs(keyed.select("_id", "lon", "lat", "box", "wkb").dropDuplicates(["_id"]), queries.withColumn("_id", digest))
    hits = met.where(decide).select(F.col("l__id").alias("_id")).distinct()
    return keyed.join(hits, "_id", "left_anti" if negate else "left_semi").select(df.columns)


def _queries(queries: DataFrame, search: Column | None = None) -> DataFrame:
    return queries.where("box is not null").withColumn("search", F.col("box") if search is None else search)


def _rectangle(g: G.Geometry) -> tuple | None:
    """The bounds of a point or of a polygon that is a rectangle along the axes, which say all of it."""
    b = G.box(g)
    if g[0] == "Point" and g[1]:
        return b
    ring = g[1][0] if g[0] == "Polygon" and len(g[1]) == 1 else []
    corners = [(p[0], p[1]) for p in ring]
    if len(corners) == 5 and b[0] < b[2] and b[1] < b[3] and set(corners) == {(x, y) for x in b[::2] for y in b[1::2]} and all((p[0] == q[0]) != (p[1] == q[1]) for p, q in zip(corners, corners[1:], strict=False)):
        return b
    return None


def _boxes_of(found: list[tuple[G.Geometry, tuple]]) -> list[tuple] | None:
    """Bounds of the queries, if they are few and say all of them."""
    boxes = [_rectangle(g) for g, _ in found] if len(found) <= NATIVE_ROWS else [None]
    return None if None in boxes else boxes


def _or(terms: list[Column]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | t
    return out


def filter_intersects(df: DataFrame, queries: DataFrame, negate: bool = False) -> DataFrame:
    """Entities that meet any query (touching counts); an empty query set meets nothing."""

    def native(found: list[tuple[G.Geometry, tuple]]) -> Column | None:
        boxes = _boxes_of(found)
        if boxes is None:
            return None
        b = F.col("box")
        meets = [(b["xmin"] <= x1) & (b["xmax"] >= x0) & (b["ymin"] <= y1) & (b["ymax"] >= y0) for x0, y0, x1, y1 in boxes]
        return F.when(F.col("wkb").isNull(), _or(meets))  # points and cells: their bounds are all of them

    both = F.when(F.col("l_wkb").isNull() & F.col("r_wkb").isNull(), F.lit(True))
    return _filter(df, _queries(queries), G.intersects, negate, native, both)


def filter_contains(df: DataFrame, queries: DataFrame, negate: bool = False) -> DataFrame:
    """Entities that lie in a polygon of the queries (points strictly). Queries of other types are left out."""

    def native(found: list[tuple[G.Geometry, tuple]]) -> Column | None:
        boxes = _boxes_of(found)
        if boxes is None:
            return None
        x, y = F.col("lon"), F.col("lat")
        return F.when(x.isNotNull(), _or([(x > x0) & (x < x1) & (y > y0) & (y < y1) for x0, y0, x1, y1 in boxes]))

    inside = (F.col("l_lon") > F.col("r_box.xmin")) & (F.col("l_lon") < F.col("r_box.xmax")) & (F.col("l_lat") > F.col("r_box.ymin")) & (F.col("l_lat") < F.col("r_box.ymax"))
    pairs = F.when(F.col("l_lon").isNotNull() & F.col("r_wkb").isNull(), inside)
    return _filter(df, _queries(queries.where("gtype in ('Polygon', 'MultiPolygon')")), lambda g, q: g is not None and q is not None and G.contains_any(q, g), negate, native, pairs)


def reach(b: str, metres: float) -> Column:
    """Bounds that hold every point within metres of the box; all longitudes near a pole."""
    dy = metres / 110_000.0
    y0, y1 = F.col(f"{b}.ymin") - dy, F.col(f"{b}.ymax") + dy
    top = F.greatest(F.abs(y0), F.abs(y1))
    dx = metres / (110_000.0 * F.greatest(F.cos(F.radians(F.least(top, F.lit(90.0)))), F.lit(1e-9)))
    far = (top >= 89.0) | (dx >= 180.0)
    return F.struct(
        F.when(far, F.lit(-180.0)).otherwise(F.col(f"{b}.xmin") - dx).alias("xmin"), y0.alias("ymin"), F.when(far, F.lit(180.0)).otherwise(F.col(f"{b}.xmax") + dx).alias("xmax"), y1.alias("ymax")
    )


def filter_dwithin(df: DataFrame, queries: DataFrame, metres: float, negate: bool = False) -> DataFrame:
    """Point entities less than metres from any query. The distance runs over the shorter way round, so bounds that pass the
    antimeridian search all longitudes."""
    if not math.isfinite(metres):
        raise ValueError("a radius is a number of metres")
    around = reach("box", metres)
    wraps = (around["xmin"] < -180) | (around["xmax"] > 180)
    search = F.when(wraps, F.struct(F.lit(-180.0).alias("xmin"), around["ymin"].alias("ymin"), F.lit(180.0).alias("xmax"), around["ymax"].alias("ymax"))).otherwise(around)
    points = df.withColumn("lon", F.when(F.col("gtype").isNull() | (F.col("gtype") == "Point"), F.col("lon")).otherwise(F.raise_error(F.lit("PointRequired")).cast("double")))

    def near(g: G.Geometry | None, q: G.Geometry | None) -> bool:
        if g is None or q is None or g[0] != "Point" or not g[1]:
            return False
        d = G.distance((g[1][0], g[1][1]), q)
        return d is not None and d < metres

    return _filter(points, _queries(queries, search), near, negate)
