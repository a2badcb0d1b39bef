import struct

import pytest
from pyspark.sql import functions as F

from cartolith.functions import geohash, h3bits
from cartolith.functions.register import register
from cartolith.functions.text import read_wkt
from cartolith.operators import entities, transform
from cartolith.sources import flatgeobuf, lines, shapefile

WKT = """POINT(1 2)
LINESTRING(0 0,1 1,2 0)
POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))
MULTIPOINT((1 2),(3 4))
MULTILINESTRING((0 0,1 1),(2 2,3 3))
MULTIPOLYGON(((0 0,4 0,4 4,0 4,0 0)),((10 10,11 10,11 11,10 10)))
GEOMETRYCOLLECTION(POINT(1 2),LINESTRING(0 0,1 1))"""


def test_flatgeobuf_round_trip(spark, tmp_path):
    path = str(tmp_path / "x.fgb")
    flatgeobuf.write_flatgeobuf(lines.from_text(spark, WKT), path)
    back = entities.parse(flatgeobuf.read_flatgeobuf(spark, path))
    assert sorted(r[0] for r in back.select(entities.wkt()).collect()) == sorted(WKT.split("\n"))
    few = entities.parse(flatgeobuf.read_flatgeobuf(spark, path, (9, 9, 12, 12)))
    assert [r[0] for r in few.select("gtype").collect()] == ["MultiPolygon"]


def test_flatgeobuf_properties(spark, tmp_path):
    path = str(tmp_path / "p.fgb")
    line = '{"type":"Feature","geometry":{"type":"Point","coordinates":[%d,2]},"properties":%s}'
    props = ['{"a":1,"b":"x","c":true}', '{"a":2.5,"d":[1,2],"b":null}']
    flatgeobuf.write_flatgeobuf(lines.from_text(spark, "\n".join(line % (i, p) for i, p in enumerate(props))), path)
    back = entities.parse(flatgeobuf.read_flatgeobuf(spark, path))
    assert sorted(r[0] for r in back.select("props").collect()) == ['{"a":1.0,"b":"x","c":true}', '{"a":2.5,"d":[1,2]}']


def test_tree_holds_every_leaf():
    leaves = [((float(i), 0.0, i + 0.5, 1.0), 100 + i) for i in range(179)]
    tree = flatgeobuf.build_tree(leaves)
    assert len(tree) == 192 * 40 and [b - a for a, b in flatgeobuf.level_bounds(179)] == [179, 12, 1]
    for i in (0, 15, 16, 177, 178):
        assert [o for _, o in flatgeobuf.search_tree(tree, 179, (i + 0.1, 0, i + 0.2, 1))] == [100 + i]
    assert flatgeobuf.level_bounds(100_000)[0][1] == 106_669


def test_flatgeobuf_bbox_reads_only_what_meets_it(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "g.fgb")
    flatgeobuf.write_flatgeobuf(lines.from_text(spark, "\n".join(f"POINT({i % 40} {i // 40})" for i in range(1200))), path)
    monkeypatch.setattr(flatgeobuf, "LEAVES_PER_TASK", 64)
    file = flatgeobuf.File(path)
    leaves = list(file.leaves(0, 1200))
    boxes = [(3, 3, 3, 3), (3.2, 3.2, 3.4, 3.9), (0, 0, 39, 29), (5, 0, 11, 29), (38.5, 28.5, 90, 90), (-9, -9, -1, 99)]
    for want in boxes:
        meets = [(i, o) for i, (b, o) in enumerate(leaves) if b[0] <= want[2] and b[2] >= want[0] and b[1] <= want[3] and b[3] >= want[1]]
        assert list(file.search(want)) == meets
        assert list(file.search(want, 0, (100, 333))) == [(i, o) for i, o in meets if 100 <= i < 333]
        reader = flatgeobuf._Reader(path, want)
        parts = reader.partitions()
        assert [row for p in parts for row in reader.read(p)] == [(i, file.feature(o)) for i, o in meets]
        assert all(a.hi <= b.lo for a, b in zip(parts, parts[1:], strict=False))
    assert len(flatgeobuf._Reader(path, boxes[0]).partitions()) < 3 < 15 < len(flatgeobuf._Reader(path, boxes[2]).partitions())
    got = flatgeobuf.read_flatgeobuf(spark, path, boxes[3])
    assert got.count() == 7 * 30


def test_sql_names(spark):
    names = register(spark)
    assert len(names) == 18
    got = spark.sql(
        """select geo_intersects('POINT(1 1)', 'POLYGON((0 0,2 0,2 2,0 2,0 0))'), geo_contains('POLYGON((0 0,2 0,2 2,0 2,0 0))', 'POINT(3 1)'),
        round(geo_distance(0D, 0D, 'POINT(0 0)')), geo_coord_count('LINESTRING(0 0,1 1,2 0)'), geo_simplify('LINESTRING(0 0,1 0,2 0)', 0.1D), geo_centroid('POINT(1 2)'),
        geo_geojson('POINT(1 2)'), geo_from_geojson('{"type":"Point","coordinates":[1,2]}'), geo_bbox('LINESTRING(0 5,1 1,2 0)'), geo_bbox(null), geo_geojson(null), geo_from_geojson(null)"""
    ).first()
    assert tuple(got)[:6] == (True, False, 0.0, 3, "LINESTRING(0 0,2 0)", "POINT(1 2)")
    assert tuple(got)[6:] == ('{"coordinates":[1.0,2.0],"type":"Point"}', "POINT(1 2)", [0.0, 0.0, 2.0, 5.0], None, None, None)


def test_sql_names_of_cells_are_the_operators(spark):
    """The SQL functions of geohashes and H3 cells, and the table function of coverings, against the columns they stand for."""
    register(spark)
    rows = [(i, -180 + i * 7.321, -90 + i * 3.59, 0x8C274996E1683FF - (i % 7) * 512) for i in range(50)] + [(50, 180.0, 90.0, 0x8001FFFFFFFFFFF), (51, 181.0, 0.0, None), (52, None, 0.0, 0x8001FFFFFFFFFFF)]
    spark.createDataFrame(rows, "i long, lon double, lat double, cell long").createOrReplaceTempView("places")
    for level in (0, 1, 4, 7, 12):
        got = spark.sql(f"select lon, lat, geo_geohash(lon, lat, {level}) as gh from places").withColumn("want", geohash.encode(F.col("lon"), F.col("lat"), level))
        assert got.where("not (gh <=> want)").count() == 0
    got = spark.sql("select cell, geo_h3_text(cell) as t, geo_h3_cell(geo_h3_text(cell)) as c, geo_h3_resolution(cell) as r, geo_h3_base_cell(cell) as b, geo_h3_parent(cell, 5) as p, geo_h3_parent(cell, 13) as q from places")
    c = F.col("cell")
    want = {"t": h3bits.to_text(c), "c": c, "r": h3bits.resolution(c), "b": h3bits.base_cell(c), "p": h3bits.parent(c, 5), "q": h3bits.parent(c, 13)}
    for name, column in want.items():
        assert got.where(~F.col(name).eqNullSafe(column)).count() == 0, name
    assert spark.sql("select geo_geohash_children('u4')[31], geo_geohash_bbox('u'), geo_geohash_children(null)").first()[:] == ("u4z", [0.0, 45.0, 45.0, 90.0], None)
    shapes = ["LINESTRING(1 2,9 -7)", "POLYGON((0 0,20 0,0 10,0 0))", "POINT(5.625 0)", "MULTIPOINT((1 1),(40 40))"]
    plain = lines.from_text(spark, "\n".join(shapes))
    for level in (0, 2, 3):
        expected = transform.covering(plain, level).select("line_no", "out_no", "gh").collect()
        spark.createDataFrame(list(enumerate(shapes)), "k long, w string").createOrReplaceTempView("shapes")
        found = spark.sql(f"select k, out_no, gh from shapes, lateral geo_covering(w, {level})").collect()
        first = min(r["line_no"] for r in expected)
        assert sorted(map(tuple, found)) == sorted((r["line_no"] - first, r["out_no"], r["gh"]) for r in expected)
    assert spark.sql("select * from geo_covering(null, 3)").collect() == []


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 1, 1, 1, 4, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    point = struct.pack("<i2d", 1, 3.0, 4.0)
    records = b"".join(struct.pack(">2i", i + 1, len(c) // 2) + c for i, c in enumerate((body, point)))
    (tmp_path / "s.shp").write_bytes(struct.pack(">i", 9994).ljust(100, b"\0") + records)
    field = lambda n, t, w: n.encode().ljust(11, b"\0") + t.encode() + bytes(4) + bytes([w, 0]) + bytes(14)
    rows = b" ab   1.520240105T" + b" cd      20231231?"
    (tmp_path / "s.dbf").write_bytes(struct.pack("<4BIHH", 3, 24, 1, 1, 2, 32 + 32 * 4 + 1, 18).ljust(32, b"\0") + field("n", "C", 3) + field("v", "N", 5) + field("d", "D", 8) + field("l", "L", 1) + b"\r" + rows)
    shapefile.register(spark)
    got = [r["feature"] for r in spark.read.format("shapefile").load(str(tmp_path / "s.shp")).orderBy("line_no").collect()]
    assert got[0] == '{"geometry":{"coordinates":[[[0.0,0.0],[0.0,1.0],[1.0,1.0],[0.0,0.0]]],"type":"Polygon"},"properties":{"d":"2024-1-5","l":true,"n":"ab","v":1.5},"type":"Feature"}'
    assert '"l":null' in got[1] and '"coordinates":[3.0,4.0]' in got[1]
    with pytest.raises(ValueError, match="not a shapefile"):
        list(shapefile.features(b"x", None))


def test_shapefile_keeps_z_and_m():
    xy, z, m = [(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (0.0, 0.0)], [1.0, 2.0, 3.0, 1.0], [5.0, 6.0, -1e39, 5.0]
    plain = b"".join(struct.pack("<2d", *p) for p in xy)
    z_part, m_part = (struct.pack("<6d", 0, 0, *x) for x in (z, m))
    want = [[*p, h, *([k] if k > -1e38 else [])] for p, h, k in zip(xy, z, m, strict=True)]
    quirk = [[*p, k, h] for p, h, k in zip(xy, z, m, strict=True)]
    assert shapefile.shape(struct.pack("<i4d", 11, 1, 2, 3, 4)) == ("Point", [1, 2, 3, 4])
    assert shapefile.shape(struct.pack("<i4d", 11, 1, 2, 3, 4), True) == ("Point", [1, 2, 4, 3])
    assert shapefile.shape(struct.pack("<i3d", 21, 1, 2, 4)) == shapefile.shape(struct.pack("<i3d", 21, 1, 2, 4), True) == ("Point", [1, 2, 4])
    for kind, name, deep in ((13, "MultiLineString", True), (15, "Polygon", True), (18, "MultiPoint", False)):
        head = struct.pack("<i4d", kind, 0, 0, 9, 9) + (struct.pack("<3i", 1, 4, 0) if deep else struct.pack("<i", 4)) + plain
        for compat, points in ((False, want), (True, quirk)):
            assert shapefile.shape(head + z_part + m_part, compat) == (name, [points] if deep else points)
        flat = [[*p, h] for p, h in zip(xy, z, strict=True)]
        assert shapefile.shape(head + z_part) == (name, [flat] if deep else flat)  # the measures are optional
        head = struct.pack("<i", kind + 10) + head[4:]
        measured = [[*p, *([k] if k > -1e38 else [])] for p, k in zip(xy, m, strict=True)]
        assert shapefile.shape(head + m_part) == (name, [measured] if deep else measured)


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text(WKT)
    df = lines.read_entities(spark, str(tmp_path / "a.txt"))
    assert [r[0] for r in df.orderBy("line_no").select(entities.wkt()).collect()] == WKT.split("\n")
    assert read_wkt("POINT(1 2) POINT(3 4)") == [("Point", [1.0, 2.0]), ("Point", [3.0, 4.0])]


def test_stream(spark, tmp_path):
    from cartolith.streaming import lines as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("12,34\n9q5\n")
    q = stream.running_bbox(stream.stream_entities(spark, str(tmp_path / "in")), "running_box", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("running_box").first()["box"]) == (-119.53125, 12.0, 34.0, 35.15625)
