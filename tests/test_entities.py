"""Lines of every format through every text form, and the operators on them. Inputs are this repository's own; what is wanted follows from the stated semantics."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cartolith.functions import geohash, geometry
from cartolith.operators import aggregate, entities, filters, transform
from cartolith.operators.munge import munge_line
from cartolith.plans import catalogue
from cartolith.sources import lines

MIXED = """-7.25,48.5
51.125\t-0.75
u4
LINESTRING (1.5 2, -3 4.25)
{"type":"Point","coordinates":[-71, 42.5]}
{"id":7,"type":"Feature","properties":{"z": [1, null], "name": "quay"},"geometry":{"type":"Point","coordinates":[4.5, 52]}}
{"type":"FeatureCollection","features":[{"type":"Feature","properties":null,"geometry":{"type":"Point","coordinates":[5,6]}},{"type":"Feature","properties":{},"geometry":{"type":"MultiPoint","coordinates":[[7,8],[9,10.5]]}}]}"""


def texts(df, column):
    return [r[0] for r in df.orderBy("line_no", "part_no").select(column).collect()]


def bisected(lon, lat, level):
    """A geohash by halving, longitude first."""
    sides, bits = [[-180.0, 180.0], [-90.0, 90.0]], []
    for i in range(5 * level):
        side, v = sides[i % 2], (lon, lat)[i % 2]
        middle = sum(side) / 2
        bits.append(int(v >= middle))
        side[1 - bits[-1]] = middle
    return "".join(geohash.ALPHABET[int("".join(map(str, bits[i : i + 5])), 2)] for i in range(0, len(bits), 5)), sides


def test_text_forms(spark):
    df = lines.from_text(spark, MIXED).cache()
    _, ((x0, x1), (y0, y1)) = bisected(10.0, 60.0, 2)
    assert bisected(10.0, 60.0, 2)[0] == "u4"
    ring = ",".join(f"{x:g} {y:g}" for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)))
    assert texts(df, entities.wkt()) == ["POINT(48.5 -7.25)", "POINT(-0.75 51.125)", f"POLYGON(({ring}))", "LINESTRING(1.5 2,-3 4.25)", "POINT(-71 42.5)", "POINT(4.5 52)", "POINT(5 6)", "MULTIPOINT((7 8),(9 10.5))"]
    assert texts(df, entities.geojson())[3] == '{"coordinates":[[1.5,2.0],[-3.0,4.25]],"type":"LineString"}'
    assert texts(df, entities.feature())[5] == '{"geometry":{"coordinates":[4.5,52.0],"type":"Point"},"properties":{"name":"quay","z":[1,null]},"type":"Feature"}'
    assert texts(df, entities.label())[2:5] == ["Geohash: u4", "WKT: LINESTRING(1.5 2,-3 4.25)", 'GeoJSON Geometry: {"type":"Point","coordinates":[-71, 42.5]}']


def test_trimmed_lines_and_collection_boxes(spark):
    df = lines.from_text(spark, "\t 1,2 \r\nGEOMETRYCOLLECTION(POINT(3 4),POINT(5 9))")
    assert [r["kind"] for r in df.orderBy("line_no").collect()] == ["LatLon", "WKT"]
    box = lambda compat: tuple(lines.from_text(spark, "GEOMETRYCOLLECTION(LINESTRING(3 4,5 9))", compat=compat).first()["box"])
    assert box(False) == (3, 4, 5, 9) and box(True) == (0, 0, 5, 9)


def test_parts_are_gathered_by_column(spark):
    """A batch of lines that give none, one or several parts, with and without a box; the lines' own nulls."""
    empty, two = '{"type":"FeatureCollection","features":[]}', '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"a":1},"geometry":null},{"type":"Feature","properties":null,"geometry":{"type":"Point","coordinates":[5,6]}}]}'
    df = entities.parse(spark.createDataFrame([(0, empty), (1, two), (2, None), (3, "POINT EMPTY"), (4, empty), (5, "{")], "line_no long, value string").coalesce(1))
    rows = [(r["line_no"], r["part_no"], r["props"], r["lon"], r["box"] and tuple(r["box"]), r["error"] is None) for r in df.where("line_no != 2").orderBy("line_no", "part_no").collect()]
    assert rows == [(1, 0, '{"a":1}', None, None, False), (1, 1, "{}", 5.0, (5.0, 6.0, 5.0, 6.0), True), (3, 0, "{}", None, (0.0, 0.0, 0.0, 0.0), True), (5, 0, "{}", None, None, False)]
    assert type(entities.parse_text("WKT", "POINT(1 2)")[0]["box"]) is tuple


def test_bad_lines(spark):
    df = lines.from_text(spark, "ill?\nLINESTRING (1 2, 3\n\n832749fffffffff\nu4")
    assert [r["error"] is None for r in df.orderBy("line_no").collect()] == [False, False, False, True, True]
    with pytest.raises(Exception, match="Unable to parse"):
        lines.from_text(spark, "ill?", mode="FAILFAST").collect()


def test_lines_are_numbered_through_the_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1,1\n")
    (tmp_path / "b.txt").write_text("".join(f"{i % 90},{i % 180}\n" for i in range(2000)))
    (tmp_path / "c.txt").write_text("2,2\n3,3\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several blocks of b.txt
    try:
        got = [r["value"] for r in lines.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
        numbers = sorted(r["line_no"] for r in lines.read_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == "".join((tmp_path / f"{f}.txt").read_text() for f in "abc").splitlines() and numbers == list(range(2003))


def test_geohash(spark):
    rng = random.Random(3)
    points = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(50)]
    df = spark.createDataFrame(points, "lon double, lat double")
    got = df.select(geohash.encode(F.col("lon"), F.col("lat"), 7)).collect()
    assert [r[0] for r in got] == [bisected(x, y, 7)[0] for x, y in points]
    name, ((x0, x1), (y0, y1)) = bisected(9.1, 48.7, 4)
    w, h, cx, cy = x1 - x0, y1 - y0, (x0 + x1) / 2, (y0 + y1) / 2
    turns = [(0, 0), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    assert spark.range(1).select(geohash.neighbors(F.lit(name))).first()[0] == [bisected(cx + i * w, cy + j * h, 4)[0] for i, j in turns]
    for text in ("LINESTRING(8.9 48.1,9.7 49.3)", "POLYGON((8.9 48.1,9.7 48.2,9.2 49.3,8.9 48.1))", "9.1,8.2", "MULTIPOINT((1 2),(3 4))"):
        one = lines.from_text(spark, text)
        shape = entities.geometry(*one.select("lon", "lat", F.array("box.xmin", "box.ymin", "box.xmax", "box.ymax"), "wkb").first())
        cells = {r["gh"] for r in transform.covering(one, 4).collect()}
        (x0, y0, x1, y1), step = geometry.box(shape), 0.35
        around = {bisected(x0 - 1 + step * i * 0.5, y0 - 1 + 0.17 * 0.5 * j, 4) [0] for i in range(int((x1 - x0 + 2) / step * 2) + 2) for j in range(int((y1 - y0 + 2) / 0.085) + 2)}
        box_of = {c: spark_box for c, spark_box in zip(sorted(around), boxes_of(spark, sorted(around)), strict=True)}
        assert cells == {c for c, b in box_of.items() if geometry.intersects(shape, geometry.cell_polygon(b))}


def test_geohash_neighbors_of_all_levels(spark):
    """At the antimeridian, the poles and inside, of odd and even levels; upper case; none of what is no geohash."""
    cells = [bisected(x, y, n)[0] for n in (1, 2, 3, 7, 12) for x, y in ((-179.9999999, 10.0), (179.9999999, -89.9999999), (3.3, 89.9999999), (9.1, 48.7))] + ["", "U4", "u4a", None, "0" * 13, "ü"]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, gh string")
    rows = df.select("i", geohash.neighbors(F.col("gh")).alias("all"), geohash.neighbors(F.col("gh"), True).alias("others")).orderBy("i").collect()
    for gh, r in zip(cells, rows, strict=True):
        if gh is None or gh in ("u4a", "0" * 13, "ü"):
            assert r["all"] is None and r["others"] is None
        elif gh:
            (x0, y0, x1, y1), n = transform.cell_box(gh), len(gh)
            turns = [(0, 0), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
            middles = [(((x0 + x1) / 2 + i * (x1 - x0) + 180) % 360 - 180, (y0 + y1) / 2 + j * (y1 - y0)) for i, j in turns]
            want = [bisected(x, y, n)[0] for x, y in middles if -90 < y < 90]
            assert r["all"] == want and r["others"] == want[1:]
    assert rows[cells.index("")]["all"] == [""]


def test_points_are_dealt_out_evenly(spark, tmp_path, monkeypatch):
    """One file of one row group gives tasks by its rows."""
    monkeypatch.setattr(catalogue, "TASK_ROWS", 100)
    spark.range(1000).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    sizes = [len(p) for p in catalogue.geohash_neighbors(spark, str(tmp_path)).select("event_id").distinct().rdd.glom().collect()], catalogue._points(spark, str(tmp_path)).rdd.glom().map(len).collect()
    assert sum(sizes[0]) == 1000 and sizes[1] == [100] * 10


def test_geohash_children_name_their_cell_once(spark):
    df = spark.createDataFrame([("u4",), ("",), (None,)], "gh string").select(geohash.children(F.concat("gh", F.lit("b"))).alias("c"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    assert [r["c"][0] if r["c"] else None for r in df.collect()][:2] == ["u4b0", "b0"]


def boxes_of(spark, names):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(names)], "i int, c string").select("i", geohash.bbox(F.col("c")).alias("b")).orderBy("i").collect()
    return [tuple(r["b"]) for r in rows]


def test_centroid_and_distance(spark):
    df = lines.from_text(spark, "LINESTRING(0 0,4 0,4 2)\nPOLYGON((0 0,6 0,0 3,0 0))\nPOLYGON((0 0,4 0,4 4,0 4,0 0),(0 0,2 0,2 4,0 4,0 0))\nMULTIPOINT((1 2),(3 4))")
    got = [tuple(r) for r in transform.centroid(df).orderBy("line_no").select("centroid_lon", "centroid_lat").collect()]
    assert got[0] == pytest.approx(((4 * 2 + 2 * 4) / 6, 2 / 6)) and got[1] == pytest.approx((2, 1)) and got[2] == pytest.approx((3, 2)) and len(got) == 3
    metres = [r["m"] for r in lines.from_text(spark, "0,1\nLINESTRING(-1 1,1 1)\nPOLYGON((-1 -1,1 -1,1 1,-1 1,-1 -1))").select("line_no", transform.distance_to(0.0, 0.0).alias("m")).orderBy("line_no").collect()]
    # along the equator a degree is a/180 * pi; a degree of latitude from it is 110,574.4 m on this ellipsoid
    assert metres == pytest.approx([6378137.0 * 3.141592653589793 / 180, 110574.4, 0], abs=0.1)


def test_distance_by_steps_is_that_of_the_sql(spark, tmp_path):
    """Points of which some lie opposite, where the formula doesn't converge, or half-way between two tenths of a metre."""
    ids = [501477, 343181, 274270, 341122, 333091, 52475, 438297, 58089, 282769]
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").select("event_id", "user_id").where(F.col("event_id").isin([i % 100000 for i in ids]))
    moved = events.join(spark.createDataFrame([(i, i % 100000) for i in ids], "id long, event_id long"), "event_id").select(F.col("id").alias("event_id"), "user_id")
    moved.write.parquet(str(tmp_path / "events.parquet"))
    got = {r["line_no"]: r["metres"] for r in catalogue.measure_distance(spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == dict(db.execute(catalogue.oracle_sql()["measure_distance"]).fetchall()) and len(got) == len(ids)
    opposite = lines.from_text(spark, "-39.1015625,103.2734375").select(transform.distance_to(-77.03, 38.9), transform.distance_to(-77.03, 38.9, steps=30)).first()
    assert opposite[0] is None and opposite[1] == pytest.approx(19940412.5, abs=0.1)


SHAPES = "1,1\nnonsense\nLINESTRING(2 2,9 9)\nPOLYGON((1 1,2 1,2 2,1 2,1 1))\nMULTIPOINT((1 1),(20 20))\n20,20\n3,0\nMULTIPOINT((1 1),(2 3))\n1,1"


@pytest.mark.parametrize("limit", [20000, 0])
def test_filters(spark, monkeypatch, limit):
    """The same by rows where they are and by the join; with a column of numbers that are all 0, for no row needs one."""
    monkeypatch.setattr(filters, "SMALL_ROWS", limit)
    df = entities.parse(spark.createDataFrame(list(enumerate(SHAPES.split("\n"))), "n int, value string"))
    kept = lambda d: sorted(r["n"] for r in d.collect())
    square = lines.query_entities(spark, "POLYGON((0 0,5 0,5 5,0 5,0 0))\n-40,-40")
    everything = [0, 2, 3, 4, 5, 6, 7, 8]
    for f, want in ((filters.filter_intersects, [0, 2, 3, 4, 6, 7, 8]), (filters.filter_contains, [0, 3, 7, 8])):
        assert kept(f(df, square)) == want and kept(f(df, square, negate=True)) == [n for n in everything if n not in want]
    bent = lines.query_entities(spark, "POLYGON((0 0,5 0,5 5,4 1,0 0))")
    assert kept(filters.filter_intersects(df, bent)) == [2] and kept(filters.filter_contains(df, bent)) == []
    cross = lines.query_entities(spark, "LINESTRING(2 9,9 2)")
    assert kept(filters.filter_intersects(df, cross)) == [2]
    points = df.where("gtype = 'Point'")
    assert kept(filters.filter_dwithin(points, lines.query_entities(spark, "1,1.001\n60,60"), 112)) == [0, 8]
    assert kept(filters.filter_dwithin(points, lines.query_entities(spark, "1,1.001\n60,60"), 111)) == []
    assert kept(filters.filter_intersects(df, square.limit(0))) == [] and kept(filters.filter_intersects(df, square.limit(0), negate=True)) == everything


def test_filters_on_a_stream(spark, tmp_path):
    from cartolith.streaming.lines import stream_entities

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(SHAPES)
    square = lines.query_entities(spark, "POLYGON((0 0,5 0,5 5,0 5,0 0))")
    for i, f in enumerate((filters.filter_intersects, filters.filter_contains)):
        out = f(stream_entities(spark, str(tmp_path / "in")), square)
        out.select("raw").writeStream.format("memory").queryName(f"kept{i}").option("checkpointLocation", str(tmp_path / f"c{i}")).trigger(availableNow=True).start().awaitTermination(60)
        assert spark.table(f"kept{i}").count() == (7, 4)[i]


def test_simplified_lines_keep_ends_and_do_not_cross():
    rng = random.Random(5)
    for n in (3, 10, 200):
        line = [[i + rng.random() / 2, rng.random() * 3] for i in range(n)]
        before = n
        for epsilon in (0.1, 1.0, 10.0):
            out = geometry.simplify(("LineString", line), epsilon)[1]
            assert out[0] == line[0] and out[-1] == line[-1] and 2 <= len(out) <= before and all(p in line for p in out)
            segments = list(zip(out, out[1:], strict=False))
            assert not any(geometry.segments_meet(*map(tuple, a), *map(tuple, b)) for i, a in enumerate(segments) for b in segments[i + 2 :])
            before = len(out)
    # the tooth's vertex stays: without it the ring would cross its hole, or leave it outside
    ring = [[0, 0], [10, 0], [10, 10], [5, 10.4], [0, 10], [0, 0]]
    assert len(geometry.simplify(("Polygon", [ring]), 3)[1][0]) == 5
    for low in (9.9, 10.1):
        hole = [[4.9, low], [5.1, low], [5, 10.2], [4.9, low]]
        assert geometry.simplify(("Polygon", [ring, hole]), 3)[1][0] == ring
    assert geometry.coord_count(geometry.simplify_to(("LineString", [[i, i % 2] for i in range(100)]), 0.01, 10)) <= 10


def test_lines_of_one_way_need_no_grid(monkeypatch):
    rng = random.Random(6)
    drawn = []
    for n in (3, 20, 150):
        steps = [rng.random() + 0.01 for _ in range(n)]
        up = [sum(steps[: i + 1]) for i in range(n)]
        drawn += [[list(p)[:: 1 - 2 * turn] for p in zip(up[::way], (rng.random() * 4 for _ in range(n)), strict=True)] for way in (1, -1) for turn in (0, 1)]
    assert all(geometry._one_way([tuple(p) for p in line]) for line in drawn) and not geometry._one_way([(0, 0), (1, 1), (1, 0)])
    quick = [geometry.simplify(("LineString", line), e) for line in drawn for e in (0.2, 1)]
    monkeypatch.setattr(geometry, "_one_way", lambda at: False)
    assert quick == [geometry.simplify(("LineString", line), e) for line in drawn for e in (0.2, 1)]


def test_many_lines_are_thinned_as_each_alone():
    """With ties, both ways, along either axis; others are left to simplify_to."""
    rng = random.Random(8)
    drawn = []
    for n in [2, 3, 12, 13, 31, geometry.SHORT, geometry.SHORT + 1] * 40:
        line = [[i + 0.0, rng.randrange(5) / 8 if n % 2 else rng.uniform(-2, 2)] for i in range(n)][:: rng.choice((1, -1))]
        drawn.append([p[::-1] for p in line] if rng.random() < 0.5 else line)
    drawn += [[[0.0, 0.0], [1.0, 1.0], [1.0, 0.0]], [[0.0, 0.0], [1.0, float("nan")], [2.0, 0.0]]]
    wkb = [geometry.to_wkb(("LineString", line)) for line in drawn]
    for epsilon, target in ((0.05, 12), (0.3, None), (1e-9, 1)):
        out = geometry.thin_lines([*wkb, b"", geometry.to_wkb(("Polygon", [drawn[2]]))], epsilon, target)
        assert [x is None for x in out] == [len(line) > geometry.SHORT for line in drawn[:-2]] + [True] * 4
        assert all(x is None or x == geometry.simplify_to(("LineString", line), epsilon, target)[1] for x, line in zip(out, drawn, strict=False))


def test_plain_lines_are_read_and_written_as_by_tokens():
    from cartolith.functions import text

    rng = random.Random(9)
    numbers = ["0.0", "-0.0", "0.0001", "-0.5", "10.0", "99999.0123456789", "1.10", "0.00001", "7", "1e3", "123456.5", "+1.5", "0.05"]
    for _ in range(500):
        line = "LINESTRING(" + ",".join(f"{rng.choice(numbers)} {rng.choice(numbers[:6] if rng.random() < 0.8 else numbers)}" for _ in range(rng.randrange(2, 5))) + ")"
        g = text.read_wkt(line)[0]
        part = entities.parse_text("WKT", line)[0]
        assert (part["raw"], part["wkb"], part["box"]) == ("LINESTRING(" + ",".join(" ".join(map(text.plain_text, p)) for p in g[1]) + ")", geometry.to_wkb(g), geometry.box(g))
        assert text.write_wkt(geometry.from_wkb(part["wkb"])) == part["raw"] and text.write_geometry(g) == f'{{"coordinates":{text._coordinates(g[1])},"type":"LineString"}}'
    assert text.plain_line("LINESTRING(1.5 2.0,-3.25 4.0)") == ("LINESTRING(1.5 2,-3.25 4)", [1.5, 2.0, -3.25, 4.0]) and text.plain_line("LINESTRING(1.5 2.0,1e3 4.0)") is None


def test_types_of_properties(spark):
    """Each number by how it is written; names of any characters; nulls have no type."""
    props = '{"a":1,"b":1.0,"c":9223372036854775808,"d":1e3,"e":"1","f":true,"g":null,"h":[1],"i":{"x":1},"q\\"]$.":-3}'
    df = spark.createDataFrame([(0, 0, props), (1, 0, '{"a":2.5,"e":1}'), (2, 0, "{}"), (3, 0, None)], "line_no long, part_no long, props string")
    want = {"a": "double", "b": "double", "c": "double", "d": "double", "e": "json", "f": "bool", "h": "json", "i": "json", 'q"]$.': "long"}
    assert {r["name"]: r["type"] for r in aggregate.schema_infer(aggregate.properties(df)).collect()} == want
    compat = aggregate.schema_infer(aggregate.properties(df), compat=True)
    assert {r["name"]: r["type"] for r in compat.collect()} == want | {"a": "json"}  # the long comes first
    assert aggregate.schema_infer(aggregate.properties(df.limit(0))).collect() == []


def test_aggregates(spark):
    df = lines.from_text(spark, "-7.5,3\nLINESTRING(1 2,8 -9)")
    assert aggregate.bbox_all(df).select(transform.box_geojson()).first()[0] == '{"coordinates":[[[8.0,2.0],[1.0,2.0],[1.0,-9.0],[8.0,-9.0],[8.0,2.0]]],"type":"Polygon"}'
    assert aggregate.feature_collection(df).first()[0].startswith('{"features":[{"geometry":{"coordinates":[3.0,-7.5]')
    assert aggregate.feature_collection(df.limit(0)).first()[0] == '{"features":[],"type":"FeatureCollection"}'


def test_a_collection_is_joined_in_pieces(spark, monkeypatch):
    df = lines.from_text(spark, "\n".join(f"{i % 90},{i}.5" for i in range(150))).repartition(7)
    pieces = aggregate.feature_pieces(df, 500).orderBy("part", "piece").collect()
    assert len(pieces) > 10 and max(len(r["text"]) for r in pieces) < 700
    features = [r["f"] for r in df.orderBy("line_no").select(entities.feature().alias("f")).collect()]
    assert ",".join(r["text"] for r in pieces) == ",".join(features)
    monkeypatch.setattr(aggregate, "PIECE", 500)
    assert aggregate.feature_collection(df).first()[0] == '{"features":[' + ",".join(features) + '],"type":"FeatureCollection"}'
    monkeypatch.setattr(aggregate, "LONGEST", 5000)
    with pytest.raises(Exception, match="use feature_pieces"):
        aggregate.feature_collection(df).collect()


def test_munge():
    want = '{"geometry":{"coordinates":[7.5,-2.25],"type":"Point"},"properties":{"depth":null,"kind":"buoy"},"type":"Feature"}'
    for keys in (("latitude", "longitude"), ("lat", "lon"), ("latitude", "lng")):
        assert munge_line(f'{{"kind": "buoy", "{keys[0]}": "-2.25", "{keys[1]}": 7.5, "depth": null}}') == (want, None)
    text = '{\\"type\\":\\"Point\\",\\"coordinates\\":[7.5,-2.25]}'
    for key, value in (("geojson", f'"{text}"'), ("geometry", f'"{text}"'), ("wkt", '"POINT(7.5 -2.25)"'), ("geojson", '{"type":"Point","coordinates":[7.5,-2.25]}')):
        assert munge_line(f'{{"depth": null, "{key}": {value}, "kind": "buoy"}}') == (want, None)
    assert munge_line("no json")[0] is None and munge_line("[1]") == (None, "InvalidJSONType") and munge_line('{"lat": "x", "lon": 1}')[0] is None
