"""Commands over lines: python -m cartolith.cli COMMAND ... < lines. Each reads text lines (stdin, or --input PATH for Spark to read) and prints lines in order."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.functions import geohash, h3bits, h3geo
from cartolith.operators import aggregate, entities, filters, munge, transform
from cartolith.sources import flatgeobuf, lines, outside, shapefile


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cartolith")
    top.add_argument("--input", help="text files for Spark to read instead of stdin")
    top.add_argument("--compat", action="store_true", help="reproduce known quirks")
    sub = top.add_subparsers(dest="command", required=True)

    def command(path: str, *arguments: tuple[tuple[str, ...], dict]) -> None:
        names, at = path.split(), sub
        for i, name in enumerate(names[:-1]):
            if name not in at.choices:
                at.add_parser(name).add_subparsers(dest=f"sub{i}", required=True)
            at = next(a for a in at.choices[name]._actions if isinstance(a, argparse._SubParsersAction))
        p = at.add_parser(names[-1])
        p.set_defaults(path=path)
        for flags, options in arguments:
            p.add_argument(*flags, **options)

    whole = {"type": int}
    flag = {"action": "store_true"}
    for path in ("read", "wkt", "gj geom", "gj f", "gj fc", "gh children", "gh roots", "gh encode-long", "json munge", "centroid", "whereami", "map", "h3 hierarchy", "h3 to-str", "h3 from-str", "h3 resolution"):
        command(path)
    command("gh point", (("level",), whole))
    command("gh covering", (("level",), whole), (("-o", "--original"), flag))
    command("gh neighbors", (("-e", "--exclude"), flag))
    for name in ("intersects", "contains", "dwithin"):
        radius = [(("-r", "--radius"), {"type": float, "required": True})] if name == "dwithin" else []
        command(f"filter {name}", (("query",), {"nargs": "?"}), (("-q", "--query-file"), {}), (("-n", "--negate"), flag), *radius)
    command("measure distance", (("query",), {}))
    command("measure coord-count", (("--geojson",), flag))
    command("simplify", (("epsilon",), {"type": float}), (("--to-coord-count",), whole))
    command("bbox", (("-e", "--embed"), flag), (("-a", "--all"), flag))
    command("shp", (("file",), {}))
    command("fgb write", (("file",), {}))
    command("fgb read", (("file",), {}), (("--bbox",), {}))
    command("h3 point", (("resolution",), whole))
    for name in ("children", "parent"):
        command(f"h3 {name}", (("resolution",), {"type": int, "nargs": "?"}))
    command("h3 grid-disk", (("radius",), {"type": int, "nargs": "?", "default": 1}))
    command("h3 covering", (("resolution",), whole), (("-o", "--original"), flag))
    return top


def _explode(df: DataFrame, values, keep_raw: bool = False) -> DataFrame:
    out = df.select("line_no", "part_no", "raw", F.posexplode(values).alias("out_no", "text"))
    if not keep_raw:
        return out
    raw = df.select("line_no", "part_no", "raw", F.lit(-1).alias("out_no"), F.col("raw").alias("text"))
    return raw.unionByName(out)


def _must(ok, error: str, value):
    return F.when(ok, value).otherwise(F.raise_error(F.lit(error)).cast("string"))


def run(spark: SparkSession, args: argparse.Namespace, text: str | None) -> DataFrame | list[str]:
    """The command's lines: a DataFrame with text (ordered by line_no, part_no, out_no where present), or a list."""
    path, compat = args.path, args.compat

    def raw_lines() -> DataFrame:
        if args.input:
            return lines.read_lines(spark, args.input)
        rows = list(enumerate((text or "").splitlines()))
        return spark.createDataFrame(rows, "line_no long, value string")

    def df() -> DataFrame:
        return entities.parse(raw_lines(), mode="FAILFAST", compat=compat)

    def column(value, of: DataFrame | None = None) -> DataFrame:
        return (df() if of is None else of).withColumn("text", value)

    if path == "read":
        return column(entities.label())
    if path == "wkt":
        return column(entities.wkt())
    if path == "gj geom":
        return column(entities.geojson())
    if path == "gj f":
        return column(entities.feature())
    if path == "gj fc":
        return aggregate.feature_collection(df()).withColumnRenamed("collection", "text")
    if path == "map":
        return [outside.write_map(df())]
    if path == "whereami":
        return [x for x in (outside.whereami(),) if x]
    if path == "gh point":
        return column(_must(F.col("gtype") == "Point", "NotImplemented", geohash.encode(F.col("lon"), F.col("lat"), args.level)))
    if path == "gh covering":
        out = transform.covering(df(), args.level).withColumn("text", F.col("gh"))
        return out.select("line_no", "part_no", "out_no", "text").union(df().select("line_no", "part_no", F.lit(-1), "raw")) if args.original else out
    if path == "gh children":
        return _explode(df(), geohash.children(F.col("raw")))
    if path == "gh neighbors":
        return _explode(df(), geohash.neighbors(F.col("raw"), args.exclude))
    if path == "gh roots":
        return list(geohash.ALPHABET)
    if path == "gh encode-long":
        return raw_lines().withColumn("text", _must(F.col("value").try_cast("decimal(20,0)").isNotNull(), "not a number", geohash.encode_long(F.col("value"))))
    if path.startswith("filter "):
        q = lines.query_entities(spark, args.query, args.query_file)
        f = {"intersects": filters.filter_intersects, "contains": filters.filter_contains}.get(path.split()[1])
        if f is filters.filter_contains and q.where("gtype in ('Polygon', 'MultiPolygon')").isEmpty():
            raise ValueError("PolygonRequired")
        out = f(df(), q, args.negate) if f else filters.filter_dwithin(df(), q, args.radius, args.negate)
        return column(F.col("raw"), out)
    if path == "json munge":
        return munge.munge(raw_lines(), mode="FAILFAST").withColumn("text", F.coalesce("feature", "error"))
    if path == "centroid":
        return column(transform.point_geojson(F.col("centroid_lon"), F.col("centroid_lat")), transform.centroid(df()))
    if path == "measure distance":
        q = lines.from_text(spark, args.query, "FAILFAST").collect()
        if len(q) != 1 or q[0]["gtype"] != "Point":
            raise ValueError("PointRequired" if len(q) == 1 else "TooManyFeatures")
        metres = transform.distance_to(q[0]["lon"], q[0]["lat"])
        return column(transform.distance_line(metres))
    if path == "measure coord-count":
        n = transform.coord_count()
        return column(entities.feature(props=transform.coord_count_props()) if args.geojson else F.concat(n.cast("string"), F.lit("\t"), F.col("raw")))
    if path == "simplify":
        return column(F.col("feature"), transform.simplify(df(), args.epsilon, args.to_coord_count))
    if path == "bbox":
        if args.all:
            out = aggregate.bbox_all(df())
            return out.withColumn("text", _must(F.col("box").isNotNull(), "NoInputGiven", transform.box_geojson()))
        return column(transform.box_feature(entities.geojson()) if args.embed else transform.box_geojson())
    if path == "shp":
        shapefile.register(spark)
        return spark.read.format("shapefile").option("compat", str(compat)).load(args.file).withColumnRenamed("feature", "text")
    if path == "fgb write":
        flatgeobuf.write_flatgeobuf(df(), args.file, compat)
        return []
    if path == "fgb read":
        bbox = tuple(float(x) for x in args.bbox.split(",")) if args.bbox else None
        if bbox is not None and len(bbox) != 4:
            raise ValueError("InvalidInput: a bbox has four numbers")
        return aggregate.feature_collection(entities.parse(flatgeobuf.read_flatgeobuf(spark, args.file, bbox))).withColumnRenamed("collection", "text")
    cell = F.coalesce(F.col("h3"), h3bits.from_text(F.col("raw"))) if path != "h3 to-str" else None
    if path == "h3 to-str":
        c = F.col("value").try_cast("bigint")
        return raw_lines().withColumn("text", _must(h3bits.is_valid(c), "InvalidInput", h3bits.to_text(c)))
    if path == "h3 from-str":
        return column(cell.cast("string"))
    if path == "h3 resolution":
        return column(h3bits.resolution(cell).cast("string"))
    if path == "h3 parent":
        return column(_must(h3bits.parent(cell, args.resolution).isNotNull(), "InvalidInput: no such parent", h3bits.to_text(h3bits.parent(cell, args.resolution))))
    if path == "h3 children":
        return _explode(df(), F.transform(h3bits.children(cell, args.resolution), h3bits.to_text))
    if path == "h3 point":
        return column(h3bits.to_text(h3geo.point(F.col("lon"), F.col("lat"), args.resolution)))
    if path == "h3 hierarchy":
        return h3geo.hierarchy(df()).withColumn("text", h3bits.to_text(F.col("cell")))
    if path == "h3 grid-disk":
        return _explode(df(), F.transform(h3geo.grid_disk(cell, args.radius), h3bits.to_text))
    return h3geo.covering(df(), args.resolution, compat).withColumn("text", h3bits.to_text(F.col("cell")))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    needs = not args.input and args.path not in ("gh roots", "whereami", "shp", "fgb read")
    text = sys.stdin.read() if needs else None
    spark = SparkSession.builder.appName("cartolith").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        out = run(spark, args, text)
        if isinstance(out, list):
            print(*out, sep="\n", end="\n" * bool(out))
        else:
            order = [c for c in ("line_no", "part_no", "out_no") if c in out.columns]
            for r in (out.orderBy(*order) if order else out).select("text").toLocalIterator():
                print(r["text"])
    except Exception as e:
        print(f"cartolith exited with error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
