"""Aggregates over whole sets of entities."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions import hilbert
from cartolith.operators.entities import feature

NODE = 16
PIECE = 4_000_000  # characters of a feature collection that are joined at once
LONGEST = 2_000_000_000  # bytes of one text in a row, within Spark's limit of 2**31 - 16 with some head and tail


def bbox_all(df: DataFrame) -> DataFrame:
    """One row, box: the bounds of all entities (partial minima and maxima first); null without any."""
    ends = [F.min("box.xmin").alias("xmin"), F.min("box.ymin").alias("ymin"), F.max("box.xmax").alias("xmax"), F.max("box.ymax").alias("ymax")]
    out = df.agg(*ends)
    return out.select(F.when(F.col("xmin").isNotNull(), F.struct(*out.columns)).alias("box"))


def feature_pieces(df: DataFrame, size: int) -> DataFrame:
    """(part, piece, text): all entities' Features in order, joined by commas to texts of about size characters each. The texts in the order of part and piece, joined by
    commas too, are the members of one collection, of any length; no task holds more than a batch and a piece."""
    ordered = df.where("box is not null").select("line_no", "part_no", feature().alias("f")).orderBy("line_no", "part_no", "f")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, texts, length = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([piece], pa.int32()), pa.array([",".join(texts)], pa.string())], ["part", "piece", "text"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                texts.append(text)
                length += len(text)
                if length >= size:
                    yield out()
                    piece, texts, length = piece + 1, [], 0
        if texts:
            yield out()

    return ordered.where("f is not null").select("f").mapInArrow(join, "part int, piece int, text string")


def feature_collection(df: DataFrame) -> DataFrame:
    """One row, collection: all entities' Features in order, as one GeoJSON document. One document is one row, so beyond 2 GB it is an error: feature_pieces has no such limit.

    The last task writes the sorted pieces to one buffer, which is the row's value: of the whole document it holds few copies."""
    longest = LONGEST

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, sep = io.BytesIO(), b""
        out.write(b'{"features":[')
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    out.write(sep)
                    out.write(text.as_buffer())
                    sep = b","
            if out.tell() > longest:
                raise ValueError("a collection of more than 2 GB doesn't fit one row: use feature_pieces")
        out.write(b'],"type":"FeatureCollection"}')
        text = pa.Array.from_buffers(pa.string(), 1, [None, pa.array([0, out.tell()], pa.int32()).buffers()[1], pa.py_buffer(out.getbuffer())])
        yield pa.RecordBatch.from_arrays([text], ["collection"])

    none = df.sparkSession.range(1).select(F.lit(-1).alias("part"), F.lit(0).alias("piece"), F.lit(None).cast("string").alias("text"))  # so that no features give a row too
    return feature_pieces(df, PIECE).union(none).repartition(1).sortWithinPartitions("part", "piece").select("text").mapInArrow(write, "collection string")


def hilbert_key(df: DataFrame) -> DataFrame:
    """df with hilbert: the key of each entity's middle within the bounds of all."""
    extent = bbox_all(df).select(F.col("box").alias("_e"))
    middle = [(F.col(f"box.{a}min") + F.col(f"box.{a}max")) / 2 for a in "xy"]
    joined = df.join(F.broadcast(extent))  # one row
    x, y = (hilbert.scaled(m, F.col(f"_e.{a}min"), F.col(f"_e.{a}max")) for m, a in zip(middle, "xy", strict=True))
    return joined.withColumn("hilbert", hilbert.key(x, y)).drop("_e")


def hilbert_sort(df: DataFrame) -> DataFrame:
    """df in the order of the curve; ties in the order of the lines."""
    return hilbert_key(df).orderBy("hilbert", "line_no", "part_no")


def value_type(schema: Column) -> Column:
    """Type of a JSON value, from the schema of its variant: bool, long, double (any number but the long ones, 1.0 too), string, json; null for null."""
    return (
        F.when(schema == "VOID", None)
        .when(schema == "BOOLEAN", "bool")
        .when(schema == "BIGINT", "long")
        .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "double")
        .when(schema == "STRING", "string")
        .otherwise("json")
    )


def schema_infer(values: DataFrame, compat: bool = False) -> DataFrame:
    """(name, type) of the properties in values (name, order, type): one type keeps, long and double give double, other mixtures json.

    compat: long before double gives json (only double before long gives double). Counts are partial: no property's values are gathered.
    """
    seen = values.where("type is not null").groupBy("name").agg(
        F.sort_array(F.collect_set("type")).alias("types"), F.min(F.when(F.col("type") == "long", F.col("order"))).alias("long_at"), F.min(F.when(F.col("type") == "double", F.col("order"))).alias("double_at")
    )
    mixed = F.col("types") == F.array(F.lit("double"), F.lit("long"))
    if compat:
        mixed = mixed & (F.col("double_at") < F.col("long_at"))
    return seen.select("name", F.when(F.size("types") == 1, F.col("types")[0]).when(mixed, "double").otherwise("json").alias("type"))


def properties(df: DataFrame) -> DataFrame:
    """(name, order, type) of all properties of entities, each text read once."""
    members = F.explode(F.parse_json("props").cast("map<string, variant>")).alias("name", "value")
    parsed = df.select(F.struct("line_no", "part_no").alias("order"), members)
    return parsed.select("name", "order", value_type(F.schema_of_variant("value")).alias("type"))


def geometry_type(df: DataFrame) -> DataFrame:
    """One row, gtype: the type of all geometries, or Unknown."""
    kinds = F.collect_set("gtype")
    return df.agg(F.when(F.size(kinds) == 1, kinds[0]).otherwise("Unknown").alias("gtype"))


def rtree_levels(n: Column) -> Column:
    """Numbers of nodes per level of a packed tree over n items, leaves last."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(16)),
        F.struct(F.array(n.cast("long")).alias("levels"), n.cast("long").alias("n")),
        lambda s, _: F.when(s["n"] > 1, F.struct(F.concat(F.array(F.ceil(s["n"] / NODE)), s["levels"]).alias("levels"), F.ceil(s["n"] / NODE).alias("n"))).otherwise(s),
    )
    return step["levels"]


def rtree_level(df: DataFrame, rank: str = "rank") -> DataFrame:
    """Bounds of each group of 16 consecutive items (box, rank): the next level up, all items within their parent."""
    parent = F.floor(F.col(rank) / NODE).alias(rank)
    out = df.groupBy(parent).agg(F.min("box.xmin").alias("xmin"), F.min("box.ymin").alias("ymin"), F.max("box.xmax").alias("xmax"), F.max("box.ymax").alias("ymax"))
    return out.select(rank, F.struct("xmin", "ymin", "xmax", "ymax").alias("box"))
