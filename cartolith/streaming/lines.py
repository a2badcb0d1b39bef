"""The same operators on unbounded lines: parsing, text forms, transforms, and filters by a static query set of bounded size are stateless and run
unchanged on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartolith.operators import aggregate, entities


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no): lines of the text files that arrive in a folder. A stream has no global order: line_no is 0."""
    return spark.readStream.text(path).select("value", F.lit(0).cast("long").alias("line_no"))


def stream_entities(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    return entities.parse(stream_lines(spark, path), compat=compat)


def running_bbox(df: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """The bounds of all entities so far, as the in-memory table name (complete mode: the state is four numbers)."""
    return aggregate.bbox_all(df).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def write_each(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to sink (df, number): with it any batch operator, as a collection per batch, works on a stream."""
    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
