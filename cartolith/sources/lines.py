"""Line sources: text files and streams of one feature per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.operators import entities


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no, file): lines of text files, numbered from 0 through the files in the order of their paths.

    Every block of a file is read by one task, in order, so a line's number is that of its block's first line plus its place in the block. One pass counts
    the blocks' lines; the table of blocks is joined to the lines.
    """
    place = F.monotonically_increasing_id()
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), place.alias("_place"))
    blocks = read.groupBy("file", "_at").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("file", "_at")) - F.col("_n")  # a row a block: few enough for one task
    blocks = blocks.select("file", "_at", (before - F.col("_first")).alias("_shift"))
    return read.join(blocks, ["file", "_at"]).select("value", (F.col("_place") + F.col("_shift")).alias("line_no"), "file")


def read_entities(spark: SparkSession, path: str, mode: str = "PERMISSIVE", compat: bool = False) -> DataFrame:
    return entities.parse(read_lines(spark, path), mode=mode, compat=compat)


def from_text(spark: SparkSession, text: str, mode: str = "PERMISSIVE", compat: bool = False) -> DataFrame:
    """Entities of the lines of a text, such as a command's argument."""
    rows = list(enumerate(text.split("\n")))
    return entities.parse(spark.createDataFrame(rows, "line_no long, value string"), mode=mode, compat=compat)


def query_entities(spark: SparkSession, query: str | None = None, query_file: str | None = None) -> DataFrame:
    """The query set: exactly one of a text and a file."""
    if (query is None) == (query_file is None):
        raise ValueError("MissingArgument: a query, or a query file")
    return from_text(spark, query, "FAILFAST") if query is not None else read_entities(spark, query_file, "FAILFAST")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A column as text lines, in the order of the input's lines."""
    order = [c for c in ("line_no", "part_no", "out_no") if c in df.columns]
    df.orderBy(*order).select(F.col(column).alias("value")).write.text(path)
