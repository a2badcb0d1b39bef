"""A training corpus from raw documents: language ID, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each stage's rows as Parquet and reads
them back for the next. All but the last return the columns of documents. No SQL can state the language models or the packing, so ORACLE_SQL is
None; the tests hold the stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.llm import langid
from cartolith.llm.decontaminate import decontaminate
from cartolith.llm.near_dedup import near_duplicates
from cartolith.llm.packing import pack, token_pieces
from cartolith.llm.shared import materialise
from cartolith.llm.substring_dedup import substring_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a rejected document (no letter, or unlike every language learned) goes."""
    model = langid.train(docs.where(~langid.held_out()), "doc_id", "text", "lang")
    return langid.identify(docs, model).where("not rejected").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates (word 5-shingles, Jaccard similarity 0.8 or more).

    Rows of one id are one document: all its texts stay or go, each text once (the row whose hash is smallest). Rows without an id all stay.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), threshold=(80, 100)).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))))
    rows = named.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), place.alias("place")).where("place = 1").select("row.*")
    return rows.union(docs.where("doc_id is null"))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that 13-word windows of smaller ids repeat; one that loses all its words goes, one that loses none stays as it is."""
    out = substring_dedup(docs).where("n_words = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    row = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        row["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*(v.alias(c) for c, v in row.items()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("item_ids") == 0).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences of 4096."""
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), spaced=False, end_id=1)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
