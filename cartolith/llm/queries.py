"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm.decontaminate import decontaminate
from cartolith.llm.html_text import extract
from cartolith.llm.langid import held_out, identify, train
from cartolith.llm.line_quality import fit, quality
from cartolith.llm.near_dedup import near_duplicates
from cartolith.llm.packing import pack, token_pieces
from cartolith.llm.pll_score import pseudo_likelihood
from cartolith.llm.pll_score import train as train_window
from cartolith.llm.shared import shared_dir
from cartolith.llm.sharding import fill, place
from cartolith.llm.substring_dedup import substring_dedup
from cartolith.llm.token_store import read_tokens, write_tokens


SHARDS = [f"shard-{i:03d}" for i in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_permutation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS).select("doc_id", "slot", "shard")


def op3_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "item_ids", "score", (F.size("item_ids") > 0).alias("contaminated"), (F.size("item_ids") == 0).alias("kept"))


def op4_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op6_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()), "doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), model)
    return out.select(F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op7_rans_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), where, public_tokenizers.path("byte_bpe_50k.json"), spaced=True, end_id=0)
    return read_tokens(spark, where).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_crf_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op9_masked_pll(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudo_likelihood(docs, train_window(docs), keep=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "pll", "pll_per_token")


def op10_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), spaced=False, end_id=1)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_substring_dedup,
        op2_permutation_sharding,
        op3_bm25_decontamination,
        op4_minmax_near_dedup,
        op5_template_extraction,
        op6_kneser_ney_langid,
        op7_rans_token_store,
        op8_crf_line_quality,
        op9_masked_pll,
        op10_lp_packing,
    )
    return {f.__name__: f for f in found}


WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SUBSTRING_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM win JOIN first USING (k) WHERE doc_id > m),
word AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

NEAR_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT doc_id, CASE WHEN l.a = r THEN l.b ELSE l.a END FROM reach JOIN link l ON l.a = r OR l.b = r)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m AS component_id, d.doc_id = m AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS m FROM reach GROUP BY doc_id) USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express an operator. The look-up table of sharding is stated as a list made by its rule."""
    shards = fill(SHARDS)
    slot = f"CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 15) AS BIGINT) % {len(shards)}"
    return {
        "op1_substring_dedup": SUBSTRING_SQL,
        "op4_minmax_near_dedup": NEAR_SQL,
        "op2_permutation_sharding": f"SELECT doc_id, slot, CAST(({shards})[slot + 1] AS INTEGER) AS shard FROM (SELECT doc_id, {slot} AS slot FROM documents)",
    }
