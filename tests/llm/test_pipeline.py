"""The pipeline's stages against what brute force keeps, on a small table."""

import corpus_pipeline
from cartolith.llm.shared import materialise
from tests.llm.test_operators import WORD, brute_components


def test_stages(spark):
    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, where), name)
        kept[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.dtypes == before.dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
    before, after = kept["near_dedup"]
    want = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 80, 100)
    assert {r["doc_id"] for r in after.collect()} == {i for i, (_, c) in want.items() if c == i}
    before, after = kept["decontamination"]
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in before.collect() if not any(t in " ".join(WORD.findall(r["text"] or "")) for t in items)}
    assert {r["doc_id"] for r in after.collect()} == clean
    assert {r["doc_id"] for r in docs.collect()} == clean


def odd_rows(spark, extra="row string"):
    text = " ".join(f"palabra{i} de la casa" for i in range(20))
    rows = [(1, text, "es", "s", 9, "x"), (1, text, "es", "s", 9, "x"), (1, text + " y algo distinto " * 9, "es", "s", 9, "x"), (2, text, None, None, None, None), (3, None, "es", "s", 0, "x"), (4, "", "es", "s", 0, "x"), (None, text, "es", "s", 9, "x"), (None, text, "es", "s", 9, "x")]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars int, {extra}")


def test_rows_of_one_id_and_without_one(spark):
    kept = corpus_pipeline.near_dedup(spark, odd_rows(spark), "").collect()
    texts = lambda i: sorted(r["text"] or "" for r in kept if r["doc_id"] == i)
    assert len(texts(1)) == 2 and len(set(texts(1))) == 2 and texts(2) == [] and len(texts(None)) == 2 and texts(3) == [""] and texts(4) == [""]


def test_stages_take_nulls_clashing_names_and_empty_tables(spark):
    where = "/root/testdata/sf0.001"
    for docs in (odd_rows(spark), odd_rows(spark, "kept_text string").withColumnRenamed("kept_text", "n_removed"), odd_rows(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, where)
            rows = out.collect()
            if name != "packing":
                assert out.dtypes == docs.dtypes
            assert (len(rows) > 0) == (docs.count() > 0) or name == "language_id"
