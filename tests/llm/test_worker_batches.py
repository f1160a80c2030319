"""Rows that a Python worker is handed at a time: few where whole texts go, and no result depends on it."""

import pytest

pytest.importorskip("txnwatch.llm")

import pyarrow as pa

import corpus_pipeline
from txnwatch.llm import cutting, decontam, neardup, shared
from txnwatch.llm.shared import stored

CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_stored_bounds_batches_and_leaves_the_setting(spark):
    def sizes(stream):
        for batch in stream:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], ["n"])

    rows = spark.range(0, 2_500, 1, 1).mapInArrow(sizes, "n long")
    before = spark.conf.get(CONF)
    assert max(r["n"] for r in stored(rows, "sizes", 400).collect()) <= 400
    assert spark.conf.get(CONF) == before
    assert [r["n"] for r in stored(rows, "sizes").collect()] == [2_500]
    try:
        spark.conf.set(CONF, 300)  # one that is lower already stays
        assert max(r["n"] for r in stored(rows, "sizes", 400).collect()) <= 300
        assert spark.conf.get(CONF) == "300"
    finally:
        spark.conf.set(CONF, before)


def test_the_pipeline_hands_over_few_whole_texts_at_a_time(spark, monkeypatch, tmp_path):
    asked = []
    for module in (neardup, cutting, corpus_pipeline):
        monkeypatch.setattr(module, "stored", lambda df, name, rows=None: asked.append((name, rows)) or stored(df, name, rows))
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (2, text), (3, None), (None, text)], "doc_id long, text string")
    spark.createDataFrame([(7, "another item of six words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.keep_one_of_each(spark, docs, "").count() == 2 + 1
    assert corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).count() == 4
    assert cutting.pack(docs).count() == 4
    assert {n for n, rows in asked if rows == shared.BATCH_ROWS} == {"described", "candidate-sets", "contaminated", "pieces"}
    assert neardup.BATCH_BYTES <= 1 << 19 and decontam.BATCH_BYTES <= 1 << 19
