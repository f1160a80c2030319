"""The operators' queries over the given tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnwatch.llm import (
    backoff,
    bfd,
    credentials,
    crf,
    cutting,
    decontam,
    lexical,
    neardup,
    oracles,
    quality,
    sharding,
    suffixes,
    warc,
    whitening,
)
from txnwatch.llm.shared import table


def op1_suffix_dedup(spark, sf_dir):
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    verdicts = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdicts.select("doc_id", *quality.BASE, "score", "base_failed", "kept")


def op4_packed_ids(spark, sf_dir):
    return bfd.packed_ids(table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    index, folder = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op6_html_extraction(spark, sf_dir):
    return crf.main_text(table(spark, sf_dir, "pages"))


def op7_lm_scores(spark, sf_dir):
    return backoff.lm_scores(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark, sf_dir):
    found = credentials.find_secrets(table(spark, sf_dir, "documents"))
    counts = [
        f"cast(size(filter(base_spans, x -> x.kind = {kind})) as bigint) as n_{credentials.KINDS[kind]}"
        for kind in (credentials.ASSIGN, credentials.ACCESS, credentials.HEX)
    ]
    base = credentials.spans_text("base_spans")
    return found.selectExpr(
        "doc_id", *counts, f"sha2({base}, 256) as base_sha256", f"{credentials.spans_text('spans')} as spans"
    )


def op9_decontamination(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_packing(spark, sf_dir):
    return cutting.pack(table(spark, sf_dir, "documents"))


def op11_sharding(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", sharding.document_size().alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("copies")
    )
    placed = sharding.by_bytes(docs, F.col("size"), F.col("copies"), F.col("doc_id"))
    return placed.select(
        *(F.col(f"row.{c}").alias(c) for c in ("doc_id", "size", "text_crc32")),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op12_lexical_search(spark, sf_dir):
    return lexical.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_near_duplicates,
        op3_quality_rules,
        op4_packed_ids,
        op5_warc,
        op6_html_extraction,
        op7_lm_scores,
        op8_secret_scan,
        op9_decontamination,
        op10_packing,
        op11_sharding,
        op12_lexical_search,
        op13_whitening,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op2_near_duplicates": oracles.NEAR_DUPLICATES,
    "op5_warc": oracles.WARC,
    "op12_lexical_search": oracles.LEXICAL_SEARCH,
}
