"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of
``documents`` unchanged, whatever further columns there are (only masking changes ``text`` and ``n_chars``).
Rows without doc_id pass every stage that could not name them; rows that repeat an id stay or go together
where the stage goes by id. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txnwatch.llm import credentials, cutting, decontam, neardup, quality
from txnwatch.llm.shared import BATCH_ROWS, stored, table

# Hash functions, a model, and linear programming: beyond SQL.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail them go."""
    return quality.good_rows(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates: of each group the document with the smallest id stays."""
    copies = neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(stored(copies, "copies"), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents that hold a benchmark item go."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(stored(found, "contaminated", BATCH_ROWS), "doc_id", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: what was found is masked in the text; every document stays."""
    return credentials.masked_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: one row per piece of a document, with its place in a sequence."""
    return cutting.pack(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
