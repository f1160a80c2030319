"""Helpers that several operators use: the shared folder, sizes, column hygiene."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1_000  # whole texts that a Python worker is handed at a time
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only in a local session, where all is one machine, an unset ``spark.checkpoint.dir`` is set to a folder of
    our own; on a cluster it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("no shared folder: set spark.checkpoint.dir to one that driver and executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    ``batch_rows``: rows that Python workers are handed at a time at most, meanwhile. A batch stands in the
    memory of the JVM, of the worker's Arrow and of its objects at once, and no row depends on it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_BATCH_CONF)
    if batch_rows and not 0 < int(before) < batch_rows:
        spark.conf.set(_BATCH_CONF, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        if batch_rows:
            spark.conf.set(_BATCH_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))


def total_bytes(df: DataFrame, text: str = "text") -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
