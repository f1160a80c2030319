"""Tables in versions under one folder, with a pointer that is written last.

A reader looks up the newest pointer and reads what it names, so it sees one whole version or the one before,
never a part. Pointers are small files that are only added; ``tidy`` removes old versions with their pointers.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def new_version() -> str:
    return uuid.uuid4().hex


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def publish(spark: SparkSession, path: str, version: str, **facts) -> None:
    """Make ``version`` the one that readers see; ``facts`` are columns of the pointer."""
    columns = [F.lit(v).alias(k) for k, v in {"version": version, **facts}.items()]
    pointer = spark.range(1).select(*columns, F.current_timestamp().alias("written_at"))
    pointer.coalesce(1).write.mode("append").parquet(f"{path}/pointer")


def newest(spark: SparkSession, path: str) -> Row | None:
    """The newest pointer, or None where nothing was published."""
    if not exists(spark, f"{path}/pointer"):
        return None
    return _pointers(spark, path).first()


def tidy(spark: SparkSession, path: str, tables: list[str], keep: int = 3) -> None:
    """Remove all but the ``keep`` newest versions: ``<path>/<table>/version=<version>``, and their pointers.

    A reader that looked up a removed version before has to look up the pointer again.
    """
    old = _pointers(spark, path).collect()[keep:]
    for pointer in old:
        _remove(spark, pointer["file"])
        for table in tables:
            _remove(spark, f"{path}/{table}/version={pointer['version']}")


def _pointers(spark: SparkSession, path: str) -> DataFrame:
    pointers = spark.read.option("mergeSchema", True).parquet(f"{path}/pointer")
    return pointers.select("*", F.col("_metadata.file_path").alias("file")).orderBy(F.desc("written_at"), "version")


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
