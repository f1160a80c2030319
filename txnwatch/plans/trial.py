"""Would Spark start this as a stream?

Much of what a stream must not do (a distinct count, an aggregation of an aggregation, a mode that an operator
lacks) is refused only when the query starts, and then the whole query with all its rules. So rules are started
beforehand on a stream without rows that has the same columns and watermark, and stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DELAY = "spark.watermarkDelayMs"  # fixed: where Spark keeps a column's watermark


def idle_copy(stream: DataFrame) -> DataFrame:
    """A stream with the columns and watermarks of ``stream`` that never has a row."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]
    idle = stream.sparkSession.readStream.format("rate").load().where("false").select(*columns)
    for f in stream.schema:
        if DELAY in (f.metadata or {}):
            idle = idle.withWatermark(f.name, f"{f.metadata[DELAY]} milliseconds")
    return idle


def start_and_stop(df: DataFrame, modes: list[str]) -> None:
    """Raise what Spark raises when the query is started, if it starts in none of the output modes."""
    for mode in modes:
        try:
            _started(df, mode).stop()
            return
        except Exception as error:
            refused = error
    raise refused


def _started(df: DataFrame, mode: str) -> StreamingQuery:
    name = f"trial-{uuid.uuid4().hex}"
    writer = df.writeStream.format("noop").outputMode(mode).queryName(name)
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if shared:
        writer = writer.option("checkpointLocation", f"{shared.rstrip('/')}/{name}")
    return writer.trigger(processingTime="1 hour").start()
