"""Reading and parsing transaction messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from txnwatch.schemas import ALERT, TRANSACTION


def message_stream(spark: SparkSession, fmt: str, options: dict, schema=None, path: str | None = None) -> DataFrame:
    """Any streaming source."""
    reader = spark.readStream.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def kafka_options(
    servers: str, topic: str, starting_offsets: str = "latest", max_offsets_per_trigger: int = 10_000, **more: str
) -> dict:
    """Options of the Kafka source; the offset limit is the total of a micro-batch, over all partitions."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
        "maxOffsetsPerTrigger": str(max_offsets_per_trigger),
        **more,
    }


def parse(messages: DataFrame) -> DataFrame:
    """Decode ``value`` (text or bytes) into the transaction columns.

    The text stays in ``raw_value`` and the source's own time, where it has one, in
    ``source_time``. What is no transaction gets null in all transaction columns.
    """
    text = messages.withColumnRenamed("timestamp", "source_time").withColumn("raw_value", F.col("value").cast("string"))
    kept = ["raw_value"] + [c for c in text.columns if c == "source_time"]
    # As a generator, because a filter on its output stays above it: written as a plain column,
    # a filter on a parsed field is pushed below and every message is parsed twice.
    decoded = text.select(*kept, F.explode(F.array(F.from_json("raw_value", TRANSACTION))).alias("txn"))
    return decoded.select("txn.*", *kept)


def alert_messages(messages: DataFrame) -> DataFrame:
    """Alerts from the topic that they were published to; what is no alert message is left out."""
    fields = [StructField("alert_id", StringType()), *ALERT.fields]
    kind = StructType([StructField(f.name, f.dataType) for f in fields])
    decoded = messages.select(F.explode(F.array(F.from_json(F.col("value").cast("string"), kind))).alias("alert"))
    return decoded.select("alert.*").where("alert_id is not null")


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("txn_id").isNotNull())


def bad_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("txn_id").isNull())


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Unparseable messages as records for the dead-letter topic, text unchanged."""
    return bad_rows(parsed).select(F.lit("parse_failure").alias("key"), F.col("raw_value").alias("value"))


def dlq_rate(parsed: DataFrame, watermark: str = "2 minutes") -> DataFrame:
    """Unparseable messages per minute of the source's time.

    On a stream a minute is given out, and its state freed, ``watermark`` after it ended.
    """
    bad = bad_rows(parsed)
    if parsed.isStreaming:
        bad = bad.withWatermark("source_time", watermark)
    return (
        bad.groupBy(F.window("source_time", "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("bad_messages"))
        .select(F.col("w.start").alias("minute"), "bad_messages")
    )


def dormant_cards(spark: SparkSession, path: str) -> DataFrame:
    """The stored list of dormant cards."""
    return spark.read.parquet(path).select("card_id").distinct()
