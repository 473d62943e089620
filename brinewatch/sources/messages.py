"""Beacon messages: broker source and lenient JSON parsing, for batch and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewatch import schema as S
from brinewatch.functions import epoch_ms, event_ms


def read_topic(
    spark: SparkSession,
    brokers: str,
    topic: str,
    *,
    max_per_trigger: int | None = None,
    streaming: bool = True,
    **options: str,
) -> DataFrame:
    """Messages of a Kafka topic from the earliest offset (needs the Kafka connector on the path)."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    reader = (
        reader.option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**options)
    )
    if streaming and max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().select(F.col("value").cast("string").alias("value"), "timestamp")


def parse_events(
    df: DataFrame,
    *,
    value: str = "value",
    append_ts: str = "timestamp",
    now: Column | None = None,
) -> DataFrame:
    """One typed row per parsable message.

    Text that is no JSON object is dropped; a field of the wrong type only becomes NULL.
    """
    # Generating the fields parses each text once; a plain column would be parsed again by the
    # filter that is pushed below it.
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = df.select(
        F.col(value).alias("_text"), F.col(append_ts).alias("_append"),
        F.inline(F.array(F.from_json(value, S.message_schema(), options))),
    )
    whole = F.col("_corrupt_record").isNull() | F.get_json_object("_text", "$").isNotNull()
    rows = parsed.where(F.ltrim("_text").startswith("{") & whole)
    columns = []
    for field, (column, kind) in S.EVENT_FIELDS.items():
        source = F.col(field)
        if field == "DateTimeUTC":
            source = F.coalesce(source.try_cast("bigint"), source.try_cast("double").try_cast("bigint"))
        columns.append(source.cast(kind).alias(column))
    return rows.select(
        *columns,
        event_ms(F.col("DateTimeUTC")).alias("event_time_utc_ms"),
        epoch_ms(F.col("_append")).alias("kafka_logappend_ms"),
        (now if now is not None else F.current_timestamp()).alias("ingest_at"),
    )
