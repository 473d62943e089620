"""Drain a stream: process all that is available, then hand back a batch table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewatch.functions import in_range
from brinewatch.session import scratch_dir
from brinewatch.sources.sinks import dedup_first
from brinewatch.streaming.keyed import KeyedTable, UpsertLog


def _finish(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drain(stream: DataFrame, label: str, *, path: str | None = None) -> DataFrame:
    """Append-mode stream into a parquet table; file commits and checkpoint make it exactly-once."""
    spark = stream.sparkSession
    path = path or scratch_dir(spark, label)
    _finish(stream.writeStream.format("parquet").option("path", f"{path}/table"), f"{path}/state")
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def drain_upserts(stream: DataFrame, label: str, key: Sequence[str]) -> DataFrame:
    """Update-mode stream into an upsert log: each batch costs its changes, not the table."""
    path = scratch_dir(stream.sparkSession, label)
    log = UpsertLog(stream.sparkSession, path, stream.schema, key)
    _finish(stream.writeStream.outputMode("update").foreachBatch(log.write), f"{path}/state")
    return log.content()


def drain_insert_ignore(
    stream: DataFrame, label: str, *, key: str, order: Sequence[str], target: DataFrame | None = None,
    buckets: int = 64, bucket_rows: int = 500_000, every: int = 20,
) -> DataFrame:
    """Rows whose key neither ``target`` nor an earlier batch has; rows without a key are all kept.

    A batch reads the keys of the buckets that its own keys fall into, so a key stays unique however late it
    comes again, and a trigger costs what its keys need, not the table.
    """
    spark = stream.sparkSession
    path = scratch_dir(spark, label)
    table = KeyedTable(spark, path, stream.schema, [key], every=every, buckets=buckets, bucket_rows=bucket_rows)
    if target is not None:
        table.write(target, -1)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        known = table.lookup(batch, batch_id)
        table.write(dedup_first(batch, key=key, order=order).join(known, key, "left_anti"), batch_id)
        batch.unpersist()

    _finish(stream.writeStream.foreachBatch(write), f"{path}/state")
    return table.content()


def drain_split(stream: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected rows of a stream into two tables, from one pass over the source."""
    spark = stream.sparkSession
    path = scratch_dir(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumn("schema_valid", in_range())
        marked.write.mode("overwrite").partitionBy("schema_valid").parquet(f"{path}/log/batch_id={batch_id}")

    _finish(stream.writeStream.foreachBatch(write), f"{path}/state")
    marks = [T.StructField("schema_valid", T.BooleanType()), T.StructField("batch_id", T.LongType())]
    both = (
        spark.read.option("basePath", f"{path}/log")
        .schema(T.StructType([*stream.schema, *marks]))
        .parquet(f"{path}/log")
        .drop("batch_id")
    )
    valid = F.col("schema_valid")
    return both.where(valid).drop("schema_valid"), both.where(~valid).drop("schema_valid")
