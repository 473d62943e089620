"""Transforms of streaming frames, and the stream-style jobs run on them.

All state is bounded by the watermark ``delay``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewatch import schema as S
from brinewatch.functions import in_range
from brinewatch.operators.joins import asof_setpoints, join_setpoints, stream_setpoints
from brinewatch.operators.tumbling import point_flags, tumbling_stats
from brinewatch.plans import stream as plans
from brinewatch.session import scratch_dir
from brinewatch.streaming.served import ServedStream, Table, current

DELAY = "10 minutes"


def tumbling(events: DataFrame, *, ts: str = "kafka_ts", delay: str = DELAY, **options) -> DataFrame:
    """Closed windows per device; partial sums are combined before the state shuffle.

    In append mode a window comes out once the watermark has passed its end; the upsert form
    (``drain_upserts``) has open windows as well.
    """
    return tumbling_stats(events, ts=ts, delay=delay, **options)


def deduplicated(
    events: DataFrame, *, key: str = S.EVENT_ID, ts: str = "kafka_ts", delay: str = DELAY
) -> DataFrame:
    """First arrival of each key within the watermark; rows without a key all pass."""
    timed = events.withWatermark(ts, delay)
    keyed = timed.where(F.col(key).isNotNull()).dropDuplicatesWithinWatermark([key])
    return keyed.unionByName(timed.where(F.col(key).isNull()))


def validated(events: DataFrame) -> DataFrame:
    """Only rows within the range contract."""
    return events.where(in_range())


def enriched(events: DataFrame, machines: DataFrame) -> DataFrame:
    """Row flags against the machines' setpoints."""
    return stream_setpoints(events, machines).withColumns(point_flags())


def kappa_stream(
    events: DataFrame, machines: Table, path: str, *, raw_time: str = S.TIME, ts: str = "kafka_ts", delay: str = DELAY
) -> ServedStream:
    """Each event at once with its row flags; its window is added when the table is read."""

    def enrich(batch: DataFrame) -> DataFrame:
        return join_setpoints(batch, current(machines)).withColumns(plans.kappa_row(raw_time, ts))

    return ServedStream(events, path, enrich, ts=ts, delay=delay)


def speed_stream(
    events: DataFrame, machines: Table, path: str, *, raw_time: str = S.TIME, ts: str = "kafka_ts", delay: str = DELAY
) -> ServedStream:
    """The speed layer of the two-layer style."""

    def enrich(batch: DataFrame) -> DataFrame:
        return join_setpoints(batch, current(machines)).withColumns(plans.speed_row(raw_time, ts))

    return ServedStream(events, path, enrich, ts=ts, delay=delay)


def fabric_stream(
    events: DataFrame, versions: Table, path: str, *, raw_time: str = S.TIME, ts: str = "kafka_ts", delay: str = DELAY
) -> ServedStream:
    """Valid rows with setpoints as of the event; windows on event time cover all rows with a sensor value."""

    def enrich(batch: DataFrame) -> DataFrame:
        timed = batch.withColumn("_event_ts", F.timestamp_seconds(S.TIME))
        return asof_setpoints(timed, current(versions)).withColumns(plans.fabric_row(raw_time, ts))

    sensed = F.coalesce(*(F.col(s) for s in S.SENSORS)).isNotNull()
    return ServedStream(events, path, enrich, ts="_event_ts", delay=delay, counted=sensed, shown=F.col("schema_valid"))


def run_kappa(events: DataFrame, machines: Table, *, ts: str = "kafka_ts", **options) -> DataFrame:
    """Stream-only style: all events come out, those of open windows and late ones (``late``) included.

    ``conc_ok`` and ready time follow the event's window. ``machines`` may be a function that reads the table:
    it is called for every micro-batch.
    """
    served = kappa_stream(events, machines, scratch_dir(events.sparkSession, "kappa"), ts=ts, **options)
    return served.drain().withColumns(plans.kappa_window(ts))


def run_speed(events: DataFrame, machines: Table, *, ts: str = "kafka_ts", **options) -> DataFrame:
    """The speed layer on a stream."""
    served = speed_stream(events, machines, scratch_dir(events.sparkSession, "speed"), ts=ts, **options)
    return served.drain().withColumns(plans.speed_window(ts))


def run_fabric(events: DataFrame, versions: Table, **options) -> DataFrame:
    """Validated style on a stream; ``versions`` may be a function that reads them for every micro-batch.

    Rejected rows can be had from the same source with ``drain_split``.
    """
    served = fabric_stream(events, versions, scratch_dir(events.sparkSession, "fabric"), **options)
    return served.drain().withColumns(plans.fabric_window()).drop("_event_ts")
