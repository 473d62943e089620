"""Stream-style jobs in their batch form, the speed-plus-batch merge, and domain products.

The streaming counterparts in ``brinewatch.streaming`` use the same column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewatch import schema as S
from brinewatch.functions import append_ms, event_ms, event_s_whole, fallback_key, in_range, ready_at
from brinewatch.operators import domains
from brinewatch.operators.joins import asof_setpoints, join_setpoints
from brinewatch.operators.skew import DEFAULT_POLICY, HotPolicy, hot_devices
from brinewatch.operators.tumbling import attach_window, conc_ok_column, point_flags, quiet_flags
from brinewatch.plans.batch import feature_batch, flag_batch
from brinewatch.sources.sinks import overwrite_columns

BATCH_FLAGS = (
    "temp_below_setpoint", "rinse_temp_below_setpoint", "conc_constant_over", "conc_constant_under",
    "conc_ok", "flags_computed_at", "features_ready_ms",
)


def kappa_job(
    events: DataFrame, machines: DataFrame, *, raw_time: str = S.TIME, ts: str = "kafka_ts",
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Stream-only style: row flags, windowed conductivity check, ready at the window's end."""
    hot = hot_devices(events, S.DEVICE, S.TIME, policy)
    rows = attach_window(join_setpoints(events, machines, hot=hot), ts=ts, source=events, hot=hot)
    return rows.withColumns({**kappa_row(raw_time, ts), **kappa_window(ts)})


def kappa_row(raw_time: str, ts: str) -> dict[str, Column]:
    """What is known of an event by itself, once its setpoints are there."""
    appended = append_ms(F.col(ts))
    return {
        "event_id": fallback_key(F.col(S.EVENT_ID), appended, F.col(S.MAC)),
        "event_time_utc_ms": event_ms(F.col(raw_time), on_null="null", guarded=False),
        "kafka_logappend_ms": appended,
        **point_flags(),
        **quiet_flags(),
    }


def kappa_window(ts: str) -> dict[str, Column]:
    """What an event's window adds."""
    ready = ready_at(F.col("window_end"), F.col(ts), S.WINDOW_MINUTES)
    return {"conc_ok": conc_ok_column(), "flags_computed_at": ready, "stream_features_ready_at": ready}


def speed_job(
    events: DataFrame, machines: DataFrame, *, raw_time: str = S.TIME, ts: str = "kafka_ts",
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Speed layer: as above with guarded event time, keyed as given, flags not yet final."""
    hot = hot_devices(events, S.DEVICE, S.TIME, policy)
    rows = attach_window(join_setpoints(events, machines, hot=hot), ts=ts, source=events, hot=hot)
    return rows.withColumns({**speed_row(raw_time, ts), **speed_window(ts)})


def speed_row(raw_time: str, ts: str) -> dict[str, Column]:
    return {
        "event_time_utc_ms": event_ms(F.col(raw_time), on_null="null"),
        "kafka_logappend_ms": append_ms(F.col(ts)),
        **point_flags(),
        **quiet_flags(),
        "flags_computed_at": F.lit(None).cast("timestamp"),
    }


def speed_window(ts: str) -> dict[str, Column]:
    return {
        "conc_ok": conc_ok_column(),
        "speed_features_ready_at": ready_at(F.col("window_end"), F.col(ts), S.WINDOW_MINUTES),
    }


def serving_merge(speed: DataFrame, batch: DataFrame) -> DataFrame:
    """Serving view: the batch layer's flags replace those of the speed layer where it has run."""
    return overwrite_columns(speed, batch, key=S.EVENT_ID, columns=BATCH_FLAGS)


def lambda_job(
    events: DataFrame, machines: DataFrame, *, raw_time: str = S.TIME, now: Column | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    speed = speed_job(events, machines, raw_time=raw_time, policy=policy)
    return serving_merge(speed, flag_batch(events, machines, now=now, policy=policy))


def fabric_job(
    events: DataFrame, versions: DataFrame, *, raw_time: str = S.TIME, ts: str = "kafka_ts",
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Validated style: range contract, setpoints as of the event, windows on event time.

    Windows cover all events with any sensor value; only the output rows must be valid.
    """
    hot = hot_devices(events, S.DEVICE, S.TIME, policy)
    timed = events.withColumn("_event_ts", F.timestamp_seconds(S.TIME))
    valid = timed.where(in_range())
    rows = attach_window(
        asof_setpoints(valid, versions, hot=hot), ts="_event_ts", source=timed, drop_empty=True, hot=hot
    )
    return rows.withColumns({**fabric_row(raw_time, ts), **fabric_window()}).drop("_event_ts")


def fabric_row(raw_time: str, ts: str) -> dict[str, Column]:
    return {
        **point_flags(),
        **quiet_flags(),
        "schema_valid": in_range(),
        "event_time_utc_ms": event_ms(F.col(raw_time), on_null="null"),
        S.TIME: event_s_whole(F.col(raw_time)),
        "kafka_logappend_ms": append_ms(F.col(ts), F.col("produced_at_ms")),
    }


def fabric_window() -> dict[str, Column]:
    return {"conc_ok": conc_ok_column(), "stream_features_ready_at": F.col("window_end")}


def mesh_job(
    events: DataFrame, machines: DataFrame, *, now: Column | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Domain style: flags and features per event, labelled with the owning domain."""
    return domains.with_domain(feature_batch(events, machines, now=now, policy=policy))
