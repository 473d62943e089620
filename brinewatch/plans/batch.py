"""Batch jobs: flags over the whole history, and flags plus quality features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewatch import schema as S
from brinewatch.functions import epoch_ms
from brinewatch.operators.features import add_features, fal_seconds
from brinewatch.operators.flags import detect_anomalies
from brinewatch.operators.joins import join_setpoints
from brinewatch.operators.rolling import rolling_means
from brinewatch.operators.skew import DEFAULT_POLICY, LANE, HotPolicy, hot_devices, with_lane
from brinewatch.operators.tumbling import quiet_flags
from brinewatch.sources.pending import pending


def baseline_job(
    events: DataFrame, machines: DataFrame, *, now: Column | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Pending rows -> setpoints -> rolling means -> flags on the 15-minute conductivity."""
    now = now if now is not None else F.current_timestamp()
    rows = pending(events)
    hot = hot_devices(rows, S.DEVICE, S.TIME, policy)
    laned = with_lane(join_setpoints(rows, machines, hot=hot), S.DEVICE, hot)
    rolled = rolling_means(laned, hot=hot)
    flagged = detect_anomalies(rolled, conc_col="rolling_conductivity_avg_15min", hot=hot).drop(LANE)
    ready = epoch_ms(now)
    return flagged.withColumns(
        {
            **quiet_flags(),
            "flags_computed_at": now,
            "features_ready_ms": ready,
            "fal_seconds": fal_seconds(ready, F.col("kafka_logappend_ms")),
        }
    )


def flag_batch(
    events: DataFrame, machines: DataFrame, *, now: Column | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Flags of all rows on raw conductivity: what the batch layer overwrites the speed layer with."""
    now = now if now is not None else F.current_timestamp()
    hot = hot_devices(events, S.DEVICE, S.TIME, policy)
    flagged = detect_anomalies(join_setpoints(events, machines, hot=hot), hot=hot)
    return flagged.withColumns(
        {**quiet_flags(), "flags_computed_at": now, "features_ready_ms": epoch_ms(now)}
    )


def feature_batch(
    events: DataFrame, machines: DataFrame, *, now: Column | None = None,
    rate_per_minute: float = 60.0, policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Flags and quality features of rows without features."""
    now = now if now is not None else F.current_timestamp()
    rows = pending(events, done="features_computed_at")
    hot = hot_devices(rows, S.DEVICE, S.TIME, policy)
    laned = with_lane(join_setpoints(rows, machines, hot=hot), S.DEVICE, hot)
    flagged = detect_anomalies(laned, hot=hot)
    featured = add_features(flagged, rate_per_minute=rate_per_minute, now=now, hot=hot).drop(LANE)
    return featured.withColumns(
        {
            **quiet_flags(),
            "window_integrity_5min": F.col("window_integrity_score_5min"),
            "features_ready_ms": epoch_ms(now),
            "flags_computed_at": now,
        }
    )
