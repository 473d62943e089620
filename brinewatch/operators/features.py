"""Quality features per row: latency, missing values, skew, order, integrity, flag stability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewatch import schema as S
from brinewatch.functions import missing_rate, number
from brinewatch.operators.skew import DEFAULT_POLICY, Chunks, Hot, HotPolicy, hot_devices, order_columns, ordered_chunks

#: Flags whose changes are counted; ``conc_ok`` is left out, it merely negates the two others.
STABILITY_FLAGS = (
    "temp_below_setpoint", "rinse_temp_below_setpoint", "conc_constant_over", "conc_constant_under",
)
LATENCY_ROWS = 5


def add_latency(df: DataFrame, *, now: Column | None = None, keep_given: bool = False) -> DataFrame:
    """Insert-time columns: persisted and ingest time default, latency from the broker append.

    ``keep_given`` keeps an existing ``latency_seconds`` instead of overwriting it.
    """
    now = now if now is not None else F.current_timestamp()
    null_ts = F.lit(None).cast("timestamp")
    given_ingest = F.col("ingest_at") if "ingest_at" in df.columns else null_ts
    given_event = F.col("event_latency_seconds") if "event_latency_seconds" in df.columns else F.lit(None).cast("double")
    given = F.col("latency_seconds") if "latency_seconds" in df.columns else F.lit(None).cast("double")
    persisted = F.coalesce(F.col("persisted_at"), now)
    measured = F.coalesce(
        (F.unix_micros("persisted_at") / 1000.0 - F.col("kafka_logappend_ms")) / 1000.0, given_event
    )
    filled = df.withColumn("persisted_at", persisted)
    filled = filled.withColumn("ingest_at", F.coalesce(given_ingest, F.col("persisted_at")))
    filled = filled.withColumn("event_latency_seconds", measured)
    latency = F.coalesce(given, F.col("event_latency_seconds")) if keep_given else F.col("event_latency_seconds")
    return filled.withColumn("latency_seconds", latency)


def fal_seconds(ready_ms: Column, append_ms: Column) -> Column:
    """Append-to-ready lag of one row in seconds; NULL when the append time is missing."""
    return (ready_ms - append_ms) / 1000.0


def batch_latency(
    flags_at: str = "flags_computed_at", ingest: str = "ingest_at", latency: str = "latency_seconds"
) -> Column:
    """Append-to-flags lag of a batch in seconds: from ingest to the flags, plus the latency before ingest.

    NULL without an ingest or flags time; a missing latency counts as none.
    """
    waited = (F.unix_micros(F.col(flags_at)) - F.unix_micros(F.col(ingest))) / 1e6
    return waited + F.coalesce(number(F.col(latency)), F.lit(0.0))


def row_quality(processing: str = "ingest_at", time: str = S.TIME) -> dict[str, Column]:
    """Features that need only the row itself."""
    rate = missing_rate()
    floor_s = F.floor(F.unix_micros(F.col(processing)) / 1_000_000)
    return {
        "missing_rate": rate,
        "field_consistency_score": F.lit(1.0) - rate,
        "timestamp_skew_ms": F.abs(floor_s - F.col(time).cast("double")) * 1000,
    }


def _latency(chunks: Chunks, latency: str) -> dict[str, Column]:
    value = number(F.col(latency))
    frame = chunks.ordered.rowsBetween(-(LATENCY_ROWS - 1), 0)
    return {
        "latency_raw": value,
        "latency_rolling_mean_5min": F.avg(value).over(frame),
        "latency_volatility": F.coalesce(F.stddev_samp(value).over(frame), F.lit(0.0)),
    }


def latency_rolling(
    df: DataFrame, latency: str = "latency_seconds", *,
    keys: Sequence[str] = S.DEVICE, order: Sequence[str] = S.BY_TIME,
    hot: Hot | None = None, policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Mean and sample deviation of the last five rows' latency."""
    chunks = ordered_chunks(df, keys=keys, order=order, rows_back=LATENCY_ROWS - 1, hot=hot, policy=policy)
    return chunks.done(chunks.df.withColumns(_latency(chunks, latency)))


def _steps_back(chunks: Chunks, time: str) -> Column:
    return F.coalesce(F.col(time) < F.lag(time).over(chunks.ordered), F.lit(False))


def ooo_indicator(
    df: DataFrame, time: str = S.TIME, *,
    keys: Sequence[str] = S.DEVICE, order: Sequence[str] = S.BY_ARRIVAL,
    hot: Hot | None = None, policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Event time steps back from the row before, in arrival order."""
    chunks = ordered_chunks(df, keys=keys, order=order, rows_back=1, hot=hot, policy=policy)
    return chunks.done(chunks.df.withColumn("out_of_order_indicator", _steps_back(chunks, time)))


def _stability(chunks: Chunks, flags: Sequence[str]) -> dict[str, Column]:
    def as_number(name: str) -> Column:
        return F.col(name).cast("double")

    flips = sum(
        (
            F.coalesce(F.abs(as_number(f) - F.lag(as_number(f)).over(chunks.ordered)), F.lit(0.0))
            for f in flags
        ),
        F.lit(0.0),
    )
    flip_rate = flips / F.lit(float(max(len(flags), 1)))

    def any_of(part: str) -> Column:
        named = [F.coalesce(as_number(f), F.lit(0.0)) for f in flags if part in f]
        return F.greatest(F.lit(0.0), *named) if named else F.lit(0.0)

    return {
        "flag_flip_rate": flip_rate,
        "freq_temp_flag": any_of("temp"),
        "freq_conductivity_flag": any_of("conc"),
        "combined_flag_stability": F.lit(1.0)
        - F.least(F.lit(1.0), flip_rate / F.greatest(chunks.size, F.lit(1))),
    }


def flag_stability(
    df: DataFrame, flags: Sequence[str] = STABILITY_FLAGS, *,
    keys: Sequence[str] = S.DEVICE, order: Sequence[str] = S.BY_TIME,
    hot: Hot | None = None, policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Share of flags that changed since the row before, and what follows from it."""
    present = [f for f in flags if f in df.columns]
    chunks = ordered_chunks(df, keys=keys, order=order, rows_back=1, hot=hot, policy=policy)
    return chunks.done(chunks.df.withColumns(_stability(chunks, present)))


def _integrity(chunks: Chunks, rate: float, minutes: Sequence[int]) -> dict[str, Column]:
    out = {}
    for m in minutes:
        expected = max(rate * m, 1.0)
        out[f"event_count_ratio_{m}min"] = F.lit(1.0)
        out[f"window_integrity_score_{m}min"] = F.least(chunks.size / F.lit(expected), F.lit(1.0))
    return out


def batch_integrity(
    df: DataFrame, *, rate_per_minute: float = 60.0, minutes: Sequence[int] = (1, 5, 15),
    keys: Sequence[str] = S.DEVICE, order: Sequence[str] = S.BY_TIME,
    hot: Hot | None = None, policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Rows of the group relative to the number expected in each window."""
    chunks = ordered_chunks(df, keys=keys, order=order, rows_back=0, hot=hot, policy=policy)
    return chunks.done(chunks.df.withColumns(_integrity(chunks, rate_per_minute, minutes)))


def add_features(
    df: DataFrame,
    *,
    flags: Sequence[str] = STABILITY_FLAGS,
    latency: str = "latency_seconds",
    processing: str = "ingest_at",
    rate_per_minute: float = 60.0,
    keys: Sequence[str] = S.DEVICE,
    order: Sequence[str] = S.BY_TIME,
    arrival: Sequence[str] = S.BY_ARRIVAL,
    now: Column | None = None,
    hot: Hot | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """All features in one pass over one exchange; only hot devices are cut a second time, along arrival."""
    present = [f for f in flags if f in df.columns]
    time = order[0]
    if hot is None or hot.keys != tuple(keys):
        hot = hot_devices(df, keys, time, policy)
    if not hot.empty:
        df = ooo_indicator(df, time, keys=keys, order=arrival, policy=policy)
    chunks = ordered_chunks(df, keys=keys, order=order, rows_back=LATENCY_ROWS - 1, hot=hot, policy=policy)
    arriving = chunks.parts.orderBy(*order_columns(arrival))
    steps_back = F.coalesce(F.col(time) < F.lag(time).over(arriving), F.lit(False))
    featured = chunks.df.withColumns(
        {
            **row_quality(processing, time),
            **_latency(chunks, latency),
            **_stability(chunks, present),
            **_integrity(chunks, rate_per_minute, (1, 5, 15)),
            "out_of_order_indicator": steps_back if hot.empty else F.col("out_of_order_indicator"),
        }
    )
    return chunks.done(featured).withColumn(
        "features_computed_at", now if now is not None else F.current_timestamp()
    )
