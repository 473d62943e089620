"""Tumbling-window aggregates per device and the flags that need them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewatch import schema as S
from brinewatch.functions import below_setpoint_now, in_band, over_band, under_band
from brinewatch.operators.skew import DEFAULT_POLICY, Hot, HotPolicy, hot_devices, salted_join

#: Flags the streams declare but never raise.
QUIET_FLAGS = S.RULE_FLAGS[4:]


def decimals(value: Column) -> Column:
    """The number as it is written, for sums that no order of rows can tip; NULL beyond a billion."""
    real = value.cast("double")
    return F.when(F.abs(real) < 1e9, real.try_cast("decimal(38,18)"))


def exact_mean(total: Column, known: Column, rough: Column, count: Column) -> Column:
    """The mean from the sum of ``known`` decimals, or from the ``rough`` sum if other values occur."""
    mean = F.try_divide(total, known.cast("decimal(20,0)")).cast("double")
    return F.coalesce(F.when(known == count, mean), F.try_divide(rough, count))


def _average(column: str) -> Column:
    exact, value = decimals(F.col(column)), F.col(column).cast("double")
    return exact_mean(F.try_sum(exact), F.count(exact), F.sum(value), F.count(value))


def tumbling_stats(
    df: DataFrame,
    *,
    ts: str = "kafka_ts",
    minutes: int = S.WINDOW_MINUTES,
    key: str = S.MAC,
    drop_empty: bool = False,
    delay: str | None = None,
) -> DataFrame:
    """Sensor statistics per device and window; the same code serves batch and stream.

    ``drop_empty`` leaves out rows without any sensor value; ``delay`` sets the watermark. The average is that of
    the decimal numbers, so one on the edge of a band does not depend on the order of additions.
    """
    rows = df.withWatermark(ts, delay) if delay else df
    if drop_empty:
        rows = rows.where(F.coalesce(*[F.col(s) for s in S.SENSORS]).isNotNull())
    return rows.groupBy(F.window(ts, f"{minutes} minutes").alias("window"), key).agg(
        _average("mean_conductivity").alias("avg_conductivity"),
        F.min("mean_wash_tank_temp").alias("min_wash_temp"),
        F.max("mean_wash_tank_temp").alias("max_wash_temp"),
        F.count("mean_wash_tank_temp").alias("wash_temp_count"),
        F.min("mean_rinse_temp").alias("min_rinse_temp"),
        F.max("mean_rinse_temp").alias("max_rinse_temp"),
        F.count("mean_rinse_temp").alias("rinse_temp_count"),
        F.count(F.lit(1)).alias("total_events"),
    )


def point_flags() -> dict[str, Column]:
    """Three-valued flags of a single row that carries its setpoints."""
    conc, sp = F.col("mean_conductivity"), F.col("setpoint_conductivity")
    return {
        "temp_below_setpoint": below_setpoint_now(
            F.col("mean_wash_tank_temp"), F.col("wash_temp_setpoint"), F.col("en_wash_on")
        ),
        "rinse_temp_below_setpoint": below_setpoint_now(
            F.col("mean_rinse_temp"), F.col("rinse_temp_setpoint"), F.col("en_rinse_on")
        ),
        "conc_constant_over": over_band(conc, sp),
        "conc_constant_under": under_band(conc, sp),
    }


def quiet_flags() -> dict[str, Column]:
    return {name: F.lit(False) for name in QUIET_FLAGS}


def conc_ok_column(average: str = "avg_conductivity") -> Column:
    return in_band(F.col("mean_conductivity"), F.col("setpoint_conductivity"), F.col(average))


def attach_window(
    df: DataFrame,
    *,
    ts: str = "kafka_ts",
    minutes: int = S.WINDOW_MINUTES,
    drop_empty: bool = False,
    only: Column | None = None,
    source: DataFrame | None = None,
    columns: Sequence[str] = ("avg_conductivity",),
    hot: Hot | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Give each row its own window's aggregates and ``window_end`` (NULL if there are none).

    ``source`` gives other rows than ``df`` to build the windows from, ``only`` restricts them.  The aggregate is combined map-side and
    joined back on (device, window); rows of hot devices are spread over salts.
    """
    hot = hot or hot_devices(df, S.DEVICE, S.TIME, policy)
    span = minutes * 60_000_000
    start = F.unix_micros(F.col(ts))
    counted = source if source is not None else df
    counted = counted.where(only) if only is not None else counted
    stats = tumbling_stats(
        counted.select(ts, S.MAC, *S.SENSORS), ts=ts, minutes=minutes, drop_empty=drop_empty
    ).select(
        S.MAC,
        F.unix_micros("window.start").alias("_start"),
        F.col("window.end").alias("window_end"),
        *columns,
    )
    rows = df.withColumn("_start", start - F.pmod(start, F.lit(span)))
    joined = salted_join(
        rows, stats.where(F.col(S.MAC).isNotNull()), [S.MAC, "_start"], hot=hot, salt_on=S.EVENT_ID
    )
    return joined.drop("_start")
