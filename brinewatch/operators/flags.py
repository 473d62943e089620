"""Sustained anomaly flags per device (batch meaning: two-valued, missing compares FALSE)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewatch import schema as S
from brinewatch.functions import enable_flag, number, over_band, under_band
from brinewatch.operators.skew import DEFAULT_POLICY, Chunks, Hot, HotPolicy, hot_devices, ordered_chunks

WINDOW_ROWS = 4
MIN_SHARE = 0.5


def _sustained(now: Column, chunks: Chunks) -> Column:
    """Three-way rule: 1 row -> now; 2-3 rows -> now and before; else > half of the last four."""
    w = chunks.ordered
    share = F.avg(now.cast("int")).over(w.rowsBetween(-(WINDOW_ROWS - 1), 0))
    return (
        F.when(chunks.size < 2, now)
        .when(chunks.size < WINDOW_ROWS, now & F.lag(now, 1, False).over(w))
        .otherwise(share > MIN_SHARE)
    )


def _known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _chunks(
    df: DataFrame, rows_back: int, keys: Sequence[str], order: Sequence[str],
    hot: Hot | None, policy: HotPolicy,
) -> Chunks:
    return ordered_chunks(
        df, keys=keys, order=order, rows_back=rows_back, hot=hot, policy=policy
    )


def below_setpoint(
    df: DataFrame,
    value: str,
    setpoint: str,
    active: str,
    out: str,
    *,
    keys: Sequence[str] = S.DEVICE,
    order: Sequence[str] = S.BY_TIME,
    hot: Hot | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Sustained temperature below the setpoint; only rows with ``active = 1`` may be TRUE."""
    chunks = _chunks(df, WINDOW_ROWS - 1, keys, order, hot, policy)
    return chunks.done(
        chunks.df.withColumn(out, _below(chunks, value, setpoint, active))
    )


def _below(chunks: Chunks, value: str, setpoint: str, active: str) -> Column:
    now = _known(number(F.col(value)) < F.col(setpoint).cast("double"))
    valid = F.col(chunks.keys[-1]).isNotNull() & (enable_flag(F.col(active)) == 1)
    return F.when(valid, _sustained(now, chunks)).otherwise(F.lit(False))


def _band_flags(chunks: Chunks, value: str, setpoint: str, band: float) -> dict[str, Column]:
    v, sp = number(F.col(value)), number(F.col(setpoint))
    named = F.col(chunks.keys[-1]).isNotNull()
    return {
        "conc_constant_over": named & _sustained(_known(over_band(v, sp, band)), chunks),
        "conc_constant_under": named & _sustained(_known(under_band(v, sp, band)), chunks),
    }


def _conc_ok() -> Column:
    return ~F.col("conc_constant_over") & ~F.col("conc_constant_under")


def sustained_band(
    df: DataFrame,
    value: str = "mean_conductivity",
    setpoint: str = "setpoint_conductivity",
    *,
    band: float = S.CONDUCTIVITY_BAND,
    keys: Sequence[str] = S.DEVICE,
    order: Sequence[str] = S.BY_TIME,
    hot: Hot | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Conductivity constantly over / under its band; ``conc_ok`` when neither."""
    chunks = _chunks(df, WINDOW_ROWS - 1, keys, order, hot, policy)
    flagged = chunks.df.withColumns(_band_flags(chunks, value, setpoint, band))
    return chunks.done(flagged.withColumn("conc_ok", _conc_ok()))


def _trend(chunks: Chunks, value: str, step: float) -> Column:
    v = number(F.col(value))
    drop = v - F.lag(v).over(chunks.ordered) < -step
    return F.col(chunks.keys[-1]).isNotNull() & _known(drop)


def trend_down(
    df: DataFrame,
    values: dict[str, str],
    *,
    step: float = 1.0,
    keys: Sequence[str] = S.DEVICE,
    order: Sequence[str] = S.BY_TIME,
    hot: Hot | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """``values`` maps a sensor to its flag: fell by more than ``step`` since the row before."""
    chunks = _chunks(df, 1, keys, order, hot, policy)
    return chunks.done(
        chunks.df.withColumns({out: _trend(chunks, v, step) for v, out in values.items()})
    )


def _violation_profile(
    df: DataFrame, hot: Hot, value: str, setpoint: str, margin: float
) -> DataFrame:
    """Share of violating rows of each hot device (map-side combined, one row for each)."""
    return (
        hot.tag(df, "inner")
        .groupBy(*hot.keys)
        .agg(F.avg(_violates(value, setpoint, margin)).alias("_hot_share"))
    )


def _with_profile(
    df: DataFrame, chunks: Chunks, hot: Hot, value: str, setpoint: str, margin: float
) -> DataFrame:
    """Chunked rows with ``_hot_share``, the violating share of their device if it is hot."""
    if hot.empty:
        return chunks.df.withColumn("_hot_share", F.lit(None).cast("double"))
    profile = _violation_profile(df, hot, value, setpoint, margin)
    return chunks.df.join(F.broadcast(profile) if hot.short else profile, list(hot.keys), "left")


def _violates(value: str, setpoint: str, margin: float) -> Column:
    return _known(number(F.col(value)) < F.col(setpoint).cast("double") - F.lit(margin)).cast("int")


def _frequent(chunks: Chunks, value: str, setpoint: str, margin: float, share: float, min_rows: int) -> Column:
    ratio = F.coalesce(
        F.col("_hot_share"), F.avg(_violates(value, setpoint, margin)).over(chunks.group)
    )
    return F.col(chunks.keys[-1]).isNotNull() & (chunks.size >= min_rows) & (ratio > share)


def frequent_violation(
    df: DataFrame,
    value: str = "mean_wash_tank_temp",
    setpoint: str = "wash_temp_setpoint",
    *,
    out: str = "temp_frequent_violation",
    margin: float = 2.0,
    share: float = 0.2,
    min_rows: int = 3,
    keys: Sequence[str] = S.DEVICE,
    order: Sequence[str] = S.BY_TIME,
    hot: Hot | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Flag every row of a device whose share of clear violations exceeds ``share``."""
    hot = hot or hot_devices(df, keys, order[0], policy)
    chunks = _chunks(df, 0, keys, order, hot, policy)
    flagged = _with_profile(df, chunks, hot, value, setpoint, margin).withColumn(
        out, _frequent(chunks, value, setpoint, margin, share, min_rows)
    )
    return chunks.done(flagged.drop("_hot_share"))


def detect_anomalies(
    df: DataFrame,
    *,
    conc_col: str = "mean_conductivity",
    keys: Sequence[str] = S.DEVICE,
    order: Sequence[str] = S.BY_TIME,
    hot: Hot | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """All batch flags in one pass: every window shares a single exchange per device chunk.

    ``df`` carries the setpoint columns (see ``join_setpoints``).
    """
    hot = hot or hot_devices(df, keys, order[0], policy)
    chunks = _chunks(df, WINDOW_ROWS - 1, keys, order, hot, policy)
    flagged = (
        _with_profile(df, chunks, hot, "mean_wash_tank_temp", "wash_temp_setpoint", 2.0)
        .withColumns(
            {
                "temp_below_setpoint": _below(
                    chunks, "mean_wash_tank_temp", "wash_temp_setpoint", "en_wash_on"
                ),
                "rinse_temp_below_setpoint": _below(
                    chunks, "mean_rinse_temp", "rinse_temp_setpoint", "en_rinse_on"
                ),
                "temp_trend_down": _trend(chunks, "mean_wash_tank_temp", 1.0),
                "rinse_temp_trend_down": _trend(chunks, "mean_rinse_temp", 1.0),
                "temp_frequent_violation": _frequent(
                    chunks, "mean_wash_tank_temp", "wash_temp_setpoint", 2.0, 0.2, 3
                ),
                **_band_flags(chunks, conc_col, "setpoint_conductivity", S.CONDUCTIVITY_BAND),
            }
        )
        .withColumn("conc_ok", _conc_ok())
        .drop("_hot_share")
    )
    return chunks.done(flagged)
