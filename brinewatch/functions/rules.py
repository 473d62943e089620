"""Rule expressions on single rows.  Comparisons with NULL stay NULL unless said otherwise."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewatch import schema as S


def below_setpoint_now(value: Column, setpoint: Column, active: Column) -> Column:
    """TRUE/FALSE while the programme runs and both numbers are known, else NULL."""
    known = (active >= 1) & value.isNotNull() & setpoint.isNotNull()
    return F.when(known, value < setpoint.cast("double"))


def over_band(value: Column, setpoint: Column, band: float = S.CONDUCTIVITY_BAND) -> Column:
    return value > setpoint * F.lit(1 + band)


def under_band(value: Column, setpoint: Column, band: float = S.CONDUCTIVITY_BAND) -> Column:
    return value < setpoint * F.lit(1 - band)


def in_band(
    value: Column, setpoint: Column, average: Column, band: float = S.CONDUCTIVITY_BAND
) -> Column:
    """Window average within the band; NULL unless all inputs exist and the setpoint is > 0."""
    known = value.isNotNull() & (setpoint > 0) & average.isNotNull()
    return F.when(known, average.between(setpoint * F.lit(1 - band), setpoint * F.lit(1 + band)))


def in_range(
    columns: Iterable[str] = S.SENSORS, low: float = S.SENSOR_RANGE[0], high: float = S.SENSOR_RANGE[1]
) -> Column:
    """Range contract: every sensor is missing or within [low, high]."""
    ok = F.lit(True)
    for name in columns:
        ok = ok & (F.col(name).isNull() | F.col(name).between(F.lit(low), F.lit(high)))
    return ok


def missing_rate(columns: Iterable[str] = S.SENSORS) -> Column:
    """Share of missing sensor values in the row."""
    names = list(columns)
    missing = sum((F.col(n).isNull().cast("int") for n in names), F.lit(0))
    return missing / F.lit(float(len(names)))


def conductivity_violation(
    value: Column,
    setpoint: Column,
    *,
    threshold: float = S.CONDUCTIVITY_THRESHOLD,
    band: float = S.CONDUCTIVITY_BAND,
) -> Column:
    """Distance to the setpoint exceeds both the absolute and the relative tolerance.

    FALSE when a value is missing or the setpoint is not positive.
    """
    tolerance = F.greatest(setpoint * F.lit(band), F.lit(threshold))
    return F.coalesce((setpoint > 0) & (F.abs(value - setpoint) > tolerance), F.lit(False))


def alarm_flag(
    df: DataFrame,
    *,
    flags: Iterable[str] = S.RULE_FLAGS,
    threshold: float = S.CONDUCTIVITY_THRESHOLD,
    band: float = S.CONDUCTIVITY_BAND,
    op_state_alarm: int = S.OP_STATE_ALARM,
) -> Column:
    """Any rule flag, own alarm, conductivity violation or high operating state.

    Columns that ``df`` does not have are left out.
    """
    have = set(df.columns)
    parts = []
    for name in ("y_alarm", *flags):
        if name in have:
            parts.append(F.coalesce(F.col(name).cast("double"), F.lit(0.0)) >= 1)
    if {"mean_conductivity", "setpoint_conductivity"} <= have:
        parts.append(
            conductivity_violation(
                F.col("mean_conductivity"), F.col("setpoint_conductivity"),
                threshold=threshold, band=band,
            )
        )
    if "op_state" in have:
        parts.append(F.coalesce(F.col("op_state") >= op_state_alarm, F.lit(False)))
    hit = F.lit(False)
    for part in parts:
        hit = hit | part
    return hit
