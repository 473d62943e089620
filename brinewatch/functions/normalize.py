"""Times, keys and lenient casts.  Every function takes and returns columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Larger numbers are milliseconds, smaller ones seconds.
MS_LIMIT = 1_000_000_000_000


def _whole(value: Column) -> Column:
    """Lenient whole number: text and reals are accepted, anything else is NULL."""
    return F.coalesce(value.try_cast("bigint"), value.try_cast("double").try_cast("bigint"))


def event_ms(value: Column, *, on_null: str = "zero", guarded: bool = True) -> Column:
    """Event time in milliseconds.

    ``guarded`` leaves values that already are milliseconds alone.  ``on_null`` decides what a
    missing or unreadable time becomes: ``zero`` or ``null``.
    """
    v = _whole(value)
    scaled = F.try_multiply(v, F.lit(1000).cast("bigint"))
    out = F.when(v > MS_LIMIT, v).otherwise(scaled) if guarded else scaled
    return F.coalesce(out, F.lit(0).cast("bigint")) if on_null == "zero" else out


def event_s(value: Column) -> Column:
    """Event time in seconds, with fractions (milliseconds are divided)."""
    v = value.try_cast("double")
    return F.when(v > MS_LIMIT, v / 1000).otherwise(v)


def event_s_whole(value: Column) -> Column:
    """Event time in whole seconds (milliseconds are divided without remainder)."""
    v = _whole(value)
    return F.when(v > MS_LIMIT, F.floor(v / 1000).cast("bigint")).otherwise(v)


def epoch_s(ts: Column) -> Column:
    """Timestamp (or its text) to seconds since the epoch; unreadable text is NULL."""
    return F.unix_micros(ts.try_cast("timestamp")) / F.lit(1_000_000.0)


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def append_ms(ts: Column, produced_ms: Column | None = None) -> Column:
    """Broker append time in ms, at whole seconds; with ``produced_ms`` the later of the two.

    Comparing with a missing time gives NULL, as in SQL, rather than the other value.
    """
    whole = F.floor(F.unix_micros(ts) / 1_000_000).cast("bigint") * 1000
    if produced_ms is None:
        return whole
    both = whole.isNotNull() & produced_ms.isNotNull()
    return F.when(both, F.greatest(whole, produced_ms.cast("bigint")))


def fallback_key(event_id: Column, append_time_ms: Column, mac: Column) -> Column:
    """The event's own id, else one built from append time and device."""
    built = F.concat(F.lit("fallback_"), append_time_ms.cast("string"), F.lit("_"), mac)
    return F.coalesce(event_id, built)


def ready_at(window_end: Column, ts: Column, minutes: int) -> Column:
    """When a row's windowed features are complete: its window's end, else ``ts`` + minutes."""
    return F.coalesce(window_end, ts + F.make_dt_interval(mins=F.lit(minutes)))


def number(value: Column) -> Column:
    """Lenient cast to double; NaN counts as missing."""
    return null_if_nan(value.try_cast("double"))


def null_if_nan(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def enable_flag(value: Column) -> Column:
    """Enable flags as whole numbers; missing or unreadable is 0."""
    return F.coalesce(value.try_cast("double").try_cast("int"), F.lit(0))


def false_if_null(value: Column) -> Column:
    return F.coalesce(value.cast("boolean"), F.lit(False))


def steady_round(value: Column, digits: int) -> Column:
    """Half-up rounding that the last bits of a floating-point sum cannot tip at a tie."""
    return F.round(F.round(value, 12), digits)
