"""Column functions: normalisation, coercion and rule expressions."""

from brinewatch.functions.normalize import (
    append_ms,
    enable_flag,
    epoch_ms,
    epoch_s,
    event_ms,
    event_s,
    event_s_whole,
    fallback_key,
    false_if_null,
    null_if_nan,
    number,
    ready_at,
    steady_round,
)
from brinewatch.functions.rules import (
    alarm_flag,
    below_setpoint_now,
    conductivity_violation,
    in_band,
    in_range,
    missing_rate,
    over_band,
    under_band,
)

__all__ = [
    "alarm_flag", "append_ms", "below_setpoint_now", "conductivity_violation", "enable_flag",
    "epoch_ms", "epoch_s", "event_ms", "event_s", "event_s_whole", "fallback_key",
    "false_if_null", "in_band", "in_range", "missing_rate", "null_if_nan", "number",
    "over_band", "ready_at", "steady_round", "under_band",
]
