"""Column names, event formats and thresholds shared by all operators."""

from __future__ import annotations

# --- Fixed values: message fields, their columns and types -------------------------------
EVENT_FIELDS: dict[str, tuple[str, str]] = {
    "Id": ("event_id", "string"),
    "DeviceID": ("device_id", "string"),
    "MACAddressString": ("mac_address_string", "string"),
    "BeaconEventID": ("beacon_event_id", "int"),
    "MeanConductivity": ("mean_conductivity", "double"),
    "SetpointConductivity": ("setpoint_conductivity", "double"),
    "MeanWashTankTemp": ("mean_wash_tank_temp", "double"),
    "MeanRinseTemp": ("mean_rinse_temp", "double"),
    "EnFillOn": ("en_fill_on", "int"),
    "EnRinseOn": ("en_rinse_on", "int"),
    "EnWashOn": ("en_wash_on", "int"),
    "VersionAndMessageType": ("version_and_message_type", "int"),
    "DateTimeUTC": ("date_time_utc", "bigint"),
    "_produced_at_ms": ("produced_at_ms", "bigint"),
}

# --- Fixed values: machine list header -> column and type --------------------------------
MACHINE_FIELDS: dict[str, tuple[str, str]] = {
    "MACAdress String": ("mac", "string"),
    "Device Name": ("device_name", "string"),
    "Maschine Name And Model": ("model", "string"),
    "Site": ("site", "string"),
    "Wash Temp Threshold": ("wash_temp_setpoint", "int"),
    "Rinse Temp Threshold": ("rinse_temp_setpoint", "int"),
    "Dosing Unit Type": ("dosing_unit_type", "string"),
    "Energy KW": ("energy_kw", "float"),
}

# --- Fixed values: columns of a run extract ----------------------------------------------
EXTRACT_TYPES: dict[str, str] = {
    "mac_address_string": "string",
    "beacon_event_id": "int",
    "date_time_utc": "bigint",
    "event_time_utc_ms": "bigint",
    "kafka_logappend_ms": "bigint",
    "produced_at_ms": "bigint",
    "event_latency_seconds": "double",
    "fal_seconds": "double",
    "features_ready_ms": "bigint",
    "flags_computed_at": "timestamp",
    "speed_features_ready_at": "timestamp",
    "stream_features_ready_at": "timestamp",
    "op_state": "int",
    "mean_conductivity": "double",
    "setpoint_conductivity": "double",
    "mean_wash_tank_temp": "double",
    "mean_rinse_temp": "double",
    "persisted_at": "timestamp",
}

# --- Fixed values: rule flags that make up an alarm --------------------------------------
RULE_FLAGS = (
    "temp_below_setpoint",
    "rinse_temp_below_setpoint",
    "conc_constant_over",
    "conc_constant_under",
    "wash_temp_recovery_failure",
    "rinse_temp_recovery_failure",
    "conc_recovery_failure",
    "wash_temp_repeated_issue",
    "rinse_temp_repeated_issue",
    "conc_repeated_issue",
    "wash_temp_high_variance",
    "rinse_temp_high_variance",
)

# --- Fixed values: thresholds -------------------------------------------------------------
SENSORS = ("mean_wash_tank_temp", "mean_rinse_temp", "mean_conductivity")
SENSOR_RANGE = (0.0, 255.0)
CONDUCTIVITY_BAND = 0.1
CONDUCTIVITY_THRESHOLD = 1.0
OP_STATE_ALARM = 100
WINDOW_MINUTES = 20
RECOVERY_WINDOW_S = 600
REPEATED_ISSUE_WINDOW_S = 7200
REPEATED_ISSUE_MIN_COUNT = 2
VARIANCE_WINDOW_S = 1200
VARIANCE_THRESHOLD = 9.0
DOMAINS = ("washing", "rinsing", "chemistry")

MAC = "mac_address_string"
TIME = "date_time_utc"
EVENT_ID = "event_id"
DEVICE = (MAC,)
BY_TIME = (TIME, EVENT_ID)
BY_ARRIVAL = ("persisted_at", "kafka_logappend_ms", EVENT_ID)

#: Contracts: required message columns, their types and, for the product contract, enums.
CONTRACT_REQUIRED = tuple(
    column for field, (column, _) in EVENT_FIELDS.items() if not field.startswith("_")
)
# What the product contract allows.
PRODUCT_ENUMS = {"architecture": ("datamesh",), "data_product": DOMAINS}


def message_schema() -> str:
    """DDL for ``from_json``; the event time stays text so that odd numbers survive."""
    columns = [
        f"`{field}` {'string' if field == 'DateTimeUTC' else kind}"
        for field, (_, kind) in EVENT_FIELDS.items()
    ]
    return ", ".join([*columns, "`_corrupt_record` string"])
