"""Normalisation, joins and anomaly flags: queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewatch import functions as fn
from brinewatch.operators import flags, joins
from brinewatch.sources.messages import parse_events
from checks import inputs as I
from checks.registry import check

KEYS = ("event_id", "mac_address_string", "date_time_utc")
M = I.SQL_MACHINES
WITH_SETPOINTS = """WITH e AS (
  SELECT b.*, m.wash_temp_setpoint, m.rinse_temp_setpoint
  FROM beacons b LEFT JOIN machines m ON b.mac_address_string = m.mac)"""
W = "PARTITION BY mac_address_string ORDER BY date_time_utc, event_id"


def sustained(now: str) -> str:
    """The three-way rule for a two-valued SQL condition column."""
    return f"""CASE WHEN n < 2 THEN {now}
      WHEN n < 4 THEN {now} AND lag({now}, 1, FALSE) OVER w
      ELSE avg(CAST({now} AS INTEGER)) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) > 0.5 END"""


def _with_setpoints(spark, sf):
    return joins.join_setpoints(I.beacons(spark, sf), I.machines(spark, sf))


@check(
    "parse_events_json",
    I.with_inputs("""
    SELECT event_id, device_id, mac_address_string, beacon_event_id, mean_conductivity,
      setpoint_conductivity, CASE WHEN k = 51 THEN NULL ELSE mean_wash_tank_temp END AS mean_wash_tank_temp,
      mean_rinse_temp, en_fill_on, en_rinse_on, en_wash_on, version_and_message_type,
      CASE WHEN k <> 52 THEN date_time_raw END AS date_time_utc, produced_at_ms,
      CASE WHEN k = 52 THEN 0 ELSE event_time_utc_ms END AS event_time_utc_ms, kafka_logappend_ms
    FROM beacons WHERE k <> 50"""),
)
def parse_events_json(spark, sf):
    return parse_events(I.raw_events(spark, sf)).drop("ingest_at")


@check(
    "event_time_ms",
    I.with_inputs("""
    SELECT event_id,
      CASE WHEN date_time_raw > 1000000000000 THEN date_time_raw ELSE date_time_raw * 1000 END AS guarded_ms,
      date_time_raw * 1000 AS unguarded_ms,
      CASE WHEN k % 10 = 0 THEN 0 WHEN date_time_raw > 1000000000000 THEN date_time_raw
           ELSE date_time_raw * 1000 END AS zero_ms,
      CASE WHEN k % 10 = 0 THEN NULL WHEN date_time_raw > 1000000000000 THEN date_time_raw
           ELSE date_time_raw * 1000 END AS null_ms
    FROM beacons"""),
)
def event_time_ms(spark, sf):
    b = I.beacons(spark, sf)
    text = F.when(F.col("k") % 10 == 0, F.lit("unknown")).otherwise(F.col("date_time_raw").cast("string"))
    return b.select(
        "event_id",
        fn.event_ms(F.col("date_time_raw")).alias("guarded_ms"),
        fn.event_ms(F.col("date_time_raw"), guarded=False).alias("unguarded_ms"),
        fn.event_ms(text).alias("zero_ms"),
        fn.event_ms(text, on_null="null").alias("null_ms"),
    )


@check(
    "event_time_s",
    I.with_inputs("""
    SELECT event_id,
      CASE WHEN date_time_raw > 1000000000000 THEN date_time_raw / 1000e0
           ELSE CAST(date_time_raw AS DOUBLE) END AS event_s,
      CASE WHEN produced_at_ms > 1000000000000 THEN produced_at_ms // 1000 ELSE produced_at_ms END AS whole_s,
      kafka_logappend_ms / 1000e0 AS kafka_s
    FROM beacons"""),
)
def event_time_s(spark, sf):
    return I.beacons(spark, sf).select(
        "event_id",
        fn.event_s(F.col("date_time_raw")).alias("event_s"),
        fn.event_s_whole(F.col("produced_at_ms")).alias("whole_s"),
        fn.epoch_s(F.col("kafka_ts").cast("string")).alias("kafka_s"),
    )


@check(
    "fallback_key",
    I.with_inputs("""
    SELECT event_id AS id, CASE WHEN k % 10 = 0
      THEN 'fallback_' || ((kafka_logappend_ms // 1000) * 1000) || '_' || mac_address_string
      ELSE event_id END AS event_key FROM beacons"""),
)
def fallback_key(spark, sf):
    given = F.when(F.col("k") % 10 != 0, F.col("event_id"))
    return I.beacons(spark, sf).select(
        F.col("event_id").alias("id"),
        fn.fallback_key(given, fn.append_ms(F.col("kafka_ts")), F.col("mac_address_string")).alias("event_key"),
    )


@check(
    "append_time",
    I.with_inputs("""
    SELECT event_id, (kafka_logappend_ms // 1000) * 1000 AS append_ms,
      CASE WHEN k % 10 <> 0 THEN greatest((kafka_logappend_ms // 1000) * 1000, produced_at_ms) END AS latest_ms
    FROM beacons"""),
)
def append_time(spark, sf):
    produced = F.when(F.col("k") % 10 != 0, F.col("produced_at_ms"))
    return I.beacons(spark, sf).select(
        "event_id",
        fn.append_ms(F.col("kafka_ts")).alias("append_ms"),
        fn.append_ms(F.col("kafka_ts"), produced).alias("latest_ms"),
    )


@check(
    "setpoint_join",
    I.with_inputs(WITH_SETPOINTS + """
    SELECT event_id, mac_address_string, wash_temp_setpoint, rinse_temp_setpoint FROM e""", M),
)
def setpoint_join(spark, sf):
    return _with_setpoints(spark, sf).select(
        "event_id", "mac_address_string", "wash_temp_setpoint", "rinse_temp_setpoint"
    )


@check(
    "asof_setpoints",
    I.with_inputs("""
    SELECT b.event_id, b.date_time_utc, v.wash_temp_setpoint, v.rinse_temp_setpoint
    FROM beacons b ASOF LEFT JOIN machine_versions v
      ON b.mac_address_string = v.mac AND b.date_time_utc >= v.valid_from""", M, I.SQL_VERSIONS),
)
def asof_setpoints(spark, sf):
    return joins.asof_setpoints(I.beacons(spark, sf), I.machine_versions(spark, sf)).select(
        "event_id", "date_time_utc", "wash_temp_setpoint", "rinse_temp_setpoint"
    )


def _below_sql(value: str, setpoint: str, active: str, out: str) -> str:
    return I.with_inputs(WITH_SETPOINTS + f""",
    c AS (SELECT *, coalesce({value} < {setpoint}, FALSE) AS below,
            count(*) OVER (PARTITION BY mac_address_string) AS n FROM e)
    SELECT event_id, mac_address_string, date_time_utc,
      CASE WHEN {active} = 1 THEN {sustained('below')} ELSE FALSE END AS {out}
    FROM c WINDOW w AS ({W})""", M)


@check(
    "temp_below_setpoint",
    _below_sql("mean_wash_tank_temp", "wash_temp_setpoint", "en_wash_on", "temp_below_setpoint"),
)
def temp_below_setpoint(spark, sf):
    return flags.below_setpoint(
        _with_setpoints(spark, sf), "mean_wash_tank_temp", "wash_temp_setpoint", "en_wash_on",
        "temp_below_setpoint",
    ).select(*KEYS, "temp_below_setpoint")


@check(
    "rinse_below_setpoint",
    _below_sql("mean_rinse_temp", "rinse_temp_setpoint", "en_rinse_on", "rinse_temp_below_setpoint"),
)
def rinse_below_setpoint(spark, sf):
    return flags.below_setpoint(
        _with_setpoints(spark, sf), "mean_rinse_temp", "rinse_temp_setpoint", "en_rinse_on",
        "rinse_temp_below_setpoint",
    ).select(*KEYS, "rinse_temp_below_setpoint")


@check(
    "conc_constant_flags",
    I.with_inputs(f"""
    WITH c AS (SELECT *, coalesce(mean_conductivity > setpoint_conductivity * 1.1e0, FALSE) AS over_now,
        coalesce(mean_conductivity < setpoint_conductivity * 0.9e0, FALSE) AS under_now,
        count(*) OVER (PARTITION BY mac_address_string) AS n FROM beacons),
    d AS (SELECT event_id, {sustained('over_now')} AS conc_constant_over,
            {sustained('under_now')} AS conc_constant_under FROM c WINDOW w AS ({W}))
    SELECT *, NOT conc_constant_over AND NOT conc_constant_under AS conc_ok FROM d"""),
)
def conc_constant_flags(spark, sf):
    return flags.sustained_band(I.beacons(spark, sf)).select(
        "event_id", "conc_constant_over", "conc_constant_under", "conc_ok"
    )


@check(
    "temp_trend_down",
    I.with_inputs(f"""
    SELECT event_id,
      coalesce(mean_wash_tank_temp - lag(mean_wash_tank_temp) OVER w < -1.0, FALSE) AS temp_trend_down,
      coalesce(mean_rinse_temp - lag(mean_rinse_temp) OVER w < -1.0, FALSE) AS rinse_temp_trend_down
    FROM beacons WINDOW w AS ({W})"""),
)
def temp_trend_down(spark, sf):
    return flags.trend_down(
        I.beacons(spark, sf),
        {"mean_wash_tank_temp": "temp_trend_down", "mean_rinse_temp": "rinse_temp_trend_down"},
    ).select("event_id", "temp_trend_down", "rinse_temp_trend_down")


@check(
    "frequent_violation",
    I.with_inputs(WITH_SETPOINTS + """,
    s AS (SELECT mac_address_string AS mac, count(*) AS n,
        avg(CAST(coalesce(mean_wash_tank_temp < wash_temp_setpoint - 2.0, FALSE) AS INTEGER)) AS share
      FROM e GROUP BY 1)
    SELECT event_id, n >= 3 AND share > 0.2 AS temp_frequent_violation
    FROM e JOIN s ON e.mac_address_string = s.mac""", M),
)
def frequent_violation(spark, sf):
    return flags.frequent_violation(_with_setpoints(spark, sf)).select(
        "event_id", "temp_frequent_violation"
    )
