"""Operators on a hot device: it holds a third of all rows, times are fractional, some are missing,
temperatures lie far from zero. A small policy makes the operators cut it; the SQL knows nothing of that."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewatch import schema as S
from brinewatch.operators import issues, joins, rolling
from brinewatch.operators.skew import HotPolicy
from checks import inputs as I
from checks.feature_checks import rounded
from checks.flag_checks import asof_setpoints  # noqa: F401 - registers the SQL used below
from checks.registry import ORACLES, check

CUT = HotPolicy(min_rows=200, chunk_rows=50)

HOT_SQL = """hot AS (SELECT event_id, beacon_event_id AS k,
      CASE WHEN beacon_event_id % 3 = 0 THEN 'HOT' ELSE mac_address_string END AS mac_address_string,
      CASE WHEN beacon_event_id % 41 <> 0 THEN date_time_utc + (beacon_event_id % 4) * 0.25e0 END AS date_time_utc,
      mean_wash_tank_temp + 1e9 AS mean_wash_tank_temp, mean_rinse_temp, mean_conductivity,
      coalesce(mean_conductivity > 31, FALSE) AS over FROM beacons)"""
FRAME = "PARTITION BY mac_address_string ORDER BY date_time_utc RANGE BETWEEN {}.999e0 PRECEDING AND CURRENT ROW"
ROW = "PARTITION BY mac_address_string ORDER BY date_time_utc, event_id"
TIMED = "date_time_utc IS NOT NULL"


def hot_rows(spark, sf):
    k = F.col("beacon_event_id")
    return I.beacons(spark, sf).select(
        "event_id", k.alias("k"),
        F.when(k % 3 == 0, "HOT").otherwise(F.col(S.MAC)).alias(S.MAC),
        F.when(k % 41 != 0, F.col(S.TIME) + (k % 4) * 0.25).alias(S.TIME),
        (F.col("mean_wash_tank_temp") + 1e9).alias("mean_wash_tank_temp"), "mean_rinse_temp", "mean_conductivity",
        F.coalesce(F.col("mean_conductivity") > 31, F.lit(False)).alias("over"),
    )


@check(
    "high_variance_hot",
    I.with_inputs(
        f"""SELECT event_id,
      coalesce({TIMED} AND round(var_samp(mean_wash_tank_temp - 1e9) OVER ({FRAME.format(1199)}), 9) > 8.7654321, FALSE) AS wash,
      coalesce({TIMED} AND round(var_samp(mean_rinse_temp) OVER ({FRAME.format(1199)}), 9) > 8.7654321, FALSE) AS rinse FROM hot""",
        HOT_SQL,
    ),
)
def high_variance_hot(spark, sf):
    values = {"mean_wash_tank_temp": "wash", "mean_rinse_temp": "rinse"}
    rows = hot_rows(spark, sf)
    # No variance of whole numbers comes near this limit, so the last digit decides nothing.
    return issues.high_variance(rows, values, threshold=8.7654321, policy=CUT).select("event_id", "wash", "rinse")


@check(
    "recovery_failure_hot",
    I.with_inputs(
        f"""SELECT event_id, coalesce(date_time_utc - min(date_time_utc) OVER (PARTITION BY mac_address_string) >= 600
      AND bool_and(over) OVER ({FRAME.format(599)}), FALSE) AS failed FROM hot""",
        HOT_SQL,
    ),
)
def recovery_failure_hot(spark, sf):
    return issues.recovery_failure(hot_rows(spark, sf), {"over": "failed"}, policy=CUT).select("event_id", "failed")


@check(
    "rolling_means_hot",
    I.with_inputs(
        "SELECT event_id, " + ", ".join(
            f"CASE WHEN {TIMED} THEN round(avg({v}) OVER ({FRAME.format(60 * m - 1)}), 6) END AS {v}_{m}min"
            for v in ("mean_rinse_temp", "mean_conductivity") for m in (1, 5, 15)
        ) + " FROM hot",
        HOT_SQL,
    ),
)
def rolling_means_hot(spark, sf):
    columns = {v: v for v in ("mean_rinse_temp", "mean_conductivity")}
    names = [f"{v}_{m}min" for v in columns for m in (1, 5, 15)]
    return rounded(rolling.rolling_means(hot_rows(spark, sf), columns, policy=CUT), *names).select("event_id", *names)


@check(
    "sensor_features_hot",
    I.with_inputs(
        f"""SELECT event_id, round(mean_rinse_temp - lag(mean_rinse_temp) OVER ({ROW}), 6) AS rinse_temp_diff,
      CASE WHEN {TIMED} THEN round(max(mean_conductivity) OVER ({FRAME.format(299)}), 6) END AS conductivity_max_5min,
      round(mean_conductivity - (SELECT arg_max(o.mean_conductivity, (o.date_time_utc, o.event_id)) FROM hot o
        WHERE o.mac_address_string = h.mac_address_string AND o.date_time_utc <= h.date_time_utc - 30
          AND o.mean_conductivity IS NOT NULL), 6) AS conductivity_delta_30s FROM hot h""",
        HOT_SQL,
    ),
)
def sensor_features_hot(spark, sf):
    names = ["rinse_temp_diff", "conductivity_max_5min", "conductivity_delta_30s"]
    rows = hot_rows(spark, sf).withColumnRenamed("over", "conc_constant_over")
    return rounded(issues.sensor_features(rows, flags=["conc_constant_over"], policy=CUT), *names).select("event_id", *names)


# The dimension counts as too large to broadcast; busy devices are salted.
SHUFFLED = dict(max_broadcast_rows=1, policy=HotPolicy(min_rows=20, chunk_rows=5))


@check("setpoint_join_shuffle", ORACLES["setpoint_join"])
def setpoint_join_shuffle(spark, sf):
    out = joins.join_setpoints(I.beacons(spark, sf), I.machines(spark, sf), **SHUFFLED)
    return out.select("event_id", S.MAC, "wash_temp_setpoint", "rinse_temp_setpoint")


@check("asof_setpoints_shuffle", ORACLES["asof_setpoints"])
def asof_setpoints_shuffle(spark, sf):
    out = joins.asof_setpoints(I.beacons(spark, sf), I.machine_versions(spark, sf), **SHUFFLED)
    return out.select("event_id", S.TIME, "wash_temp_setpoint", "rinse_temp_setpoint")
