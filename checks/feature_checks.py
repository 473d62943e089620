"""Rolling and quality features, windowed flags and contracts: queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewatch import functions as fn
from brinewatch import schema as S
from brinewatch.operators import contracts, features, flags, rolling, tumbling
from brinewatch.operators.joins import join_setpoints
from checks import inputs as I
from checks.flag_checks import M, W, WITH_SETPOINTS, sustained
from checks.registry import check

def now():
    return F.lit(1704100000).cast("timestamp")


NOW_MS = 1704100000000
ARRIVAL = "PARTITION BY mac_address_string ORDER BY persisted_at_ms, kafka_logappend_ms, event_id"


def rounded(df, *names):
    return df.withColumns({n: fn.steady_round(F.col(n), 6) for n in names})


def _means_sql(prefixes: dict[str, str], minutes) -> str:
    parts = [
        f"round(avg({value}) OVER (PARTITION BY mac_address_string ORDER BY date_time_utc "
        f"RANGE BETWEEN {m * 60 - 1} PRECEDING AND CURRENT ROW), 6) AS {prefix}_{suffix}"
        for value, prefix in prefixes.items()
        for m, suffix in minutes.items()
    ]
    return I.with_inputs(f"SELECT event_id, {', '.join(parts)} FROM beacons")


PREFIXES = {
    "mean_wash_tank_temp": "rolling_wash_temp_avg",
    "mean_rinse_temp": "rolling_rinse_temp_avg",
    "mean_conductivity": "rolling_conductivity_avg",
}


@check("rolling_means", _means_sql(PREFIXES, {1: "1min", 5: "5min", 15: "15min"}))
def rolling_means(spark, sf):
    names = [f"{p}_{m}min" for p in PREFIXES.values() for m in (1, 5, 15)]
    return rounded(rolling.rolling_means(I.beacons(spark, sf)), *names).select("event_id", *names)


FIVE = {"mean_conductivity": "conductivity_mean", "mean_wash_tank_temp": "wash_temp_mean",
        "mean_rinse_temp": "rinse_temp_mean"}


@check("rolling_features_5min", _means_sql(FIVE, {5: "5min"}))
def rolling_features_5min(spark, sf):
    names = [f"{p}_5min" for p in FIVE.values()]
    return rounded(rolling.rolling_features_5min(I.beacons(spark, sf)), *names).select("event_id", *names)


def with_latency(spark, sf):
    return features.add_latency(I.beacons(spark, sf), now=now())


LATENCY = "(persisted_at_ms - kafka_logappend_ms) / 1000e0"


@check(
    "latency_rolling",
    I.with_inputs(f"""
    WITH l AS (SELECT *, {LATENCY} AS latency FROM beacons)
    SELECT event_id, latency AS latency_raw,
      round(avg(latency) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS latency_rolling_mean_5min,
      round(coalesce(stddev_samp(latency) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0e0), 6) AS latency_volatility
    FROM l WINDOW w AS ({W})"""),
)
def latency_rolling(spark, sf):
    out = features.latency_rolling(with_latency(spark, sf))
    return rounded(out, "latency_rolling_mean_5min", "latency_volatility").select(
        "event_id", "latency_raw", "latency_rolling_mean_5min", "latency_volatility"
    )


@check(
    "ooo_indicator",
    I.with_inputs(f"""
    SELECT event_id, coalesce(date_time_utc < lag(date_time_utc) OVER w, FALSE) AS out_of_order_indicator
    FROM beacons WINDOW w AS ({ARRIVAL})"""),
)
def ooo_indicator(spark, sf):
    return features.ooo_indicator(I.beacons(spark, sf)).select("event_id", "out_of_order_indicator")


BATCH_FLAGS_SQL = WITH_SETPOINTS + f""",
    c AS (SELECT *, coalesce(mean_wash_tank_temp < wash_temp_setpoint, FALSE) AS wash_now,
        coalesce(mean_rinse_temp < rinse_temp_setpoint, FALSE) AS rinse_now,
        coalesce(mean_conductivity > setpoint_conductivity * 1.1e0, FALSE) AS over_now,
        coalesce(mean_conductivity < setpoint_conductivity * 0.9e0, FALSE) AS under_now,
        count(*) OVER (PARTITION BY mac_address_string) AS n FROM e),
    f AS (SELECT *,
        CASE WHEN en_wash_on = 1 THEN {sustained('wash_now')} ELSE FALSE END AS temp_below_setpoint,
        CASE WHEN en_rinse_on = 1 THEN {sustained('rinse_now')} ELSE FALSE END AS rinse_temp_below_setpoint,
        {sustained('over_now')} AS conc_constant_over,
        {sustained('under_now')} AS conc_constant_under
      FROM c WINDOW w AS ({W}))"""
STABILITY_SQL = BATCH_FLAGS_SQL + f""",
    s AS (SELECT *, NOT conc_constant_over AND NOT conc_constant_under AS conc_ok, (
        coalesce(abs(CAST(temp_below_setpoint AS INTEGER) - lag(CAST(temp_below_setpoint AS INTEGER)) OVER w), 0)
        + coalesce(abs(CAST(rinse_temp_below_setpoint AS INTEGER) - lag(CAST(rinse_temp_below_setpoint AS INTEGER)) OVER w), 0)
        + coalesce(abs(CAST(conc_constant_over AS INTEGER) - lag(CAST(conc_constant_over AS INTEGER)) OVER w), 0)
        + coalesce(abs(CAST(conc_constant_under AS INTEGER) - lag(CAST(conc_constant_under AS INTEGER)) OVER w), 0)
        ) / 4e0 AS flag_flip_rate,
        CAST(temp_below_setpoint OR rinse_temp_below_setpoint AS DOUBLE) AS freq_temp_flag,
        CAST(conc_constant_over OR conc_constant_under AS DOUBLE) AS freq_conductivity_flag
      FROM f WINDOW w AS ({W}))"""


def flagged(spark, sf):
    return flags.detect_anomalies(join_setpoints(with_latency(spark, sf), I.machines(spark, sf)))


@check(
    "flag_stability",
    I.with_inputs(STABILITY_SQL + """
    SELECT event_id, flag_flip_rate, freq_temp_flag, freq_conductivity_flag,
      round(1e0 - least(1e0, flag_flip_rate / n), 6) AS combined_flag_stability FROM s""", M),
)
def flag_stability(spark, sf):
    return rounded(features.flag_stability(flagged(spark, sf)), "combined_flag_stability").select(
        "event_id", "flag_flip_rate", "freq_temp_flag", "freq_conductivity_flag", "combined_flag_stability"
    )


@check(
    "batch_integrity",
    I.with_inputs("""
    WITH c AS (SELECT *, count(*) OVER (PARTITION BY mac_address_string) AS n FROM beacons)
    SELECT event_id, 1e0 AS event_count_ratio_5min,
      round(least(1e0, n / 10e0), 6) AS window_integrity_score_1min,
      round(least(1e0, n / 50e0), 6) AS window_integrity_score_5min,
      round(least(1e0, n / 150e0), 6) AS window_integrity_score_15min FROM c"""),
)
def batch_integrity(spark, sf):
    names = [f"window_integrity_score_{m}min" for m in (1, 5, 15)]
    return rounded(features.batch_integrity(I.beacons(spark, sf), rate_per_minute=10.0), *names).select(
        "event_id", "event_count_ratio_5min", *names
    )


MISSING = """(CAST(mean_wash_tank_temp IS NULL AS INTEGER) + CAST(mean_rinse_temp IS NULL AS INTEGER)
      + CAST(mean_conductivity IS NULL AS INTEGER)) / 3e0"""


@check(
    "missing_rate",
    I.with_inputs(f"SELECT event_id, {MISSING} AS missing_rate, 1e0 - {MISSING} AS field_consistency_score FROM beacons"),
)
def missing_rate(spark, sf):
    quality = features.row_quality("persisted_at")
    return I.beacons(spark, sf).select(
        "event_id", *[quality[n].alias(n) for n in ("missing_rate", "field_consistency_score")]
    )


SKEW = "CAST(abs(persisted_at_ms // 1000 - date_time_utc) * 1000 AS DOUBLE)"


@check("timestamp_skew", I.with_inputs(f"SELECT event_id, {SKEW} AS timestamp_skew_ms FROM beacons"))
def timestamp_skew(spark, sf):
    return I.beacons(spark, sf).select(
        "event_id", features.row_quality("persisted_at")["timestamp_skew_ms"].alias("timestamp_skew_ms")
    )


CONDUCTIVITY = """coalesce(setpoint_conductivity > 0 AND abs(mean_conductivity - setpoint_conductivity)
      > greatest(setpoint_conductivity * 0.1e0, 1e0), FALSE)"""


@check("conductivity_violation", I.with_inputs(f"SELECT event_id, {CONDUCTIVITY} AS violation FROM beacons"))
def conductivity_violation(spark, sf):
    return I.beacons(spark, sf).select(
        "event_id",
        fn.conductivity_violation(F.col("mean_conductivity"), F.col("setpoint_conductivity")).alias("violation"),
    )


@check(
    "alarm_flag",
    I.with_inputs(BATCH_FLAGS_SQL + f"""
    SELECT event_id, temp_below_setpoint OR rinse_temp_below_setpoint OR conc_constant_over
      OR conc_constant_under OR {CONDUCTIVITY} OR op_state >= 100 AS alarm FROM f""", M),
)
def alarm_flag(spark, sf):
    df = flagged(spark, sf)
    return df.select("event_id", fn.alarm_flag(df).alias("alarm"))


@check(
    "event_latency",
    I.with_inputs(f"""
    SELECT event_id, CASE WHEN k % 11 = 0 THEN {NOW_MS} ELSE persisted_at_ms END AS persisted_ms,
      CASE WHEN k % 11 = 0 THEN {NOW_MS} ELSE persisted_at_ms END AS ingest_ms,
      (CASE WHEN k % 11 = 0 THEN {NOW_MS} ELSE persisted_at_ms END - kafka_logappend_ms) / 1000e0 AS latency_seconds
    FROM beacons"""),
)
def event_latency(spark, sf):
    b = I.beacons(spark, sf)
    late = b.withColumn("persisted_at", F.when(F.col("k") % 11 != 0, F.col("persisted_at")))
    return features.add_latency(late, now=now()).select(
        "event_id", fn.epoch_ms(F.col("persisted_at")).alias("persisted_ms"),
        fn.epoch_ms(F.col("ingest_at")).alias("ingest_ms"), "latency_seconds",
    )


@check(
    "fal_seconds",
    I.with_inputs(f"""
    SELECT event_id, CASE WHEN k % 9 <> 0 THEN ({NOW_MS} - kafka_logappend_ms) / 1000e0 END AS fal_seconds
    FROM beacons"""),
)
def fal_seconds(spark, sf):
    append = F.when(F.col("k") % 9 != 0, F.col("kafka_logappend_ms"))
    return I.beacons(spark, sf).select(
        "event_id", features.fal_seconds(F.lit(NOW_MS).cast("bigint"), append).alias("fal_seconds")
    )


@check(
    "feature_batch",
    I.with_inputs(STABILITY_SQL + f"""
    SELECT event_id, temp_below_setpoint, rinse_temp_below_setpoint, conc_constant_over,
      conc_constant_under, conc_ok, {MISSING} AS missing_rate, 1e0 - {MISSING} AS field_consistency_score,
      {SKEW} AS timestamp_skew_ms, round(least(1e0, n / 300e0), 6) AS window_integrity_5min,
      round(least(1e0, n / 60e0), 6) AS window_integrity_score_1min,
      round(least(1e0, n / 900e0), 6) AS window_integrity_score_15min, 1e0 AS event_count_ratio_15min,
      flag_flip_rate, freq_temp_flag, freq_conductivity_flag,
      round(1e0 - least(1e0, flag_flip_rate / n), 6) AS combined_flag_stability,
      coalesce(date_time_utc < lag(date_time_utc) OVER (PARTITION BY mac_address_string
        ORDER BY persisted_at_ms, kafka_logappend_ms, event_id), FALSE) AS out_of_order_indicator,
      {LATENCY} AS latency_raw,
      round(coalesce(stddev_samp({LATENCY}) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0e0), 6) AS latency_volatility,
      round(avg({LATENCY}) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS latency_rolling_mean_5min,
      CAST({NOW_MS} AS BIGINT) AS features_ready_ms
    FROM s WINDOW w AS ({W})""", M),
)
def feature_batch(spark, sf):
    from brinewatch.plans.batch import feature_batch as job

    out = job(with_latency(spark, sf), I.machines(spark, sf), now=now())
    scores = ("window_integrity_score_1min", "window_integrity_score_15min", "combined_flag_stability", "latency_volatility")
    return rounded(out, "window_integrity_5min", "latency_rolling_mean_5min", *scores).select(
        "event_id", *scores, "event_count_ratio_15min", "freq_temp_flag", "freq_conductivity_flag",
        "out_of_order_indicator", "temp_below_setpoint", "rinse_temp_below_setpoint", "conc_constant_over",
        "conc_constant_under", "conc_ok", "missing_rate", "field_consistency_score",
        "timestamp_skew_ms", "window_integrity_5min", "flag_flip_rate", "latency_raw",
        "latency_rolling_mean_5min", "features_ready_ms",
    )


STATS_SQL = """avg(mean_conductivity) AS avg_conductivity, min(mean_wash_tank_temp) AS min_wash_temp,
    max(mean_wash_tank_temp) AS max_wash_temp, count(mean_wash_tank_temp) AS wash_temp_count,
    min(mean_rinse_temp) AS min_rinse_temp, max(mean_rinse_temp) AS max_rinse_temp,
    count(mean_rinse_temp) AS rinse_temp_count, count(*) AS total_events"""


@check(
    "tumbling_20min",
    I.with_inputs(f"""
    WITH g AS (SELECT mac_address_string, (kafka_logappend_ms // 1200000) * 1200000 AS start_ms, {STATS_SQL}
      FROM beacons GROUP BY 1, 2)
    SELECT * REPLACE (round(avg_conductivity, 6) AS avg_conductivity), start_ms + 1200000 AS end_ms FROM g"""),
)
def tumbling_20min(spark, sf):
    stats = tumbling.tumbling_stats(I.beacons(spark, sf))
    return rounded(stats, "avg_conductivity").select(
        "*", fn.epoch_ms(F.col("window.start")).alias("start_ms"),
        fn.epoch_ms(F.col("window.end")).alias("end_ms"),
    ).drop("window")


POINT_SQL = """
      CASE WHEN en_wash_on >= 1 AND mean_wash_tank_temp IS NOT NULL AND wash_temp_setpoint IS NOT NULL
           THEN mean_wash_tank_temp < wash_temp_setpoint END AS temp_below_setpoint,
      CASE WHEN en_rinse_on >= 1 AND mean_rinse_temp IS NOT NULL AND rinse_temp_setpoint IS NOT NULL
           THEN mean_rinse_temp < rinse_temp_setpoint END AS rinse_temp_below_setpoint,
      mean_conductivity > setpoint_conductivity * 1.1e0 AS conc_constant_over,
      mean_conductivity < setpoint_conductivity * 0.9e0 AS conc_constant_under"""


@check("point_flags", I.with_inputs(WITH_SETPOINTS + f" SELECT event_id, {POINT_SQL} FROM e", M))
def point_flags(spark, sf):
    df = join_setpoints(I.beacons(spark, sf), I.machines(spark, sf))
    return df.withColumns(tumbling.point_flags()).select("event_id", *S.RULE_FLAGS[:4])


WINDOW_SQL = """WITH w AS (SELECT mac_address_string AS mac, kafka_logappend_ms // 1200000 AS slot,
        avg(mean_conductivity) AS avg_conductivity, (kafka_logappend_ms // 1200000 + 1) * 1200000 AS end_ms
      FROM beacons GROUP BY 1, 2, 4)"""
CONC_OK_SQL = """CASE WHEN mean_conductivity IS NOT NULL AND setpoint_conductivity > 0
        AND avg_conductivity IS NOT NULL THEN avg_conductivity BETWEEN setpoint_conductivity * 0.9e0
        AND setpoint_conductivity * 1.1e0 END"""


@check(
    "conc_ok_window",
    I.with_inputs(WINDOW_SQL + f"""
    SELECT event_id, round(avg_conductivity, 6) AS avg_conductivity, {CONC_OK_SQL} AS conc_ok
    FROM beacons b LEFT JOIN w ON b.mac_address_string = w.mac AND b.kafka_logappend_ms // 1200000 = w.slot"""),
)
def conc_ok_window(spark, sf):
    df = tumbling.attach_window(I.beacons(spark, sf)).withColumn("conc_ok", tumbling.conc_ok_column())
    return rounded(df, "avg_conductivity").select("event_id", "avg_conductivity", "conc_ok")


@check(
    "features_ready_at",
    I.with_inputs("""
    WITH w AS (SELECT DISTINCT mac_address_string AS mac, event_time_utc_ms // 1200000 AS slot FROM beacons
      WHERE en_wash_on = 1)
    SELECT event_id, coalesce((slot + 1) * 1200000, event_time_utc_ms + 1200000) AS ready_ms
    FROM beacons b LEFT JOIN w ON b.mac_address_string = w.mac AND b.event_time_utc_ms // 1200000 = w.slot"""),
)
def features_ready_at(spark, sf):
    """Windows hold only washing rows here, so that rows without a window occur."""
    b = I.beacons(spark, sf).withColumn("ts", F.timestamp_millis("event_time_utc_ms"))
    rows = tumbling.attach_window(b, ts="ts", only=F.col("en_wash_on") == 1)
    return rows.select(
        "event_id",
        fn.epoch_ms(fn.ready_at(F.col("window_end"), F.col("ts"), 20)).alias("ready_ms"),
    )


VALID = " AND ".join(f"({c} IS NULL OR {c} BETWEEN 0 AND 255)" for c in S.SENSORS)


@check("schema_valid", I.with_inputs(f"SELECT event_id, {VALID} AS schema_valid FROM beacons"))
def schema_valid(spark, sf):
    return contracts.mark_valid(I.beacons(spark, sf)).select("event_id", "schema_valid")


@check(
    "schema_rejects",
    I.with_inputs(f"""SELECT event_id, mean_wash_tank_temp, 'mean_wash_tank_temp' AS violations
    FROM beacons WHERE NOT ({VALID})"""),
)
def schema_rejects(spark, sf):
    return contracts.rejected_rows(I.beacons(spark, sf)).select("event_id", "mean_wash_tank_temp", "violations")


def _contract_row(field: str, column: str, kind: str) -> str:
    missing = {"mean_wash_tank_temp": f"k = 50 OR (k <> 51 AND {column} IS NULL)",
               "date_time_utc": "k IN (50, 52)"}.get(column, f"k = 50 OR {column} IS NULL")
    wrong = "k = 51" if column == "mean_wash_tank_temp" else "FALSE"
    return (f"SELECT '{field}' AS field, count(*) AS messages, count(*) FILTER ({missing}) AS missing, "
            f"count(*) FILTER ({wrong}) AS wrong_type, CAST(0 AS BIGINT) AS outside_enum FROM beacons")


@check(
    "contract_violations",
    I.with_inputs(" UNION ALL ".join(
        _contract_row(field, column, kind) for field, (column, kind) in S.EVENT_FIELDS.items()
        if column in S.CONTRACT_REQUIRED)),
)
def contract_violations(spark, sf):
    return contracts.contract_violations(I.raw_events(spark, sf))


# k = 60: a number as architecture; 61: an unknown product; 62: a quoted number; 63: JSON null; 64: cut short.
PRODUCT_ROWS = {
    "Id": ("k IN (64)", "FALSE", "FALSE"), "BeaconEventID": ("k IN (63, 64)", "k = 62", "FALSE"),
    "architecture": ("k IN (64)", "k = 60", "k = 60"), "data_product": ("k IN (64)", "FALSE", "k = 61"),
}


@check(
    "product_contract",
    I.with_inputs(" UNION ALL ".join(
        f"""SELECT '{field}' AS field, count(*) AS messages, count(*) FILTER ({missing}) AS missing,
      count(*) FILTER ({wrong}) AS wrong_type, count(*) FILTER ({outside}) AS outside_enum FROM beacons"""
        for field, (missing, wrong, outside) in PRODUCT_ROWS.items())),
)
def product_contract(spark, sf):
    """The product contract with its enums, by the types of the JSON tokens."""
    k = F.col("k")
    value = F.concat(
        F.lit('{"Id":"'), "event_id", F.lit('","BeaconEventID":'),
        F.when(k == 62, '"7"').when(k == 63, "null").otherwise(k.cast("string")),
        F.lit(',"architecture":'), F.when(k == 60, "5").otherwise('"datamesh"'), F.lit(',"data_product":"'),
        F.when(k == 61, "cooking").otherwise(F.element_at(F.array(*map(F.lit, S.DOMAINS)), (k % 3 + 1).cast("int"))),
        F.when(k == 64, "").otherwise('"}'),
    )
    messages = I.beacons(spark, sf).select(value.alias("value"))
    return contracts.contract_violations(
        messages, required=("event_id", "beacon_event_id"), enums=S.PRODUCT_ENUMS
    )
