"""Inputs derived from the driver's tables, once in Spark and once as SQL (see FIXTURES.md).

``beacons`` is a plain projection of ``events`` - every row is kept, nothing is shuffled - so it
can be read as a batch table or as a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = 1704067200
EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)

# Devices of every 25th user are cut into 400-second slices, so that small groups occur.
_MAC_SPARK = (
    f"concat('M', lpad(cast(user_id as string), 12, '0'), case when user_id % 25 = 24 "
    f"then concat('S', cast((t - {START}) div 400 as string)) else '' end)"
)


def prepare(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def as_beacons(events: DataFrame) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    base = events.select(
        "event_id", "user_id", "event_type", "value",
        # ``props`` holds the one number; stripping the rest is far cheaper than parsing it.
        F.translate("props", '{"k": }', "").cast("int").alias("k"),
        (F.lit(START).cast("bigint") + F.floor((us - F.lit(START * 1_000_000)) / 240_000_000)).cast("bigint").alias("t"),
    )
    return base.selectExpr(
        "concat('E', cast(event_id as string)) as event_id",
        "concat('D', cast(user_id as string)) as device_id",
        f"{_MAC_SPARK} as mac_address_string",
        "cast(k as int) as beacon_event_id",
        "case when k % 19 = 0 then null else 30D + cast(floor(value * 100) as bigint) % 2000 / 100D end as mean_conductivity",
        "case when k % 23 = 0 then null else 40D end as setpoint_conductivity",
        "case when event_type = 'error' and k % 5 = 0 then 300D when k % 17 = 0 then null else cast(52 + k % 16 as double) end as mean_wash_tank_temp",
        "case when k % 13 = 0 then null else cast(72 + (7 * k) % 16 as double) end as mean_rinse_temp",
        "cast(event_type = 'error' as int) as en_fill_on",
        "cast(event_type in ('purchase', 'signup') as int) as en_rinse_on",
        "cast(event_type in ('click', 'view', 'purchase') as int) as en_wash_on",
        "1 as version_and_message_type",
        "case when k % 3 = 0 then t * 1000 else t end as date_time_raw",
        "t as date_time_utc",
        "t * 1000 as event_time_utc_ms",
        "t * 1000 + 10 * k as produced_at_ms",
        "t * 1000 + 10 * k + (37 * k) % 500 as kafka_logappend_ms",
        "t * 1000 + 10 * k + (37 * k) % 500 + (k * k) % 3000 + case when k % 20 = 0 then 120000 else 0 end as persisted_at_ms",
        "case when k = 7 then 120 else 0 end as op_state",
        "case when event_id % 2 = 0 then 'kappa' else 'lambda' end as architecture",
        "substr('ABCDE', cast(user_id % 5 as int) + 1, 1) as workload",
        "cast(event_id % 3 as int) as repeat",
        "k",
    ).withColumns(
        {
            "kafka_ts": F.timestamp_millis("kafka_logappend_ms"),
            "persisted_at": F.timestamp_millis("persisted_at_ms"),
        }
    )


def beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_beacons(table(spark, sf_dir, "events"))


def beacon_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a stream: the file source reads the events table as it lies."""
    prepare(spark)
    # As a pattern the path may be one file or a folder of files.
    raw = spark.readStream.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parque[t]")
    return as_beacons(raw)


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every tenth machine is listed under a MAC no event carries, so some joins find nothing.
    mac = "concat(if(c_custkey % 10 = 9, 'X', 'M'), lpad(cast(c_custkey as string), 12, '0'))"
    return table(spark, sf_dir, "customer").select(
        F.expr(
            f"explode(case when c_custkey % 25 = 24 then transform(sequence(0, 26), "
            f"s -> concat({mac}, 'S', cast(s as string))) else array({mac}) end)"
        ).alias("mac"),
        F.col("c_name").alias("device_name"),
        F.col("c_mktsegment").alias("site"),
        F.expr("case when c_custkey % 37 = 0 then 0 else 55 + 5 * (c_nationkey % 2) end").cast("int").alias("wash_temp_setpoint"),
        F.expr("75 + 5 * (c_nationkey % 2)").cast("int").alias("rinse_temp_setpoint"),
    )


def machine_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = machines(spark, sf_dir)
    return m.select(
        "mac",
        F.explode(
            F.array(
                F.struct(F.lit(START).cast("bigint").alias("valid_from"), F.col("wash_temp_setpoint")),
                F.struct(
                    F.lit(START + 5400).cast("bigint").alias("valid_from"),
                    (F.col("wash_temp_setpoint") + 5).alias("wash_temp_setpoint"),
                ),
            )
        ).alias("v"),
        "rinse_temp_setpoint",
    ).select("mac", "v.*", "rinse_temp_setpoint")


def beacons_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with k % 10 = 0 appear twice, the copy one second later."""
    b = beacons(spark, sf_dir)
    copies = F.expr("case when k % 10 = 0 then array(0, 1) else array(0) end")
    return (
        b.withColumn("copy", F.explode(copies))
        .withColumn("persisted_at_ms", F.col("persisted_at_ms") + F.col("copy") * 1000)
        .withColumn("persisted_at", F.timestamp_millis("persisted_at_ms"))
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message texts as a broker would deliver them; k = 50 is cut short, k = 51 has a bad field."""
    b = beacons(spark, sf_dir)
    text = F.to_json(
        F.struct(
            F.col("event_id").alias("Id"),
            F.col("device_id").alias("DeviceID"),
            F.col("mac_address_string").alias("MACAddressString"),
            F.col("beacon_event_id").alias("BeaconEventID"),
            F.col("mean_conductivity").alias("MeanConductivity"),
            F.col("setpoint_conductivity").alias("SetpointConductivity"),
            F.when(F.col("k") != 51, F.col("mean_wash_tank_temp")).alias("MeanWashTankTemp"),
            F.col("mean_rinse_temp").alias("MeanRinseTemp"),
            F.col("en_fill_on").alias("EnFillOn"),
            F.col("en_rinse_on").alias("EnRinseOn"),
            F.col("en_wash_on").alias("EnWashOn"),
            F.col("version_and_message_type").alias("VersionAndMessageType"),
            F.when(F.col("k") != 52, F.col("date_time_raw")).alias("DateTimeUTC"),
            F.col("produced_at_ms").alias("_produced_at_ms"),
        )
    )
    bad_field = F.concat(F.lit('{"MeanWashTankTemp":"hot",'), F.expr("substr(text, 2)"))
    b = b.withColumn("text", text)
    value = (
        F.when(F.col("k") == 50, F.substring("text", 1, 40))
        .when(F.col("k") == 51, bad_field)
        .otherwise(F.col("text"))
    )
    return b.select(value.alias("value"), F.col("kafka_ts").alias("timestamp"))


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beacons with the ready times their architecture would have written.

    Window ends mislead about readiness; kappa's workload E and lambda's workload D are honest.
    """
    b = beacons(spark, sf_dir)
    end = "(kafka_logappend_ms div 1200000 + 1) * 1200000"
    ms = {
        "stream": f"case when architecture = 'kappa' then case when workload = 'E' then kafka_logappend_ms + 20000 else {end} end end",
        "speed": f"case when architecture = 'lambda' and workload <> 'D' then {end} end",
        "features": "case when architecture = 'lambda' then persisted_at_ms + 60000 end",
    }
    return b.withColumns(
        {
            "stream_features_ready_at": F.expr(f"timestamp_millis({ms['stream']})"),
            "speed_features_ready_at": F.expr(f"timestamp_millis({ms['speed']})"),
            "features_ready_ms": F.expr(ms["features"]),
            "flags_computed_at": F.expr(f"timestamp_millis(coalesce({ms['features']}, {ms['stream']}))"),
            "event_latency_seconds": F.expr("(persisted_at_ms - kafka_logappend_ms) / 1000D"),
        }
    )


SQL_BEACONS = f"""
beacons0 AS (
  SELECT event_id, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         {START} + CAST(floor((epoch_us(ts) - {START}000000) / 240000000.0) AS BIGINT) AS t
  FROM events),
beacons AS (
  SELECT 'E' || event_id AS event_id, 'D' || user_id AS device_id,
    'M' || lpad(CAST(user_id AS VARCHAR), 12, '0')
        || CASE WHEN user_id % 25 = 24 THEN 'S' || ((t - {START}) // 400) ELSE '' END AS mac_address_string,
    k AS beacon_event_id,
    CASE WHEN k % 19 = 0 THEN NULL
         ELSE 30e0 + (CAST(floor(value * 100) AS BIGINT) % 2000) / 100e0 END AS mean_conductivity,
    CASE WHEN k % 23 = 0 THEN NULL ELSE 40e0 END AS setpoint_conductivity,
    CASE WHEN event_type = 'error' AND k % 5 = 0 THEN 300e0 WHEN k % 17 = 0 THEN NULL
         ELSE CAST(52 + k % 16 AS DOUBLE) END AS mean_wash_tank_temp,
    CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(72 + (7 * k) % 16 AS DOUBLE) END AS mean_rinse_temp,
    CAST(event_type = 'error' AS INTEGER) AS en_fill_on,
    CAST(event_type IN ('purchase', 'signup') AS INTEGER) AS en_rinse_on,
    CAST(event_type IN ('click', 'view', 'purchase') AS INTEGER) AS en_wash_on,
    1 AS version_and_message_type,
    CASE WHEN k % 3 = 0 THEN t * 1000 ELSE t END AS date_time_raw,
    t AS date_time_utc, t * 1000 AS event_time_utc_ms,
    t * 1000 + 10 * k AS produced_at_ms,
    t * 1000 + 10 * k + (37 * k) % 500 AS kafka_logappend_ms,
    t * 1000 + 10 * k + (37 * k) % 500 + (k * k) % 3000
        + CASE WHEN k % 20 = 0 THEN 120000 ELSE 0 END AS persisted_at_ms,
    CASE WHEN k = 7 THEN 120 ELSE 0 END AS op_state,
    CASE WHEN event_id % 2 = 0 THEN 'kappa' ELSE 'lambda' END AS architecture,
    substr('ABCDE', CAST(user_id % 5 AS INTEGER) + 1, 1) AS workload,
    CAST(event_id % 3 AS INTEGER) AS repeat, k
  FROM beacons0)"""

SQL_MACHINES = """
machines AS (
  SELECT mac0 || suffix AS mac, device_name, site, wash_temp_setpoint, rinse_temp_setpoint
  FROM (
    SELECT CASE WHEN c_custkey % 10 = 9 THEN 'X' ELSE 'M' END
        || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS mac0, c_name AS device_name,
      c_mktsegment AS site,
      CAST(CASE WHEN c_custkey % 37 = 0 THEN 0 ELSE 55 + 5 * (c_nationkey % 2) END AS INTEGER) AS wash_temp_setpoint,
      CAST(75 + 5 * (c_nationkey % 2) AS INTEGER) AS rinse_temp_setpoint,
      unnest(CASE WHEN c_custkey % 25 = 24 THEN list_transform(range(27), lambda s: 'S' || s) ELSE [''] END) AS suffix
    FROM customer))"""

SQL_VERSIONS = f"""
machine_versions AS (
  SELECT mac, CAST({START} AS BIGINT) AS valid_from, wash_temp_setpoint, rinse_temp_setpoint FROM machines
  UNION ALL
  SELECT mac, {START + 5400}, wash_temp_setpoint + 5, rinse_temp_setpoint FROM machines)"""

SQL_RUNS = """
run_rows AS (
  SELECT *, CASE WHEN architecture = 'kappa' THEN CASE WHEN workload = 'E' THEN kafka_logappend_ms + 20000
      ELSE (kafka_logappend_ms // 1200000 + 1) * 1200000 END END AS stream_ms,
    CASE WHEN architecture = 'lambda' AND workload <> 'D'
      THEN (kafka_logappend_ms // 1200000 + 1) * 1200000 END AS speed_ms,
    CASE WHEN architecture = 'lambda' THEN persisted_at_ms + 60000 END AS features_ms,
    (persisted_at_ms - kafka_logappend_ms) / 1000e0 AS event_latency_seconds
  FROM beacons)"""

SQL_DUP = """
beacons_dup AS (
  SELECT * EXCLUDE (persisted_at_ms, copy), CAST(copy AS INTEGER) AS copy,
         persisted_at_ms + copy * 1000 AS persisted_at_ms
  FROM (SELECT *, unnest(CASE WHEN k % 10 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM beacons))"""


def steady(sql: str) -> str:
    """Every ``round(x, digits)`` rounds to twelve digits first, as ``steady_round`` does."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        value, _, digits = sql[start + 6:end - 1].rpartition(",")
        out += [sql[at:start], f"round(round({steady(value)}, 12),{digits})"]
        at = end
    return "".join([*out, sql[at:]])


def with_inputs(body: str, *parts: str) -> str:
    """``body`` below the derivations it needs; ``body`` may start with further CTEs."""
    ctes = ",".join((SQL_BEACONS, *parts))
    text = steady(body.strip())
    if text.upper().startswith("WITH "):
        return f"WITH {ctes},\n{text[5:]}"
    return f"WITH {ctes}\n{text}"
