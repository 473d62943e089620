"""Sources, sinks, domains, workload transforms, whole jobs and declared-only flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewatch import functions as fn
from brinewatch import schema as S
from brinewatch.operators import domains, issues, workloads
from brinewatch.operators.joins import join_setpoints
from brinewatch.operators.tumbling import point_flags
from brinewatch.plans import batch, stream
from brinewatch.session import scratch_dir
from brinewatch.sources import machines as machine_source
from brinewatch.sources import pending, runs, sinks, traces
from checks import inputs as I
from checks.feature_checks import (
    BATCH_FLAGS_SQL, CONC_OK_SQL, M, MISSING, NOW_MS, POINT_SQL, STABILITY_SQL, VALID, WINDOW_SQL, now, rounded,
    with_latency,
)
from checks.flag_checks import W, sustained
from checks.registry import check

QUIET_SQL = ", ".join(f"FALSE AS {f}" for f in S.RULE_FLAGS[4:])


# --- sources ---------------------------------------------------------------------------------
@check(
    "load_machines",
    I.with_inputs("""
    SELECT mac, device_name, site, CAST(NULL AS VARCHAR) AS model, CAST(NULL AS VARCHAR) AS dosing_unit_type,
      wash_temp_setpoint, CASE WHEN rinse_temp_setpoint <> 75 THEN rinse_temp_setpoint END AS rinse_temp_setpoint,
      CAST(wash_temp_setpoint / 4e0 AS FLOAT) AS energy_kw FROM machines WHERE mac NOT LIKE 'X%'""", M),
)
def load_machines(spark, sf):
    """The list is written as its CSV (empty MAC for unlisted machines) and read back."""
    path = scratch_dir(spark, "machines")
    listed = I.machines(spark, sf).select(
        F.col("device_name").alias("Device Name"),
        F.when(~F.col("mac").startswith("X"), F.concat(F.lit(" "), "mac")).otherwise(F.lit(" ")).alias("MACAdress String"),
        F.lit(None).cast("string").alias("Maschine Name And Model"),
        F.col("site").alias("Site"),
        (F.col("wash_temp_setpoint") / 4).alias("Energy KW"),
        F.col("wash_temp_setpoint").alias("Wash Temp Threshold"),
        F.when(F.col("rinse_temp_setpoint") != 75, F.col("rinse_temp_setpoint").cast("string"))
        .otherwise(F.lit("")).alias("Rinse Temp Threshold"),
        F.lit(None).cast("string").alias("Dosing Unit Type"),
    )
    listed.write.option("sep", ";").option("header", True).csv(path)
    return machine_source.read_machines(spark, path)


@check(
    "trace_files",
    I.with_inputs("""SELECT event_id, device_id, mac_address_string, mean_conductivity, mean_wash_tank_temp, en_wash_on,
      date_time_raw AS date_time_utc FROM beacons WHERE k NOT BETWEEN 50 AND 52"""),
)
def trace_files(spark, sf):
    """All events as arrays of up to a million, read back by as many tasks as the files have splits."""
    path = scratch_dir(spark, "trace")
    raw = I.raw_events(spark, sf).withColumn("id", F.get_json_object("value", "$.Id"))
    odd = I.beacons(spark, sf).where("k between 50 and 52").select(F.col("event_id").alias("id"))
    good = raw.where(F.col("id").isNotNull()).join(odd, "id", "left_anti")
    traces.write_trace_file(good.withColumn("n", F.expr("cast(substr(id, 2) as bigint)")), path)
    return traces.read_trace_files(spark, path).select(
        "event_id", "device_id", "mac_address_string", "mean_conductivity", "mean_wash_tank_temp", "en_wash_on", "date_time_utc"
    )


@check(
    "trace_slice",
    I.with_inputs("""SELECT event_id, date_time_utc FROM beacons
    WHERE date_time_utc <= (SELECT min(date_time_utc) FROM beacons) + 3600"""),
)
def trace_slice(spark, sf):
    return traces.trace_slice(I.beacons(spark, sf), 60).select("event_id", "date_time_utc")


@check(
    "pending_rows",
    I.with_inputs("""
    WITH p AS (SELECT * FROM beacons WHERE k % 4 = 0),
    top AS (SELECT * FROM p ORDER BY date_time_utc, event_id LIMIT 100)
    SELECT event_id, date_time_utc, (SELECT count(*) FROM p) AS pending_rows,
      (SELECT count(*) FROM beacons) AS total_rows FROM top"""),
)
def pending_rows(spark, sf):
    """The report of the earliest rows still waiting, with the overall counts."""
    b = I.beacons(spark, sf).withColumn("flags_computed_at", F.when(F.col("k") % 4 != 0, F.col("persisted_at")))
    counts = pending.progress(b)
    return pending.pending(b, limit=100).select(
        "event_id", "date_time_utc",
        counts.select("pending_rows").scalar().alias("pending_rows"),
        counts.select("total_rows").scalar().alias("total_rows"),
    )


@check(
    "extract_runs",
    I.with_inputs("""
    SELECT mac_address_string, beacon_event_id, event_time_utc_ms // 1000 AS date_time_utc, event_time_utc_ms,
      kafka_logappend_ms, CAST(NULL AS DOUBLE) AS fal_seconds, CAST(NULL AS BIGINT) AS features_ready_ms, op_state,
      mean_conductivity, persisted_at_ms AS persisted_ms, 'r1' AS run_id, 'kappa' AS architecture
    FROM beacons WHERE architecture = 'kappa' UNION ALL
    SELECT mac_address_string, beacon_event_id, event_time_utc_ms // 1000, event_time_utc_ms,
      kafka_logappend_ms, CAST(NULL AS DOUBLE), persisted_at_ms, op_state,
      mean_conductivity, persisted_at_ms, 'r2', 'lambda' FROM beacons WHERE architecture = 'lambda'"""),
)
def extract_runs(spark, sf):
    """Two architectures with different columns, brought to one extract."""
    b = I.beacons(spark, sf)
    kappa = b.where("architecture = 'kappa'").withColumnRenamed(S.MAC, "mac_address")
    lam = b.where("architecture = 'lambda'").withColumn("features_ready_ms", F.col("persisted_at_ms"))
    both = runs.extract_run(kappa, "kappa", "r1", mac="mac_address").unionByName(
        runs.extract_run(lam, "lambda", "r2")
    )
    return both.select(
        "mac_address_string", "beacon_event_id", "date_time_utc", "event_time_utc_ms", "kafka_logappend_ms",
        "fal_seconds", "features_ready_ms", "op_state", "mean_conductivity",
        fn.epoch_ms(F.col("persisted_at")).alias("persisted_ms"), "run_id", "architecture",
    )


def _written_runs(spark, sf) -> str:
    path = scratch_dir(spark, "runs")
    rows = runs.align_schema(I.beacons(spark, sf), {**S.EXTRACT_TYPES, "workload": "string", "repeat": "int", "architecture": "string"})
    rows.write.option("header", True).partitionBy("architecture", "workload", "repeat").csv(path)
    return path


@check(
    "run_discovery",
    I.with_inputs("""SELECT architecture, workload, repeat, count(*) AS events,
      max(persisted_at_ms) AS last_persisted_ms FROM beacons GROUP BY ALL"""),
)
def run_discovery(spark, sf):
    """Extracts are written as CSV, found again by listing, and read with their run keys."""
    path = _written_runs(spark, sf)
    found = runs.discover_runs(spark, path).select("architecture", "workload", "repeat").distinct()
    read = runs.read_runs(spark, path).groupBy("architecture", "workload", "repeat").agg(
        F.count(F.lit(1)).alias("events"),
        F.max(fn.epoch_ms(F.col("persisted_at"))).alias("last_persisted_ms"),
    )
    return found.join(read, ["architecture", "workload", "repeat"])


@check(
    "manifest_merge",
    I.with_inputs("""
    WITH found AS (SELECT DISTINCT architecture, workload, repeat FROM beacons WHERE repeat < 2),
    listed AS (SELECT architecture, workload, repeat, count(*) AS produced_events FROM beacons
      WHERE repeat > 0 GROUP BY ALL)
    SELECT architecture, workload, repeat,
      CASE WHEN l.repeat IS NULL OR workload = 'A' THEN 'found' ELSE 'listed' END AS csv_path, produced_events
    FROM found f FULL JOIN listed l USING (architecture, workload, repeat)
    WHERE NOT (f.repeat IS NULL AND workload = 'A')
    UNION ALL SELECT architecture, workload, repeat, NULL, produced_events FROM listed
    WHERE repeat = 2 AND workload = 'A'"""),
)
def manifest_merge(spark, sf):
    b = I.beacons(spark, sf)
    found = b.where("repeat < 2").select("architecture", "workload", "repeat").distinct().withColumn(
        "csv_path", F.lit("found")
    )
    listed = b.where("repeat > 0").groupBy("architecture", "workload", "repeat").agg(
        F.when(F.max("workload") == "A", F.lit("")).otherwise(F.lit("listed")).alias("csv_path"),
        F.count(F.lit(1)).alias("produced_events"),
    )
    return runs.merge_manifest(found, listed)


@check(
    "run_csv_export",
    I.with_inputs("""SELECT architecture, 'A' AS workload, CAST(0 AS INTEGER) AS repeat, 'r-' || architecture AS run_id,
      mac_address_string, date_time_raw // CASE WHEN k % 3 = 0 THEN 1000 ELSE 1 END AS date_time_utc, mean_conductivity,
      op_state, persisted_at_ms AS persisted_ms FROM beacons"""),
)
def run_csv_export(spark, sf):
    """Each architecture's extract is exported as CSV in its run's folder, found there and read again."""
    path = scratch_dir(spark, "export")
    for architecture in ("kappa", "lambda"):
        rows = I.beacons(spark, sf).where(F.col("architecture") == architecture)
        extract = runs.extract_run(rows, architecture, f"r-{architecture}")
        runs.write_run_csv(extract, f"{path}/{architecture}/workload_A/run_0/raw_data.csv")
    found = runs.discover_runs(spark, path)
    types = {**S.EXTRACT_TYPES, "run_id": "string", "architecture": "string"}
    # One path for each part of an export.
    paths = [r.csv_path for r in found.select("csv_path").collect()]
    read = spark.read.option("header", True).schema(", ".join(f"{n} {k}" for n, k in types.items())).csv(paths)
    keyed = read.join(found.select("architecture", "workload", "repeat").distinct(), "architecture")
    return keyed.select(
        "architecture", "workload", "repeat", "run_id", "mac_address_string", "date_time_utc", "mean_conductivity", "op_state",
        fn.epoch_ms(F.col("persisted_at")).alias("persisted_ms"),
    )


@check(
    "summary_json",
    I.with_inputs("""SELECT architecture, workload, 'wash' AS metric, count(mean_wash_tank_temp) AS n,
      round(avg(mean_wash_tank_temp), 6) AS mean FROM beacons GROUP BY ALL
    UNION ALL SELECT architecture, workload, 'rinse', count(mean_rinse_temp), round(avg(mean_rinse_temp), 6) FROM beacons GROUP BY ALL"""),
)
def summary_json(spark, sf):
    """The summary as JSON, one object per architecture and workload, read again."""
    path = scratch_dir(spark, "summary")
    b = I.beacons(spark, sf)
    long = b.select(
        "architecture", "workload",
        F.explode(F.create_map(F.lit("wash"), "mean_wash_tank_temp", F.lit("rinse"), "mean_rinse_temp")).alias("metric", "value"),
    )
    figures = long.groupBy("architecture", "workload", "metric").agg(
        F.count("value").alias("n"), fn.steady_round(F.avg("value"), 6).alias("mean")
    )
    sinks.write_summary_json(figures, path)
    read = spark.read.schema("architecture string, workload string, metrics map<string, struct<n: bigint, mean: double>>").json(path)
    return read.select("architecture", "workload", F.explode("metrics").alias("metric", "v")).select(
        "architecture", "workload", "metric", "v.n", "v.mean"
    )


# --- sinks -----------------------------------------------------------------------------------
@check(
    "dedup_first",
    I.with_inputs("""
    WITH d AS (SELECT * REPLACE (CASE WHEN k = 30 THEN NULL ELSE event_id END AS event_id) FROM beacons_dup)
    SELECT event_id, mac_address_string, persisted_at_ms FROM d
    WHERE event_id IS NULL OR copy = 0""", I.SQL_DUP),
)
def dedup_first(spark, sf):
    d = I.beacons_dup(spark, sf).withColumn("event_id", F.when(F.col("k") != 30, F.col("event_id")))
    return sinks.dedup_first(d, order=["persisted_at_ms"]).select(
        "event_id", "mac_address_string", "persisted_at_ms"
    )


@check(
    "insert_ignore",
    I.with_inputs("""
    SELECT event_id, CAST(CASE WHEN k < 20 THEN -1 ELSE persisted_at_ms END AS BIGINT) AS persisted_at_ms
    FROM beacons_dup WHERE copy = 0""", I.SQL_DUP),
)
def insert_ignore(spark, sf):
    rows = I.beacons_dup(spark, sf).select("event_id", "persisted_at_ms", "k", "copy")
    target = rows.where("k < 20 and copy = 0").select(
        "event_id", F.lit(-1).cast("bigint").alias("persisted_at_ms")
    )
    return sinks.insert_ignore(rows.drop("k", "copy"), target, order=["persisted_at_ms"])


@check(
    "upsert_last",
    I.with_inputs("""
    SELECT event_id, max(persisted_at_ms) AS persisted_at_ms, max(copy) AS copy
    FROM beacons_dup GROUP BY event_id""", I.SQL_DUP),
)
def upsert_last(spark, sf):
    rows = I.beacons_dup(spark, sf).select("event_id", "persisted_at_ms", "copy")
    target = rows.where("copy = 0")
    return sinks.upsert(rows, target, key=["event_id"], order=["persisted_at_ms"])


@check(
    "machines_upsert",
    I.with_inputs("""
    SELECT mac, CASE WHEN site = 'BUILDING' THEN wash_temp_setpoint + 2 ELSE wash_temp_setpoint END AS wash_temp_setpoint,
      CASE WHEN site = 'BUILDING' THEN NULL ELSE device_name END AS device_name FROM machines""", M),
)
def machines_upsert(spark, sf):
    """All attributes are overwritten, also with NULL; a machine listed twice takes its later row."""
    m = I.machines(spark, sf)
    fresh = m.where("site = 'BUILDING'").select(
        "mac", F.explode(F.array(F.lit(1), F.lit(2))).alias("position"), "wash_temp_setpoint",
        F.lit(None).cast("string").alias("device_name"),
    ).withColumn("wash_temp_setpoint", F.col("wash_temp_setpoint") + F.col("position"))
    return sinks.upsert(fresh, m.select("mac", "wash_temp_setpoint", "device_name"), key=["mac"], order=["position"])


# --- domains ---------------------------------------------------------------------------------
DOMAIN = """CASE CAST('0x' || substr(md5(mac_address_string), 1, 2) AS INTEGER) % 3
      WHEN 0 THEN 'washing' WHEN 1 THEN 'rinsing' ELSE 'chemistry' END"""


@check("mesh_domain", I.with_inputs(f"SELECT event_id, mac_address_string, {DOMAIN} AS domain FROM beacons"))
def mesh_domain(spark, sf):
    return domains.with_domain(I.beacons(spark, sf)).select("event_id", "mac_address_string", "domain")


@check(
    "mesh_products",
    I.with_inputs(f"""SELECT {DOMAIN} AS domain, count(*) AS events, count(DISTINCT mac_address_string) AS devices
    FROM beacons GROUP BY 1"""),
)
def mesh_products(spark, sf):
    """Each product is read through its own view."""
    b = domains.with_domain(I.beacons(spark, sf))
    domains.register_products(b)
    parts = [
        spark.table(f"{name}_product").groupBy("domain").agg(
            F.count(F.lit(1)).alias("events"), F.countDistinct("mac_address_string").alias("devices")
        )
        for name in S.DOMAINS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


GATE_SQL = """SELECT domain, round(avg(missing_rate), 6) AS missing_rate_avg,
      round(avg(1 - missing_rate), 6) AS field_consistency_avg, round(avg(flag_flip_rate), 6) AS flag_flip_rate_avg,
      CASE WHEN avg(missing_rate) < 0.0605 AND avg(1 - missing_rate) > 0.7 THEN 'pass' ELSE 'warn' END AS status
    FROM q GROUP BY domain"""
GATE_COLUMNS = ("domain", "missing_rate_avg", "field_consistency_avg", "flag_flip_rate_avg", "status")


def _gates(featured):
    gates = domains.quality_gates(featured, max_missing=0.0605, now=now())
    return rounded(gates, *GATE_COLUMNS[1:4]).select(*GATE_COLUMNS)


@check(
    "quality_gates",
    I.with_inputs(f"""WITH q AS (SELECT {DOMAIN} AS domain, {MISSING} AS missing_rate,
        CAST(k % 2 AS DOUBLE) / 4 AS flag_flip_rate FROM beacons) {GATE_SQL}"""),
)
def quality_gates(spark, sf):
    b = domains.with_domain(I.beacons(spark, sf))
    return _gates(
        b.withColumns(
            {
                "missing_rate": fn.missing_rate(),
                "field_consistency_score": F.lit(1.0) - fn.missing_rate(),
                "flag_flip_rate": (F.col("k") % 2) / 4,
            }
        )
    )


@check(
    "gate_upsert",
    I.with_inputs(f"""WITH q AS (SELECT {DOMAIN} AS domain, {MISSING} AS missing_rate,
        CAST(k % 2 AS DOUBLE) / 4 AS flag_flip_rate FROM beacons)
    SELECT *, CAST({NOW_MS} AS BIGINT) AS run_ms FROM ({GATE_SQL})
    UNION ALL SELECT 'rinsing_old', 0e0, 5e-1, 0e0, 'warn', CAST({NOW_MS} - 60000 AS BIGINT)"""),
)
def gate_upsert(spark, sf):
    """Two runs meet a table of an older run: an early one, listed last, and the one that counts."""
    rows = domains.with_domain(I.beacons(spark, sf)).withColumns(
        {
            "missing_rate": fn.missing_rate(),
            "field_consistency_score": F.lit(1.0) - fn.missing_rate(),
            "flag_flip_rate": (F.col("k") % 2) / 4,
        }
    )
    early = now() - F.expr("interval 1 minute")
    old = domains.quality_gates(rows.where("k % 3 = 0"), now=early)
    gone = domains.quality_gates(
        rows.limit(1).select(
            F.lit("rinsing_old").alias("domain"), F.lit(0.0).alias("missing_rate"),
            F.lit(0.5).alias("field_consistency_score"), F.lit(0.0).alias("flag_flip_rate"),
        ),
        now=early,
    )
    new = domains.quality_gates(rows, max_missing=0.0605, now=now())
    both = new.unionByName(domains.quality_gates(rows.where("k % 2 = 0"), now=early))
    table = domains.upsert_gates(old.unionByName(gone), both)
    return rounded(table, *GATE_COLUMNS[1:4]).select(*GATE_COLUMNS, fn.epoch_ms(F.col("last_gate_run")).alias("run_ms"))


@check(
    "quality_snapshot",
    I.with_inputs(f"""WITH q AS (SELECT {DOMAIN} AS domain,
        CASE WHEN k % 7 = 0 THEN NULL ELSE {MISSING} END AS missing_rate FROM beacons)
    SELECT domain, round(avg(coalesce(missing_rate, 0e0)), 6) AS missing_rate_avg,
      round(avg(coalesce(1 - missing_rate, 0.5e0)), 6) AS field_consistency_avg, count(*) AS sample_count
    FROM q GROUP BY domain"""),
)
def quality_snapshot(spark, sf):
    b = domains.with_domain(I.beacons(spark, sf))
    rate = F.when(F.col("k") % 7 != 0, fn.missing_rate())
    snapshot = domains.quality_snapshot(
        b.withColumns({"missing_rate": rate, "field_consistency_score": F.lit(1.0) - rate})
    )
    return rounded(snapshot, "missing_rate_avg", "field_consistency_avg")


# --- workload transforms ---------------------------------------------------------------------
def hexdraw(seed: str, part: int) -> str:
    return f"CAST('0x' || substr(md5(event_id || '|{seed}'), {1 + 4 * part}, 4) AS INTEGER)"


@check(
    "replicate_devices",
    I.with_inputs("""
    SELECT CASE WHEN c = 0 THEN event_id ELSE md5(event_id || '|' || c) END AS event_id,
      CASE WHEN c = 0 THEN mac_address_string ELSE mac_address_string || '_R' || lpad(CAST(c AS VARCHAR), 4, '0') END
        AS mac_address_string, date_time_utc
    FROM beacons, (SELECT unnest(range(3)) AS c)"""),
)
def replicate_devices(spark, sf):
    return workloads.replicate_devices(I.beacons(spark, sf), 3).select(
        "event_id", "mac_address_string", "date_time_utc"
    )


FAULT_SQL = f"""f AS (SELECT event_id, date_time_utc AS t,
      CASE WHEN {hexdraw('time', 0)} < 1310 THEN CASE WHEN {hexdraw('time', 1)} % 2 = 0 THEN 'late' ELSE 'future' END END AS fault,
      10 + {hexdraw('time', 2)} % 51 AS delay FROM beacons)"""


@check(
    "inject_time_faults",
    I.with_inputs(f"""WITH {FAULT_SQL}
    SELECT event_id, fault, CAST(CASE fault WHEN 'late' THEN t - delay WHEN 'future' THEN t + 3600 ELSE t END AS BIGINT)
      AS date_time_utc, count(*) OVER (PARTITION BY fault) AS events FROM f"""),
)
def inject_time_faults(spark, sf):
    faulty = workloads.inject_time_faults(I.beacons(spark, sf), 0.02)
    kinds = workloads.injection_counts(faulty, "_fault").unionByName(
        faulty.where("_fault is null").agg(F.lit(None).cast("string").alias("kind"), F.count(F.lit(1)).alias("events"))
    )
    return faulty.join(F.broadcast(kinds), F.col("_fault").eqNullSafe(F.col("kind"))).select(
        "event_id", F.col("_fault").alias("fault"), "date_time_utc", "events"
    )


@check(
    "inject_range_violations",
    I.with_inputs(f"""
    WITH v AS (SELECT *, CASE WHEN {hexdraw('range', 0)} < 6553 THEN {hexdraw('range', 1)} % 3 END AS s,
        CASE {hexdraw('range', 2)} % 3 WHEN 0 THEN -1e0 WHEN 1 THEN 256e0 ELSE 300e0 END AS bad FROM beacons)
    SELECT event_id, CASE s WHEN 0 THEN 'wash_temp' WHEN 1 THEN 'rinse_temp' WHEN 2 THEN 'conductivity' END AS violation,
      CASE WHEN s = 0 THEN bad ELSE mean_wash_tank_temp END AS mean_wash_tank_temp,
      CASE WHEN s = 1 THEN bad ELSE mean_rinse_temp END AS mean_rinse_temp,
      CASE WHEN s = 2 THEN bad ELSE mean_conductivity END AS mean_conductivity FROM v"""),
)
def inject_range_violations(spark, sf):
    return workloads.inject_range_violations(I.beacons(spark, sf), 0.1).select(
        "event_id", F.col("_schema_violation").alias("violation"), *S.SENSORS
    )


# --- whole jobs ------------------------------------------------------------------------------
@check(
    "baseline_job",
    I.with_inputs(f"""WITH e AS (
      SELECT b.*, m.wash_temp_setpoint, m.rinse_temp_setpoint,
        avg(mean_conductivity) OVER (PARTITION BY mac_address_string ORDER BY date_time_utc
          RANGE BETWEEN 899 PRECEDING AND CURRENT ROW) AS rolled
      FROM beacons b LEFT JOIN machines m ON b.mac_address_string = m.mac),
    c AS (SELECT *, coalesce(mean_wash_tank_temp < wash_temp_setpoint, FALSE) AS wash_now,
        coalesce(mean_rinse_temp < rinse_temp_setpoint, FALSE) AS rinse_now,
        coalesce(rolled > setpoint_conductivity * 1.1e0, FALSE) AS over_now,
        coalesce(rolled < setpoint_conductivity * 0.9e0, FALSE) AS under_now,
        count(*) OVER (PARTITION BY mac_address_string) AS n,
        avg(CAST(coalesce(mean_wash_tank_temp < wash_temp_setpoint - 2, FALSE) AS INTEGER))
          OVER (PARTITION BY mac_address_string) AS share FROM e),
    f AS (SELECT *,
        CASE WHEN en_wash_on = 1 THEN {sustained('wash_now')} ELSE FALSE END AS temp_below_setpoint,
        CASE WHEN en_rinse_on = 1 THEN {sustained('rinse_now')} ELSE FALSE END AS rinse_temp_below_setpoint,
        {sustained('over_now')} AS conc_constant_over, {sustained('under_now')} AS conc_constant_under,
        coalesce(mean_wash_tank_temp - lag(mean_wash_tank_temp) OVER w < -1, FALSE) AS temp_trend_down,
        n >= 3 AND share > 0.2 AS temp_frequent_violation FROM c WINDOW w AS ({W}))
    SELECT event_id, temp_below_setpoint, rinse_temp_below_setpoint, conc_constant_over, conc_constant_under,
      NOT conc_constant_over AND NOT conc_constant_under AS conc_ok, temp_trend_down, temp_frequent_violation,
      {QUIET_SQL}, CAST({NOW_MS} AS BIGINT) AS features_ready_ms, ({NOW_MS} - kafka_logappend_ms) / 1000e0 AS fal_seconds
    FROM f""", M),
)
def baseline_job(spark, sf):
    return batch.baseline_job(I.beacons(spark, sf), I.machines(spark, sf), now=now()).select(
        "event_id", *S.RULE_FLAGS, "conc_ok", "temp_trend_down", "temp_frequent_violation",
        "features_ready_ms", "fal_seconds",
    )


READY = "(kafka_logappend_ms // 1200000 + 1) * 1200000"
STREAM_FROM = """FROM beacons b LEFT JOIN machines m ON b.mac_address_string = m.mac
      LEFT JOIN w ON b.mac_address_string = w.mac AND b.kafka_logappend_ms // 1200000 = w.slot"""


@check(
    "kappa_job",
    I.with_inputs(WINDOW_SQL + f"""
    SELECT CASE WHEN k % 10 = 0 THEN 'fallback_' || ((kafka_logappend_ms // 1000) * 1000) || '_' || mac_address_string
        ELSE event_id END AS event_id, date_time_raw * 1000 AS event_time_utc_ms,
      (kafka_logappend_ms // 1000) * 1000 AS kafka_logappend_ms, {POINT_SQL}, {CONC_OK_SQL} AS conc_ok, {QUIET_SQL},
      {READY} AS ready_ms {STREAM_FROM}""", M),
)
def kappa_job(spark, sf):
    b = I.beacons(spark, sf)
    unkeyed = b.withColumn("event_id", F.when(F.col("k") % 10 != 0, F.col("event_id")))
    out = stream.kappa_job(unkeyed, I.machines(spark, sf), raw_time="date_time_raw")
    return out.select(
        "event_id", "event_time_utc_ms", "kafka_logappend_ms", *S.RULE_FLAGS, "conc_ok",
        fn.epoch_ms(F.col("stream_features_ready_at")).alias("ready_ms"),
    )


@check(
    "lambda_serving_merge",
    I.with_inputs(BATCH_FLAGS_SQL + f"""
    SELECT event_id, event_time_utc_ms, (kafka_logappend_ms // 1000) * 1000 AS kafka_logappend_ms,
      temp_below_setpoint, rinse_temp_below_setpoint, conc_constant_over, conc_constant_under,
      NOT conc_constant_over AND NOT conc_constant_under AS conc_ok, {QUIET_SQL},
      {READY} AS ready_ms, CAST({NOW_MS} AS BIGINT) AS flags_computed_ms FROM f""", M),
)
def lambda_serving_merge(spark, sf):
    out = stream.lambda_job(I.beacons(spark, sf), I.machines(spark, sf), raw_time="date_time_raw", now=now())
    return out.select(
        "event_id", "event_time_utc_ms", "kafka_logappend_ms", *S.RULE_FLAGS, "conc_ok",
        fn.epoch_ms(F.col("speed_features_ready_at")).alias("ready_ms"),
        fn.epoch_ms(F.col("flags_computed_at")).alias("flags_computed_ms"),
    )


@check(
    "fabric_job",
    I.with_inputs(f"""
    WITH w AS (SELECT mac_address_string AS wmac, event_time_utc_ms // 1200000 AS slot,
        avg(mean_conductivity) AS avg_conductivity, (event_time_utc_ms // 1200000 + 1) * 1200000 AS end_ms FROM beacons
      WHERE coalesce(mean_conductivity, mean_wash_tank_temp, mean_rinse_temp) IS NOT NULL GROUP BY 1, 2, 4)
    SELECT event_id, {POINT_SQL}, {CONC_OK_SQL} AS conc_ok, {QUIET_SQL}, TRUE AS schema_valid, date_time_utc,
      event_time_utc_ms, greatest((kafka_logappend_ms // 1000) * 1000, produced_at_ms) AS kafka_logappend_ms,
      end_ms AS ready_ms
    FROM beacons b ASOF LEFT JOIN machine_versions v
        ON b.mac_address_string = v.mac AND b.date_time_utc >= v.valid_from
      LEFT JOIN w ON b.mac_address_string = w.wmac AND b.event_time_utc_ms // 1200000 = w.slot
    WHERE {VALID}""", M, I.SQL_VERSIONS),
)
def fabric_job(spark, sf):
    out = stream.fabric_job(I.beacons(spark, sf), I.machine_versions(spark, sf), raw_time="date_time_raw")
    return out.select(
        "event_id", *S.RULE_FLAGS, "conc_ok", "schema_valid", "date_time_utc", "event_time_utc_ms",
        "kafka_logappend_ms", fn.epoch_ms(F.col("stream_features_ready_at")).alias("ready_ms"),
    )


@check(
    "mesh_job",
    I.with_inputs(STABILITY_SQL + f""",
    q AS (SELECT {DOMAIN} AS domain, {MISSING} AS missing_rate, flag_flip_rate FROM s) {GATE_SQL}""", M),
)
def mesh_job(spark, sf):
    """Domain products with their features, gated."""
    return _gates(stream.mesh_job(with_latency(spark, sf), I.machines(spark, sf), now=now()))


# --- declared-only flags ---------------------------------------------------------------------
VIOLATION = "coalesce(mean_conductivity > setpoint_conductivity * 1.1e0, FALSE)"
WASH = "CASE WHEN en_wash_on >= 1 THEN coalesce(mean_wash_tank_temp < wash_temp_setpoint, FALSE) ELSE FALSE END"
RANGE = "PARTITION BY mac_address_string ORDER BY date_time_utc RANGE BETWEEN {} PRECEDING AND CURRENT ROW"
E_SQL = """WITH e AS (SELECT b.*, m.wash_temp_setpoint, m.rinse_temp_setpoint
      FROM beacons b LEFT JOIN machines m ON b.mac_address_string = m.mac)"""


def _violations(spark, sf):
    df = join_setpoints(I.beacons(spark, sf), I.machines(spark, sf))
    return df.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in point_flags().items()})


@check(
    "recovery_failure",
    I.with_inputs(E_SQL + f""",
    v AS (SELECT *, {VIOLATION} AS conc_v, {WASH} AS wash_v,
        date_time_utc - min(date_time_utc) OVER (PARTITION BY mac_address_string) AS age FROM e)
    SELECT event_id, age >= 600 AND bool_and(wash_v) OVER ({RANGE.format(599)}) AS wash_temp_recovery_failure,
      age >= 600 AND bool_and(conc_v) OVER ({RANGE.format(599)}) AS conc_recovery_failure FROM v""", M),
)
def recovery_failure(spark, sf):
    out = issues.recovery_failure(
        _violations(spark, sf),
        {"temp_below_setpoint": "wash_temp_recovery_failure", "conc_constant_over": "conc_recovery_failure"},
    )
    return out.select("event_id", "wash_temp_recovery_failure", "conc_recovery_failure")


@check(
    "repeated_issue",
    I.with_inputs(E_SQL + f""",
    v AS (SELECT *, {VIOLATION} AS conc_v, {WASH} AS wash_v FROM e),
    s AS (SELECT *, CAST(conc_v AND NOT lag(conc_v, 1, FALSE) OVER w AS INTEGER) AS conc_s,
        CAST(wash_v AND NOT lag(wash_v, 1, FALSE) OVER w AS INTEGER) AS wash_s FROM v WINDOW w AS ({W}))
    SELECT event_id, sum(wash_s) OVER ({RANGE.format(7199)}) >= 2 AS wash_temp_repeated_issue,
      sum(conc_s) OVER ({RANGE.format(7199)}) >= 2 AS conc_repeated_issue FROM s""", M),
)
def repeated_issue(spark, sf):
    out = issues.repeated_issue(
        _violations(spark, sf),
        {"temp_below_setpoint": "wash_temp_repeated_issue", "conc_constant_over": "conc_repeated_issue"},
    )
    return out.select("event_id", "wash_temp_repeated_issue", "conc_repeated_issue")


@check(
    "high_variance",
    I.with_inputs(f"""
    SELECT event_id,
      coalesce(round(var_samp(mean_wash_tank_temp) OVER ({RANGE.format(1199)}), 9) > 9, FALSE) AS wash_temp_high_variance,
      coalesce(round(var_samp(mean_rinse_temp) OVER ({RANGE.format(1199)}), 9) > 9, FALSE) AS rinse_temp_high_variance
    FROM beacons"""),
)
def high_variance(spark, sf):
    out = issues.high_variance(
        I.beacons(spark, sf),
        {"mean_wash_tank_temp": "wash_temp_high_variance", "mean_rinse_temp": "rinse_temp_high_variance"},
    )
    return out.select("event_id", "wash_temp_high_variance", "rinse_temp_high_variance")


def _sensor_sql() -> str:
    parts = []
    for value, short in (("mean_wash_tank_temp", "wash_temp"), ("mean_rinse_temp", "rinse_temp"), ("mean_conductivity", "conductivity")):
        parts.append(f"round({value} - lag({value}) OVER w, 6) AS {short}_diff")
        parts += [f"round({a}({value}) OVER ({RANGE.format(299)}), 6) AS {short}_{n}_5min"
                  for a, n in (("avg", "mean"), ("min", "min"), ("max", "max"))]
    for value, short in (("mean_wash_tank_temp", "wash_temp"), ("mean_conductivity", "conductivity")):
        parts.append(
            f"""round({value} - (SELECT arg_max(o.{value}, (o.date_time_utc, o.event_id)) FROM beacons o
              WHERE o.mac_address_string = b.mac_address_string AND o.date_time_utc <= b.date_time_utc - 30
                AND o.{value} IS NOT NULL), 6) AS {short}_delta_30s""")
    return I.with_inputs(f"""SELECT event_id, {', '.join(parts)},
      CAST({VIOLATION} AS INTEGER) AS any_anomaly FROM beacons b WINDOW w AS ({W})""")


@check("sensor_features", _sensor_sql())
def sensor_features(spark, sf):
    b = I.beacons(spark, sf).withColumn(
        "conc_constant_over", F.coalesce(point_flags()["conc_constant_over"], F.lit(False))
    )
    out = issues.sensor_features(b)
    names = [f"{s}_{x}" for s in ("wash_temp", "rinse_temp", "conductivity") for x in ("diff", "mean_5min", "min_5min", "max_5min")]
    names += ["wash_temp_delta_30s", "conductivity_delta_30s"]
    return rounded(out, *names).select("event_id", *names, "any_anomaly")
