"""Run reports beside the extracts, their roll-up, and batch latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewatch.operators import features
from brinewatch.plans.summary import run_report_summary
from brinewatch.session import scratch_dir
from brinewatch.sources import runs as run_source
from checks import inputs as I
from checks.feature_checks import NOW_MS, now, rounded, with_latency
from checks.registry import check

# Every run of workload E lacks a producer report.
RUNS_SQL = """runs AS (SELECT architecture, workload, repeat, count(*) AS produced_events,
    count(*) FILTER (k % 20 <> 0) AS db_written_events, max(mean_rinse_temp) AS cpu,
    CASE WHEN workload <> 'E' THEN CASE WHEN repeat = 0 THEN 'replay' ELSE 'rate' END END AS mode,
    CASE WHEN workload <> 'E' THEN CAST(count(*) AS DOUBLE) / 2 END AS rate_limit,
    CASE WHEN workload <> 'E' THEN CAST(1 + repeat AS BIGINT) END AS replication_factor,
    CASE WHEN workload <> 'E' AND repeat < 2 THEN CAST(count(*) AS DOUBLE) / 8
      WHEN workload <> 'E' THEN 0 END AS wall_clock_seconds FROM beacons GROUP BY architecture, workload, repeat)"""


def _runs(spark, sf):
    """Runs joined with their reports, which are written as JSON files first and read back."""
    found = I.beacons(spark, sf).groupBy("architecture", "workload", "repeat").agg(
        F.count(F.lit(1)).alias("produced_events"),
        F.count_if(F.col("k") % 20 != 0).alias("db_written_events"),
        F.max("mean_rinse_temp").alias("cpu"),
    )
    root, n = scratch_dir(spark, "reports"), F.col("produced_events").cast("double")
    hardware = F.expr("named_struct('hardware_metrics', map('cpu', map('max', cpu)))")
    producer = F.struct(
        F.when(F.col("repeat") == 0, "replay").otherwise("rate").alias("mode"), (n / 2).alias("rate_limit"),
        (1 + F.col("repeat")).alias("replication_factor"),
        F.when(F.col("repeat") < 2, n / 8).otherwise(0.0).alias("wall_clock_seconds"),
    )
    keys = ["architecture", "workload", "repeat"]
    for name, body, rows in (
        ("run_meta.json", hardware, found), ("producer_report.json", producer, found.where("workload <> 'E'"))
    ):
        texts = rows.select(*keys, F.to_json(body).alias("value"))
        texts.write.partitionBy(*keys).text(f"{root}/{name}")
    meta = run_source.read_run_reports(spark, f"{root}/run_meta.json", run_source.HARDWARE_FIELDS)
    reports = run_source.read_run_reports(spark, f"{root}/producer_report.json", run_source.PRODUCER_FIELDS)
    return run_source.join_run_reports(found.drop("cpu"), meta, reports)


@check(
    "run_reports",
    I.with_inputs("""SELECT architecture, workload, repeat, produced_events, cpu, mode, rate_limit, replication_factor,
      wall_clock_seconds FROM runs""", RUNS_SQL),
)
def run_reports(spark, sf):
    cpu = F.col("hardware_metrics")["cpu"]["max"].alias("cpu")
    return _runs(spark, sf).select(
        "architecture", "workload", "repeat", "produced_events", cpu, "mode", "rate_limit", "replication_factor",
        "wall_clock_seconds",
    )


@check(
    "run_report_summary",
    I.with_inputs("""
    SELECT architecture, workload, count(*) AS repeats, 5e0 AS warmup_minutes, arg_min(mode, repeat) AS producer_mode,
      arg_min(rate_limit, repeat) AS target_rate, min(replication_factor) AS replication_factor,
      round(avg(nullif(wall_clock_seconds, 0)), 1) AS wall_mean, max(nullif(wall_clock_seconds, 0)) AS wall_max,
      round(avg(produced_events), 0) AS produced_mean, CAST(min(db_written_events) AS DOUBLE) AS written_min
    FROM runs GROUP BY architecture, workload""", RUNS_SQL),
)
def report_summary(spark, sf):
    settings, figures = run_report_summary(_runs(spark, sf), warmup_minutes=5, measurement_minutes=5)

    def figure(metric, column):
        return F.max(F.when(F.col("metric") == metric, F.col(column)))

    wide = figures.groupBy("architecture", "workload").agg(
        figure("wall_clock_seconds", "mean").alias("wall_mean"), figure("wall_clock_seconds", "max").alias("wall_max"),
        figure("produced_events", "mean").alias("produced_mean"), figure("db_written_events", "min").alias("written_min"),
    )
    return settings.drop("measurement_minutes").join(wide, ["architecture", "workload"])


@check(
    "batch_latency",
    I.with_inputs(f"""SELECT event_id, round(({NOW_MS} - persisted_at_ms) / 1000e0
      + (persisted_at_ms - kafka_logappend_ms) / 1000e0, 6) AS batch_latency FROM beacons"""),
)
def batch_latency(spark, sf):
    rows = with_latency(spark, sf).withColumn("flags_computed_at", now())
    return rounded(rows.withColumn("batch_latency", features.batch_latency()), "batch_latency").select(
        "event_id", "batch_latency"
    )
