"""From run extracts to the summary of all architectures and workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewatch.operators.runs import aggregate_runs, readiness_indices, run_metrics, run_rollup


#: Decimals of the figures that are rolled up over runs.
RUN_FIGURES = {
    "wall_clock_seconds": 1, "actual_msg_per_sec": 1, "produced_events": 0, "db_written_events": 0, "db_write_rate_msg_s": 1,
}


def run_report_summary(
    runs: DataFrame, *, warmup_minutes: float | None = None, measurement_minutes: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """What the summary says of runs besides their metrics, from runs joined with their reports.

    First, one row per architecture and workload: number of repeats, the slice's parameters, and the
    producer settings of the first run that reports any. Second, average and bounds of the runs' figures;
    a producer's zero wall clock or rate counts as not reported.
    """
    by = ["architecture", "workload"]
    told = F.col("mode").isNotNull() | F.col("rate_limit").isNotNull() | F.col("replication_factor").isNotNull()
    first = {"producer_mode": "mode", "target_rate": "rate_limit", "replication_factor": "replication_factor"}
    settings = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("repeats"),
        F.lit(warmup_minutes).cast("double").alias("warmup_minutes"),
        F.lit(measurement_minutes).cast("double").alias("measurement_minutes"),
        *(F.min_by(source, F.when(told, F.col("repeat"))).alias(name) for name, source in first.items()),
    )
    reported = {c: F.when(F.col(c) != 0, F.col(c)) for c in ("wall_clock_seconds", "actual_msg_per_sec")}
    figures = {c: d for c, d in RUN_FIGURES.items() if c in runs.columns}
    return settings, run_rollup(runs.withColumns(reported), figures)


def summary_job(runs: DataFrame, **options) -> DataFrame:
    """Aggregated metrics of all runs with the readiness scores appended as metrics."""
    aggregated = aggregate_runs(run_metrics(runs, **options))
    scores = readiness_indices(aggregated)
    names = [c for c in scores.columns if c not in ("architecture", "workload")]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    long = scores.select("architecture", "workload", F.explode(pairs).alias("_p")).select(
        "architecture", "workload", "_p.*"
    )
    return aggregated.unionByName(long, allowMissingColumns=True)
