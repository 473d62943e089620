"""Metrics of whole runs, their aggregation over repeats, and the readiness indices.

Tables are long: one row per run (or architecture and workload) and metric.  Distribution metrics
fill ``mean, std, p95, p99``; scalar metrics fill ``value``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewatch import schema as S
from brinewatch.functions import alarm_flag, event_s, event_s_whole, steady_round
from brinewatch.operators import quality, timeliness
from brinewatch.operators.distribution import metric_summary
from brinewatch.operators.skew import DEFAULT_POLICY, HotPolicy, hot_devices
from brinewatch.session import checkpointed

RUN = ("architecture", "workload", "repeat")

# --- Fixed values: metric names -----------------------------------------------------------
DISTRIBUTION_METRICS = (
    "ingest_latency_s", "persist_latency_s", "availability_latency_s", "fal_total_window_s",
    "flag_flip_rate_per_hour", "mtbf_minutes", "missing_rate", "window_integrity_score_5min",
)
ML_METRICS = {
    "precision": "ml_precision", "recall": "ml_recall", "f1": "ml_f1",
    "support_positive": "ml_support_positive", "support_total": "ml_support_total",
}
COUNT_METRICS = ("event_count", "device_count")
WHOLE_METRICS = ("ml_support_positive", "ml_support_total")
EMPTY_RUN = {"out_of_order_count": 0.0, "out_of_order_rate": 0.0, "event_count": 0.0, "device_count": 0.0}

STATS = ("mean", "std", "p95", "p99")


def run_counts(df: DataFrame, *, run: Sequence[str] = RUN) -> DataFrame:
    """Events and distinct devices of each run."""
    per_device = df.groupBy(*run, S.MAC).agg(F.count(F.lit(1)).alias("_c"))
    return per_device.groupBy(*run).agg(
        F.sum("_c").alias("event_count"), F.count(S.MAC).alias("device_count")
    )


def normalise_time(df: DataFrame, time: str = S.TIME) -> DataFrame:
    """Seconds in ``time``: whole numbers stay whole, the millisecond column is the fallback."""
    if time not in df.columns:
        return df.withColumn(time, event_s(F.col("event_time_utc_ms")))
    whole = df.schema[time].dataType.simpleString() in ("bigint", "int")
    return df.withColumn(time, (event_s_whole if whole else event_s)(F.col(time)))


def _values(df: DataFrame, run: Sequence[str], metric: str, value: str, weight: str | None = None) -> DataFrame:
    return df.select(
        *run, F.lit(metric).alias("metric"), F.col(value).cast("double").alias("value"),
        (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("weight"),
    )


def _scalars(df: DataFrame, run: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in columns.items()]
    )
    none = F.lit(None).cast("double")
    return df.select(*run, F.explode(pairs).alias("_p")).select(
        *run, "_p.*", *[none.alias(s) for s in STATS]
    )


def run_metrics(
    df: DataFrame,
    *,
    run: Sequence[str] = RUN,
    warmup_minutes: float = 5,
    measurement_minutes: float = 120,
    threshold: float = S.CONDUCTIVITY_THRESHOLD,
    band: float = S.CONDUCTIVITY_BAND,
    runs: DataFrame | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """All metrics of all runs at once; ``runs`` adds default rows for runs without events."""
    run = list(run)
    rows = timeliness.measurement_slice(
        normalise_time(df), run=run, warmup_minutes=warmup_minutes,
        measurement_minutes=measurement_minutes,
    )
    alarm = alarm_flag(rows, threshold=threshold, band=band)
    # About a dozen steps below read the slice: it is made once.
    rows = checkpointed(rows.withColumn("_alarm", alarm))

    # Device-level tables are read several times below: written once, they also keep plans short.
    hot = hot_devices(rows, (*run, S.MAC), S.TIME, policy)
    gaps = checkpointed(quality.gap_counts(rows, run=run, hot=hot, policy=policy))
    cadence = checkpointed(quality.device_cadence(gaps, run=run))
    arrivals = checkpointed(
        quality.arrival_metrics(rows, run=run, alarm="_alarm", hot=hot, policy=policy)
    )
    bins = quality.integrity_bins(rows, cadence, run=run, hot=hot, policy=policy)
    ml = quality.proxy_ml_metrics(rows, run=run, threshold=threshold, band=band, hot=hot, policy=policy)

    # One summary serves all device- and window-level metrics.
    values = reduce(
        DataFrame.unionByName,
        [
            _values(timeliness.fal_windows(rows, run=run), run, "fal_total_window_s", "fal_total_s"),
            arrivals.select(
                *run,
                F.explode(
                    F.array(
                        F.struct(F.lit("flag_flip_rate_per_hour").alias("metric"),
                                 F.col("flip_rate_per_hour").alias("value")),
                        F.struct(F.lit("mtbf_minutes").alias("metric"),
                                 F.col("mtbf_minutes").alias("value")),
                    )
                ).alias("_p"),
            ).select(*run, "_p.*", F.lit(1).cast("bigint").alias("weight")),
            _values(quality.gap_rate(gaps, cadence, run=run), run, "missing_rate", "gap_rate"),
            _values(bins, run, "window_integrity_score_5min", "score", "bins"),
        ],
    )
    summaries = metric_summary(values, "value", [*run, "metric"], weight="weight", materialize=True).drop("n")
    latencies = timeliness.latency_decomposition(rows, run=run, materialize=True).drop("n")
    spread = summaries.unionByName(latencies).select(
        *run, "metric", F.lit(None).cast("double").alias("value"), *STATS
    )

    late = arrivals.groupBy(*run).agg(F.sum("ooo_count").alias("_late"))
    per_run = (
        rows.groupBy(*run).agg(F.count(F.lit(1)).alias("_events"), F.avg(F.col("_alarm").cast("int")).alias("_alarms"))
        .join(run_counts(rows, run=run).select(*run, "device_count"), run)
        .join(late, run, "left")
        .join(ml, run, "left")
    )
    late_count = F.coalesce(F.col("_late"), F.lit(0))
    scalars = _scalars(
        checkpointed(per_run), run,
        {
            "out_of_order_count": late_count,
            "out_of_order_rate": steady_round(late_count / F.col("_events"), 6),
            "alarm_rate": steady_round(F.col("_alarms"), 6),
            **{metric: F.col(c) for c, metric in ML_METRICS.items()},
            "event_count": F.col("_events"),
            "device_count": F.col("device_count"),
        },
    )
    out = spread.unionByName(scalars)
    if runs is not None:
        absent = runs.select(*run).join(per_run.select(*run), run, "left_anti")
        out = out.unionByName(_scalars(absent, run, {n: F.lit(v) for n, v in EMPTY_RUN.items()}))
    return out


def aggregate_runs(metrics: DataFrame, *, by: Sequence[str] = ("architecture", "workload")) -> DataFrame:
    """Combine the repeats of each architecture and workload.

    Means, p95 and p99 are averaged; late events are summed; counts keep average, min and max.
    """
    scalar = F.col("metric").isin(*EMPTY_RUN, "alarm_rate", *ML_METRICS.values())
    rounded = {
        c: steady_round(F.avg(c), 6).alias(c) for c in ("mean", "p95", "p99")
    }
    grouped = metrics.groupBy(*by, "metric").agg(
        F.count("mean").alias("_n"),
        F.count("value").alias("_scalars"),
        F.sum("value").alias("_sum"),
        F.avg("value").alias("_avg"),
        F.min("value").alias("_min"),
        F.max("value").alias("_max"),
        *rounded.values(),
        steady_round(F.coalesce(F.stddev_samp("mean"), F.lit(0.0)), 6).alias("_across"),
        steady_round(F.avg("std"), 6).alias("_within"),
    )
    counted = F.col("metric").isin(*COUNT_METRICS)
    value = (
        F.when(F.col("metric") == "out_of_order_count", F.col("_sum"))
        .when(counted, steady_round(F.col("_avg"), 1))
        .when(F.col("metric").isin(*WHOLE_METRICS), F.floor("_avg").cast("double"))
        .when(scalar, steady_round(F.col("_avg"), 6))
    )
    return grouped.where((F.col("_n") > 0) | (F.col("_scalars") > 0)).select(
        *by, "metric", value.alias("value"), "mean", "p95", "p99",
        F.when(~scalar, F.col("_across")).alias("std_across_runs"),
        F.when(~scalar, F.col("_within")).alias("std_within_run_mean"),
        F.when(counted, F.col("_min")).alias("min"),
        F.when(counted, F.col("_max")).alias("max"),
    )


def readiness_indices(summary: DataFrame, *, by: Sequence[str] = ("architecture", "workload")) -> DataFrame:
    """Performance, trust and readiness scores; a missing component leaves its score NULL."""

    def pick(metric: str, stat: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col(stat)))

    raw = summary.groupBy(*by).agg(
        pick("availability_latency_s", "p95").alias("_al"),
        pick("missing_rate", "mean").alias("_mr"),
        pick("window_integrity_score_5min", "mean").alias("_wi"),
        pick("out_of_order_rate", "value").alias("_ooo"),
        pick("flag_flip_rate_per_hour", "p95").alias("_flip"),
        pick("mtbf_minutes", "mean").alias("_mtbf"),
    )
    # F.least skips NULL, hence the guard.
    parts = raw.select(
        *by,
        (1.0 / (1.0 + F.col("_al"))).alias("n_al"),
        (1.0 - F.col("_mr")).alias("n_mr"),
        F.col("_wi").alias("n_wi"),
        (1.0 / (1.0 + 100.0 * F.col("_ooo"))).alias("n_ooo"),
        (1.0 / (1.0 + F.col("_flip"))).alias("n_flip"),
        F.when(F.col("_mtbf").isNotNull(), F.least(F.lit(1.0), F.col("_mtbf") / 60.0)).alias("n_mtbf"),
    )
    opi = F.col("n_al") * F.col("n_mr")
    oti = F.col("n_wi") * F.col("n_ooo") * F.col("n_flip") * F.col("n_mtbf")
    ors = F.when((opi >= 0) & (oti >= 0), F.sqrt(opi * oti))
    return parts.select(
        *by,
        steady_round(opi, 6).alias("online_performance_index"),
        steady_round(oti, 6).alias("online_trust_index"),
        steady_round(ors, 6).alias("online_readiness_score"),
        *[steady_round(F.col(c), 6).alias(c) for c in ("n_al", "n_mr", "n_wi", "n_ooo", "n_flip", "n_mtbf")],
    )


def run_rollup(
    runs: DataFrame, columns: dict[str, int], *, by: Sequence[str] = ("architecture", "workload")
) -> DataFrame:
    """Average, minimum and maximum over runs; ``columns`` maps each column to its decimals."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("metric"), F.col(c).cast("double").alias("_v"), F.lit(d).alias("_d")
            )
            for c, d in columns.items()
        ]
    )
    long = runs.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.*")
    rolled = long.where(F.col("_v").isNotNull()).groupBy(*by, "metric", "_d").agg(
        F.avg("_v").alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max")
    )
    by_decimals = F.coalesce(
        *[F.when(F.col("_d") == d, steady_round(F.col("mean"), d)) for d in sorted(set(columns.values()))]
    )
    return rolled.select(*by, "metric", by_decimals.alias("mean"), "min", "max")


def aggregate_hardware(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Hardware figures over runs: averages of mean, p95, p99 and the largest maximum."""
    return stats.groupBy(*by).agg(
        *[steady_round(F.avg(c), 2).alias(c) for c in ("mean", "p95", "p99")],
        steady_round(F.max("max"), 2).alias("max"),
    )


def metric_grid(
    summary: DataFrame, metric: str, stat: str = "p95", *, workloads: Sequence[str] | None = None
) -> DataFrame:
    """Architectures as rows, workloads as columns; combinations that are missing stay NULL."""
    cells = summary.where(F.col("metric") == metric).groupBy("architecture")
    pivoted = cells.pivot("workload", list(workloads)) if workloads else cells.pivot("workload")
    return pivoted.agg(F.max(stat))
