"""Run metrics: queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewatch.functions import steady_round
from brinewatch.operators import distribution as D
from brinewatch.operators import quality, runs, timeliness
from brinewatch.operators.runs import RUN
from brinewatch.plans.summary import summary_job
from checks import inputs as I
from checks.feature_checks import CONDUCTIVITY, rounded
from checks.registry import check

R = ", ".join(RUN)
DEV = "mac_address_string"
ALARM = f"({CONDUCTIVITY} OR op_state >= 100)"
SQL_SLICE = f"""
span AS (SELECT {R}, min(date_time_utc) AS t0, max(date_time_utc) AS t1 FROM run_rows GROUP BY ALL),
sliced AS (SELECT r.* FROM run_rows r JOIN span USING ({R})
  WHERE date_time_utc >= t0 + 300 AND date_time_utc <= CASE WHEN t0 + 7500 > t1 AND t1 - t0 < 7500
    THEN t1 + 1 ELSE t0 + 7500 END)"""


def dist(value: str, by: str, source: str, name: str | None = None) -> str:
    """Summary SELECT of one metric."""
    label = f"'{name}' AS metric, " if name else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}{label}round(avg({value}), 6) AS mean,
      round(coalesce(stddev_samp({value}), 0e0), 6) AS std, round(quantile_cont({value}, 0.95), 6) AS p95,
      round(quantile_cont({value}, 0.99), 6) AS p99 FROM {source} WHERE {value} IS NOT NULL
      {'GROUP BY ' + by if by else ''}"""


def gaps_sql(source: str, run: str = "") -> str:
    """CTEs gaps (with NULL for non-positive) and cadence per device."""
    lead = f"{run}, " if run else ""
    overall = (
        f"(SELECT {lead}quantile_cont(gap, 0.5) AS median FROM gaps WHERE gap IS NOT NULL "
        f"{'GROUP BY ' + run if run else ''})"
    )
    on = f"USING ({run})" if run else "ON TRUE"
    return f"""
gaps AS (SELECT {lead}{DEV}, CASE WHEN g > 0 THEN CAST(g AS DOUBLE) END AS gap FROM (
    SELECT {lead}{DEV}, date_time_utc - lag(date_time_utc) OVER (PARTITION BY {lead}{DEV} ORDER BY date_time_utc) AS g
    FROM {source})),
cadence AS (SELECT o.*, coalesce(own, median) AS cadence_s
  FROM (SELECT {lead}{DEV}, quantile_cont(gap, 0.5) AS own FROM gaps GROUP BY ALL) o
  LEFT JOIN {overall} m {on}),
gap_rates AS (SELECT {lead}{DEV}, count(*) FILTER (gap > 3 * cadence_s) / nullif(count(gap), 0) AS gap_rate
  FROM gaps JOIN cadence USING ({lead}{DEV}) GROUP BY ALL)"""


def arrivals_sql(source: str, run: str = "") -> str:
    lead = f"{run}, " if run else ""
    return f"""
steps AS (SELECT {lead}{DEV}, date_time_utc AS t, persisted_at_ms, kafka_logappend_ms, event_id,
    coalesce(date_time_utc < lag(date_time_utc) OVER w, FALSE) AS back,
    coalesce({ALARM} <> lag({ALARM}) OVER w, FALSE) AS flip
  FROM {source} WINDOW w AS (PARTITION BY {lead}{DEV} ORDER BY persisted_at_ms, kafka_logappend_ms, event_id)),
flip_gaps AS (SELECT {lead}{DEV}, t - lag(t) OVER (PARTITION BY {lead}{DEV}
    ORDER BY persisted_at_ms, kafka_logappend_ms, event_id) AS g FROM steps WHERE flip),
mtbfs AS (SELECT {lead}{DEV}, avg(g) / 60e0 AS mtbf_minutes FROM flip_gaps WHERE g IS NOT NULL GROUP BY ALL),
arrivals AS (SELECT s.*, mtbf_minutes FROM (
    SELECT {lead}{DEV}, count(*) AS events, count(*) FILTER (back) AS ooo_count, count(*) FILTER (flip) AS flips,
      CASE WHEN max(t) > min(t) THEN count(*) FILTER (flip) / ((max(t) - min(t)) / 3600e0) ELSE 0e0 END AS flip_rate_per_hour
    FROM steps GROUP BY ALL) s LEFT JOIN mtbfs USING ({lead}{DEV}))"""


def bins_sql(source: str, run: str = "") -> str:
    lead = f"{run}, " if run else ""
    return f"""
device_span AS (SELECT {lead}{DEV}, min(date_time_utc) AS d0, max(date_time_utc) AS d1,
    CAST(ceil((max(date_time_utc) - min(date_time_utc)) / 300e0) AS BIGINT) AS bins FROM {source} GROUP BY ALL),
all_bins AS (SELECT {lead}{DEV}, unnest(range(bins)) AS bin FROM device_span WHERE bins > 0),
bin_counts AS (SELECT {lead}{DEV}, least((date_time_utc - d0) // 300, bins - 1) AS bin, count(*) AS c
  FROM {source} JOIN device_span USING ({lead}{DEV}) WHERE bins > 0 GROUP BY ALL),
scores AS (SELECT {lead}{DEV}, bin, least(1e0, coalesce(c, 0) * cadence_s / 300e0) AS score
  FROM all_bins LEFT JOIN bin_counts USING ({lead}{DEV}, bin) JOIN cadence USING ({lead}{DEV})
  WHERE cadence_s > 0)"""


def choice_sql(source: str) -> str:
    return f"""
present AS (SELECT {R}, 'kafka_logappend_ms' AS anchor,
    CASE WHEN count(speed_ms) > 0 THEN 'speed_features_ready_at'
         WHEN count(features_ms) > 0 THEN 'features_ready_ms'
         WHEN count(stream_ms) > 0 THEN 'stream_features_ready_at' ELSE 'persisted_at' END AS first_choice,
    median((persisted_at_ms - kafka_logappend_ms) / 1000e0) AS persisted_lag,
    median((speed_ms - kafka_logappend_ms) / 1000e0) AS speed_lag,
    median((stream_ms - kafka_logappend_ms) / 1000e0) AS stream_lag
  FROM {source} GROUP BY ALL),
choice AS (SELECT {R}, anchor, CASE
    WHEN first_choice = 'speed_features_ready_at' AND persisted_lag BETWEEN 0 AND 3599.9 AND speed_lag - persisted_lag > 60
      THEN 'persisted_at'
    WHEN first_choice = 'stream_features_ready_at' AND persisted_lag BETWEEN 0 AND 3599.9 AND stream_lag - persisted_lag > 60
      THEN 'persisted_at'
    ELSE first_choice END AS ready FROM present)"""


def fal_sql(source: str) -> str:
    """Windows by explicit start times, the next anchor by a direct lookup."""
    return f"""
timed AS (SELECT {R}, date_time_utc AS t, event_id, kafka_logappend_ms AS a,
    CASE ready WHEN 'persisted_at' THEN persisted_at_ms WHEN 'speed_features_ready_at' THEN speed_ms
      WHEN 'stream_features_ready_at' THEN stream_ms ELSE features_ms END AS ready_ms
  FROM {source} JOIN choice USING ({R})),
run_span AS (SELECT {R}, min(t) AS t0, max(t) AS t1 FROM timed GROUP BY ALL),
starts AS (SELECT {R}, t0, unnest(range(t0, t1, 1200)) AS ws FROM run_span),
seen AS (SELECT s.{', s.'.join(RUN)}, ws, (ws - t0) // 1200 AS window_no, max(ready_ms) AS visible, min(a) AS lo, max(a) AS hi
  FROM starts s JOIN timed e ON e.architecture = s.architecture AND e.workload = s.workload AND e.repeat = s.repeat
    AND e.t >= ws AND e.t < ws + 1200 WHERE ready_ms IS NOT NULL GROUP BY ALL),
fal AS (SELECT {R}, window_no, ws AS window_start, greatest((visible - lo) / 1000e0, 0e0) AS fal_total_s,
    greatest((visible - hi) / 1000e0, 0e0) AS fal_pipeline_s,
    greatest(coalesce((visible - (SELECT arg_min(e.a, (e.t, e.event_id)) FROM timed e
      WHERE e.architecture = seen.architecture AND e.workload = seen.workload AND e.repeat = seen.repeat
        AND e.t >= ws + 1200)) / 1000e0, 0e0), 0e0) AS fal_freshness_s FROM seen)"""


def ml_sql(source: str, run: str) -> str:
    return f"""
rolled AS (SELECT {run}, mean_conductivity AS c, setpoint_conductivity AS sp,
    avg(mean_conductivity) OVER (PARTITION BY {run}, {DEV} ORDER BY date_time_utc
      RANGE BETWEEN 299 PRECEDING AND CURRENT ROW) AS m FROM {source}),
judged AS (SELECT {run}, abs(c - sp) > greatest(sp * 0.1e0, 1e0) AS y, abs(m - sp) > greatest(sp * 0.1e0, 1e0) AS p
  FROM rolled WHERE sp > 0 AND c IS NOT NULL AND m IS NOT NULL),
confusion AS (SELECT {run}, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp,
    count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (y) AS support_positive, count(*) AS support_total
  FROM judged GROUP BY {run}),
ml AS (SELECT {run}, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
    round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0))
      / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) AS f1,
    support_positive, support_total FROM confusion)"""


def latency_sql(source: str) -> str:
    """All medians are sane on these tables, so every part is kept and persist is the given one."""
    return f"""
parts AS (SELECT {R}, greatest((kafka_logappend_ms - produced_at_ms) / 1000e0, 0e0) AS ingest,
    event_latency_seconds AS persist, (persisted_at_ms - produced_at_ms) / 1000e0 AS availability FROM {source}),
latencies AS ({dist('ingest', R, 'parts', 'ingest_latency_s')} UNION ALL
  {dist('persist', R, 'parts', 'persist_latency_s')} UNION ALL
  {dist('availability', R, 'parts', 'availability_latency_s')})"""


def with_runs(body: str) -> str:
    return I.with_inputs(body, I.SQL_RUNS)


def summaries(spark, sf):
    return runs.run_metrics(I.run_rows(spark, sf))


@check("measurement_slice", with_runs(f"WITH {SQL_SLICE} SELECT {R}, event_id, date_time_utc FROM sliced"))
def measurement_slice(spark, sf):
    return timeliness.measurement_slice(I.run_rows(spark, sf), run=RUN).select(*RUN, "event_id", "date_time_utc")


@check(
    "run_counts",
    with_runs(f"SELECT {R}, count(*) AS event_count, count(DISTINCT {DEV}) AS device_count FROM run_rows GROUP BY ALL"),
)
def run_counts(spark, sf):
    counts = runs.run_counts(I.run_rows(spark, sf))
    return counts.withColumn("event_count", F.col("event_count").cast("bigint"))


@check("device_cadence", with_runs(f"WITH {gaps_sql('run_rows')} SELECT {DEV}, cadence_s FROM cadence"))
def device_cadence(spark, sf):
    return quality.device_cadence(quality.gap_counts(I.run_rows(spark, sf)))


@check(
    "gap_rate",
    with_runs(f"WITH {gaps_sql('run_rows', R)} SELECT {R}, {DEV}, round(gap_rate, 6) AS gap_rate FROM gap_rates"),
)
def gap_rate(spark, sf):
    gaps = quality.gap_counts(I.run_rows(spark, sf), run=RUN)
    return rounded(quality.gap_rate(gaps, quality.device_cadence(gaps, run=RUN), run=RUN), "gap_rate")


@check(
    "out_of_order",
    with_runs(f"""WITH {arrivals_sql('run_rows')}
    SELECT {DEV}, events, ooo_count, sum(ooo_count) OVER () / sum(events) OVER () AS ooo_rate FROM arrivals""".replace(
        "sum(ooo_count) OVER () / sum(events) OVER ()", "round(sum(ooo_count) OVER () / sum(events) OVER (), 6)")),
)
def out_of_order(spark, sf):
    per_device = quality.out_of_order(I.run_rows(spark, sf))
    rate = per_device.agg(steady_round(F.sum("ooo_count") / F.sum("events"), 6)).scalar()
    return per_device.withColumn("ooo_rate", rate)


@check(
    "flip_rate",
    with_runs(f"""WITH {arrivals_sql('run_rows')}
    SELECT {DEV}, flips, round(flip_rate_per_hour, 6) AS flip_rate_per_hour FROM arrivals"""),
)
def flip_rate(spark, sf):
    return rounded(quality.flip_rate(I.run_rows(spark, sf)), "flip_rate_per_hour")


@check(
    "mtbf",
    with_runs(f"""WITH {arrivals_sql('run_rows')}
    SELECT {DEV}, flips, round(mtbf_minutes, 6) AS mtbf_minutes FROM arrivals"""),
)
def mtbf(spark, sf):
    return rounded(quality.mtbf(I.run_rows(spark, sf)), "mtbf_minutes")


@check(
    "window_integrity",
    with_runs(f"""WITH {gaps_sql('run_rows')}, {bins_sql('run_rows')}
    SELECT {DEV}, count(*) AS bins, count(*) FILTER (score > 0) AS filled_bins,
      round(avg(score), 6) AS window_integrity FROM scores GROUP BY ALL"""),
)
def window_integrity(spark, sf):
    rows = I.run_rows(spark, sf)
    cadence = quality.device_cadence(quality.gap_counts(rows))
    return rounded(quality.window_integrity(rows, cadence), "window_integrity")


@check("fal_source_choice", with_runs(f"WITH {choice_sql('run_rows')} SELECT {R}, anchor, ready FROM choice"))
def fal_source_choice(spark, sf):
    return timeliness.fal_source_choice(I.run_rows(spark, sf), run=RUN)


@check(
    "fal_windows",
    with_runs(f"""WITH {choice_sql('run_rows')}, {fal_sql('run_rows')}
    SELECT {R}, window_no, window_start, round(fal_total_s, 6) AS fal_total_s,
      round(fal_pipeline_s, 6) AS fal_pipeline_s, round(fal_freshness_s, 6) AS fal_freshness_s FROM fal"""),
)
def fal_windows(spark, sf):
    return rounded(
        timeliness.fal_windows(I.run_rows(spark, sf), run=RUN), "fal_total_s", "fal_pipeline_s", "fal_freshness_s"
    )


@check("proxy_ml_metrics", with_runs(f"WITH {ml_sql('run_rows', R)} SELECT * FROM ml"))
def proxy_ml_metrics(spark, sf):
    return quality.proxy_ml_metrics(I.run_rows(spark, sf), run=RUN)


@check("latency_decomposition", with_runs(f"WITH {latency_sql('run_rows')} SELECT * FROM latencies"))
def latency_decomposition(spark, sf):
    return timeliness.latency_decomposition(I.run_rows(spark, sf), run=RUN).drop("n")


@check(
    "latency_stats",
    with_runs("""WITH l AS (SELECT architecture, event_latency_seconds AS v,
        row_number() OVER (PARTITION BY architecture ORDER BY event_latency_seconds) - 1 AS i,
        count(*) OVER (PARTITION BY architecture) AS n FROM run_rows)
    SELECT architecture, count(*) AS count, round(avg(v), 6) AS avg, min(v) AS min, max(v) AS max,
      max(v) FILTER (i = n // 2) AS p50, max(v) FILTER (i = CAST(floor(n * 0.95e0) AS BIGINT)) AS p95,
      max(v) FILTER (i = CAST(floor(n * 0.99e0) AS BIGINT)) AS p99 FROM l GROUP BY ALL"""),
)
def latency_stats(spark, sf):
    return rounded(D.latency_stats(I.run_rows(spark, sf), "event_latency_seconds", ["architecture"]), "avg")


@check("metric_summary", with_runs(dist("mean_conductivity", R, "run_rows")))
def metric_summary(spark, sf):
    return D.metric_summary(I.run_rows(spark, sf), "mean_conductivity", RUN).drop("n")


HW = f"""hw AS (SELECT {R}, 'cpu_usage_percent' AS metric, mean_rinse_temp AS v FROM run_rows
    UNION ALL SELECT {R}, 'memory_usage_gb', mean_conductivity / 4e0 FROM run_rows),
  hw_stats AS (SELECT {R}, metric, round(avg(v), 2) AS mean, round(quantile_cont(v, 0.95), 2) AS p95,
    round(quantile_cont(v, 0.99), 2) AS p99, round(max(v), 2) AS max FROM hw WHERE v IS NOT NULL GROUP BY ALL)"""


@check(
    "hw_sample_stats",
    with_runs(f"""WITH {HW} SELECT architecture, workload, metric, round(avg(mean), 2) AS mean, round(avg(p95), 2) AS p95,
      round(avg(p99), 2) AS p99, round(max(max), 2) AS max FROM hw_stats GROUP BY ALL"""),
)
def hw_sample_stats(spark, sf):
    """Sensor values stand in for load samples: per run first, then over runs."""
    samples = I.run_rows(spark, sf).select(
        *RUN,
        F.explode(
            F.array(
                F.struct(F.lit("cpu_usage_percent").alias("metric"), F.col("mean_rinse_temp").alias("v")),
                F.struct(F.lit("memory_usage_gb").alias("metric"), (F.col("mean_conductivity") / 4).alias("v")),
            )
        ).alias("s"),
    ).select(*RUN, "s.*")
    stats = D.hw_sample_stats(samples, "v", [*RUN, "metric"])
    return runs.aggregate_hardware(stats, ["architecture", "workload", "metric"])


NONE = "CAST(NULL AS DOUBLE)"
METRICS_SQL = f"""WITH {SQL_SLICE}, {gaps_sql('sliced', R)}, {arrivals_sql('sliced', R)}, {bins_sql('sliced', R)},
{choice_sql('sliced')}, {fal_sql('sliced')}, {ml_sql('sliced', R)}, {latency_sql('sliced')},
spread AS (SELECT {R}, metric, {NONE} AS value, mean, std, p95, p99 FROM (
  SELECT * FROM latencies UNION ALL {dist('fal_total_s', R, 'fal', 'fal_total_window_s')}
  UNION ALL {dist('flip_rate_per_hour', R, 'arrivals', 'flag_flip_rate_per_hour')}
  UNION ALL {dist('mtbf_minutes', R, 'arrivals', 'mtbf_minutes')}
  UNION ALL {dist('gap_rate', R, 'gap_rates', 'missing_rate')}
  UNION ALL {dist('score', R, 'scores', 'window_integrity_score_5min')})),
counts AS (SELECT {R}, count(*) AS event_count, count(DISTINCT {DEV}) AS device_count,
  round(avg(CAST({ALARM} AS INTEGER)), 6) AS alarm_rate FROM sliced GROUP BY ALL),
late AS (SELECT {R}, sum(ooo_count) AS late FROM arrivals GROUP BY ALL),
wide AS (SELECT * FROM counts JOIN late USING ({R}) LEFT JOIN ml USING ({R})),
scalars AS (
  SELECT {R}, 'out_of_order_count' AS metric, CAST(late AS DOUBLE) AS value FROM wide
  UNION ALL SELECT {R}, 'out_of_order_rate', round(late / event_count, 6) FROM wide
  UNION ALL SELECT {R}, 'alarm_rate', alarm_rate FROM wide
  UNION ALL SELECT {R}, 'ml_precision', precision FROM wide
  UNION ALL SELECT {R}, 'ml_recall', recall FROM wide
  UNION ALL SELECT {R}, 'ml_f1', f1 FROM wide
  UNION ALL SELECT {R}, 'ml_support_positive', CAST(support_positive AS DOUBLE) FROM wide
  UNION ALL SELECT {R}, 'ml_support_total', CAST(support_total AS DOUBLE) FROM wide
  UNION ALL SELECT {R}, 'event_count', CAST(event_count AS DOUBLE) FROM wide
  UNION ALL SELECT {R}, 'device_count', CAST(device_count AS DOUBLE) FROM wide),
metrics AS (SELECT * FROM spread UNION ALL
  SELECT *, {NONE} AS mean, {NONE} AS std, {NONE} AS p95, {NONE} AS p99 FROM scalars)"""


@check("run_metrics", with_runs(f"{METRICS_SQL} SELECT * FROM metrics"))
def run_metrics(spark, sf):
    return summaries(spark, sf)


AGGREGATE_SQL = METRICS_SQL + f""",
agg0 AS (SELECT architecture, workload, metric, count(mean) AS n, avg(value) AS v, sum(value) AS total, min(value) AS lo,
    max(value) AS hi, round(avg(mean), 6) AS mean, round(avg(p95), 6) AS p95, round(avg(p99), 6) AS p99,
    round(coalesce(stddev_samp(mean), 0e0), 6) AS across, round(avg(std), 6) AS within
  FROM metrics GROUP BY ALL HAVING count(mean) > 0 OR count(value) > 0),
agg AS (SELECT architecture, workload, metric,
    CASE WHEN metric = 'out_of_order_count' THEN total
         WHEN metric IN ('event_count', 'device_count') THEN round(v, 1)
         WHEN metric LIKE 'ml_support%' THEN floor(v) WHEN n = 0 THEN round(v, 6) END AS value,
    mean, p95, p99, CASE WHEN n > 0 THEN across END AS std_across_runs,
    CASE WHEN n > 0 THEN within END AS std_within_run_mean,
    CASE WHEN metric IN ('event_count', 'device_count') THEN lo END AS min,
    CASE WHEN metric IN ('event_count', 'device_count') THEN hi END AS max FROM agg0)"""


@check("aggregate_runs", with_runs(f"{AGGREGATE_SQL} SELECT * FROM agg"))
def aggregate_runs(spark, sf):
    return runs.aggregate_runs(summaries(spark, sf))


INDEX_SQL = AGGREGATE_SQL + """,
parts2 AS (SELECT architecture, workload,
    1 / (1 + max(p95) FILTER (metric = 'availability_latency_s')) AS n_al,
    1 - max(mean) FILTER (metric = 'missing_rate') AS n_mr,
    max(mean) FILTER (metric = 'window_integrity_score_5min') AS n_wi,
    1 / (1 + 100 * max(value) FILTER (metric = 'out_of_order_rate')) AS n_ooo,
    1 / (1 + max(p95) FILTER (metric = 'flag_flip_rate_per_hour')) AS n_flip,
    least(1e0, max(mean) FILTER (metric = 'mtbf_minutes') / 60) AS n_mtbf
  FROM agg GROUP BY ALL),
indices AS (SELECT architecture, workload, round(n_al * n_mr, 6) AS online_performance_index,
    round(n_wi * n_ooo * n_flip * n_mtbf, 6) AS online_trust_index,
    round(sqrt(n_al * n_mr * (n_wi * n_ooo * n_flip * n_mtbf)), 6) AS online_readiness_score,
    round(n_al, 6) AS n_al, round(n_mr, 6) AS n_mr, round(n_wi, 6) AS n_wi, round(n_ooo, 6) AS n_ooo,
    round(n_flip, 6) AS n_flip, round(n_mtbf, 6) AS n_mtbf FROM parts2)"""


@check("readiness_indices", with_runs(f"{INDEX_SQL} SELECT * FROM indices"))
def readiness_indices(spark, sf):
    return runs.readiness_indices(runs.aggregate_runs(summaries(spark, sf)))


@check(
    "summary",
    with_runs(INDEX_SQL + f""" SELECT * FROM agg UNION ALL
    SELECT architecture, workload, metric, value, {', '.join(f'{NONE} AS {c}' for c in
      ('mean', 'p95', 'p99', 'std_across_runs', 'std_within_run_mean', 'min', 'max'))}
    FROM (UNPIVOT indices ON COLUMNS(* EXCLUDE (architecture, workload)) INTO NAME metric VALUE value)"""),
)
def summary(spark, sf):
    return summary_job(I.run_rows(spark, sf))


RUN_TABLE_SQL = f"""run_table AS (SELECT {R}, count(*) AS produced_events, count(persisted_at_ms) AS written_events,
    round(count(*) / ((max(produced_at_ms) - min(produced_at_ms)) / 1000e0), 6) AS write_rate
  FROM run_rows GROUP BY ALL)"""


@check(
    "run_rollup",
    with_runs(f"""WITH {RUN_TABLE_SQL}
    SELECT architecture, workload, 'produced_events' AS metric, round(avg(produced_events), 0) AS mean,
      CAST(min(produced_events) AS DOUBLE) AS min, CAST(max(produced_events) AS DOUBLE) AS max FROM run_table GROUP BY ALL
    UNION ALL SELECT architecture, workload, 'written_events', round(avg(written_events), 0),
      CAST(min(written_events) AS DOUBLE), CAST(max(written_events) AS DOUBLE) FROM run_table GROUP BY ALL
    UNION ALL SELECT architecture, workload, 'write_rate', round(avg(write_rate), 1),
      min(write_rate), max(write_rate) FROM run_table GROUP BY ALL"""),
)
def run_rollup(spark, sf):
    table = I.run_rows(spark, sf).groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("produced_events"),
        F.count("persisted_at").alias("written_events"),
        steady_round(
            F.count(F.lit(1)) / ((F.max("produced_at_ms") - F.min("produced_at_ms")) / 1000.0), 6
        ).alias("write_rate"),
    )
    return runs.run_rollup(table, {"produced_events": 0, "written_events": 0, "write_rate": 1})


@check(
    "metric_grid",
    with_runs(f"""WITH {latency_sql('run_rows')},
    g AS (SELECT architecture, workload, round(avg(p95), 6) AS p95 FROM latencies
      WHERE metric = 'availability_latency_s' GROUP BY ALL)
    SELECT architecture, {', '.join(f"max(p95) FILTER (workload = '{w}') AS {w}" for w in 'ABCDE')} FROM g GROUP BY ALL"""),
)
def metric_grid(spark, sf):
    long = timeliness.latency_decomposition(I.run_rows(spark, sf), run=RUN)
    table = runs.aggregate_runs(long.withColumn("value", F.lit(None).cast("double")))
    return runs.metric_grid(table, "availability_latency_s", workloads=list("ABCDE"))


# --- values far from zero, and many values close together --------------------------------------
@check(
    "metric_summary_offset",
    I.with_inputs("""SELECT mac_address_string, count(*) AS n, round(avg(k), 4) AS mean,
      round(coalesce(stddev_samp(k), 0e0), 6) AS std, round(quantile_cont(k, 0.95e0), 4) AS p95,
      round(quantile_cont(k, 0.99e0), 4) AS p99 FROM beacons GROUP BY 1"""),
)
def metric_summary_offset(spark, sf):
    """Figures of ``k`` and of ``k`` a long way up differ by that way, and not in their deviation."""
    far = I.beacons(spark, sf).select(DEV, (F.col("k") + 1e9).alias("v"))
    out = D.metric_summary(far, "v", [DEV])
    return out.withColumns({n: steady_round(F.col(n) - 1e9, 4) for n in ("mean", "p95", "p99")})


@check(
    "latency_stats_crowded",
    I.with_inputs("""
    WITH v AS (SELECT 0.99e0 + CAST(substr(event_id, 2) AS BIGINT) / 1e8 AS v FROM beacons),
    o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS pos, count(*) OVER () AS n FROM v)
    SELECT count(*) AS count, round(avg(v), 9) AS avg, min(v) AS min, max(v) AS max,
      max(v) FILTER (pos = floor(n * 0.5e0)) AS p50, max(v) FILTER (pos = floor(n * 0.95e0)) AS p95,
      max(v) FILTER (pos = floor(n * 0.99e0)) AS p99 FROM o"""),
)
def latency_stats_crowded(spark, sf):
    """All values lie in a few buckets; the low limit makes them be cut into ranges again and again."""
    number = F.expr("cast(substr(event_id, 2) as bigint)")
    close = I.beacons(spark, sf).select((F.lit(0.99) + number / F.lit(1e8)).alias("v"))
    out = D.latency_stats(close, "v", most_values=3)
    return out.withColumn("avg", steady_round(F.col("avg"), 9))
