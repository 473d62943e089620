"""Hot devices: results must not change when devices are cut, salted or pre-aggregated."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewatch import schema as S
from brinewatch.operators import features, flags, issues, joins, quality, rolling, tumbling
from brinewatch.operators.rolling import Rolling
from brinewatch.operators.runs import RUN
from brinewatch.operators.skew import HotPolicy, hot_devices, ordered_chunks
from brinewatch.session import checkpointed
from checks import inputs as I

#: Every device with more than 20 rows is hot and is cut every few rows.
CUT = HotPolicy(share=0.0, min_rows=20, chunk_rows=5, salts=3)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    """One device holds a third of all rows, some rows have no device, one has no time."""
    b = I.run_rows(spark, sf_dir)
    mac = (
        F.when(F.col("k") < 33, F.lit("HOT")).when(F.col("k") == 34, F.lit(None).cast("string"))
        .otherwise(F.col(S.MAC))
    )
    joined = joins.join_setpoints(b.withColumn(S.MAC, mac), I.machines(spark, sf_dir))
    setpoint = F.when(F.col(S.MAC) == "HOT", F.lit(60)).otherwise(F.col("wash_temp_setpoint"))
    return features.add_latency(joined.withColumn("wash_temp_setpoint", setpoint)).cache()


def same(a, b, columns):
    a = a.select(*[F.round(c, 9).alias(c) if t in ("double", "float") else F.col(c) for c, t in a.dtypes if c in columns])
    b = b.select(*[F.round(c, 9).alias(c) if t in ("double", "float") else F.col(c) for c, t in b.dtypes if c in columns])
    b = b.select(*a.columns)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0


def test_third_of_rows_is_found_hot(rows):
    hot = hot_devices(rows, S.DEVICE, S.TIME, HotPolicy(share=0.2, min_rows=10))
    assert [r[S.MAC] for r in hot.table.collect()] == ["HOT"]
    assert hot_devices(rows, S.DEVICE, S.TIME).empty


def test_chunks_are_small(rows):
    chunks = ordered_chunks(rows, keys=S.DEVICE, order=S.BY_TIME, rows_back=3, policy=CUT)
    sizes = chunks.df.where(F.col(S.MAC) == "HOT").groupBy("_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] < rows.where(F.col(S.MAC) == "HOT").count() / 10


def test_anomaly_flags(rows):
    names = ["event_id", *S.RULE_FLAGS[:4], "conc_ok", "temp_trend_down", "rinse_temp_trend_down", "temp_frequent_violation"]
    same(flags.detect_anomalies(rows), flags.detect_anomalies(rows, policy=CUT), names)


@pytest.mark.parametrize(
    "operator",
    [
        lambda d, p: flags.below_setpoint(d, "mean_wash_tank_temp", "wash_temp_setpoint", "en_wash_on", "out", policy=p),
        lambda d, p: flags.frequent_violation(d, out="out", policy=p),
        lambda d, p: features.ooo_indicator(d, policy=p).withColumnRenamed("out_of_order_indicator", "out"),
    ],
)
def test_single_flags(rows, operator):
    same(operator(rows, HotPolicy()), operator(rows, CUT), ["event_id", "out"])


def test_features(rows):
    def run(p):
        return features.add_features(flags.detect_anomalies(rows, policy=p), policy=p)

    names = ["event_id", "latency_rolling_mean_5min", "latency_volatility", "flag_flip_rate", "combined_flag_stability",
             "window_integrity_score_5min", "out_of_order_indicator", "missing_rate"]
    same(run(HotPolicy()), run(CUT), names)


def test_rolling(rows):
    names = ["event_id", *[f"rolling_{s}_avg_{m}min" for s in ("wash_temp", "rinse_temp", "conductivity") for m in (1, 5, 15)]]
    same(rolling.rolling_means(rows), rolling.rolling_means(rows, policy=CUT), names)


def test_issues(rows):
    violations = {"conc_over": "conc_flag"}
    marked = rows.withColumn("conc_over", F.col("mean_conductivity") > 44)
    same(issues.recovery_failure(marked, violations), issues.recovery_failure(marked, violations, policy=CUT), ["event_id", "conc_flag"])
    same(issues.repeated_issue(marked, violations), issues.repeated_issue(marked, violations, policy=CUT), ["event_id", "conc_flag"])
    values = {"mean_wash_tank_temp": "v"}
    same(issues.high_variance(rows, values), issues.high_variance(rows, values, policy=CUT), ["event_id", "v"])
    names = ["event_id", "wash_temp_diff", "conductivity_max_5min", "wash_temp_delta_30s", "conductivity_delta_30s"]
    same(issues.sensor_features(rows), issues.sensor_features(rows, policy=CUT), names)


def test_joins(rows, spark, sf_dir):
    b = rows.drop(*joins.SETPOINTS)
    names = ["event_id", *joins.SETPOINTS]
    m, v = I.machines(spark, sf_dir), I.machine_versions(spark, sf_dir)
    same(joins.join_setpoints(b, m), joins.join_setpoints(b, m, max_broadcast_rows=1, policy=CUT), names)
    same(joins.asof_setpoints(b, v), joins.asof_setpoints(b, v, max_broadcast_rows=1, policy=CUT), names)


def test_windows(rows):
    same(tumbling.attach_window(rows), tumbling.attach_window(rows, policy=CUT), ["event_id", "avg_conductivity"])


@pytest.mark.parametrize("run", [(), RUN])
def test_run_metrics(rows, run):
    cut = HotPolicy(share=0.0, min_rows=8, chunk_rows=3)
    same(quality.gap_counts(rows, run=run), quality.gap_counts(rows, run=run, policy=cut), [*run, S.MAC, "gap_s", "gaps"])
    names = [*run, S.MAC, "ooo_count", "flips", "flip_rate_per_hour", "mtbf_minutes"]
    same(quality.arrival_metrics(rows, run=run), quality.arrival_metrics(rows, run=run, policy=cut), names)
    same(quality.proxy_ml_metrics(rows, run=run), quality.proxy_ml_metrics(rows, run=run, policy=cut), [*run, "precision", "recall", "f1", "support_total"])


@pytest.mark.parametrize("run", [(), RUN])
def test_integrity_of_hot_devices(rows, run):
    cut = HotPolicy(share=0.0, min_rows=8, chunk_rows=3)
    cadence = quality.device_cadence(quality.gap_counts(rows, run=run), run=run)
    names = [*run, S.MAC, "bins", "filled_bins", "window_integrity"]
    same(quality.window_integrity(rows, cadence, run=run), quality.window_integrity(rows, cadence, run=run, policy=cut), names)


def test_integrity_bins_are_dealt_out_by_rows(spark):
    """Narrow rows compress well, so Spark would unite more of them than a task should hold."""
    devices, n = 60_000, 600_000
    df = spark.range(0, n, 1, 8).select(
        F.concat(F.lit("m"), (F.col("id") % devices).cast("string")).alias(S.MAC), (F.expr(f"id div {devices}") * 400).alias(S.TIME)
    )
    cadence = df.select(S.MAC).distinct().withColumn("cadence_s", F.lit(400.0))
    bins = quality.integrity_bins(df, cadence)
    assert bins.agg(F.sum("bins"), F.count_if(F.col("score") == 1)).first()[:] == (12 * devices, n)
    held = bins.where("score > 0").groupBy(F.input_file_name().alias("file")).count()
    assert held.agg(F.max("count")).first()[0] <= 250_000


def test_a_million_rows_of_one_device_in_an_hour(spark):
    """Frames of a quarter of a million rows: linear work, and figures as computed one by one."""
    n = 1_000_000
    hashed = lambda seed: F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(10_000)) / 100
    df = checkpointed(spark.range(0, n, 1, 8).select(
        F.lit("m").alias("mac_address_string"), F.col("id").alias("event_id"),
        (1704067200 + F.pmod(F.xxhash64("id"), F.lit(3_600_000)) / 1000).alias("date_time_utc"),
        hashed(1).alias("a"), F.when(hashed(2) > 10, hashed(3) + 1e9).alias("b"),
    ))
    specs = [Rolling("mean", "avg", "a", 900), Rolling("least", "min", "a", 60), Rolling("most", "max", "b", 60),
             Rolling("var", "var_samp", "b", 300)]
    start = time.time()
    got = rolling.rolling(df, specs).toPandas().sort_values("date_time_utc")
    assert time.time() - start < 120
    ms = np.round(got["date_time_utc"].to_numpy() * 1000).astype(np.int64)
    how = {"avg": np.mean, "min": np.min, "max": np.max, "var_samp": lambda v: np.var(v - 1e9, ddof=1)}
    for i in np.random.default_rng(1).choice(n, 100):
        for s in specs:
            first, last = np.searchsorted(ms, [ms[i] - 1000 * s.seconds, ms[i]], side="right")
            value = got[s.value].to_numpy()[first:last]
            value = value[~np.isnan(value)]
            assert np.isclose(got[s.out].to_numpy()[i], how[s.agg](value), rtol=1e-9) if len(value) > 1 else True


def test_jobs_deal_rows_out_once(spark, sf_dir):
    """One exchange of rows by device, whatever flags, features and frames follow."""
    from brinewatch.plans import batch, stream
    from checks.feature_checks import with_latency

    events, machines = with_latency(spark, sf_dir), I.machines(spark, sf_dir)
    jobs = {
        "baseline": batch.baseline_job(events, machines),
        "features": batch.feature_batch(events, machines),
        "mesh": stream.mesh_job(events, machines),
        "sensors": issues.sensor_features(events),
    }
    for name, df in jobs.items():
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_lane" in line]
        by_device = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and S.MAC in line]
        # The machine list is brought to one row a device as well.
        assert len(dealt) == 1 and len(by_device) <= 2, (name, by_device)
