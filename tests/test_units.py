"""Hand-computed edge cases."""

import json
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brinewatch import functions as fn
from brinewatch import schema as S
from brinewatch.operators import distribution as D
from brinewatch.operators import domains, features, flags, issues, quality, runs, timeliness, workloads
from brinewatch.operators.skew import HotPolicy
from brinewatch.session import scratch_dir
from brinewatch.sources import machines, messages, pending, sinks, traces
from brinewatch.sources import runs as run_source

FLAG_DDL = (
    "event_id string, mac_address_string string, date_time_utc bigint, mean_wash_tank_temp double, "
    "mean_rinse_temp double, mean_conductivity double, setpoint_conductivity double, en_wash_on int, "
    "en_rinse_on int, wash_temp_setpoint int, rinse_temp_setpoint int"
)


def beacon(i, mac, t, wash=50.0, rinse=90.0, conc=50.0, sp=40.0, en_wash=1, en_rinse=1, wash_sp=60, rinse_sp=80):
    return (f"E{i:03d}", mac, t, wash, rinse, conc, sp, en_wash, en_rinse, wash_sp, rinse_sp)


@pytest.fixture(scope="module")
def flagged(spark):
    rows = []
    for mac, n in (("one", 1), ("two", 2), ("three", 3), ("five", 5)):
        rows += [beacon(len(rows) + i, mac, i) for i in range(n)]
    rows += [
        beacon(20, "mixed", 0, wash=70.0), beacon(21, "mixed", 1), beacon(22, "mixed", 2, en_wash=0),
        beacon(23, "mixed", 3), beacon(24, "mixed", 4, wash=None), beacon(25, "mixed", 5, wash=70.0),
        beacon(30, None, 0), beacon(31, "nosp", 0, wash_sp=None, sp=None), beacon(32, "idle", 0, en_wash=2),
    ]
    out = flags.detect_anomalies(spark.createDataFrame(rows, FLAG_DDL))
    return {r["event_id"]: r for r in out.collect()}


def test_small_groups(flagged):
    wash = {k: r["temp_below_setpoint"] for k, r in flagged.items()}
    assert wash["E000"] is True
    # Two and three rows: now and the row before.
    assert [wash[f"E{i:03d}"] for i in (1, 2)] == [False, True]
    assert [wash[f"E{i:03d}"] for i in (3, 4, 5)] == [False, True, True]
    assert all(wash[f"E{i:03d}"] for i in range(6, 11))


def test_share_counts_inactive_rows(flagged):
    # below: F T T T F F; row by row the share of the last four is 0, 1/2, 2/3, 3/4, 3/4, 2/4.
    wash = [flagged[f"E{i:03d}"]["temp_below_setpoint"] for i in range(20, 26)]
    assert wash == [False, False, False, True, True, False]


def test_missing_device_and_setpoint(flagged):
    assert not any(flagged["E030"][f] for f in S.RULE_FLAGS[:4]) and flagged["E030"]["conc_ok"]
    assert not flagged["E031"]["temp_below_setpoint"] and flagged["E031"]["conc_ok"]
    assert not flagged["E032"]["temp_below_setpoint"]  # the batch rule wants exactly 1


def test_point_flags_are_three_valued(spark):
    from brinewatch.operators.tumbling import conc_ok_column, point_flags

    rows = spark.createDataFrame(
        [beacon(0, "a", 0, en_wash=2), beacon(1, "a", 0, en_wash=0), beacon(2, "a", 0, sp=None), beacon(3, "a", 0, sp=0.0)],
        FLAG_DDL,
    ).withColumn("avg_conductivity", F.lit(40.0))
    out = rows.withColumns({**point_flags(), "conc_ok": conc_ok_column()}).orderBy("event_id").collect()
    assert [r["temp_below_setpoint"] for r in out] == [True, None, True, True]
    assert [r["conc_constant_over"] for r in out] == [True, True, None, True]
    assert [r["conc_ok"] for r in out] == [True, True, None, None]


def events(spark, times, mac="a", **columns):
    rows = [(f"E{i}", mac, t) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "event_id string, mac_address_string string, date_time_utc bigint")
    return df.withColumns(columns)


def test_integrity_bins(spark):
    # Cadence 100 s; span 600 s is two bins, the last one takes the event at its end.
    df = events(spark, [0, 100, 200, 600])
    cadence = quality.device_cadence(quality.gap_counts(df))
    assert cadence.first()["cadence_s"] == 100.0
    row = quality.window_integrity(df, cadence).first()
    assert (row["bins"], row["filled_bins"]) == (2, 2)
    assert row["window_integrity"] == pytest.approx((1 + 1 / 3) / 2)


def test_integrity_empty_bins_and_single_events(spark):
    df = events(spark, [0, 100, 901]).unionByName(events(spark, [5], mac="b"))
    cadence = quality.device_cadence(quality.gap_counts(df))
    assert {r[S.MAC]: r["cadence_s"] for r in cadence.collect()} == {"a": 450.5, "b": 450.5}
    rows = quality.window_integrity(df, cadence).collect()
    assert [(r[S.MAC], r["bins"], r["filled_bins"]) for r in rows] == [("a", 4, 2)]


def test_gap_rate_of_equal_times(spark):
    df = events(spark, [0, 0, 10, 20, 60]).unionByName(events(spark, [7, 7], mac="b"))
    gaps = quality.gap_counts(df)
    rate = {r[S.MAC]: r["gap_rate"] for r in quality.gap_rate(gaps, quality.device_cadence(gaps)).collect()}
    assert rate == {"a": pytest.approx(1 / 3), "b": None}


def arrivals(spark, rows):
    return spark.createDataFrame(
        [(f"E{i}", "a", t, a, a, al) for i, (t, a, al) in enumerate(rows)],
        "event_id string, mac_address_string string, date_time_utc bigint, persisted_at bigint, kafka_logappend_ms bigint, alarm boolean",
    )


@pytest.mark.parametrize(
    ("alarms", "flips", "mtbf"),
    [([True] * 4, 0, None), ([False, False, True, True], 1, None), ([False, True, False, True], 3, 1.0)],
)
def test_flips(spark, alarms, flips, mtbf):
    df = arrivals(spark, [(60 * i, i, a) for i, a in enumerate(alarms)])
    row = quality.arrival_metrics(df, alarm="alarm").first()
    assert (row["flips"], row["mtbf_minutes"], row["ooo_count"]) == (flips, mtbf, 0)
    assert row["flip_rate_per_hour"] == pytest.approx(flips / 0.05)


def test_out_of_order_follows_arrival(spark):
    df = arrivals(spark, [(0, 0, True), (20, 1, True), (10, 2, True), (30, 3, True), (29, 4, True)])
    assert quality.out_of_order(df).first()["ooo_count"] == 2


def test_span_zero_has_no_flip_rate(spark):
    df = arrivals(spark, [(5, 0, True), (5, 1, False)])
    assert quality.flip_rate(df).first()["flip_rate_per_hour"] == 0.0


def fal_rows(spark, rows):
    return spark.createDataFrame(
        [(f"E{i}", t, k, p) for i, (t, k, p) in enumerate(rows)],
        "event_id string, date_time_utc bigint, kafka_logappend_ms bigint, ready_ms bigint",
    ).withColumn("features_ready_ms", F.col("ready_ms"))


def test_fal_windows(spark):
    rows = [(0, 1000, 5000), (1199, 2000, 9000), (1200, None, 11000), (1300, 12000, None), (2400, 13000, 99000)]
    out = timeliness.fal_windows(fal_rows(spark, rows), anchor="kafka_logappend_ms", ready="features_ready_ms").collect()
    # The last event lies exactly at the end: it opens no window of its own, but closes the second;
    # that one has no append time among its ready rows.
    assert [(r["window_no"], r["fal_total_s"], r["fal_pipeline_s"], r["fal_freshness_s"]) for r in out] == [(0, 8.0, 7.0, 0.0)]


def test_fal_freshness_and_lateness(spark):
    rows = [(0, 1000, 50000), (1250, 7000, 8000), (1500, 20000, 21000)]
    df = fal_rows(spark, rows)
    plain = timeliness.fal_windows(df, anchor="kafka_logappend_ms", ready="features_ready_ms").orderBy("window_no").collect()
    assert plain[0]["fal_freshness_s"] == 43.0
    late = timeliness.fal_windows(df, anchor="kafka_logappend_ms", ready="features_ready_ms", lateness_s=100).orderBy("window_no").collect()
    assert late[0]["fal_freshness_s"] == 30.0


def test_source_choice_without_flags(spark):
    df = fal_rows(spark, [(0, None, 5), (10, None, 6)]).withColumn("produced_at_ms", F.lit(1).cast("bigint"))
    row = timeliness.fal_source_choice(df).first()
    assert (row["anchor"], row["ready"]) == ("produced_at_ms", "features_ready_ms")


def test_ml_without_positive_predictions(spark):
    df = events(spark, [0, 10], mean_conductivity=F.lit(40.0), setpoint_conductivity=F.lit(40.0))
    row = quality.proxy_ml_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1"], row["support_total"]) == (None, None, None, 2)


def test_distribution_matches_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 5, 400), rng.integers(-3, 4, 300).astype(float), [1e-9, 1e12, -7.5]])
    df = spark.createDataFrame([(float(v), int(w)) for v, w in zip(values, rng.integers(0, 4, len(values)))], "v double, w int")
    weighted = np.repeat(values, [r["w"] for r in df.collect()])
    row = D.distribution(df, "v", [], linear={"p10": 0.1, "p50": 0.5, "p99": 0.99}, nearest={"m": 0.5}, weight="w").first()
    assert row["n"] == len(weighted)
    for name, q in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
        assert row[name] == pytest.approx(np.quantile(weighted, q), rel=1e-12)
    assert row["m"] == np.sort(weighted)[len(weighted) // 2]
    assert row["std"] == pytest.approx(weighted.std(ddof=1), rel=1e-9)


def test_summary_of_one_value(spark):
    row = D.metric_summary(spark.createDataFrame([("a", 2.5), ("a", None)], "g string, v double"), "v", ["g"]).first()
    assert (row["n"], row["mean"], row["std"], row["p95"]) == (1, 2.5, 0.0, 2.5)


def test_single_run_has_no_spread_across_runs(spark):
    metrics = spark.createDataFrame(
        [("x", "A", 0, "missing_rate", None, 0.25, 0.5, 0.75, 1.0), ("x", "A", 0, "out_of_order_count", 3.0, None, None, None, None)],
        "architecture string, workload string, repeat int, metric string, value double, mean double, std double, p95 double, p99 double",
    )
    rows = {r["metric"]: r for r in runs.aggregate_runs(metrics).collect()}
    assert (rows["missing_rate"]["std_across_runs"], rows["missing_rate"]["std_within_run_mean"]) == (0.0, 0.5)
    assert (rows["out_of_order_count"]["value"], rows["out_of_order_count"]["std_across_runs"]) == (3.0, None)
    index = runs.readiness_indices(runs.aggregate_runs(metrics)).first()
    assert (index["n_mr"], index["online_performance_index"], index["n_mtbf"]) == (0.75, None, None)


def test_slice_of_short_and_empty_runs(spark):
    df = events(spark, [0, 200, 400]).withColumn("run", F.lit("short")).unionByName(
        events(spark, [0, 10]).withColumn("run", F.lit("tiny"))
    )
    kept = timeliness.measurement_slice(df, run=["run"]).groupBy("run").count().collect()
    assert {r["run"]: r["count"] for r in kept} == {"short": 1, "tiny": 2}


def test_event_times(spark):
    df = spark.createDataFrame([("1704067200",), ("1704067200123",), ("1.7040672E9",), ("soon",), (None,)], "t string")
    row = df.select(F.collect_list(fn.event_ms(F.col("t"))), F.collect_list(fn.event_s(F.col("t")))).first()
    assert row[0] == [1704067200000, 1704067200123, 1704067200000, 0, 0]
    assert row[1] == [1704067200.0, 1704067200.123, 1704067200.0]


def test_messages(spark):
    texts = [
        '{"Id": "a", "MeanRinseTemp": 7, "DateTimeUTC": "1704067200", "extra": 1}', '{"Id": "b", "MeanRinseTemp": "warm"}',
        '{"Id": "c", ', "[1]", "null", "", None,
    ]
    df = spark.createDataFrame([(t, 5) for t in texts], "value string, s long").withColumn("timestamp", F.timestamp_seconds("s"))
    rows = {r["event_id"]: r for r in messages.parse_events(df).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"]["date_time_utc"], rows["a"]["event_time_utc_ms"], rows["a"]["mean_rinse_temp"]) == (1704067200, 1704067200000, 7.0)
    assert (rows["b"]["mean_rinse_temp"], rows["b"]["event_time_utc_ms"], rows["b"]["kafka_logappend_ms"]) == (None, 0, 5000)


def test_machine_list(spark, tmp_path):
    path = tmp_path / "machines.csv"
    path.write_text(
        "﻿Device Name;MACAdress String;Maschine Name And Model;Site;Energy KW;Wash Temp Threshold;Rinse Temp Threshold;Dosing Unit Type\n"
        "D1; M1 ;Model;S;68;0;;None\nD2;  ;Model;S;1;2;3;x\n", encoding="utf-8",
    )
    rows = machines.read_machines(spark, str(path)).collect()
    assert len(rows) == 1 and rows[0]["mac"] == "M1" and rows[0]["energy_kw"] == 68.0
    assert (rows[0]["wash_temp_setpoint"], rows[0]["rinse_temp_setpoint"]) == (0, None)


def test_classic_run_folders(spark, tmp_path):
    for name in ("kappa/workload_A/run_1", "kappa/workload_B/run_x", "fabric/workload_C/run_12", "other/run_1"):
        folder = tmp_path / name
        os.makedirs(folder)
        (folder / "raw_data.csv").write_text("mac_address_string\n")
    rows = run_source.discover_runs(spark, str(tmp_path)).collect()
    assert {(r["architecture"], r["workload"], r["repeat"]) for r in rows} == {("kappa", "A", 1), ("fabric", "C", 12)}


def test_trace_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"Id": "1", "DateTimeUTC": 100}, {"Id": "2", "DateTimeUTC": 161}]))
    (tmp_path / "b.json").write_text(json.dumps({"Id": "3", "DateTimeUTC": 100}))
    (tmp_path / "c.json").write_text(json.dumps([{"Id": "4", "DateTimeUTC": 160}]))
    df = traces.read_trace_files(spark, str(tmp_path))
    assert {r["event_id"] for r in traces.trace_slice(df, 1).collect()} == {"1", "4"}


def test_odd_trace_files(spark, tmp_path):
    """Braces in texts, nested objects, cut files, empty arrays, blanks and line ends anywhere."""
    good = {"a": '[]', "b": ' [\n ]\n', "c": '[{"Id": "1"} ,\n\t{"Id":"2"}\n]\n', "d": '[{"Id": "x}, {y"}, {"Id": "3"}]',
            "e": '[{"Id": "4", "more": {"deep": [{}]}}, {"Id": "5"}]', "f": '[{"Id": "}]"}]'}
    none = {"g": '{"Id": "6"}\n{"Id": "7"}', "h": '[{"Id": "8"}', "i": "", "j": '[[{"Id": "9"}]]', "k": "]["}
    for name, text in (good | none).items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = [r["event_id"] for r in traces.read_trace_files(spark, str(tmp_path)).collect()]
    wanted = {"1", "2", "3", "4", "5", "x}, {y", "}]"}
    assert wanted <= set(rows) and len([r for r in rows if r is not None]) == len(wanted)


def test_a_large_array_is_read_by_several_tasks(spark):
    path = scratch_dir(spark, "large")
    event = F.to_json(F.struct(F.col("id").cast("string").alias("Id"), F.rpad(F.lit("x"), 150, "yz").alias("DeviceID")))
    traces.write_trace_file(spark.range(1_000_000).select(F.col("id").alias("n"), event.alias("value")), path)
    read = traces.read_trace_files(spark, path)
    assert read.rdd.getNumPartitions() >= 2
    spread = read.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in spread) == 1_000_000 and sum(r["count"] > 100_000 for r in spread) >= 2
    assert read.select("event_id").distinct().count() == 1_000_000


def test_no_task_writes_a_whole_trace(spark):
    path = scratch_dir(spark, "stretches")
    event = F.to_json(F.struct(F.col("id").cast("string").alias("Id")))
    rows = spark.range(1000).select((F.col("id") % 500).alias("n"), event.alias("value"))
    traces.write_trace_file(rows, path, most_events=100)
    texts = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    arrays = [[int(e["Id"]) % 500 for e in json.loads(t)] for t in texts]
    assert len(arrays) > 5 and max(map(len, arrays)) < 300 and all(a == sorted(a) for a in arrays)
    assert sorted(n for a in arrays for n in a) == sorted(2 * list(range(500)))
    assert sorted(int(r.event_id) for r in traces.read_trace_files(spark, path).collect()) == list(range(1000))
    traces.write_trace_file(rows.limit(0), f"{path}/none")
    assert traces.read_trace_files(spark, f"{path}/none").count() == 0


def test_insert_ignore_keeps_rows_without_key(spark):
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5), (None, 1), (None, 1)], "event_id string, v int")
    target = spark.createDataFrame([("b", 0), (None, 9)], "event_id string, v int")
    rows = sorted(map(tuple, sinks.insert_ignore(new, target, order=["v"]).collect()), key=repr)
    assert rows == sorted([("a", 1), ("b", 0), (None, 1), (None, 1), (None, 9)], key=repr)


def test_latency_columns(spark):
    df = spark.createDataFrame([(1000, 3), (None, 3)], "kafka_logappend_ms bigint, s bigint").withColumns(
        {"persisted_at": F.timestamp_seconds("s"), "latency_seconds": F.lit(9.0)}
    )
    kept = features.add_latency(df, keep_given=True).collect()
    assert [r["latency_seconds"] for r in kept] == [9.0, 9.0]
    assert [r["latency_seconds"] for r in features.add_latency(df).collect()] == [2.0, None]


def test_injected_faults(spark):
    df = events(spark, [10_000] * 4000, **{s: F.lit(50.0) for s in S.SENSORS})
    shifted = workloads.inject_time_faults(df, 0.1).where("_fault is not null")
    deltas = {(r["_fault"], r["date_time_utc"] - 10_000) for r in shifted.collect()}
    assert {d for f, d in deltas if f == "future"} == {3600}
    assert all(-60 <= d <= -10 for f, d in deltas if f == "late")
    bad = workloads.inject_range_violations(df, 0.1).where("_schema_violation is not null")
    assert 300 < bad.count() < 500 and bad.where(fn.in_range()).count() == 0
    assert {r[0] for r in bad.select(F.explode(F.array(*S.SENSORS))).collect()} == {-1.0, 50.0, 256.0, 300.0}
    assert "_fault" not in workloads.publish(shifted).columns


def test_gates_of_missing_figures(spark):
    df = spark.createDataFrame([("washing", None, None, None), ("washing", 0.2, None, None)], "domain string, missing_rate double, field_consistency_score double, flag_flip_rate double")
    gate = domains.quality_gates(df).first()
    assert (gate["missing_rate_avg"], gate["field_consistency_avg"], gate["flag_flip_rate_avg"], gate["status"]) == (0.2, 0.5, 0.0, "warn")
    snapshot = domains.quality_snapshot(df).first()
    assert (snapshot["missing_rate_avg"], snapshot["field_consistency_avg"]) == (0.1, 0.5)


def test_pending_top_k(spark):
    df = events(spark, [3, 1, 2], flags_computed_at=F.lit(None).cast("timestamp"))
    assert [r["date_time_utc"] for r in pending.pending(df, limit=2).collect()] == [1, 2]


def test_summary_json(spark, tmp_path):
    df = spark.createDataFrame([("x", "A", "m", 1.0, None)], "architecture string, workload string, metric string, value double, mean double")
    sinks.write_summary_json(df, str(tmp_path / "out"))
    row = spark.read.json(str(tmp_path / "out")).first()
    assert row["metrics"]["m"]["value"] == 1.0


def test_empty_runs_get_defaults(spark, sf_dir):
    from checks import inputs as I

    one = I.run_rows(spark, sf_dir).where("architecture = 'kappa' and workload = 'A' and repeat = 0")
    listed = spark.createDataFrame([("kappa", "A", 0), ("mesh", "Z", 1)], "architecture string, workload string, repeat int")
    out = runs.run_metrics(one, runs=listed).where("architecture = 'mesh'").collect()
    assert {(r["metric"], r["value"]) for r in out} == set(runs.EMPTY_RUN.items())


def test_overwrite_columns_without_key(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "event_id string, v int")
    new = spark.createDataFrame([("a", 2), ("b", None), (None, 9)], "event_id string, v int")
    rows = sorted(map(tuple, sinks.overwrite_columns(base, new, columns=["v"]).collect()), key=repr)
    assert rows == sorted([("a", 2), ("b", 1), (None, 1)], key=repr)


def test_large_dimension_takes_the_salted_stream_join(spark, sf_dir):
    from brinewatch import streaming
    from brinewatch.operators.joins import stream_setpoints
    from checks import inputs as I

    rows, dim = I.beacon_stream(spark, sf_dir), I.machines(spark, sf_dir)
    names = ("event_id", "wash_temp_setpoint")
    small = streaming.drain(stream_setpoints(rows, dim).select(*names), "small")
    large = streaming.drain(stream_setpoints(rows, dim, max_broadcast_rows=1).select(*names), "large")
    assert small.exceptAll(large).count() == 0 and small.count() == large.count() > 0


def test_dimensions_that_do_not_fit_are_never_broadcast(spark, sf_dir):
    """Spark would: it goes by the size of the files, which are small before rows are exploded and copied."""
    from brinewatch.operators import joins
    from checks import inputs as I

    rows, dim, versions = I.beacons(spark, sf_dir), I.machines(spark, sf_dir), I.machine_versions(spark, sf_dir)
    few = {"max_broadcast_rows": 1}
    for joined in (
        joins.stream_setpoints(rows, dim, **few), joins.stream_asof_setpoints(rows, versions, **few),
        joins.join_setpoints(rows, dim, **few), joins.asof_setpoints(rows, versions, **few),
    ):
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_infinite_values_are_counted(spark):
    rows = [("a", float("inf")), ("a", 1.0), ("a", 2.0), ("b", float("-inf")), ("b", float("inf")), ("c", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in D.distribution(df, "v", ["g"], linear={"p0": 0.0, "p100": 1.0}).collect()}
    assert got["a"].max == got["a"].p100 == got["a"].mean == float("inf") and got["a"].p0 == 1.0
    assert got["b"].min == float("-inf") and got["b"].mean != got["b"].mean and got["b"].n == 2
    assert got["c"].mean == 3.0 and got["c"].std == 0.0


def test_rows_without_time_are_not_earlier(spark):
    rows = [("e1", "m", None, 10.0), ("e2", "m", 1000, 50.0), ("e3", "m", 1040, 60.0)]
    schema = "event_id string, mac_address_string string, date_time_utc bigint, mean_conductivity double"
    df = spark.createDataFrame(rows, schema).withColumns(
        {"mean_wash_tank_temp": F.lit(1.0), "mean_rinse_temp": F.lit(1.0), "conc_constant_over": F.lit(False)}
    )
    for policy in (HotPolicy(), HotPolicy(min_rows=1, chunk_rows=1)):
        got = issues.sensor_features(df, flags=["conc_constant_over"], policy=policy)
        assert {r.event_id: r.conductivity_delta_30s for r in got.collect()} == {"e1": None, "e2": None, "e3": 10.0}


def test_run_reports_in_run_folders(spark, tmp_path):
    folder = tmp_path / "kappa" / "workload_A" / "run_2"
    folder.mkdir(parents=True)
    (folder / "producer_report.json").write_text('{\n "mode": "rate",\n "rate_limit": 5}')
    got = run_source.read_run_reports(spark, f"{tmp_path}/*/*/*/producer_report.json", run_source.PRODUCER_FIELDS)
    row = got.first()
    assert (row.architecture, row.workload, row.repeat, row["mode"], row.rate_limit) == ("kappa", "A", 2, "rate", 5.0)


def test_scratch_tables_can_be_dropped(spark):
    from brinewatch import session

    app = spark.sparkContext.applicationId
    kept = session._written.pop(app, [])
    table = session.checkpointed(spark.range(3))
    path = session._written[app][0]
    assert table.count() == 3 and os.path.exists(path)
    assert session.drop_scratch(spark) == 1 and not os.path.exists(path)
    session._written[app] = kept


def test_deviation_far_from_zero(spark):
    rows = [("a", 1e9, 1), ("a", 1e9 + 1, 2), ("a", 1e9, 1), ("b", -1e12, 3), ("b", -1e12 + 2, 3)]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    got = {r.g: r for r in D.distribution(df, "v", ["g"], weight="w").collect()}
    assert abs(got["a"].std - 0.5773502691896258) < 1e-12 and abs(got["b"].std - 1.0954451150103321) < 1e-12
    assert D.metric_summary(df.where("g = 'a'"), "v", ["g"], weight="w").first()["std"] == 0.57735


@pytest.mark.parametrize("most", [2, 1000])
def test_quantiles_of_crowded_buckets(spark, most):
    random = np.random.default_rng(5)
    parts = [random.uniform(0.99, 1.0, 3000), -np.abs(random.normal(1e9, 1.0, 2000)), np.full(500, 0.995), [0.0, np.inf, 1e-300, 5e-324]]
    skewed = 1.0 + 2.0 ** -random.uniform(2, 50, 2000)
    values = np.concatenate([*parts, skewed])
    random.shuffle(values)
    df = spark.createDataFrame(pd.DataFrame({"v": values, "g": np.arange(len(values)) % 2}))
    probes = {"p0": 0.0, "p1": 0.01, "p33": 1 / 3, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    got = {r.g: r for r in D.distribution(df, "v", ["g"], linear=probes, nearest={"m": 0.7}, most_values=most).collect()}
    for g in (0, 1):
        mine = np.sort(values[np.arange(len(values)) % 2 == g])
        for name, q in probes.items():
            assert np.isclose(got[g][name], np.quantile(mine, q), rtol=1e-14, atol=0), (g, name)
        assert got[g].m == mine[int(len(mine) * 0.7)]


def test_ten_million_close_values(spark):
    """No window sees more than the limit; ranges halve by the thousand."""
    n = 10_000_000
    df = spark.range(0, n, 1, 8).select((F.lit(0.99) + F.col("id") / F.lit(1e9)).alias("v"))
    start = time.time()
    row = D.latency_stats(df, "v").first()
    assert (row["count"], row["p50"], row["p99"]) == (n, 0.99 + (n // 2) / 1e9, 0.99 + int(n * 0.99) / 1e9)
    assert D.MOST_VALUES <= n / 50 and time.time() - start < 240


def test_median_gap_of_a_device_with_many_gaps(spark):
    random = np.random.default_rng(6)
    rows = [("a", float(g), int(c)) for g, c in zip(random.choice(10**6, 300, replace=False) / 7, random.integers(1, 9, 300))]
    rows += [("b", 2.0, 3), ("b", 8.0, 1), ("c", None, 4)]
    gaps = spark.createDataFrame(rows, "mac_address_string string, gap_s double, gaps long")
    whole, cut = ({r.mac_address_string: r.cadence_s for r in quality.device_cadence(gaps, most_values=m).collect()} for m in (10**6, 50))
    assert whole.keys() == cut.keys() == {"a", "b", "c"}
    assert all(abs(whole[k] - cut[k]) < 1e-9 * whole[k] for k in whole)
