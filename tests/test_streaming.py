"""Streams over several micro-batches: late rows, keys that come again, snapshots of upsert logs."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from brinewatch import streaming
from brinewatch.session import scratch_dir
from checks.stream_checks import write_batches

ROWS = (
    "event_id string, mac_address_string string, kafka_ts timestamp, date_time_utc bigint, mean_conductivity double, "
    "mean_wash_tank_temp double, mean_rinse_temp double, en_wash_on int, en_rinse_on int, setpoint_conductivity double"
)


def batches(spark, label, schema, *parts):
    """A stream that reads one part at each trigger."""
    path = scratch_dir(spark, label)
    for number, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/part={number}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return stream.option("recursiveFileLookup", "true").parquet(path)


def event(key, mac, minute, conc):
    return (key, mac, f"2024-01-01 00:{minute:02d}:00", 0, conc, 50.0, 70.0, 1, 1, 40.0)


def test_kappa_keeps_open_windows_and_late_rows(spark):
    rows = [
        [event("a", "m", 1, 40.0), event("b", "m", 30, 10.0), event(None, "m", 2, 40.0)],
        [event("c", "m", 59, 40.0)],
        [event("late", "m", 3, 90.0), event("d", "m", 58, 41.0)],
    ]
    text = ROWS.replace("kafka_ts timestamp", "kafka_ts string")
    stream = batches(spark, "kappa", text, *rows).withColumn("kafka_ts", F.col("kafka_ts").cast("timestamp"))
    machines = spark.createDataFrame([("m", 55, 75)], "mac string, wash_temp_setpoint int, rinse_temp_setpoint int")
    got = {r.event_id: r for r in streaming.run_kappa(stream, machines).collect()}
    assert len(got) == 6
    assert {k for k, r in got.items() if r.late} == {"late"}
    assert got["d"].avg_conductivity == 40.5 and got["d"].window_end.minute == 0
    assert got["a"].avg_conductivity == 40.0 and got["late"].temp_below_setpoint
    assert any(k.startswith("fallback_") for k in got) and got["b"].conc_ok is False


def test_a_mean_on_the_edge_of_the_band_does_not_depend_on_the_order_of_rows(spark):
    """The mean is 44, the band's upper end; added in this order as doubles it comes out above."""
    from brinewatch.operators.tumbling import attach_window, conc_ok_column

    values = [v for v in (36.47, 41.28, 48.41, 49.84) for _ in range(60)]
    total = 0.0
    for v in values:
        total += v
    assert total / len(values) > 44.0
    rows = [event(f"e{n}", "m", 1, v) for n, v in enumerate(values)]
    text = ROWS.replace("kafka_ts timestamp", "kafka_ts string")
    stream = batches(spark, "edge", text, rows[:100], rows[100:]).withColumn("kafka_ts", F.col("kafka_ts").cast("timestamp"))
    machines = spark.createDataFrame([("m", 55, 75)], "mac string, wash_temp_setpoint int, rinse_temp_setpoint int")
    assert {(r.avg_conductivity, r.conc_ok) for r in streaming.run_kappa(stream, machines).collect()} == {(44.0, True)}
    table = spark.createDataFrame(rows, text).coalesce(1).withColumn("kafka_ts", F.col("kafka_ts").cast("timestamp"))
    table = attach_window(table).withColumn("conc_ok", conc_ok_column())
    assert {(r.avg_conductivity, r.conc_ok) for r in table.collect()} == {(44.0, True)}
    odd = spark.createDataFrame([event("huge", "m", 1, 1e12), event("b", "m", 1, 2e12), event("none", "m", 1, None)], text)
    odd = attach_window(odd.withColumn("kafka_ts", F.col("kafka_ts").cast("timestamp")))
    assert {r.avg_conductivity for r in odd.collect()} == {1.5e12}


def test_insert_ignore_is_unique_over_batches_and_target(spark):
    schema = "k string, v int"
    stream = batches(spark, "ignore", schema, [("a", 1), ("a", 0), (None, 1)], [("a", 2), ("b", 2)], [("t", 3), (None, 3)])
    target = spark.createDataFrame([("t", 9)], schema)
    got = streaming.drain_insert_ignore(stream, "ignored", key="k", order=["v"], target=target)
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 0), ("b", 2), ("t", 9), (None, 1), (None, 3)]


def test_upsert_log_with_snapshots(spark):
    schema = spark.createDataFrame([], "k int, v int").schema
    log = streaming.UpsertLog(spark, scratch_dir(spark, "log"), schema, ["k"], every=3)
    assert log.content().collect() == []
    for number in range(8):
        log.write(spark.createDataFrame([(number % 3, number), (9, number)], schema), number)
    log.write(spark.createDataFrame([(0, 70)], schema), 7)  # the same batch once more
    assert {r.k: r.v for r in log.content().collect()} == {0: 70, 1: 4, 2: 5, 9: 6}
    assert {r.k: r.v for r in log.content(5).collect()} == {0: 3, 1: 4, 2: 5, 9: 5}


TEXT_ROWS = ROWS.replace("kafka_ts timestamp", "kafka_ts string")


def timed_stream(spark, label, *parts):
    stream = batches(spark, label, TEXT_ROWS, *parts)
    return stream.withColumn("kafka_ts", F.col("kafka_ts").cast("timestamp"))


def machine_table(spark):
    return spark.createDataFrame([("m", 55, 75)], "mac string, wash_temp_setpoint int, rinse_temp_setpoint int")


def in_figures(rows):
    """The average of each window's rows that are not late."""
    out = {}
    for r in rows:
        if not r.late:
            out.setdefault((r.mac_address_string, r.window_end), []).append(r.mean_conductivity)
    return {k: sum(v) / len(v) for k, v in out.items()}


def test_late_rows_are_exactly_those_not_in_the_figures(spark):
    """A row between the marks of two batches, and rows of a window that closes batch by batch."""
    hour = [[event("a", "m", 1, 40.0)], [event("b", "m", 5, 30.0)], [event("c", "m", 2, 10.0)],
            [event("d", "m", 29, 20.0)], [event("e", "m", 3, 60.0)], [event("f", "m", 30, 20.0)],
            [event("g", "m", 4, 80.0)], [event("h", "m", 25, 90.0), event("i", "n", 6, 50.0)]]
    got = streaming.run_kappa(timed_stream(spark, "between", *hour), machine_table(spark), delay="10 minutes").collect()
    # 00:30 less ten minutes is the end of the first window: the batch after it finds it closed.
    assert sorted(r.event_id for r in got if r.late) == ["g", "i"]
    figures = in_figures(got)
    for r in got:
        assert r.avg_conductivity == figures.get((r.mac_address_string, r.window_end)), r.event_id
    days = [[event("a", "m", 1, 40.0)], [("b", "m", "2024-01-01 05:00:00", 0, 1.0, 50.0, 70.0, 1, 1, 40.0)], [event("c", "m", 2, 10.0)]]
    got = {r.event_id: r for r in streaming.run_kappa(timed_stream(spark, "jump", *days), machine_table(spark)).collect()}
    assert got["c"].late and got["c"].avg_conductivity == got["a"].avg_conductivity == 40.0


def test_fabric_marks_come_from_all_rows(spark):
    """The newest row is invalid: it moves time on, but is not shown."""

    def at(key, minute, conc, wash=50.0):
        return (key, "m", "2024-01-01 00:00:00", 1704067200 + 60 * minute, conc, wash, 70.0, 1, 1, 40.0)

    parts = [[at("a", 1, 40.0)], [at("bad", 300, 30.0, wash=300.0)], [at("c", 2, 10.0)]]
    versions = spark.createDataFrame([("m", 0, 55, 75)], "mac string, valid_from bigint, wash_temp_setpoint int, rinse_temp_setpoint int")
    stream = timed_stream(spark, "fabric", *parts).withColumn("produced_at_ms", F.lit(0).cast("bigint"))
    got = {r.event_id: r for r in streaming.run_fabric(stream, versions).collect()}
    assert set(got) == {"a", "c"} and got["c"].late and not got["a"].late
    assert got["a"].avg_conductivity == 40.0


def test_a_dimension_may_change_between_triggers(spark):
    path = scratch_dir(spark, "dimension")
    schema = "mac string, wash_temp_setpoint int, rinse_temp_setpoint int"
    spark.createDataFrame([("m", 45, 75)], schema).write.parquet(path)
    stream = timed_stream(spark, "changing", [event("a", "m", 1, 40.0)], [event("b", "m", 2, 40.0)], [event("c", "m", 3, 40.0)])
    served = streaming.kappa_stream(stream, lambda: spark.read.schema(schema).parquet(path), scratch_dir(spark, "served"))
    write = served.write

    def then_change(batch, batch_id):
        write(batch, batch_id)
        if batch_id == 0:
            spark.createDataFrame([("m", 55, 75)], schema).write.mode("overwrite").parquet(path)

    served.write = then_change
    got = {r.event_id: r.temp_below_setpoint for r in served.drain().collect()}
    assert got == {"a": False, "b": True, "c": True}


def test_a_repeated_batch_changes_nothing_and_the_table_is_there_while_running(spark):
    stream = timed_stream(spark, "again", [event("a", "m", 1, 40.0)], [event("b", "m", 59, 20.0)], [event("c", "m", 2, 10.0)])
    served = streaming.kappa_stream(stream, machine_table(spark), scratch_dir(spark, "twice"))
    write, seen = served.write, []

    def twice(batch, batch_id):
        write(batch, batch_id)
        write(batch, batch_id)
        seen.append(sorted((r.event_id, r.late, r.avg_conductivity) for r in served.table().collect()))

    served.write = twice
    query = served.start(processingTime="100 milliseconds")
    query.processAllAvailable()
    query.stop()
    assert seen == [
        [("a", False, 40.0)],
        [("a", False, 40.0), ("b", False, 20.0)],
        [("a", False, 40.0), ("b", False, 20.0), ("c", True, 40.0)],
    ]


def folders(path):
    return sum(len(names) for _, names, _ in os.walk(path))


def test_upsert_log_keeps_few_folders_and_right_readers(spark):
    schema = spark.createDataFrame([], "k int, v int").schema
    path = scratch_dir(spark, "bounded")
    log = streaming.UpsertLog(spark, path, schema, ["k"], every=5, buckets=4)
    reader, sizes = None, []
    for number in range(100):
        log.write(spark.createDataFrame([(number % 7, number), (100 + number % 3, number)], schema), number)
        sizes.append(folders(path))
        if number == 52:
            reader = log.content()
        if number == 56:  # a snapshot later, what was read from is still there
            assert {r.k: r.v for r in reader.collect()} == {**{n % 7: n for n in range(46, 53)}, **{100 + n % 3: n for n in range(50, 53)}}
    assert max(sizes[50:]) <= max(sizes[20:50]) and max(sizes) < 60, sizes
    assert {r.k: r.v for r in log.content().collect()} == {**{n % 7: n for n in range(93, 100)}, **{100 + n % 3: n for n in range(97, 100)}}


def test_insert_ignore_reads_only_its_keys_buckets(spark):
    schema = spark.createDataFrame([], "k int, v int").schema
    path = scratch_dir(spark, "buckets")
    table = streaming.KeyedTable(spark, path, schema, ["k"], every=5, buckets=4, bucket_rows=200)
    table.write(spark.range(4000).selectExpr("cast(id as int) k", "0 v"), -1)
    read = []
    for number in range(20):
        batch = spark.createDataFrame([(number * 37, 1), (5000 + number, 1), (None, number)], schema)
        known = table.lookup(batch, number)
        read.append(known.count())
        table.write(batch.join(known, "k", "left_anti"), number)
    rows = [tuple(r) for r in table.content().collect()]
    assert sorted(r for r in rows if r[0] is not None) == sorted([(k, 0) for k in range(4000)] + [(5000 + n, 1) for n in range(20)])
    assert sorted(v for k, v in rows if k is None) == list(range(20))
    # Buckets double until none holds many more than its limit; a trigger reads two of them and the last changes.
    assert read[0] >= 1500 and max(read[-5:]) < 1200, read
    assert max(table._snapshot(10**6).rows.values()) < 1200


def test_batches_of_several_files_do_not_run_into_each_other(spark, tmp_path):
    """Each batch is written by several tasks, and a stream takes it whole."""
    df = spark.range(0, 9000, 1, 4).selectExpr("id as event_id", "if(id % 9 < 5, 7, id % 9) as half", "if(id % 9 < 5, 7, id % 9) as batch")
    path, files = write_batches(df.unionByName(df.limit(5).withColumn("batch", F.lit(None).cast("bigint"))), "batch", by="event_id", file_rows=700)
    assert files == 9
    written = spark.read.option("recursiveFileLookup", "true").schema("event_id bigint, half bigint").parquet(path)
    assert written.count() == 9000 and len(written.inputFiles()) == 4 * files
    seen = []
    stream = spark.readStream.schema(written.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)
    writer = stream.writeStream.foreachBatch(lambda batch, _: seen.append({r.half: r["count"] for r in batch.groupBy("half").count().collect()}))
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [{5: 1000}, {6: 1000}, {7: 6000}, {8: 1000}]
    # Too few rows to be sure of every file: one file a batch.
    assert write_batches(df.limit(150), "batch", by="event_id", file_rows=10)[1] == 1
