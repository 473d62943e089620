"""Streaming queries: drained with availableNow, compared with SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewatch import functions as fn
from brinewatch import schema as S
from brinewatch import streaming
from brinewatch.operators.tumbling import tumbling_stats
from brinewatch.session import checkpointed, scratch_dir
from checks import inputs as I
from checks.feature_checks import CONC_OK_SQL, M, POINT_SQL, STATS_SQL, VALID, WINDOW_SQL, rounded
from checks.job_checks import QUIET_SQL, READY, STREAM_FROM
from checks.registry import ORACLES, check

# With one input batch a window is emitted once its end is not after the watermark.
CLOSED = "(SELECT max(kafka_logappend_ms) - 600000 FROM beacons)"
TUMBLING_SQL = f"""
    WITH g AS (SELECT mac_address_string, (kafka_logappend_ms // 1200000) * 1200000 AS start_ms, {STATS_SQL}
      FROM beacons GROUP BY 1, 2)
    SELECT * REPLACE (round(avg_conductivity, 6) AS avg_conductivity) FROM g"""


def _flat(stats):
    return rounded(stats, "avg_conductivity").select(
        "*", fn.epoch_ms(F.col("window.start")).alias("start_ms")
    ).drop("window")


@check("stream_tumbling", I.with_inputs(f"{TUMBLING_SQL} WHERE start_ms + 1200000 <= {CLOSED}"))
def stream_tumbling(spark, sf):
    return _flat(streaming.drain(streaming.tumbling(I.beacon_stream(spark, sf)), "tumbling"))


@check(
    "stream_dedup",
    I.with_inputs("SELECT event_id, mac_address_string, date_time_utc FROM beacons"),
)
def stream_dedup(spark, sf):
    """Every event is delivered twice; one copy of each survives."""
    b = I.beacon_stream(spark, sf).select("event_id", "mac_address_string", "date_time_utc", "kafka_ts")
    twice = b.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return streaming.drain(streaming.deduplicated(twice), "dedup").drop("kafka_ts")


@check(
    "stream_enriched",
    I.with_inputs(f"""
    SELECT event_id, wash_temp_setpoint, {POINT_SQL}
    FROM beacons b LEFT JOIN machines m ON b.mac_address_string = m.mac""", M),
)
def stream_enriched(spark, sf):
    out = streaming.enriched(I.beacon_stream(spark, sf), I.machines(spark, sf))
    return streaming.drain(out.select("event_id", "wash_temp_setpoint", *S.RULE_FLAGS[:4]), "enriched")


@check(
    "stream_validated",
    I.with_inputs(f"""SELECT event_id, mean_wash_tank_temp, 'valid' AS outcome FROM beacons WHERE {VALID}
    UNION ALL SELECT event_id, mean_wash_tank_temp, 'rejected' FROM beacons WHERE NOT ({VALID})"""),
)
def stream_validated(spark, sf):
    rows = I.beacon_stream(spark, sf).select("event_id", *S.SENSORS)
    valid, rejected = streaming.drain_split(rows, "validated")
    return valid.withColumn("outcome", F.lit("valid")).unionByName(
        rejected.withColumn("outcome", F.lit("rejected"))
    ).select("event_id", "mean_wash_tank_temp", "outcome")


@check("stream_kappa_flags", ORACLES["kappa_job"])
def stream_kappa_flags(spark, sf):
    """All events come out, also those of windows that are still open."""
    b = I.beacon_stream(spark, sf)
    unkeyed = b.withColumn("event_id", F.when(F.col("k") % 10 != 0, F.col("event_id")))
    out = streaming.run_kappa(unkeyed, I.machines(spark, sf), raw_time="date_time_raw")
    return out.select(
        "event_id", "event_time_utc_ms", "kafka_logappend_ms", *S.RULE_FLAGS, "conc_ok",
        fn.epoch_ms(F.col("stream_features_ready_at")).alias("ready_ms"),
    )


@check(
    "stream_speed",
    I.with_inputs(WINDOW_SQL + f"""
    SELECT event_id, event_time_utc_ms, (kafka_logappend_ms // 1000) * 1000 AS kafka_logappend_ms, {POINT_SQL},
      {CONC_OK_SQL} AS conc_ok, {QUIET_SQL}, {READY} AS ready_ms {STREAM_FROM}""", M),
)
def stream_speed(spark, sf):
    out = streaming.run_speed(I.beacon_stream(spark, sf), I.machines(spark, sf), raw_time="date_time_raw")
    return out.select(
        "event_id", "event_time_utc_ms", "kafka_logappend_ms", *S.RULE_FLAGS, "conc_ok",
        fn.epoch_ms(F.col("speed_features_ready_at")).alias("ready_ms"),
    )


#: Half an hour of arrivals makes a batch; every twentieth row arrives two hours later.
HELD_SQL = """held AS (SELECT *, kafka_logappend_ms + CASE WHEN k % 20 = 0 THEN 7200000 ELSE 0 END AS arrival_ms FROM beacons),
    batched AS (SELECT *, arrival_ms // 1800000 AS batch, kafka_logappend_ms // 1200000 AS w FROM held),
    marks AS (SELECT batch, max(max(kafka_logappend_ms)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark
      FROM batched GROUP BY batch),
    judged AS (SELECT b.*, coalesce((w + 1) * 1200000 <= mark - 600000, FALSE) AS late FROM batched b JOIN marks USING (batch))"""


def write_batches(df, batch, *, by, file_rows=100_000):
    """``df`` as a folder of files from which a stream takes ``files`` at a time, one batch: ``(folder, files)``.

    One batch after the other, as a stream takes the older files first; each has the same number of files, written by
    as many tasks, which the rows are dealt out to by a hash of ``by``.
    """
    spark = df.sparkSession
    stored, path = scratch_dir(spark, "stored"), scratch_dir(spark, "held")
    df = df.where(F.col(batch).isNotNull())
    sizes = {r[batch]: r["count"] for r in df.groupBy(batch).count().collect()}
    most, least = max(sizes.values(), default=0), min(sizes.values(), default=0)
    files = max(1, min(-(-most // file_rows), least // 100))
    # Dealt out by batch once, so that each batch is read without the others.
    filed = df.withColumn("_file", F.pmod(F.xxhash64(by), F.lit(files)))
    filed.repartition(max(1, files * len(sizes)), batch, "_file").write.partitionBy(batch).parquet(stored)
    kept = spark.read.schema(filed.schema).parquet(stored)
    # A file that is missing would let the batches run into each other.
    if files > 1 and kept.select(batch, "_file").distinct().count() < files * len(sizes):
        files, kept = 1, kept.withColumn("_file", F.lit(0))
    for number in sorted(sizes):
        rows = kept.where(F.col(batch) == number).drop(batch)
        rows.repartition(files, "_file").write.partitionBy("_file").parquet(f"{path}/batch={number}")
    return path, files


@check(
    "stream_late",
    I.with_inputs("""
    SELECT event_id, late, round(avg(mean_conductivity) FILTER (NOT late) OVER g, 6) AS avg_conductivity,
      CASE WHEN bool_or(NOT late) OVER g THEN (w + 1) * 1200000 END AS window_end_ms
    FROM judged WINDOW g AS (PARTITION BY mac_address_string, w)""", HELD_SQL),
)
def stream_late(spark, sf):
    """Rows behind the watermark are kept and marked, and no figure counts them."""
    held = I.beacons(spark, sf).withColumn("batch", F.expr("(kafka_logappend_ms + if(k % 20 = 0, 7200000, 0)) div 1800000"))
    path, files = write_batches(held, "batch", by="event_id")
    rows = spark.readStream.schema(held.drop("batch").schema).option("maxFilesPerTrigger", files)
    stream = rows.option("recursiveFileLookup", "true").parquet(path)
    # Every batch reads the machines: they are made once, in several files.
    machines = checkpointed(I.machines(spark, sf).repartition("mac"))
    out = streaming.run_kappa(stream, machines, raw_time="date_time_raw")
    return rounded(out, "avg_conductivity").select(
        "event_id", "late", "avg_conductivity", fn.epoch_ms(F.col("window_end")).alias("window_end_ms")
    )


@check("stream_fabric", ORACLES["fabric_job"])
def stream_fabric(spark, sf):
    out = streaming.run_fabric(I.beacon_stream(spark, sf), I.machine_versions(spark, sf), raw_time="date_time_raw")
    return out.select(
        "event_id", *S.RULE_FLAGS, "conc_ok", "schema_valid", "date_time_utc", "event_time_utc_ms",
        "kafka_logappend_ms", fn.epoch_ms(F.col("stream_features_ready_at")).alias("ready_ms"),
    )


@check(
    "stream_insert_ignore",
    I.with_inputs("SELECT event_id, CASE WHEN k % 4 = 0 THEN 'there' ELSE 'new' END AS origin FROM beacons"),
)
def stream_insert_ignore(spark, sf):
    """Every event comes twice; the target has a quarter of them already."""
    there = I.beacons(spark, sf).where("k % 4 = 0").select("event_id", F.lit("there").alias("origin"), F.lit(0).alias("copy"))
    b = I.beacon_stream(spark, sf).select("event_id", F.lit("new").alias("origin"))
    twice = b.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return streaming.drain_insert_ignore(twice, "insert", key="event_id", order=["copy"], target=there).drop("copy")


@check("stream_upsert", I.with_inputs(TUMBLING_SQL))
def stream_upsert(spark, sf):
    """Update mode: open windows are written too, later versions replace earlier ones."""
    stats = tumbling_stats(I.beacon_stream(spark, sf), delay="10 minutes")
    return _flat(streaming.drain_upserts(stats, "upsert", key=["window", S.MAC]))
