"""Run extracts: aligned schema, discovery on disk, and merging with a manifest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewatch import schema as S
from brinewatch.functions import event_s_whole

RUN_KEYS = ("architecture", "workload", "repeat")


def align_schema(df: DataFrame, types: Mapping[str, str] = S.EXTRACT_TYPES) -> DataFrame:
    """Exactly the columns of ``types``: present ones cast, absent ones NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
            for name, kind in types.items()
        ]
    )


def extract_run(
    df: DataFrame, architecture: str, run_id: str = "", *, mac: str = S.MAC
) -> DataFrame:
    """A run's extract: aligned columns, event time in whole seconds, labelled with its run."""
    rows = df.withColumnRenamed(mac, S.MAC) if mac != S.MAC else df
    return align_schema(
        rows.withColumn(S.TIME, event_s_whole(F.col("event_time_utc_ms")))
    ).withColumns({"run_id": F.lit(run_id), "architecture": F.lit(architecture)})


def write_run_csv(df: DataFrame, path: str, *, ordered: bool = True) -> None:
    """CSV with header.  ``ordered`` sorts by event time across files (a range shuffle)."""
    (df.orderBy(S.TIME) if ordered else df).write.option("header", True).csv(path)


def discover_runs(spark: SparkSession, root: str) -> DataFrame:
    """Run files below ``root``: ``<arch>/workload_X/run_N/raw_data.csv`` or key=value folders.

    Only the listing is read, not the files.  Folders that do not name a run are skipped.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(root)
        .select(F.col("path").alias("csv_path"))
    )
    path = F.col("csv_path")
    named = r"/([^/]+)/workload_([^/]*)/run_([^/]*)/(?:[^/]+/)*(?:raw_data\.csv|raw_data\.csv/part-[^/]*)$"
    keyed = r"/architecture=([^/]+)/workload=([^/]*)/repeat=([^/]*)/[^/]+\.csv$"

    def part(i: int):
        hit = F.regexp_extract(path, named, i)
        return F.when(hit != "", hit).otherwise(F.regexp_extract(path, keyed, i))

    return (
        files.select(
            part(1).alias("architecture"), part(2).alias("workload"),
            part(3).try_cast("int").alias("repeat"), "csv_path",
        )
        .where((F.col("architecture") != "") & F.col("repeat").isNotNull())
    )


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """All run extracts below ``root`` in key=value folders, with an explicit schema."""
    types = {**S.EXTRACT_TYPES, "run_id": "string"}
    ddl = ", ".join(f"{n} {k}" for n, k in {**types, "architecture": "string", "workload": "string", "repeat": "int"}.items())
    return spark.read.option("header", True).schema(ddl).csv(root)


def merge_manifest(discovered: DataFrame, manifest: DataFrame) -> DataFrame:
    """Runs found on disk united with listed ones; found values win, listed paths win if given.

    Both sides have at most one row per run.
    """
    keys = list(RUN_KEYS)
    d, m = discovered.alias("d"), manifest.alias("m")
    same = [F.col(f"d.{k}") == F.col(f"m.{k}") for k in keys]
    columns = []
    for name in dict.fromkeys([*discovered.columns, *manifest.columns]):
        sides = [
            F.col(f"{alias}.{name}")
            for alias, side in (("d", discovered), ("m", manifest))
            if name in side.columns
        ]
        if name == "csv_path" and len(sides) == 2:
            sides = [F.when(sides[1] != "", sides[1]), sides[0]]
        columns.append(F.coalesce(*sides).alias(name))
    return d.join(m, same, "full").select(*columns)


#: Fields of the two reports that a run may leave beside its extract.
HARDWARE_FIELDS = "hardware_metrics map<string,map<string,double>>"
PRODUCER_FIELDS = (
    "mode string, rate_limit double, replication_factor bigint, wall_clock_seconds double, actual_msg_per_sec double"
)


def read_run_reports(spark: SparkSession, paths: str, fields: str) -> DataFrame:
    """JSON reports, one per run, with the run's keys from their folders.

    ``paths`` is a pattern of files or folders, ``.../architecture/workload_X/run_N/...`` or with key=value
    folders. A report is read as a whole, as it may span lines; one that cannot be parsed has NULL fields.
    """
    options = {"multiLine": True, "recursiveFileLookup": True}
    rows = spark.read.options(**options).schema(fields).json(paths)
    path = F.col("_metadata.file_path")
    layouts = (r"([^/]+)/workload_([^/]+)/run_([0-9]+)/", r"architecture=([^/]+)/workload=([^/]+)/repeat=([0-9]+)/")
    parts = [
        F.coalesce(*(F.when(path.rlike(x), F.regexp_extract(path, x, i)) for x in layouts)) for i in (1, 2, 3)
    ]
    return rows.select(
        parts[0].alias("architecture"), parts[1].alias("workload"), parts[2].cast("int").alias("repeat"), *rows.columns
    )


def join_run_reports(runs: DataFrame, hardware: DataFrame, producers: DataFrame) -> DataFrame:
    """Runs with what their reports say; a run without reports stays, of several reports one counts.

    A run has one row on each side, so all sides are small.
    """
    keys = list(RUN_KEYS)
    for side in (hardware, producers):
        rest = [c for c in side.columns if c not in keys]
        one = side.groupBy(*keys).agg(*(F.any_value(c, True).alias(c) for c in rest))
        runs = runs.join(one, keys, "left")
    return runs


def manifest_defaults(manifest: DataFrame) -> DataFrame:
    """Listed runs without workload or repeat count as workload A, repeat 0."""
    return manifest.withColumns(
        {
            "workload": F.coalesce("workload", F.lit("A")),
            "repeat": F.coalesce(F.col("repeat").cast("int"), F.lit(0)),
        }
    )
