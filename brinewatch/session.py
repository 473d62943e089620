"""Session settings, the shared scratch folder and size-checked broadcasting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest dimension that is shipped to every executor, in rows and in bytes of its values; larger ones
#: take a shuffle join.
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 128 << 20

_fallback_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def tune(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the jobs are written for; cluster values win when already given."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session without that setting gets a temporary folder of its own.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        app = spark.sparkContext.applicationId
        if app not in _fallback_dirs:
            _fallback_dirs[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        root = _fallback_dirs[app]
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete what this application has written with ``scratch_dir``, once no result is read any more."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    delete_folders(spark, paths)
    return len(paths)


def delete_folders(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written_folders(spark: SparkSession, path: str, *, complete: bool = True) -> dict[int, str]:
    """The folders ``<name>=<number>`` in ``path`` by number; ``complete`` asks for a finished write."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    out = {}
    for status in files.listStatus(root):
        folder = status.getPath()
        _, is_numbered, number = folder.getName().partition("=")
        if is_numbered and (not complete or files.exists(hadoop.Path(folder, "_SUCCESS"))):
            out[int(number)] = folder.toString()
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it: reliable, cuts lineage."""
    spark = df.sparkSession
    path = scratch_dir(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> tuple[DataFrame, bool]:
    """``(df, fits)``: broadcast-hinted when it keeps within ``max_rows`` and ``max_bytes``, else untouched."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    width = sum(texts, F.lit(8 * len(df.columns)))
    rows, size = df.select(width.cast("bigint").alias("w")).limit(max_rows + 1).agg(F.count("w"), F.sum("w")).first()
    fits = rows <= max_rows and (size or 0) <= max_bytes
    return (F.broadcast(df) if fits else df), fits
