"""Keyed tables that a stream keeps in the shared folder, one change a micro-batch.

``log/batch_id=N`` holds what batch N has changed. Every ``every`` batches the changes since the last
snapshot are merged into it, bucket by bucket: a bucket without changes stays where it is, and a manifest,
written last, names the folder of each bucket. A reader takes the newest complete manifest and the later
changes. A snapshot deletes what neither it nor the one before it needs, so the number of folders does not
grow with the batches, and a reader has the time of ``every`` batches to finish.

Buckets are hashes of the key. When one grows beyond ``bucket_rows`` rows their number doubles, so looking up a
batch's keys reads a bounded part of the table for each of them. Repeating a batch overwrites its own folders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewatch.session import delete_folders, written_folders
from brinewatch.sources.sinks import dedup_last

#: Files of a bucket at most.
FILES = 8


@dataclass(frozen=True)
class Snapshot:
    """The content after batch ``upto``: for each bucket the snapshot that wrote it, and its rows."""

    upto: int
    buckets: int
    version: dict[int, int] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)


class KeyedTable:
    """A table whose rows of equal ``key`` are merged.

    ``merge`` gets rows with their ``batch_id`` and returns one row for each key; without it rows are kept as they
    are, and those without a key are never looked up. ``bucket`` replaces the hash by a number that follows from the
    key, as the time of windows, of which only late ones change.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], *,
        merge: Callable[[DataFrame], DataFrame] | None = None, bucket: Column | None = None,
        every: int = 20, buckets: int = 16, bucket_rows: int = 500_000,
    ):
        self.spark, self.path, self.schema, self.key = spark, path, schema, list(key)
        self.merge, self.bucket, self.every, self.bucket_rows = merge, bucket, every, bucket_rows
        self.start = Snapshot(-(2**62), buckets)
        self.known: dict[int, Snapshot] = {}

    def _numbered(self, schema: T.StructType, *names: str) -> T.StructType:
        return T.StructType([*schema, *(T.StructField(n, T.LongType()) for n in names)])

    def _read(self, part: str, folders: list[str], schema: T.StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.path}/{part}").schema(schema).parquet(*folders)

    def _snapshot(self, upto: int) -> Snapshot:
        """The newest one up to a batch."""
        numbers = [n for n in written_folders(self.spark, f"{self.path}/manifest") if n <= upto]
        if not numbers:
            return self.start
        last = max(numbers)
        if last not in self.known:
            schema = "bucket bigint, version bigint, n bigint, buckets bigint"
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/manifest/upto={last}").collect()
            whole = [r for r in rows if r.version is not None]
            self.known[last] = Snapshot(
                last, rows[0].buckets, {r.bucket: r.version for r in whole}, {r.bucket: r.n for r in whole}
            )
        return self.known[last]

    def _stored(self, snapshot: Snapshot, buckets: set[int] | None = None) -> DataFrame:
        """Rows of a snapshot, of some of its buckets or all; ``batch_id`` is its own batch."""
        folders = [
            f"{self.path}/snapshot/upto={version}/bucket={bucket}"
            for bucket, version in snapshot.version.items()
            if buckets is None or bucket in buckets
        ]
        rows = self._read("snapshot", folders, self._numbered(self.schema, "upto", "bucket"))
        return rows.drop("bucket").withColumnRenamed("upto", "batch_id")

    def _changes(self, after: int, upto: int) -> DataFrame:
        logs = written_folders(self.spark, f"{self.path}/log")
        folders = [path for n, path in sorted(logs.items()) if after < n <= upto]
        return self._read("log", folders, self._numbered(self.schema, "batch_id"))

    def _bucket(self, buckets: int) -> Column:
        if self.bucket is not None:
            return self.bucket.cast("bigint")
        hashed = F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("bigint")
        if self.merge is not None:
            return hashed
        # Negative numbers: never looked up, spread by all columns.
        loose = -1 - F.pmod(F.xxhash64(*self.schema.names), F.lit(buckets)).cast("bigint")
        return F.when(F.greatest(*(F.col(k).isNull() for k in self.key), F.lit(False)), loose).otherwise(hashed)

    def _merged(self, rows: DataFrame) -> DataFrame:
        return (rows.drop("batch_id") if self.merge is None else self.merge(rows)).select(*self.schema.names)

    def content(self, upto: int = 2**62) -> DataFrame:
        """The table after batch ``upto``."""
        snapshot = self._snapshot(upto)
        return self._merged(self._stored(snapshot).unionByName(self._changes(snapshot.upto, upto)))

    def lookup(self, keys: DataFrame, before: int) -> DataFrame:
        """Keys the table had before a batch, from those buckets that any of ``keys`` falls into."""
        snapshot = self._snapshot(before - 1)
        there = F.greatest(*(F.col(k).isNull() for k in self.key), F.lit(False))
        wanted = keys.where(~there).select(self._bucket(snapshot.buckets).alias("b")).distinct().collect()
        stored = self._stored(snapshot, {r.b for r in wanted})
        return stored.unionByName(self._changes(snapshot.upto, before - 1)).select(*self.key).where(~there)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch's changes; a repeated batch does no harm."""
        batch.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/log/batch_id={batch_id}")
        if (batch_id + 1) % self.every == 0:
            self.compact(batch_id)

    def compact(self, upto: int) -> None:
        """Make the content after batch ``upto`` a snapshot, and delete what is no longer needed."""
        old = self._snapshot(upto - 1)
        changes = self._changes(old.upto, upto)
        buckets = old.buckets
        if self.bucket is None and any(n > self.bucket_rows for b, n in old.rows.items() if b >= 0):
            buckets *= 2
        if buckets == old.buckets:
            touched = {r.b for r in changes.select(self._bucket(buckets).alias("b")).distinct().collect()}
        else:
            touched = set(old.version)
        rows = self._merged(self._stored(old, touched).unionByName(changes)).withColumn("bucket", self._bucket(buckets))
        folder = f"{self.path}/snapshot/upto={upto}"
        spread = F.pmod(F.xxhash64(*self.schema.names), F.lit(FILES))
        rows.repartition("bucket", spread).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        # One row for each bucket comes back.
        sizes = self.spark.read.schema(self._numbered(self.schema, "bucket")).parquet(folder).groupBy("bucket").count().collect()
        stay = {b: v for b, v in old.version.items() if b not in touched}
        version = stay | {r.bucket: upto for r in sizes}
        count = {b: old.rows[b] for b in stay} | {r.bucket: r["count"] for r in sizes}
        listed = [(b, v, count[b], buckets) for b, v in version.items()] or [(None, None, None, buckets)]
        manifest = self.spark.createDataFrame(listed, "bucket bigint, version bigint, n bigint, buckets bigint")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/upto={upto}")
        self.known.pop(upto, None)
        self._clean(old, self._snapshot(upto))

    def _clean(self, old: Snapshot, new: Snapshot) -> None:
        needed = {(v, b) for s in (old, new) for b, v in s.version.items()}
        gone = [p for n, p in written_folders(self.spark, f"{self.path}/log").items() if n <= old.upto]
        gone += [p for n, p in written_folders(self.spark, f"{self.path}/manifest").items() if n < old.upto]
        for version, path in written_folders(self.spark, f"{self.path}/snapshot").items():
            inside = written_folders(self.spark, path, complete=False)
            gone += [p for bucket, p in inside.items() if (version, bucket) not in needed]
            if all((version, bucket) not in needed for bucket in inside):
                gone.append(path)
        delete_folders(self.spark, gone)


class UpsertLog(KeyedTable):
    """A keyed table of which a later batch's row replaces the earlier one."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], every: int = 20, **options):
        def last(rows: DataFrame) -> DataFrame:
            return dedup_last(rows, key=key, order=["batch_id"])

        super().__init__(spark, path, schema, key, merge=last, every=every, **options)
