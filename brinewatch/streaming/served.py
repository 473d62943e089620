"""Rows of a stream with the figures of their own windows, from one query.

Each micro-batch is written once, with its rows' flags. How far time had come before the batch is known from
the batches before it; a row whose window ended ``delay`` before that is ``late``: it is kept, and counted in
no figure. All other rows of the same written batch are added to their windows, whose partial figures are a
keyed table. So rows and figures never disagree, and a repeated batch repeats both decisions.

``enrich`` is applied to each batch as a table of its own. So a dimension may change while the stream runs: it is
read again, and its size checked again, for every batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from brinewatch import schema as S
from brinewatch.operators.skew import hot_devices, salted_join
from brinewatch.operators.tumbling import decimals, exact_mean
from brinewatch.session import delete_folders, written_folders
from brinewatch.streaming.keyed import KeyedTable

Table = DataFrame | Callable[[], DataFrame]

_WINDOW = "_start bigint, mac_address_string string, "
_FIGURES = {"_exact": F.try_sum, "_known": F.sum, "_sum": F.sum, "_count": F.sum, "_wash_lo": F.min, "_wash_hi": F.max, "_wash_n": F.sum,
            "_rinse_lo": F.min, "_rinse_hi": F.max, "_rinse_n": F.sum, "_n": F.sum}
_KINDS = {"_exact": "decimal(38,18)", **dict.fromkeys(("_known", "_count", "_wash_n", "_rinse_n", "_n"), "bigint")}
_TYPES = ", ".join(f"{n} {_KINDS.get(n, 'double')}" for n in _FIGURES)


def current(table: Table) -> DataFrame:
    """A table that is given as such, or by a function that reads it as it is now."""
    return table() if callable(table) else table


def _partials() -> list[Column]:
    wash, rinse, conc = (F.col(c).cast("double") for c in ("mean_wash_tank_temp", "mean_rinse_temp", "mean_conductivity"))
    return [
        F.try_sum(decimals(conc)).alias("_exact"), F.count(decimals(conc)).alias("_known"),
        F.sum(conc).alias("_sum"), F.count(conc).alias("_count"),
        F.min(wash).alias("_wash_lo"), F.max(wash).alias("_wash_hi"), F.count(wash).alias("_wash_n"),
        F.min(rinse).alias("_rinse_lo"), F.max(rinse).alias("_rinse_hi"), F.count(rinse).alias("_rinse_n"),
        F.count(F.lit(1)).alias("_n"),
    ]


def _united(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_start", S.MAC).agg(*(how(name).alias(name) for name, how in _FIGURES.items()))


class ServedStream:
    """Writes the micro-batches of a stream below ``path``; ``table`` may be read at any time.

    ``ts`` is the time of windows of ``minutes``; ``counted`` restricts the rows that windows cover, ``shown`` those
    that ``table`` returns.
    """

    def __init__(
        self, stream: DataFrame, path: str, enrich: Callable[[DataFrame], DataFrame], *, ts: str, delay: str,
        minutes: int = S.WINDOW_MINUTES, counted: Column | None = None, shown: Column | None = None, every: int = 20,
    ):
        self.stream, self.path, self.enrich, self.ts, self.delay = stream, path, enrich, ts, delay
        self.minutes, self.counted, self.shown = minutes, counted, shown
        self.spark: SparkSession = stream.sparkSession
        extra = [T.StructField("late", T.BooleanType()), T.StructField("_start", T.LongType())]
        self.schema = T.StructType([*enrich(self.spark.createDataFrame([], stream.schema)).schema, *extra])
        day = F.floor(F.col("_start") / F.lit(86_400_000_000))
        # Only the days of recent windows change, so only their folders are written again.
        self.windows = KeyedTable(
            self.spark, f"{path}/windows", T.StructType.fromDDL(_WINDOW + _TYPES), ["_start", S.MAC],
            merge=_united, bucket=F.coalesce(day, F.lit(-1)), every=every,
        )

    def _mark(self, batch_id: int) -> int | None:
        """The greatest time, in microseconds, before a batch."""
        before = [n for n in written_folders(self.spark, f"{self.path}/marks") if n < batch_id]
        if not before:
            return None
        return self.spark.read.schema("most bigint").parquet(f"{self.path}/marks/batch_id={max(before)}").first()[0]

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Add a micro-batch; a repeated one overwrites what it wrote."""
        most, span = self._mark(batch_id), F.lit(self.minutes * 60_000_000)
        at = F.unix_micros(F.col(self.ts))
        rows = self.enrich(batch).withColumn("_start", at - F.pmod(at, span))
        closed = F.timestamp_micros(F.lit(most)) - F.expr(f"interval {self.delay}")
        late = F.lit(False) if most is None else F.coalesce(F.timestamp_micros(F.col("_start") + span) <= closed, F.lit(False))
        folder = f"{self.path}/rows/batch_id={batch_id}"
        rows.withColumn("late", late).select(*self.schema.names).write.mode("overwrite").parquet(folder)
        # The written rows, not the batch: the source is read once.
        written = self.spark.read.schema(self.schema).parquet(folder)
        counted = written.where(~F.col("late") & F.col("_start").isNotNull() & F.col(S.MAC).isNotNull())
        counted = counted.where(self.counted) if self.counted is not None else counted
        self.windows.write(counted.groupBy("_start", S.MAC).agg(*_partials()), batch_id)
        newest = written.agg(F.greatest(F.max(F.unix_micros(F.col(self.ts))), F.lit(most).cast("bigint")).alias("most"))
        newest.write.mode("overwrite").parquet(f"{self.path}/marks/batch_id={batch_id}")
        old = written_folders(self.spark, f"{self.path}/marks").items()
        delete_folders(self.spark, [p for n, p in old if n < batch_id - 2])

    def start(self, **trigger) -> StreamingQuery:
        """Run until stopped, or as ``trigger`` says (as ``processingTime="500 milliseconds"``)."""
        writer = self.stream.writeStream.foreachBatch(self.write).option("checkpointLocation", f"{self.path}/state")
        return (writer.trigger(**trigger) if trigger else writer).start()

    def drain(self) -> DataFrame:
        """Process all that is there, then read the table."""
        self.start(availableNow=True).awaitTermination()
        return self.table()

    def figures(self) -> DataFrame:
        """The windows so far, open ones included."""
        return self.windows.content().select(
            "_start", S.MAC,
            F.timestamp_micros(F.col("_start") + self.minutes * 60_000_000).alias("window_end"),
            exact_mean(*map(F.col, ("_exact", "_known", "_sum", "_count"))).alias("avg_conductivity"),
            F.col("_wash_lo").alias("min_wash_temp"), F.col("_wash_hi").alias("max_wash_temp"),
            F.col("_wash_n").alias("wash_temp_count"), F.col("_rinse_lo").alias("min_rinse_temp"),
            F.col("_rinse_hi").alias("max_rinse_temp"), F.col("_rinse_n").alias("rinse_temp_count"),
            F.col("_n").alias("total_events"),
        )

    def table(self, columns: Sequence[str] = ("avg_conductivity",)) -> DataFrame:
        """Every row with ``late``, ``window_end`` and its window's ``columns`` so far."""
        parts = written_folders(self.spark, f"{self.path}/rows")
        rows = self.spark.createDataFrame([], self.schema)
        if parts:
            rows = self.spark.read.schema(self.schema).parquet(*parts.values())
        rows = rows.where(self.shown) if self.shown is not None else rows
        hot = hot_devices(rows, S.DEVICE, "_start")
        windows = self.figures().select("_start", S.MAC, "window_end", *columns)
        return salted_join(rows, windows, [S.MAC, "_start"], hot=hot, salt_on=S.EVENT_ID).drop("_start")
