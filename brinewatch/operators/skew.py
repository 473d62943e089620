"""Per-device windows that survive devices holding a large share of all rows.

An ordinary device is one window partition.  A *hot* device (more rows than a chunk should hold)
is cut along its ordering column into chunks, and every chunk receives copies of the few rows
before it (its halo), so each window sees what it needs and results stay exact.

The limit is absolute, so no window partition grows with the data. The list of hot devices is
broadcast as long as it is short and is an ordinary table beyond that.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from brinewatch.session import checkpointed

SLOTS = 1000
#: Longest list of hot devices that is kept on the driver and broadcast.
MAX_LOCAL = 10_000
#: Devices of up to so many rows may be worked on in quadratic time.
CALM_ROWS = 20_000
NULL_KEY_SPREAD = 4096
#: Rows that a partition of ``dealt`` holds on average, at most.
DEALT_ROWS = 250_000


@dataclass(frozen=True)
class HotPolicy:
    """When a device counts as hot, and how many rows one of its chunks should hold.

    ``min_rows`` decides alone unless ``share`` asks for that part of all rows as well; ``salts`` is
    the least number of salts of a hot device in a shuffle join, which has one for each chunk.
    """

    share: float = 0.0
    min_rows: int = 1_000_000
    chunk_rows: int = 1_000_000
    salts: int = 2


DEFAULT_POLICY = HotPolicy()


@dataclass(frozen=True)
class Hot:
    """Hot devices: ``keys`` plus ``_n`` rows, ``_t0`` first order value, ``_width`` of a chunk.

    ``table`` is None if nothing is hot, and local if it is ``short``.
    """

    table: DataFrame | None
    keys: tuple[str, ...]
    order: str
    policy: HotPolicy
    short: bool = True
    #: No device has more than ``CALM_ROWS`` rows.
    calm: bool = False

    def listed(self, *columns: Column | str) -> DataFrame:
        """The hot devices' ``columns``, to be broadcast if they are few."""
        chosen = self.table.select(*columns) if columns else self.table
        return F.broadcast(chosen) if self.short else chosen

    @property
    def empty(self) -> bool:
        return self.table is None

    def tag(self, df: DataFrame, how: str = "left") -> DataFrame:
        """Attach the hot columns; ``left`` keeps all rows, ``inner`` only hot devices' rows."""
        if self.empty:
            tagged = df.withColumns({c: F.lit(None).cast("bigint") for c in ("_n", "_t0", "_width")})
            return tagged if how == "left" else tagged.where(F.lit(False))
        return df.join(self.listed(), list(self.keys), how)


def numeric(df: DataFrame, order: str) -> Column:
    """The leading order column as a long (timestamps in microseconds, reals in milli-units)."""
    kind = df.schema[order].dataType.simpleString()
    if kind == "timestamp":
        return F.unix_micros(F.col(order))
    if kind in ("double", "float") or kind.startswith("decimal"):
        return F.floor(F.col(order) * 1000)
    return F.col(order).cast("bigint")


def hot_devices(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    policy: HotPolicy = DEFAULT_POLICY,
) -> Hot:
    """Find the hot devices of ``df`` with a column-pruned, map-side combined count.

    Runs at once: knowing that nothing is hot keeps the plans of ordinary data plain.
    """
    keys = tuple(keys)
    lean = df.select(*keys, numeric(df, order).alias("_o"))
    counted = lean.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_o").alias("_t0"), F.max("_o").alias("_t1")
    )
    limit = F.lit(float(policy.min_rows))
    if policy.share > 0:
        total = df.select(F.lit(1).alias("_one")).agg(F.count("_one")).scalar()
        limit = F.greatest(limit, F.lit(policy.share) * total)
    found = counted.where(F.col("_n") > limit)
    spark = df.sparkSession
    # Busy devices, hot or not, tell whether all are calm; usually there are none.
    busy = counted.where(F.col("_n") > F.least(limit, F.lit(CALM_ROWS))).withColumn("_hot", F.col("_n") > limit)
    local = busy.limit(MAX_LOCAL + 1).toArrow()
    calm = local.num_rows == 0 or policy.min_rows < CALM_ROWS and max(local.column("_n").to_pylist()) <= CALM_ROWS
    if local.num_rows <= MAX_LOCAL:
        local = local.filter(local.column("_hot")).drop_columns(["_hot"])
    else:
        local = found.limit(MAX_LOCAL + 1).toArrow()
    if local.num_rows == 0:
        return Hot(None, keys, order, policy, calm=calm)
    short = local.num_rows <= MAX_LOCAL
    hot = spark.createDataFrame(local, found.schema) if short else checkpointed(found)
    # Chunk width from the busiest slice of the device's span, so bursts are cut finely too.
    peaks = (
        lean.join(F.broadcast(hot) if short else hot, list(keys))
        .withColumn("_slot_width", F.expr(f"(_t1 - _t0) div {SLOTS} + 1"))
        .groupBy(*keys, "_n", "_t0", "_slot_width", F.expr("(_o - _t0) div _slot_width").alias("_s"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .groupBy(*keys, "_n", "_t0", "_slot_width")
        .agg(F.max("_c").alias("_peak"))
    )
    width = F.floor(F.col("_slot_width") * F.lit(float(policy.chunk_rows)) / F.col("_peak"))
    table = peaks.select(
        *keys, "_n", "_t0",
        F.greatest(F.lit(1).cast("bigint"), width.cast("bigint")).alias("_width"),
    )
    if not short:
        return Hot(checkpointed(table), keys, order, policy, short=False)
    return Hot(spark.createDataFrame(table.toArrow(), table.schema), keys, order, policy, calm=calm)


def dealt(df: DataFrame, keys: Sequence[str], rows: int, most: int = DEALT_ROWS) -> DataFrame:
    """``df`` dealt out by ``keys`` over as many partitions as its ``rows`` ask for, so a task's memory does not grow.

    Spark unites shuffle partitions by their compressed size, which is a small part of what narrow rows take in
    memory; it leaves these as they are. A few rows are left to Spark.
    """
    if rows <= most:
        return df
    parts = max(-(-rows // most), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


def order_columns(order: Sequence[str]) -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in order]


#: A column that windows of several operators share, so that rows are dealt out once (see ``with_lane``).
LANE = "_lane"


def with_lane(df: DataFrame, keys: Sequence[str], hot: Hot) -> DataFrame:
    """Rows for several operators in turn: if no device is hot, all their windows use the same exchange.

    Rows without a device have lanes of their own. Drop ``LANE`` in the end.
    """
    if not hot.empty:
        return df
    every = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    own = F.when(F.col(keys[-1]).isNull(), F.xxhash64(*every)).otherwise(F.lit(0).cast("bigint"))
    return df.withColumn(LANE, own)


@dataclass(frozen=True)
class Chunks:
    """Rows with ``_chunk`` (window partition), ``_halo`` (helper copies) and ``_n`` (hot size)."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def parts(self) -> WindowSpec:
        """What all windows are partitioned by."""
        return Window.partitionBy(*self.keys, LANE if LANE in self.df.columns else "_chunk")

    @property
    def ordered(self) -> WindowSpec:
        return self.parts.orderBy(*order_columns(self.order))

    @property
    def group(self) -> WindowSpec:
        """The whole chunk, in the same order as ``ordered`` so that both share one sort."""
        return self.ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    @property
    def size(self) -> Column:
        """Rows of the whole device."""
        return F.coalesce(F.col("_n"), F.count(F.lit(1)).over(self.group))

    def done(self, df: DataFrame) -> DataFrame:
        """Drop the halo copies and the helper columns."""
        return df.where(~F.col("_halo")).drop("_chunk", "_halo", "_n", "_t0", "_width")


def ordered_chunks(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    rows_back: int,
    hot: Hot | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> Chunks:
    """Partition ``df`` for row-based windows looking at most ``rows_back`` rows back."""
    keys, order = tuple(keys), tuple(order)
    # Which devices are hot does not depend on the order, only their chunk widths do.
    if hot is None or hot.keys != keys or not (hot.empty or hot.order == order[0]):
        hot = hot_devices(df, keys, order[0], policy)
    # Rows without a device take no part in windows: spread them instead of piling them up.
    spread = -1 - F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(NULL_KEY_SPREAD))
    null_key = F.col(keys[-1]).isNull()
    if hot.empty:
        plain = hot.tag(df).withColumns(
            {
                "_chunk": F.when(null_key, spread).otherwise(F.lit(0).cast("bigint")),
                "_halo": F.lit(False),
            }
        )
        return Chunks(plain, keys, order)

    position = F.coalesce(F.expr("(_o - _t0) div _width"), F.lit(2**62).cast("bigint"))

    def chunked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_o", numeric(rows, order[0])).withColumn(
            "_chunk",
            F.when(null_key, spread)
            .when(F.col("_width").isNull(), F.lit(0).cast("bigint"))
            .otherwise(position),
        ).drop("_o")

    every = chunked(hot.tag(df)).withColumn("_halo", F.lit(False))
    if rows_back > 0:
        columns = [c for c in every.columns if c not in ("_chunk", "_halo")]
        newest_first = [F.col(c).desc_nulls_first() for c in order]
        in_chunk = Window.partitionBy(*keys, "_chunk")
        tails = (
            chunked(hot.tag(df, "inner"))
            .withColumn("_r", F.row_number().over(in_chunk.orderBy(*newest_first)))
            .where(F.col("_r") <= rows_back)
            .drop("_r")
        )
        # Only a few rows per chunk are left here, so one device's tails fit one window.
        along = Window.partitionBy(*keys).orderBy(*order_columns(order))
        first_of_chunk = F.row_number().over(in_chunk.orderBy(*order_columns(order)))
        halo = (
            tails.withColumn(
                "_before",
                F.collect_list(F.struct(*columns)).over(along.rowsBetween(-rows_back, -1)),
            )
            .withColumn("_r", first_of_chunk)
            .where(F.col("_r") == 1)
            .select("_chunk", F.explode("_before").alias("_row"))
            .select("_row.*", "_chunk", F.lit(True).alias("_halo"))
        )
        every = every.unionByName(halo)
    return Chunks(every.repartition(*keys, "_chunk"), keys, order)


def salted_join(
    df: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    *,
    hot: Hot,
    salt_on: str,
    how: str = "left",
    valid: Column | None = None,
    large: bool = False,
) -> DataFrame:
    """Shuffle join with a dimension of which at most one row per ``on`` matches (and is ``valid``).

    Hot devices are spread over salts and their dimension rows copied to each; rows without a
    device match nothing and are spread too, instead of meeting in one task. ``large`` dimensions are
    known not to fit: Spark, which goes by the size of files, must not broadcast them.
    """
    lost = F.col(on[0]).isNull()
    # All columns take part, as the column that usually tells rows apart may be missing.
    number = F.xxhash64(salt_on, *[c for c, kind in df.dtypes if c != salt_on and not kind.startswith(("map", "variant"))])
    unmatched = 1 + F.pmod(number, F.lit(NULL_KEY_SPREAD))
    zero = F.lit(0).cast("bigint")
    if hot.empty:
        left = df.withColumn("_salt", F.when(lost, unmatched).otherwise(zero))
        return _joined(left, dim.withColumn("_salt", zero), [*on, "_salt"], how, valid, large)
    parts = F.ceil(F.col("_n") / F.lit(hot.policy.chunk_rows))
    flags = hot.listed(*hot.keys, F.greatest(parts, F.lit(hot.policy.salts)).cast("bigint").alias("_salts"))
    keys = list(hot.keys)
    left = df.join(flags, keys, "left").withColumn(
        "_salt",
        F.when(lost, unmatched)
        .when(F.col("_salts").isNotNull(), F.pmod(number, F.col("_salts")))
        .otherwise(zero),
    )
    right = (
        dim.join(flags, keys, "left")
        .withColumn("_salt", F.explode(F.expr("sequence(0L, coalesce(_salts, 1L) - 1L)")))
        .drop("_salts")
    )
    return _joined(left, right, [*on, "_salt"], how, valid, large).drop("_salts")


def _joined(
    left: DataFrame, right: DataFrame, on: list[str], how: str, valid: Column | None, large: bool
) -> DataFrame:
    if valid is None:
        return left.join(right.hint("merge") if large else right, on, how).drop("_salt")
    apart = right.withColumnsRenamed({c: f"_of_{c}" for c in on})
    apart = apart.hint("merge") if large else apart
    for c in on:
        valid = valid & (F.col(c) == F.col(f"_of_{c}"))
    return left.join(apart, valid, how).drop("_salt", *(f"_of_{c}" for c in on))
