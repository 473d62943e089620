"""Joins with the machine dimension: current and as-of setpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewatch import schema as S
from brinewatch.operators.skew import DEFAULT_POLICY, Hot, HotPolicy, hot_devices, salted_join
from brinewatch.session import MAX_BROADCAST_ROWS, checked_broadcast

SETPOINTS = ("wash_temp_setpoint", "rinse_temp_setpoint")


def first_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key (ties resolved by the whole row, so the choice is repeatable)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*")


def join_setpoints(
    df: DataFrame,
    machines: DataFrame,
    *,
    columns: Sequence[str] = SETPOINTS,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    hot: Hot | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Left join on MAC.  The dimension is counted first: broadcast if small, else salted shuffle."""
    picked = machines.select(F.col("mac").alias(S.MAC), *columns)
    _, fits = checked_broadcast(picked, max_broadcast_rows)
    dim = first_per_key(picked, S.MAC)
    if fits:
        return df.join(F.broadcast(dim), S.MAC, "left")
    hot = hot or hot_devices(df, S.DEVICE, S.TIME, policy)
    return salted_join(df, dim, [S.MAC], hot=hot, salt_on=S.EVENT_ID, large=True)


def stream_setpoints(
    events: DataFrame, machines: DataFrame, *, columns: Sequence[str] = SETPOINTS,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS, salts: int = 16,
) -> DataFrame:
    """Stream-static form of ``join_setpoints``.

    A stream cannot be searched for hot devices first, so beyond the broadcast limit every
    device is spread over ``salts`` copies of its dimension row. The hint keeps Spark from
    broadcasting these after all: it goes by the size of the files, before rows are exploded and copied.
    """
    picked = machines.select(F.col("mac").alias(S.MAC), *columns)
    _, fits = checked_broadcast(picked, max_broadcast_rows)
    dim = first_per_key(picked, S.MAC)
    if fits:
        return events.join(F.broadcast(dim), S.MAC, "left")
    copies = dim.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    spread = events.withColumn("_salt", F.pmod(F.xxhash64(*events.columns), F.lit(salts)))
    return spread.join(copies.hint("merge"), [S.MAC, "_salt"], "left").drop("_salt")


def stream_asof_setpoints(
    events: DataFrame, versions: DataFrame, *, time: str = S.TIME, columns: Sequence[str] = SETPOINTS,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS, salts: int = 16,
) -> DataFrame:
    """Stream-static form of ``asof_setpoints``; beyond the broadcast limit every device is salted."""
    starts, valid = _intervals(versions, time, "valid_from", columns)
    _, fits = checked_broadcast(versions.select("mac", *columns), max_broadcast_rows)
    ranged = starts.withColumnRenamed(S.MAC, "_mac")
    same = (F.col(S.MAC) == F.col("_mac")) & valid
    if fits:
        return events.join(F.broadcast(ranged), same, "left").drop("_mac", "_from", "_to")
    copies = ranged.withColumn("_copy", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    spread = events.withColumn("_salt", F.pmod(F.xxhash64(*events.columns), F.lit(salts)))
    joined = spread.join(copies.hint("merge"), same & (F.col("_salt") == F.col("_copy")), "left")
    return joined.drop("_mac", "_from", "_to", "_salt", "_copy")


def _intervals(versions: DataFrame, time: str, valid_from: str, columns: Sequence[str]) -> tuple[DataFrame, Column]:
    """One row per device and start with the closed-open interval it is valid in, and the test for it."""
    along = Window.partitionBy(S.MAC).orderBy(valid_from)
    starts = (
        versions.select(F.col("mac").alias(S.MAC), valid_from, *columns)
        .groupBy(S.MAC, valid_from)
        .agg(F.max(F.struct(*columns)).alias("_v"))
        .select(S.MAC, F.col(valid_from).alias("_from"), F.lead(valid_from).over(along).alias("_to"), "_v.*")
    )
    return starts, (F.col(time) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(time) < F.col("_to")))


def asof_setpoints(
    df: DataFrame,
    versions: DataFrame,
    *,
    time: str = S.TIME,
    valid_from: str = "valid_from",
    columns: Sequence[str] = SETPOINTS,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    hot: Hot | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Setpoints valid at each event: the newest version with ``valid_from <= time``.

    Versions become closed-open validity intervals.  A dimension that fits is broadcast and the
    interval is a join condition; otherwise events are shuffled with hot devices salted.
    """
    starts, valid = _intervals(versions, time, valid_from, columns)
    _, fits = checked_broadcast(versions.select("mac", *columns), max_broadcast_rows)
    if fits:
        ranged = F.broadcast(starts.withColumnRenamed(S.MAC, "_mac"))
        return df.join(ranged, (F.col(S.MAC) == F.col("_mac")) & valid, "left").drop("_mac", "_from", "_to")
    hot = hot or hot_devices(df, S.DEVICE, S.TIME, policy)
    joined = salted_join(df, starts, [S.MAC], hot=hot, salt_on=S.EVENT_ID, valid=valid, large=True)
    return joined.drop("_from", "_to")
