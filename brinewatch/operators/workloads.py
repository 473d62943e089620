"""Workload transforms: replicated devices, shifted times and out-of-range sensor values.

All choices follow from a digest of the event id and a seed, so they are repeatable and need no
coordination between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewatch import schema as S

BAD_VALUES = (-1.0, 256.0, 300.0)
FUTURE_S = 3600
LATE_S = (10, 60)


def draw(seed: str, part: int, event_id: Column | None = None) -> Column:
    """A whole number in 0..65535 from the ``part``-th four hex digits of the id's digest."""
    event_id = event_id if event_id is not None else F.col(S.EVENT_ID)
    digest = F.md5(F.concat(event_id, F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1 + 4 * part, 4), 16, 10).cast("int")


def replicate_devices(df: DataFrame, copies: int) -> DataFrame:
    """Each event ``copies`` times; copy 0 as it is, the others on devices and ids of their own."""
    original = F.col("_copy") == 0
    copy_id = F.md5(F.concat(F.col(S.EVENT_ID), F.lit("|"), F.col("_copy").cast("string")))
    return (
        df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .withColumns(
            {
                S.MAC: F.when(original, F.col(S.MAC)).otherwise(
                    F.format_string("%s_R%04d", F.coalesce(S.MAC, F.lit("UNK")), F.col("_copy"))
                ),
                S.EVENT_ID: F.when(original, F.col(S.EVENT_ID)).otherwise(copy_id),
            }
        )
        .drop("_copy")
    )


def _chosen(fraction: float, seed: str) -> Column:
    return draw(seed, 0) < int(fraction * 65536)


def inject_time_faults(df: DataFrame, fraction: float, seed: str = "time", *, time: str = S.TIME) -> DataFrame:
    """Shift the time of a share of events: half a little late, half an hour ahead."""
    late = F.pmod(draw(seed, 1), F.lit(2)) == 0
    delay = F.lit(LATE_S[0]) + F.pmod(draw(seed, 2), F.lit(LATE_S[1] - LATE_S[0] + 1))
    fault = F.when(_chosen(fraction, seed), F.when(late, F.lit("late")).otherwise(F.lit("future")))
    shift = F.when(F.col("_fault") == "late", -delay).when(F.col("_fault") == "future", F.lit(FUTURE_S))
    return df.withColumn("_fault", fault).withColumn(
        time, F.col(time) + F.coalesce(shift, F.lit(0)).cast("bigint")
    )


def inject_range_violations(df: DataFrame, fraction: float, seed: str = "range") -> DataFrame:
    """Put one sensor of a share of events out of range."""
    sensor = F.pmod(draw(seed, 1), F.lit(3))
    names = ("wash_temp", "rinse_temp", "conductivity")
    violation = F.when(
        _chosen(fraction, seed),
        F.element_at(F.array(*[F.lit(n) for n in names]), sensor + 1),
    )
    bad = F.element_at(F.array(*[F.lit(b) for b in BAD_VALUES]), F.pmod(draw(seed, 2), F.lit(3)) + 1)
    tagged = df.withColumn("_schema_violation", violation)
    return tagged.withColumns(
        {
            column: F.when(F.col("_schema_violation") == name, bad).otherwise(F.col(column))
            for name, column in zip(names, S.SENSORS)
        }
    )


def injection_counts(df: DataFrame, tag: str) -> DataFrame:
    """Injected events per kind."""
    return df.where(F.col(tag).isNotNull()).groupBy(F.col(tag).alias("kind")).agg(
        F.count(F.lit(1)).alias("events")
    )


def publish(df: DataFrame) -> DataFrame:
    """Events as sent: without the internal tags."""
    return df.drop("_fault", "_schema_violation")
