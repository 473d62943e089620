"""Keyed sinks as table transforms: insert-or-ignore, upsert and column overwrite.

Each returns the new content of the target; write it to a new table version and swap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, key: Sequence[str], order: Sequence[str], newest: bool) -> DataFrame:
    """One row per key, combined map-side, so many copies of a key never meet in one task."""
    rest = [c for c in df.columns if c not in key]
    position = F.struct(*[F.col(c) for c in order])
    choose = F.max_by if newest else F.min_by
    return df.groupBy(*key).agg(choose(F.struct(*rest), position).alias("_row")).select(*key, "_row.*")


def dedup_first(df: DataFrame, *, key: str = "event_id", order: Sequence[str]) -> DataFrame:
    """First row of each key; rows without a key are all kept."""
    keyed = _pick(df.where(F.col(key).isNotNull()), [key], order, newest=False)
    return keyed.select(*df.columns).unionByName(df.where(F.col(key).isNull()))


def dedup_last(df: DataFrame, *, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each key."""
    return _pick(df, list(key), order, newest=True).select(*df.columns)


def insert_ignore(
    new: DataFrame, target: DataFrame, *, key: str = "event_id", order: Sequence[str]
) -> DataFrame:
    """Target plus the first row of every key it does not have yet."""
    fresh = dedup_first(new, key=key, order=order)
    known = target.select(F.col(key)).where(F.col(key).isNotNull())
    return target.unionByName(fresh.join(known, key, "left_anti").select(*target.columns))


def upsert(
    new: DataFrame, target: DataFrame, *, key: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Target with the keys of ``new`` replaced by their last new row in the declared ``order``.

    ``order`` columns need not be in the target; ``read_machines`` can give each row its ``position``.
    """
    key = list(key)
    latest = dedup_last(new, key=key, order=order)
    kept = target.join(latest.select(*key), key, "left_anti")
    return kept.select(*target.columns).unionByName(latest.select(*target.columns))


def overwrite_columns(
    base: DataFrame, new: DataFrame, *, key: str = "event_id", columns: Sequence[str]
) -> DataFrame:
    """``base`` with ``columns`` taken from the row of ``new`` with the same key, where given."""
    # Rows without a key find nothing; a key of their own keeps them from meeting in one task.
    own = F.concat(F.lit("none|"), F.xxhash64(*base.columns).cast("string"))
    keyed = base.withColumn("_key", F.coalesce(F.col(key).cast("string"), own))
    fresh = new.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns]
    )
    joined = keyed.join(fresh, "_key", "left")
    have = set(base.columns)

    def merged(name: str) -> Column:
        return F.coalesce(f"_new_{name}", name) if name in have else F.col(f"_new_{name}")

    return joined.withColumns({c: merged(c) for c in columns}).drop(
        "_key", *[f"_new_{c}" for c in columns]
    )


def write_summary_json(summary: DataFrame, path: str) -> None:
    """One JSON object per architecture and workload, metrics nested by name."""
    figures = [c for c in summary.columns if c not in ("architecture", "workload", "metric")]
    summary.groupBy("architecture", "workload").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", F.struct(*figures)))).alias("metrics")
    ).write.json(path)
