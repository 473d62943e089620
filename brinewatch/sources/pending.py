"""Rows still waiting for a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewatch import schema as S


def pending(
    df: DataFrame, *, done: str = "flags_computed_at", limit: int | None = None,
    order: tuple[str, ...] = S.BY_TIME,
) -> DataFrame:
    """Rows whose ``done`` time is missing; with ``limit`` the earliest ones (a top-k)."""
    rows = df.where(F.col(done).isNull()) if done in df.columns else df
    return rows.orderBy(*order).limit(limit) if limit is not None else rows


def progress(df: DataFrame, *, done: str = "flags_computed_at") -> DataFrame:
    """One row: pending and total counts."""
    waiting = F.col(done).isNull() if done in df.columns else F.lit(True)
    return df.agg(
        F.count_if(waiting).alias("pending_rows"), F.count(F.lit(1)).alias("total_rows")
    )
