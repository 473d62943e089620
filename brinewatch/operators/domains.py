"""Domain data products and their quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewatch import schema as S
from brinewatch.sources.sinks import upsert


def domain(mac: Column) -> Column:
    """Stable domain of a device: its MAC's digest decides; no MAC counts as empty text."""
    digest = F.md5(F.coalesce(mac, F.lit("")))
    slot = F.pmod(F.conv(F.substring(digest, 1, 2), 16, 10).cast("int"), F.lit(len(S.DOMAINS)))
    named = F.when(slot == 0, F.lit(S.DOMAINS[0]))
    for i, name in enumerate(S.DOMAINS[1:], start=1):
        named = named.when(slot == i, F.lit(name))
    return named


def with_domain(df: DataFrame, mac: str = S.MAC) -> DataFrame:
    return df.withColumn("domain", domain(F.col(mac)))


def product(df: DataFrame, name: str) -> DataFrame:
    """One domain's rows; on a table partitioned by domain only that partition is read."""
    return df.where(F.col("domain") == name)


def register_products(df: DataFrame) -> None:
    """Temporary views ``<domain>_product``."""
    for name in S.DOMAINS:
        product(df, name).createOrReplaceTempView(f"{name}_product")


def quality_gates(
    df: DataFrame, *, max_missing: float = 0.05, min_consistency: float = 0.7,
    now: Column | None = None,
) -> DataFrame:
    """Averages per domain and whether they pass; averages of nothing get neutral values."""
    now = now if now is not None else F.current_timestamp()
    gates = df.groupBy("domain").agg(
        F.coalesce(F.avg("missing_rate"), F.lit(0.0)).alias("missing_rate_avg"),
        F.coalesce(F.avg("field_consistency_score"), F.lit(0.5)).alias("field_consistency_avg"),
        F.coalesce(F.avg("flag_flip_rate"), F.lit(0.0)).alias("flag_flip_rate_avg"),
    )
    good = (F.col("missing_rate_avg") < max_missing) & (F.col("field_consistency_avg") > min_consistency)
    return gates.withColumns(
        {
            "status": F.when(good, F.lit("pass")).otherwise(F.lit("warn")),
            "last_gate_run": now,
            "updated_at": now,
        }
    )


def upsert_gates(target: DataFrame, *runs: DataFrame) -> DataFrame:
    """The gate table after further runs: of each domain the newest gate stays, other domains are untouched."""
    for gates in runs:
        target = upsert(gates, target, key=["domain"], order=["last_gate_run"])
    return target


def quality_snapshot(df: DataFrame) -> DataFrame:
    """Averages per domain where each missing figure counts with its neutral value."""
    return df.groupBy("domain").agg(
        F.avg(F.coalesce("missing_rate", F.lit(0.0))).alias("missing_rate_avg"),
        F.avg(F.coalesce("field_consistency_score", F.lit(0.5))).alias("field_consistency_avg"),
        F.count(F.lit(1)).alias("sample_count"),
    )
