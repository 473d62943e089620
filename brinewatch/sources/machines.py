"""The machine list: CSV and JDBC readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewatch import schema as S


def _text(name: str) -> Column:
    return F.col(f"`{name}`")


def read_machines(spark: SparkSession, path: str, *, position: str | None = None) -> DataFrame:
    """Semicolon-separated list with header; rows without MAC are skipped, empty is NULL.

    ``position`` names a column that grows along the file, by which an upsert lets later rows win.
    """
    raw = spark.read.option("sep", ";").option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.removeprefix("﻿") for c in raw.columns])
    mac = F.trim(_text("MACAdress String"))
    columns = []
    for header, (name, kind) in S.MACHINE_FIELDS.items():
        source = mac if name == "mac" else _text(header)
        empty = F.trim(source) == ""
        value = F.when(empty & (kind != "string"), None).otherwise(source) if kind != "string" else source
        columns.append((value.try_cast(kind) if kind != "string" else value).alias(name))
    if position:
        raw = raw.withColumn("_line", F.monotonically_increasing_id())
        columns.append(F.col("_line").alias(position))
    return raw.where(mac.isNotNull() & (mac != "")).select(*columns)


def read_machines_jdbc(spark: SparkSession, url: str, table: str = "machines", **options: str) -> DataFrame:
    """The list from a database (needs its JDBC driver on the class path)."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()
