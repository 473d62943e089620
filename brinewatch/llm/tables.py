"""Reading the given tables and small shared column helpers of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewatch.session import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from: every fifth by checksum of the id."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def arrow_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keep Arrow batches small enough that a few very long texts fit into a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def numbered(df: DataFrame, name: str, *order: Column) -> tuple[DataFrame, int]:
    """``df``, written, with the row's number from 1 in ``order``, and the number of rows.

    ``order`` should tell all rows apart, so that ranges can be cut anywhere.
    """
    spark, place, part, offset = df.sparkSession, *(fresh(df, c) for c in ("place", "part", "offset"))
    placed = checkpointed(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    ).withColumn(part, F.shiftright(place, 33))
    # One number for each range, as many as the shuffle has partitions.
    sizes = sorted((r[part], r["count"]) for r in placed.groupBy(part).count().collect())
    starts, total = [], 0
    for k, count in sizes:
        starts.append((k, total))
        total += count
    offsets = spark.createDataFrame(starts, f"{part} bigint, {offset} bigint")
    inside = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    found = placed.join(F.broadcast(offsets), part).withColumn(name, F.col(offset) + inside + 1)
    return found.drop(place, part, offset), total
