"""Exact distribution figures (moments and quantiles) of very large groups.

Values are first counted (map-side combined, spread by value) and the counts summed into logarithmic buckets.
Each wanted rank lies in one bucket. A bucket of many values is cut into equal ranges, of which the one with the
rank is cut again, until few values are left; only these are put in order. No task ever sees a whole group or
bucket, and the results are exact.

Moments are counts, means and squared deviations of values that are equally frequent within a bucket, which
Spark merges without loss of digits; they are then put together around the group's mean.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewatch.functions import steady_round
from brinewatch.session import checked_broadcast, checkpointed

#: Buckets per factor e.  A bucket holds values that differ by at most one part in this.
BUCKETS_PER_E = 256
#: Values of a range that are put in order in one task at most, and the parts a larger range is cut into.
MOST_VALUES, PARTS = 100_000, 1024
#: More than the logarithm of the smallest double times the above, to keep bucket numbers positive.
BUCKET_SHIFT = 200_000


def _bucket(value: Column) -> Column:
    """A bucket number that never decreases as the value grows."""
    infinite = F.abs(value) == float("inf")
    size = F.floor(F.ln(F.when(~infinite, F.abs(value))) * BUCKETS_PER_E) + BUCKET_SHIFT
    # Infinite values have buckets of their own, outside all others.
    size = F.when(infinite, F.lit(4 * BUCKET_SHIFT)).otherwise(size)
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * size).cast("bigint")


def distribution(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    *,
    linear: Mapping[str, float] | None = None,
    nearest: Mapping[str, float] | None = None,
    weight: str | None = None,
    materialize: bool = False,
    most_values: int = MOST_VALUES,
) -> DataFrame:
    """One row per group: ``n, mean, std, min, max`` and the quantiles asked for.

    ``linear`` quantiles interpolate between neighbours; ``nearest`` ones are the value at
    position ``floor(n * q)``, counted from 0.  ``weight`` gives a row count per input row.
    ``std`` is the sample deviation, 0 for a single value.  NULL and NaN values are left out.
    Infinite values count: they are bounds and quantiles as they come, the mean is infinite (NaN with
    both signs), and the deviation of several values is NaN.
    Value counts are written to the shared folder if quantiles or ``materialize`` ask for it.
    """
    linear, nearest = dict(linear or {}), dict(nearest or {})
    by = list(by)
    keys = by or ["_all"]
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    c = F.col(weight) if weight else F.lit(1)
    rows = df if by else df.withColumn("_all", F.lit(0))
    counts = (
        rows.select(*keys, v.alias("_v"), c.cast("bigint").alias("_c"))
        .where(F.col("_v").isNotNull() & (F.col("_c") > 0))
        .groupBy(*keys, "_v")
        .agg(F.sum("_c").alias("_c"))
        .withColumn("_b", _bucket(F.col("_v")))
    )
    # Quantiles read the counts several times, so they are written then.
    if materialize or linear or nearest:
        counts = checkpointed(counts)
    parts = counts.withColumn("_z", _near(F.col("_v"))).groupBy(*keys, "_b", "_z", "_c").agg(
        F.count(F.lit(1)).alias("_d"), F.avg(F.col("_v") - F.col("_z")).alias("_m"),
        F.var_pop(F.col("_v") - F.col("_z")).alias("_var"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
    )
    moments = _moments(parts, keys)
    if not linear and not nearest:
        return moments if by else moments.drop("_all")

    ranks: dict[str, Column] = {}
    for name, q in linear.items():
        at = F.floor((F.col("_n") - 1) * F.lit(q))
        ranks[f"{name}_lo"] = at
        ranks[f"{name}_hi"] = F.least(at + 1, F.col("_n") - 1)
    for name, q in nearest.items():
        ranks[f"{name}_at"] = F.floor(F.col("_n") * F.lit(q))
    found = _values_at(counts, parts, keys, ranks, most_values)
    picked = found.groupBy(*keys).agg(
        F.max("_n").alias("_n"), *(F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks)
    )
    quantiles = []
    for name, q in linear.items():
        at = (F.col("_n") - 1) * F.lit(q)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        between = lo + (hi - lo) * (at - F.floor(at))
        quantiles.append(F.when(lo == hi, lo).otherwise(between).alias(name))
    quantiles += [F.col(f"{name}_at").alias(name) for name in nearest]
    out = moments.join(picked.select(*keys, *quantiles), keys)
    return out if by else out.drop("_all")


def _near(value: Column) -> Column:
    """A number of at most eleven binary digits below the value: the difference is exact, and a thousandth of it."""
    size = F.abs(value)
    unit = F.pow(F.lit(2.0), F.floor(F.log2(size)) - 10)
    plain = (size > 1e-290) & (size < float("inf"))
    return F.when(plain, F.floor(F.when(plain, value) / unit) * unit).otherwise(F.lit(0.0))


def _moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``n, mean, std, min, max`` from counts, means and variances of equally frequent values.

    Means are relative to numbers near them (``_z``), and these to the group's least.
    """
    size = F.col("_c") * F.col("_d")
    group = Window.partitionBy(*keys)
    off = F.col("_z") - F.col("_z0") + F.col("_m")
    # The sum of a group with infinite values is infinite, or NaN with both signs.
    about = parts.withColumn("_z0", F.min("_z").over(group))
    about = about.withColumn("_mean", F.sum(size * off).over(group) / F.sum(size).over(group))
    infinite = F.abs(F.col("_m")) == float("inf")
    spread = F.when(infinite, F.lit(float("nan"))).otherwise(
        size * (F.col("_var") + (off - F.col("_mean")) * (off - F.col("_mean")))
    )
    moments = about.groupBy(*keys).agg(
        F.sum(size).alias("n"), F.max(F.col("_z0") + F.col("_mean")).alias("mean"), F.sum(spread).alias("_ss"),
        F.min("_lo").alias("min"), F.max("_hi").alias("max"),
    )
    deviation = F.when(F.col("n") > 1, F.sqrt(F.col("_ss") / (F.col("n") - 1))).otherwise(F.lit(0.0))
    return moments.select(*keys, "n", "mean", "min", "max", deviation.alias("std"))


def _inside(rank: str = "_rank") -> Column:
    return (F.col(rank) >= F.col("_before")) & (F.col(rank) < F.col("_before") + F.col("_size"))


def _values_at(
    counts: DataFrame, parts: DataFrame, keys: list[str], ranks: Mapping[str, Column], most_values: int
) -> DataFrame:
    """``keys, _n, _name, _v``: the value at each rank, counted from 0."""
    along = Window.partitionBy(*keys).orderBy("_b")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("_c") * F.col("_d")
    buckets = parts.groupBy(*keys, "_b").agg(
        F.sum(size).alias("_size"), F.sum("_d").alias("_d"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")
    )
    buckets = buckets.withColumns(
        {
            "_before": F.sum("_size").over(upto) - F.col("_size"),
            "_n": F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    wanted = F.explode(
        F.array(*(F.struct(F.lit(name).alias("_name"), rank.cast("bigint").alias("_rank")) for name, rank in ranks.items()))
    )
    ranges = buckets.select("*", wanted.alias("_r")).select("*", "_r._name", "_r._rank").where(_inside()).drop("_r")
    ranges = checkpointed(ranges.select(*keys, "_b", "_n", "_name", "_rank", "_before", "_lo", "_hi", "_d"))
    few = ranges.where(F.col("_d") <= most_values)
    crowded = ranges.where(F.col("_d") > most_values)
    while not crowded.isEmpty():
        crowded = checkpointed(_refined(counts, crowded, keys))
        few = few.unionByName(crowded.where(F.col("_d") <= most_values))
        crowded = crowded.where(F.col("_d") > most_values)
    return _picked(counts, few, keys)


def _within(counts: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The values of each range, which lies in one bucket of its group."""
    places = [*keys, "_b"]
    named, _ = checked_broadcast(ranges.withColumnsRenamed({k: f"_of{i}" for i, k in enumerate(places)}))
    same = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    for i, k in enumerate(places):
        same = same & F.col(k).eqNullSafe(F.col(f"_of{i}"))
    return counts.join(named, same).drop(*(f"_of{i}" for i in range(len(places))))


def _refined(counts: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Of each range, cut into equal parts, the part that holds the rank, with the bounds of its values."""
    # Rounding keeps the order, and both ends are in parts of their own: every step leaves something out.
    share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    part = F.least(F.floor(share * PARTS), F.lit(PARTS - 1))
    group = [*keys, "_name"]
    sizes = (
        _within(counts, ranges, keys)
        .groupBy(*group, "_b", "_n", "_rank", F.col("_before").alias("_base"), part.alias("_part"))
        .agg(F.sum("_c").alias("_size"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    upto = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.withColumn("_before", F.col("_base") + F.sum("_size").over(upto) - F.col("_size"))
    return placed.where(_inside()).select(*keys, "_b", "_n", "_name", "_rank", "_before", "_lo", "_hi", "_d")


def _picked(counts: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    upto = Window.partitionBy(*keys, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = _within(counts, ranges, keys).withColumn("_size", F.col("_c"))
    placed = values.withColumn("_before", F.col("_before") + F.sum("_c").over(upto) - F.col("_c"))
    return placed.where(_inside()).select(*keys, "_n", "_name", "_v")


def metric_summary(
    df: DataFrame, value: str, by: Sequence[str], *, weight: str | None = None,
    materialize: bool = False,
) -> DataFrame:
    """Mean, sample deviation, p95 and p99 of each group, rounded to six places."""
    d = distribution(df, value, by, linear={"p95": 0.95, "p99": 0.99}, weight=weight, materialize=materialize)
    return d.select(
        *by, F.col("n"), *[steady_round(F.col(c), 6).alias(c) for c in ("mean", "std", "p95", "p99")]
    )


def latency_stats(df: DataFrame, value: str, by: Sequence[str] = (), *, most_values: int = MOST_VALUES) -> DataFrame:
    """Count, average, bounds and nearest-rank p50, p95, p99."""
    d = distribution(df, value, by, nearest={"p50": 0.5, "p95": 0.95, "p99": 0.99}, most_values=most_values)
    return d.select(
        *by, F.col("n").alias("count"), F.col("mean").alias("avg"), "min", "max", "p50", "p95", "p99"
    )


def hw_sample_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean, p95, p99 and maximum of hardware samples, rounded to two places."""
    d = distribution(df, value, by, linear={"p95": 0.95, "p99": 0.99})
    return d.select(*by, *[steady_round(F.col(c), 2).alias(c) for c in ("mean", "p95", "p99", "max")])
