"""Time-based rolling aggregates per device over the frame ``(t - w, t]``.

Rows of equal time are peers and get the same result. Devices of few rows use a range window, which
is evaluated anew for each row. Rows of all others are first combined per instant, and time is cut into blocks of
one frame. A frame then is the beginning of its own block and the end of the one before: both are running
aggregates, the second one backwards, so the work is linear in the instants, and a window partition holds two
frames of a device. Sums are only added, never subtracted. Results are joined back by (device, instant).

Variances are put together from counts, means and squared deviations, all relative to the device's
least value and to the mean of the block, so values far from zero lose no digits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewatch import schema as S
from brinewatch.functions import number
from brinewatch.operators.skew import CALM_ROWS, DEFAULT_POLICY, LANE, NULL_KEY_SPREAD, Hot, HotPolicy, hot_devices


@dataclass(frozen=True)
class Rolling:
    """``out`` = ``agg`` (avg, min, max, sum or var_samp) of ``value`` over ``seconds``."""

    out: str
    agg: str
    value: str
    seconds: int


def _direct(spec: Rolling) -> Column:
    return getattr(F, spec.agg)(number(F.col(spec.value)))


def _partials(values: Sequence[str], varied: set[int]) -> list[Column]:
    out = []
    for i, name in enumerate(values):
        v = number(F.col(name))
        out += [
            F.sum(v).alias(f"_s{i}"), F.count(v).alias(f"_c{i}"), F.min(v).alias(f"_lo{i}"), F.max(v).alias(f"_hi{i}"),
        ]
        if i in varied:
            off = v - F.col(f"_z{i}")
            out += [F.avg(off).alias(f"_m{i}"), F.var_pop(off).alias(f"_d{i}")]
    return out


def _both(how, value: Column, own, before, merge) -> Column:
    """An aggregate of the own block's instants so far and of the end of the block before."""
    parts = how(F.when(F.col("_mine"), value)).over(own), how(F.when(~F.col("_mine"), value)).over(before)
    return merge(*parts)


def _added(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def _combined(spec: Rolling, i: int, own, before) -> Column:
    def total(value: Column) -> Column:
        return _both(F.sum, value, own, before, _added)

    count = total(F.col(f"_c{i}"))
    if spec.agg == "avg":
        return F.try_divide(total(F.col(f"_s{i}")), count)
    if spec.agg == "sum":
        return total(F.col(f"_s{i}"))
    if spec.agg == "var_samp":
        off = F.col(f"_m{i}") - F.col(f"_mid{i}")
        once = total(F.col(f"_c{i}") * off)
        twice = total(F.col(f"_c{i}") * (F.col(f"_d{i}") + off * off))
        return F.when(count > 1, F.greatest((twice - once * once / count) / (count - 1), F.lit(0.0)))
    if spec.agg == "min":
        return _both(F.min, F.col(f"_lo{i}"), own, before, F.least)
    return _both(F.max, F.col(f"_hi{i}"), own, before, F.greatest)


def _framed(
    instants: DataFrame, specs: Sequence[Rolling], values: Sequence[str], varied: set[int], keys: tuple[str, ...], seconds: int
) -> DataFrame:
    """``specs`` of one frame length at each instant."""
    frame = F.lit(seconds * 1000)
    block = F.floor(F.col("_ms") / frame)
    # In the next block an instant stands where it leaves the frame.
    places = F.array(
        F.struct(block.alias("_part"), F.col("_ms").alias("_at"), F.lit(True).alias("_mine")),
        F.struct((block + 1).alias("_part"), (F.col("_ms") + frame).alias("_at"), F.lit(False).alias("_mine")),
    )
    cut = instants.withColumn("_place", F.explode(places)).select(*instants.columns, "_place.*")
    cut = cut.withColumn("_back", -F.col("_at"))
    part = Window.partitionBy(*keys, "_part")
    cut = cut.withColumns({f"_mid{i}": F.avg(f"_m{i}").over(part) for i in varied})
    own = part.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    before = part.orderBy("_back").rangeBetween(Window.unboundedPreceding, -1)
    outs = [_combined(s, values.index(s.value), own, before).alias(s.out) for s in specs]
    return cut.select(*keys, "_ms", "_mine", *outs).where("_mine").drop("_mine")


def rolling(
    df: DataFrame,
    specs: Sequence[Rolling],
    *,
    keys: Sequence[str] = S.DEVICE,
    time: str = S.TIME,
    hot: Hot | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Add all ``specs``; rows without device or time get NULL."""
    keys = tuple(keys)
    if hot is None or hot.keys != keys or not hot.calm:
        hot = hot_devices(df, keys, time, replace(policy, share=0.0, min_rows=min(policy.min_rows, CALM_ROWS)))
    outs = [s.out for s in specs]
    instant = F.round(F.col(time) * 1000).cast("bigint")

    spread = F.when(
        F.col(keys[-1]).isNull() | F.col(time).isNull(),
        F.pmod(F.xxhash64(*df.columns), F.lit(NULL_KEY_SPREAD)),
    ).otherwise(F.lit(-1).cast("bigint"))
    ordinary = df if hot.empty else hot.tag(df).where(F.col("_n").isNull())
    shared = LANE in df.columns and hot.empty
    cold = ordinary.withColumns({"_ms": instant} if shared else {"_ms": instant, "_spread": spread})
    along = Window.partitionBy(*keys, LANE if shared else "_spread").orderBy("_ms")
    plain = cold.withColumns(
        {
            s.out: F.when(
                F.col(keys[-1]).isNotNull() & F.col("_ms").isNotNull(),
                _direct(s).over(along.rangeBetween(-(s.seconds * 1000 - 1), 0)),
            )
            for s in specs
        }
    ).select(*df.columns, *outs)

    if hot.empty:
        return plain
    values = list(dict.fromkeys(s.value for s in specs))
    rows = hot.tag(df, "inner").select(*df.columns).withColumn("_ms", instant)
    varied = {values.index(s.value) for s in specs if s.agg == "var_samp"}
    timed = rows.where(F.col("_ms").isNotNull())
    if varied:
        least = timed.groupBy(*keys).agg(*(F.min(number(F.col(values[i]))).alias(f"_z{i}") for i in varied))
        timed = timed.join(F.broadcast(least) if hot.short else least, list(keys))
    instants = timed.groupBy(*keys, "_ms").agg(*_partials(values, varied))
    split = rows
    for seconds in dict.fromkeys(s.seconds for s in specs):
        same = [s for s in specs if s.seconds == seconds]
        split = split.join(_framed(instants, same, values, varied, keys, seconds), [*keys, "_ms"], "left")
    split = split.select(*df.columns, *outs)
    return plain.unionByName(split)


def rolling_means(
    df: DataFrame,
    columns: dict[str, str] | None = None,
    *,
    minutes: Sequence[int] = (1, 5, 15),
    keys: Sequence[str] = S.DEVICE,
    time: str = S.TIME,
    hot: Hot | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Rolling mean of each sensor over each window; ``columns`` maps sensor to name prefix."""
    columns = columns or {
        "mean_wash_tank_temp": "rolling_wash_temp_avg",
        "mean_rinse_temp": "rolling_rinse_temp_avg",
        "mean_conductivity": "rolling_conductivity_avg",
    }
    specs = [
        Rolling(f"{prefix}_{m}min", "avg", value, m * 60)
        for value, prefix in columns.items()
        for m in minutes
    ]
    return rolling(df, specs, keys=keys, time=time, hot=hot, policy=policy)


# --- Fixed values: sensor -> short name of its five-minute features ----------------------
SHORT_NAMES = {
    "mean_conductivity": "conductivity",
    "mean_wash_tank_temp": "wash_temp",
    "mean_rinse_temp": "rinse_temp",
}


def rolling_features_5min(
    df: DataFrame,
    *,
    aggs: Sequence[str] = ("avg",),
    seconds: int = 300,
    keys: Sequence[str] = S.DEVICE,
    time: str = S.TIME,
    hot: Hot | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Five-minute features of the sensors; a sensor that ``df`` lacks gives NULL columns."""
    names = {"avg": "mean", "min": "min", "max": "max"}
    specs, absent = [], []
    for value, short in SHORT_NAMES.items():
        for agg in aggs:
            out = f"{short}_{names[agg]}_5min"
            if value in df.columns:
                specs.append(Rolling(out, agg, value, seconds))
            else:
                absent.append(out)
    rolled = rolling(df, specs, keys=keys, time=time, hot=hot, policy=policy)
    return rolled.withColumns({out: F.lit(None).cast("double") for out in absent})
