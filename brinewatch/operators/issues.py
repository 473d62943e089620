"""Longer-term issue flags and sensor features that the data model declares.

Their definitions are ours; thresholds and windows are those of the data model.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewatch import schema as S
from brinewatch.functions import alarm_flag, number
from brinewatch.operators.rolling import SHORT_NAMES, Rolling, rolling, rolling_features_5min
from brinewatch.operators.skew import DEFAULT_POLICY, LANE, NULL_KEY_SPREAD, Hot, HotPolicy, hot_devices, numeric, ordered_chunks, with_lane


def _hot(df: DataFrame, hot: Hot | None, policy: HotPolicy) -> Hot:
    return hot or hot_devices(df, S.DEVICE, S.TIME, policy)


def _history(df: DataFrame, hot: Hot) -> DataFrame:
    """``_since``: the device's first event time, in the time's own unit."""
    lost = F.when(F.col(S.MAC).isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(NULL_KEY_SPREAD)))
    if hot.empty:
        return df.withColumn("_since", F.min(S.TIME).over(Window.partitionBy(S.MAC, lost)))
    since = hot.tag(df, "inner").groupBy(S.MAC).agg(F.min(S.TIME).alias("_since"))
    tagged = hot.tag(df)
    ordinary = tagged.where("_n is null").drop("_n", "_t0", "_width")
    cold = ordinary.withColumn("_since", F.min(S.TIME).over(Window.partitionBy(S.MAC, lost)))
    split = tagged.where("_n is not null").drop("_n", "_t0", "_width")
    # One row for each hot device.
    return cold.unionByName(split.join(F.broadcast(since) if hot.short else since, S.MAC))


def recovery_failure(
    df: DataFrame, violations: Mapping[str, str], *, seconds: int = S.RECOVERY_WINDOW_S,
    hot: Hot | None = None, policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Violating now and in every row of the last ``seconds``, on a device at least that old.

    ``violations`` maps violation columns to the flags to add.
    """
    hot = _hot(df, hot, policy)
    marked = _history(df, hot).withColumns(
        {f"_{out}": F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v, out in violations.items()}
    )
    specs = [Rolling(f"_min_{out}", "min", f"_{out}", seconds) for out in violations.values()]
    rolled = rolling(marked, specs, hot=hot, policy=policy)
    old = F.col(S.TIME) - F.col("_since") >= seconds
    return rolled.withColumns(
        {out: F.coalesce((F.col(f"_min_{out}") >= 1) & old, F.lit(False)) for out in violations.values()}
    ).drop("_since", *[f"_{o}" for o in violations.values()], *[f"_min_{o}" for o in violations.values()])


def repeated_issue(
    df: DataFrame, violations: Mapping[str, str], *, seconds: int = S.REPEATED_ISSUE_WINDOW_S,
    min_count: int = S.REPEATED_ISSUE_MIN_COUNT, hot: Hot | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """At least ``min_count`` violations began within the last ``seconds``."""
    hot = _hot(df, hot, policy)
    chunks = ordered_chunks(df, keys=S.DEVICE, order=S.BY_TIME, rows_back=1, hot=hot, policy=policy)

    def begins(v: str) -> Column:
        now = F.coalesce(F.col(v), F.lit(False))
        return (now & ~F.lag(now, 1, False).over(chunks.ordered)).cast("double")

    started = chunks.done(
        chunks.df.withColumns({f"_{out}": begins(v) for v, out in violations.items()})
    )
    specs = [Rolling(f"_sum_{out}", "sum", f"_{out}", seconds) for out in violations.values()]
    rolled = rolling(started, specs, hot=hot, policy=policy)
    return rolled.withColumns(
        {out: F.coalesce(F.col(f"_sum_{out}") >= min_count, F.lit(False)) for out in violations.values()}
    ).drop(*[f"_{o}" for o in violations.values()], *[f"_sum_{o}" for o in violations.values()])


def high_variance(
    df: DataFrame, values: Mapping[str, str], *, seconds: int = S.VARIANCE_WINDOW_S,
    threshold: float = S.VARIANCE_THRESHOLD, hot: Hot | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Sample variance over the last ``seconds`` exceeds ``threshold``.

    Nine digits decide, so that the order of summation cannot tip a tie.
    """
    specs = [Rolling(f"_var_{out}", "var_samp", v, seconds) for v, out in values.items()]
    rolled = rolling(df, specs, hot=_hot(df, hot, policy), policy=policy)
    return rolled.withColumns(
        {out: F.coalesce(F.round(f"_var_{out}", 9) > threshold, F.lit(False)) for out in values.values()}
    ).drop(*[f"_var_{o}" for o in values.values()])


def _value_before(
    df: DataFrame, values: Mapping[str, str], seconds: int, hot: Hot
) -> DataFrame:
    """Last known value at least ``seconds`` ago, as columns named by ``values``.

    A row without time is neither earlier nor later than any other.
    """
    back = (Window.unboundedPreceding, -seconds)
    position = F.struct(S.TIME, S.EVENT_ID)
    timed = F.col(S.TIME).isNotNull()
    spread = F.when(
        F.col(S.MAC).isNull(), F.pmod(F.xxhash64(S.EVENT_ID), F.lit(NULL_KEY_SPREAD))
    ).otherwise(F.lit(-1).cast("bigint"))
    ordinary = df if hot.empty else hot.tag(df).where(F.col("_n").isNull())
    shared = LANE in df.columns and hot.empty
    cold = ordinary if shared else ordinary.withColumn("_spread", spread)
    along = Window.partitionBy(S.MAC, LANE if shared else "_spread").orderBy(S.TIME).rangeBetween(*back)
    plain = cold.withColumns(
        {
            out: F.when(
                timed,
                F.max_by(number(F.col(v)), F.when(timed & number(F.col(v)).isNotNull(), position)).over(along),
            )
            for v, out in values.items()
        }
    ).select(*df.columns, *values.values())
    if hot.empty:
        return plain
    rows = hot.tag(df, "inner").select(*df.columns)
    instants = rows.where(timed).groupBy(S.MAC, S.TIME).agg(
        *[
            F.max_by(number(F.col(v)), F.when(number(F.col(v)).isNotNull(), F.col(S.EVENT_ID))).alias(f"_{out}")
            for v, out in values.items()
        ]
    )
    earlier = _known_before(instants, list(values.values()), seconds, hot)
    split = rows.join(earlier, [S.MAC, S.TIME], "left").select(*df.columns, *values.values())
    return plain.unionByName(split)


def _known_before(instants: DataFrame, outs: Sequence[str], seconds: int, hot: Hot) -> DataFrame:
    """For each instant of hot devices the last known ``_<out>`` at least ``seconds`` ago, as ``<out>``.

    Time is cut into stretches. What is known is scanned within each, and what the stretches before leave
    over is carried from stretch to stretch, one row for each.
    """
    known = instants.select(
        S.MAC, F.col(S.TIME).alias("_at"), F.lit(0).alias("_asked"), F.lit(None).cast(instants.schema[S.TIME].dataType).alias(S.TIME),
        *(f"_{out}" for out in outs),
    )
    asked = instants.select(
        S.MAC, (F.col(S.TIME) - seconds).cast(instants.schema[S.TIME].dataType).alias("_at"), F.lit(1).alias("_asked"), S.TIME,
        *(F.lit(None).cast("double").alias(f"_{out}") for out in outs),
    )
    both = known.unionByName(asked)
    placed = hot.tag(both.withColumn("_o", numeric(both, "_at")), "inner")
    placed = placed.withColumn("_stretch", F.floor((F.col("_o") - F.col("_t0")) / F.col("_width")))
    last = placed.groupBy(S.MAC, "_stretch").agg(
        *(F.max_by(f"_{out}", F.when(F.col(f"_{out}").isNotNull(), F.col("_at"))).alias(f"_{out}") for out in outs)
    )
    before = Window.partitionBy(S.MAC).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(S.MAC, "_stretch", *(F.last(f"_{out}", ignorenulls=True).over(before).alias(f"_carried_{out}") for out in outs))
    upto = Window.partitionBy(S.MAC, "_stretch").orderBy("_at", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    scanned = placed.select(
        S.MAC, "_stretch", "_asked", S.TIME, *(F.last(f"_{out}", ignorenulls=True).over(upto).alias(out) for out in outs)
    ).where(F.col("_asked") == 1)
    return scanned.join(carried, [S.MAC, "_stretch"]).select(
        S.MAC, S.TIME, *(F.coalesce(out, f"_carried_{out}").alias(out) for out in outs)
    )


def sensor_features(
    df: DataFrame, *, delta_seconds: int = 30, flags: Sequence[str] = S.RULE_FLAGS,
    hot: Hot | None = None, policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Differences to the row before, 5-minute mean/min/max, 30-second deltas, any anomaly."""
    hot = _hot(df, hot, policy)
    laned = with_lane(df, S.DEVICE, hot)
    chunks = ordered_chunks(laned, keys=S.DEVICE, order=S.BY_TIME, rows_back=1, hot=hot, policy=policy)
    named = F.col(S.MAC).isNotNull()
    diffs = chunks.done(
        chunks.df.withColumns(
            {
                f"{short}_diff": F.when(
                    named, number(F.col(v)) - F.lag(number(F.col(v))).over(chunks.ordered)
                )
                for v, short in SHORT_NAMES.items()
            }
        )
    )
    rolled = rolling_features_5min(diffs, aggs=("avg", "min", "max"), hot=hot, policy=policy)
    deltas = {"mean_wash_tank_temp": "wash_temp", "mean_conductivity": "conductivity"}
    before = _value_before(rolled, {v: f"_{s}_before" for v, s in deltas.items()}, delta_seconds, hot)
    return before.withColumns(
        {
            **{
                f"{s}_delta_{delta_seconds}s": F.when(
                    F.col(S.MAC).isNotNull(), number(F.col(v)) - F.col(f"_{s}_before")
                )
                for v, s in deltas.items()
            },
            "any_anomaly": alarm_flag(df.select(*[f for f in flags if f in df.columns]), flags=flags).cast("int"),
        }
    ).drop(LANE, *[f"_{s}_before" for s in deltas.values()])
