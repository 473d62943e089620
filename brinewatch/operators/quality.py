"""Stability and completeness metrics per device, for one run or many runs at once.

``run`` names the columns that identify a run; every result is keyed by them and the device.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewatch import schema as S
from brinewatch.functions import alarm_flag, conductivity_violation, steady_round
from brinewatch.operators.distribution import MOST_VALUES, distribution
from brinewatch.operators.rolling import Rolling, rolling
from brinewatch.operators.skew import DEFAULT_POLICY, Hot, HotPolicy, dealt, hot_devices, ordered_chunks
from brinewatch.session import checked_broadcast, checkpointed


def _named(df: DataFrame, time: str | None = None) -> DataFrame:
    rows = df.where(F.col(S.MAC).isNotNull())
    return rows.where(F.col(time).isNotNull()) if time else rows


def gap_counts(
    df: DataFrame, *, run: Sequence[str] = (), time: str = S.TIME,
    hot: Hot | None = None, policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """How often each positive gap between a device's successive events occurs.

    Rows without a positive gap are counted under NULL, so no device gets lost.
    """
    keys = (*run, S.MAC)
    lean = _named(df).select(*keys, time)
    chunks = ordered_chunks(lean, keys=keys, order=(time,), rows_back=1, hot=hot, policy=policy)
    gap = F.col(time) - F.lag(time).over(chunks.ordered)
    gaps = chunks.done(chunks.df.withColumn("gap_s", gap.cast("double")))
    # Written, as cadence and rates read it several times.
    return checkpointed(
        gaps.select(*keys, F.when(F.col("gap_s") > 0, F.col("gap_s")).alias("gap_s"))
        .groupBy(*keys, "gap_s")
        .agg(F.count(F.lit(1)).alias("gaps"))
    )


def device_cadence(gaps: DataFrame, *, run: Sequence[str] = (), most_values: int = MOST_VALUES) -> DataFrame:
    """Median positive gap of each device; devices without one get the run's overall median."""
    run = list(run)
    keys = [*run, S.MAC]
    # The median of few gaps is taken in one piece; those of a device with many are counted by ranges.
    many = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") > most_values).drop("_d")
    if many.isEmpty():
        own = gaps.groupBy(*keys).agg(F.percentile("gap_s", 0.5, F.col("gaps")).alias("_own"))
    else:
        many, _ = checked_broadcast(checkpointed(many))
        few = gaps.join(many, keys, "left_anti")
        own = few.groupBy(*keys).agg(F.percentile("gap_s", 0.5, F.col("gaps")).alias("_own")).unionByName(
            distribution(gaps.join(many, keys), "gap_s", keys, linear={"_own": 0.5}, weight="gaps").select(*keys, "_own")
        )
    overall = distribution(gaps, "gap_s", run, linear={"_median": 0.5}, weight="gaps")
    if run:
        joined = own.join(overall.select(*run, "_median"), run, "left")
    else:
        joined = own.withColumn("_median", overall.select("_median").scalar())
    return joined.select(*keys, F.coalesce("_own", "_median").alias("cadence_s"))


def gap_rate(
    gaps: DataFrame, cadence: DataFrame, *, run: Sequence[str] = (), gap_factor: float = 3.0
) -> DataFrame:
    """Share of a device's positive gaps that exceed ``gap_factor`` cadences."""
    keys = [*run, S.MAC]
    known = F.col("gap_s").isNotNull()
    wide = known & (F.col("gap_s") > F.col("cadence_s") * F.lit(gap_factor))
    return (
        gaps.join(cadence, keys)
        .groupBy(*keys)
        .agg(
            F.try_divide(
                F.sum(F.when(wide, F.col("gaps")).otherwise(F.lit(0))).cast("double"),
                F.sum(F.when(known, F.col("gaps")).otherwise(F.lit(0))).cast("double"),
            ).alias("gap_rate")
        )
    )


def arrival_metrics(
    df: DataFrame,
    *,
    run: Sequence[str] = (),
    arrival: Sequence[str] = S.BY_ARRIVAL,
    time: str = S.TIME,
    alarm: Column | str | None = None,
    hot: Hot | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Out-of-order events and alarm flips of each device, in arrival order, in one pass.

    ``alarm`` is an existing flag; otherwise the alarm is derived from the row.
    Columns: events, ooo_count, flips, flip_rate_per_hour, mtbf_minutes (NULL below two flips).
    """
    keys = (*run, S.MAC)
    flag = alarm_flag(df) if alarm is None else F.col(alarm) if isinstance(alarm, str) else alarm
    lean = _named(df).select(*keys, *arrival, time, flag.alias("_alarm"))
    chunks = ordered_chunks(lean, keys=keys, order=arrival, rows_back=1, hot=hot, policy=policy)
    steps = chunks.done(
        chunks.df.withColumns(
            {
                "_back": F.coalesce(F.col(time) < F.lag(time).over(chunks.ordered), F.lit(False)),
                "_flip": F.coalesce(
                    F.col("_alarm") != F.lag("_alarm").over(chunks.ordered), F.lit(False)
                ),
            }
        )
    )
    position = F.struct(*arrival)
    at_flip = F.when(F.col("_flip"), position)
    stats = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("_back").alias("ooo_count"),
        F.count_if("_flip").alias("flips"),
        ((F.max(time) - F.min(time)) / F.lit(3600.0)).alias("_hours"),
        F.min_by(time, at_flip).alias("_first"),
        F.max_by(time, at_flip).alias("_last"),
    )
    return stats.select(
        *keys, "events", "ooo_count", "flips",
        F.when(F.col("_hours") > 0, F.col("flips") / F.col("_hours")).otherwise(F.lit(0.0))
        .alias("flip_rate_per_hour"),
        F.when(
            F.col("flips") >= 2,
            F.try_divide(F.col("_last") - F.col("_first"), F.col("flips") - 1) / F.lit(60.0),
        ).alias("mtbf_minutes"),
    )


def out_of_order(df: DataFrame, **options) -> DataFrame:
    """Events per device that arrive after a younger one."""
    out = arrival_metrics(df, alarm=F.lit(False), **options)
    return out.drop("flips", "flip_rate_per_hour", "mtbf_minutes")


def flip_rate(df: DataFrame, **options) -> DataFrame:
    """Alarm changes per hour of the device's event-time span; 0 without a span."""
    return arrival_metrics(df, **options).drop("events", "ooo_count", "mtbf_minutes")


def mtbf(df: DataFrame, **options) -> DataFrame:
    """Mean minutes between alarm changes; NULL below two changes."""
    return arrival_metrics(df, **options).drop("events", "ooo_count", "flip_rate_per_hour")


def integrity_bins(
    df: DataFrame,
    cadence: DataFrame,
    *,
    run: Sequence[str] = (),
    time: str = S.TIME,
    window_s: int = 300,
    hot: Hot | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Scores of the bins a device fills, and one row of weight ``bins`` for its empty ones.

    Bins start at the device's first event, the last one includes its end.  A device whose events
    all have the same time has no bins.
    """
    keys = [*run, S.MAC]
    known = cadence.where(F.col("cadence_s") > 0)
    named = _named(df, time).select(*keys, time)
    if hot is None or hot.keys != tuple(keys):
        hot = hot_devices(named, keys, time, policy)
    # An ordinary device is dealt out once, whole, for its cadence, its span and its bins.
    device = Window.partitionBy(*keys)
    plain = named if hot.empty else named.join(hot.listed(*keys), keys, "left_anti")
    spans = dealt(plain, keys, named.count()).join(known, keys).withColumns(
        {"_t0": F.min(time).over(device), "_t1": F.max(time).over(device)}
    )
    filled = _filled_bins(spans, [*keys, "cadence_s"], time, window_s)
    if not hot.empty:
        # Rows of the others are counted into bins map-side; no task needs a whole device.
        busy = named.join(hot.listed(*keys), keys, "left_semi")
        span = busy.groupBy(*keys).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1")).join(known, keys)
        filled = filled.unionByName(_filled_bins(busy.join(span, keys), [*keys, "cadence_s"], time, window_s))
    # Written, as it is read twice and its tasks should hold nothing else.
    filled = checkpointed(filled)
    score = F.least(F.lit(1.0), F.col("_c") * F.col("cadence_s") / F.lit(float(window_s)))
    empty = (
        filled.groupBy(*keys, "_bins").agg(F.count(F.lit(1)).alias("_filled"))
        .select(*keys, F.lit(0.0).alias("score"), (F.col("_bins") - F.col("_filled")).alias("bins"))
        .where(F.col("bins") > 0)
    )
    return filled.select(*keys, score.alias("score"), F.lit(1).cast("bigint").alias("bins")).unionByName(empty)


def _filled_bins(rows: DataFrame, keys: Sequence[str], time: str, window_s: int) -> DataFrame:
    """``keys, _bins, _bin, _c``: the rows in each bin, from rows with their device's span ``_t0, _t1``."""
    bins = F.ceil((F.col("_t1") - F.col("_t0")) / F.lit(float(window_s)))
    place = F.floor((F.col(time) - F.col("_t0")) / F.lit(float(window_s)))
    return (
        rows.withColumn("_bins", bins).where(F.col("_bins") > 0)
        .withColumn("_bin", F.least(place, F.col("_bins") - 1))
        .groupBy(*keys, "_bins", "_bin")
        .agg(F.count(F.lit(1)).alias("_c"))
    )


def window_integrity(
    df: DataFrame, cadence: DataFrame, *, run: Sequence[str] = (), time: str = S.TIME,
    window_s: int = 300, hot: Hot | None = None, policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Per device: number of bins, bins with events, and the mean score over all bins."""
    keys = [*run, S.MAC]
    scored = integrity_bins(df, cadence, run=run, time=time, window_s=window_s, hot=hot, policy=policy)
    return scored.groupBy(*keys).agg(
        F.sum("bins").alias("bins"),
        F.sum(F.when(F.col("score") > 0, F.col("bins")).otherwise(F.lit(0))).alias("filled_bins"),
        (F.sum(F.col("score") * F.col("bins")) / F.sum("bins")).alias("window_integrity"),
    )


def proxy_ml_metrics(
    df: DataFrame,
    *,
    run: Sequence[str] = (),
    time: str = S.TIME,
    threshold: float = S.CONDUCTIVITY_THRESHOLD,
    band: float = S.CONDUCTIVITY_BAND,
    hot: Hot | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """How well the violation of the five-minute mean predicts that of the raw value."""
    keys = (*run, S.MAC)
    lean = df.select(*keys, time, "mean_conductivity", "setpoint_conductivity")
    rolled = rolling(
        lean, [Rolling("_mean", "avg", "mean_conductivity", 300)],
        keys=keys, time=time, hot=hot, policy=policy,
    )
    sp = F.col("setpoint_conductivity")
    usable = rolled.where(
        (sp > 0) & F.col("mean_conductivity").isNotNull() & F.col("_mean").isNotNull()
    )
    truth = conductivity_violation(F.col("mean_conductivity"), sp, threshold=threshold, band=band)
    guess = conductivity_violation(F.col("_mean"), sp, threshold=threshold, band=band)
    counts = usable.groupBy(*run).agg(
        F.count_if(truth & guess).alias("_tp"),
        F.count_if(~truth & guess).alias("_fp"),
        F.count_if(truth & ~guess).alias("_fn"),
        F.count_if(truth).alias("support_positive"),
        F.count(F.lit(1)).alias("support_total"),
    )
    tp = F.col("_tp").cast("double")
    precision = F.try_divide(tp, F.col("_tp") + F.col("_fp"))
    recall = F.try_divide(tp, F.col("_tp") + F.col("_fn"))
    f1 = F.try_divide(F.lit(2.0) * precision * recall, precision + recall)
    return counts.select(
        *run, steady_round(precision, 6).alias("precision"), steady_round(recall, 6).alias("recall"),
        steady_round(f1, 6).alias("f1"), "support_positive", "support_total",
    )
