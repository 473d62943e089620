"""Latency parts and the availability lag of windowed features, per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewatch import schema as S
from brinewatch.functions import steady_round
from brinewatch.operators.distribution import distribution
from brinewatch.session import checked_broadcast, checkpointed

SANE_LAG_S = 3600
ANCHORS = ("kafka_logappend_ms", "produced_at_ms")
READY = ("speed_features_ready_at", "stream_features_ready_at", "features_ready_ms", "persisted_at")


def run_side(table: DataFrame) -> DataFrame:
    """A table with one row per run, written once, counted, and broadcast only if it is small."""
    side, _ = checked_broadcast(checkpointed(table), 100_000)
    return side


def with_run(df: DataFrame, run: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` and the columns naming its run; a single unnamed run gets a constant column."""
    return (df, list(run)) if run else (df.withColumn("_run", F.lit(0)), ["_run"])


def have(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def _long(df: DataFrame, run: Sequence[str], parts: dict[str, Column]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in parts.items()]
    )
    return df.select(*run, F.explode(pairs).alias("_p")).select(*run, "_p.*").where("value is not null")


def _ms(name: str) -> Column:
    """A time column in milliseconds, with fractions.

    Differences are taken in this unit: at the size of an epoch, seconds lose their last digits.
    """
    if name.endswith("_ms"):
        return F.col(name).cast("double")
    return F.unix_micros(F.col(name).try_cast("timestamp")) / 1000.0


def latency_parts(df: DataFrame) -> dict[str, Column]:
    """Raw latency expressions that the columns of ``df`` allow."""
    has = {n for n in ("persisted_at", "kafka_logappend_ms", "produced_at_ms") if have(df, n)}

    def lag(later: str, earlier: str) -> Column:
        return (_ms(later) - _ms(earlier)) / 1000.0

    parts: dict[str, Column] = {}
    if {"kafka_logappend_ms", "produced_at_ms"} <= has:
        ingest = lag("kafka_logappend_ms", "produced_at_ms")
        parts["ingest_raw"] = ingest
        parts["ingest"] = F.when(ingest.isNotNull(), F.greatest(ingest, F.lit(0.0)))
    if have(df, "event_latency_seconds"):
        parts["persist_event"] = F.col("event_latency_seconds")
    if {"persisted_at", "kafka_logappend_ms"} <= has:
        parts["persist_computed"] = lag("persisted_at", "kafka_logappend_ms")
    if {"persisted_at", "produced_at_ms"} <= has:
        parts["availability"] = lag("persisted_at", "produced_at_ms")
    return parts


def latency_decomposition(
    df: DataFrame, *, run: Sequence[str] = (), materialize: bool = False
) -> DataFrame:
    """Summary of ingest, persist and availability latency, keyed by run and metric.

    A part whose median is not sane is left out: clocks of different machines disagree then.
    """
    df, keys = with_run(df, run)
    long = _long(df, keys, latency_parts(df))
    d = distribution(long, "value", [*keys, "metric"], linear={"p50": 0.5, "p95": 0.95, "p99": 0.99}, materialize=materialize)

    def median_of(name: str) -> Column:
        return F.max(F.when(F.col("metric") == name, F.col("p50"))).over(Window.partitionBy(*keys))

    d = d.withColumns({f"_{m}": median_of(m) for m in ("ingest_raw", "persist_event")})
    sane_event = F.col("_persist_event") < SANE_LAG_S
    name = (
        F.when((F.col("metric") == "ingest") & (F.col("_ingest_raw") < SANE_LAG_S), "ingest_latency_s")
        .when((F.col("metric") == "persist_event") & sane_event, "persist_latency_s")
        .when(
            (F.col("metric") == "persist_computed") & ~F.coalesce(sane_event, F.lit(False)) & (F.col("p50") >= 0),
            "persist_latency_s",
        )
        .when((F.col("metric") == "availability") & (F.col("p50") < SANE_LAG_S), "availability_latency_s")
    )
    return d.withColumn("metric", name).where(F.col("metric").isNotNull()).select(
        *run, "metric", "n", *[steady_round(F.col(c), 6).alias(c) for c in ("mean", "std", "p95", "p99")]
    )


def _ready_ms(df: DataFrame) -> dict[str, Column]:
    return {name: _ms(name) for name in READY if have(df, name)}


def fal_source_choice(df: DataFrame, *, run: Sequence[str] = ()) -> DataFrame:
    """Per run, the columns that tell when a row's features were ready and where its lag starts.

    The first ready column holding any value wins.  If flags were computed, that is the speed
    layer's time (if that column exists) or the batch time.  A stream or speed time whose median
    lag is more than a minute above a sane persisted lag only says when the window closed:
    persisted is used then.
    """
    df, keys = with_run(df, run)
    return _source_choice(df, keys, []).select(*run, "anchor", "ready")


def _source_choice(df: DataFrame, keys: Sequence[str], extra: Sequence[Column]) -> DataFrame:
    """The choice per run, with further aggregates of the same pass."""
    ready = _ready_ms(df)
    anchors = [a for a in ANCHORS if have(df, a)]
    flags = F.count("flags_computed_at") if have(df, "flags_computed_at") else F.lit(0)
    present = df.groupBy(*keys).agg(
        flags.alias("_flags"),
        *[F.count(n).alias(f"_has_{n}") for n in (*ready, *anchors)],
        *extra,
    )

    def first(names: Sequence[str]) -> Column:
        known = [F.when(F.col(f"_has_{n}") > 0, F.lit(n)) for n in names if n in ready or n in anchors]
        return F.coalesce(F.lit(None).cast("string"), *known)

    batch_first = ["speed_features_ready_at", "features_ready_ms"] if "features_ready_ms" in ready else []
    choice = F.coalesce(F.when(F.col("_flags") > 0, first(batch_first)), first(READY))
    kept = [c for c in present.columns if c != "_flags" and not c.startswith("_has_")]
    chosen = present.select(*kept, first(ANCHORS).alias("anchor"), choice.alias("ready"))

    lagging = [n for n in READY[:2] if n in ready]
    if not lagging or "persisted_at" not in ready or not anchors:
        return chosen
    side = run_side(chosen)
    since = F.coalesce(*[F.when(F.col("anchor") == a, _ms(a)) for a in anchors])
    until = F.coalesce(*[F.when(F.col("ready") == n, ready[n]) for n in lagging])
    doubtful = side.where(F.col("ready").isin(*lagging)).select(*keys, "anchor", "ready")
    lags = _long(
        df.select(*keys, *anchors, *ready).join(doubtful, list(keys)), keys,
        {"ready": (until - since) / 1000.0, "persisted": (ready["persisted_at"] - since) / 1000.0},
    )
    medians = distribution(lags, "value", [*keys, "metric"], linear={"p50": 0.5}).groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("p50"))).alias(f"_{m}") for m in ("ready", "persisted")]
    )
    misleading = (
        (F.col("_persisted") >= 0) & (F.col("_persisted") < SANE_LAG_S)
        & (F.col("_ready") - F.col("_persisted") > 60)
    )
    return (
        side.join(medians, list(keys), "left")
        .withColumn("ready", F.when(misleading, F.lit("persisted_at")).otherwise(F.col("ready")))
        .drop("_ready", "_persisted")
    )


def fal_windows(
    df: DataFrame,
    *,
    run: Sequence[str] = (),
    time: str = S.TIME,
    anchor: str | None = None,
    ready: str | None = None,
    window_s: int = 1200,
    lateness_s: float = 0.0,
) -> DataFrame:
    """Availability lag of each window of a run, counted from the run's first event.

    ``fal_total_s``: last ready time minus first append; ``fal_pipeline_s``: minus last append;
    ``fal_freshness_s``: minus the append of the first event at or after the window's close.
    Without ``anchor`` and ``ready`` the columns are chosen per run.
    """
    df, keys = with_run(df, run)
    sources = _ready_ms(df)
    span = [F.min(time).alias("_t0"), F.max(time).alias("_t1")]
    if anchor is None or ready is None:
        side = run_side(_source_choice(df, keys, span))
    else:
        given = df.groupBy(*keys).agg(*span)
        side = run_side(given.withColumns({"anchor": F.lit(anchor), "ready": F.lit(ready)}))
    anchor_ms = F.coalesce(
        F.lit(None).cast("double"),
        *[F.when(F.col("anchor") == a, _ms(a)) for a in ANCHORS if have(df, a)],
    )
    ready_ms = F.coalesce(
        F.lit(None).cast("double"),
        *[F.when(F.col("ready") == n, c) for n, c in sources.items()],
    )
    # Chosen columns may share their name with a column of the data: pick the inputs first.
    used = [c for c in (*ANCHORS, *READY) if have(df, c)]
    rows = (
        df.select(*keys, time, S.EVENT_ID, *used).join(side, keys)
        .select(
            *keys, "_t0", "_t1", time, S.EVENT_ID, anchor_ms.alias("_anchor"), ready_ms.alias("_ready"),
            F.floor((F.col(time) - F.col("_t0")) / F.lit(float(window_s))).alias("_w"),
            F.floor((F.col(time) - F.col("_t0") - F.lit(float(lateness_s))) / F.lit(float(window_s))).alias("_late_w"),
        )
        .where(F.col("_w").isNotNull())
    )
    in_window = F.col("_ready").isNotNull()
    windows = rows.groupBy(*keys, "_t0", "_t1", "_w").agg(
        F.max("_ready").alias("_visible"),
        F.min(F.when(in_window, F.col("_anchor"))).alias("_first"),
        F.max(F.when(in_window, F.col("_anchor"))).alias("_last"),
    )
    openers = (
        rows.where(F.col("_anchor").isNotNull())
        .groupBy(*keys, F.col("_late_w").alias("_w"))
        .agg(F.min_by("_anchor", F.struct(time, S.EVENT_ID)).alias("_opener"))
    )
    later = Window.partitionBy(*keys).orderBy("_w").rowsBetween(1, Window.unboundedFollowing)
    joined = windows.join(openers, [*keys, "_w"], "full").withColumn(
        "_next", F.first("_opener", ignorenulls=True).over(later)
    )
    start = F.col("_t0") + F.col("_w") * window_s
    kept = joined.where((start < F.col("_t1")) & F.col("_visible").isNotNull() & F.col("_first").isNotNull())

    def lag_s(since: str) -> Column:
        lag = F.coalesce((F.col("_visible") - F.col(since)) / 1000.0, F.lit(0.0))
        return F.greatest(lag, F.lit(0.0))

    return kept.select(
        *(run or ()),
        F.col("_w").cast("bigint").alias("window_no"),
        start.alias("window_start"),
        lag_s("_first").alias("fal_total_s"),
        lag_s("_last").alias("fal_pipeline_s"),
        lag_s("_next").alias("fal_freshness_s"),
    )


def measurement_slice(
    df: DataFrame,
    *,
    run: Sequence[str] = (),
    time: str = S.TIME,
    warmup_minutes: float = 5,
    measurement_minutes: float = 120,
) -> DataFrame:
    """Rows of the measured stretch after the warm-up; a run with none there keeps all its rows."""
    df, keys = with_run(df, run)
    span = df.groupBy(*keys).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"))
    warm, length = warmup_minutes * 60, measurement_minutes * 60
    start = F.col("_t0") + warm
    short = F.col("_t1") - F.col("_t0") < warm + length
    end = F.when((start + length > F.col("_t1")) & short, F.col("_t1") + 1).otherwise(start + length)
    bounds = span.select(*keys, start.alias("_start"), end.alias("_end"), "_t1")
    inside = F.col(time).between(F.col("_start"), F.col("_end"))
    side = run_side(bounds)
    counted = df.select(*keys, time).join(side, keys).groupBy(*keys).agg(
        F.count_if(inside).alias("_inside")
    )
    full = run_side(side.join(counted, keys))
    return (
        df.join(full, keys)
        .where(inside | (F.col("_inside") == 0))
        .drop("_start", "_end", "_t1", "_inside", "_run")
    )
