"""Importance resampling towards a target distribution, over hashed word n-grams.

Features are all runs of one or two words; each falls into the bucket of its CRC-32. Buckets are counted over
all documents and over all target texts. A bucket's gain is the logarithm of the ratio of its smoothed shares,
a document's weight the mean gain of its features. Adding noise of the Gumbel distribution, which follows from
the id, and taking the highest sums draws documents without replacement in proportion to their ratios.

Checksums are computed for all features of a slice of texts at once (see ``crc``). Counts travel as one number
a bucket and task. The order of all documents is made by ranges of (score, id, row), and a rank is the
place in its range and the size of the ranges before it, so no task sees more than its range.

Cases: a null or empty text has no features and weight 0; a row without id is drawn as if its id were empty
and comes last among equal scores; repeated rows are drawn each by itself, in an arbitrary but fixed order;
an empty target gives weights that only undo the documents' own shares; an empty table gives no rows; other
columns pass through, except those with the name of a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewatch.llm.crc import gram_crc32
from brinewatch.llm.tables import arrow_batches, fresh, numbered
from brinewatch.llm.words import byte_table, slices, word_spans
from brinewatch.session import checkpointed

BUCKETS, MOST_WORDS, SEED, PERCENT, LEAST_WORDS = 10_000, 2, 7, 25, 20
#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE = 1 << 20

WEIGHED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_features", T.LongType()),
        T.StructField("weight", T.LongType()),
    ]
)


def _features(column: pa.Array, most: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The first word of each text; for each length of runs, the first word of each run and its bucket."""
    data, start, end, first = word_spans(column, *byte_table("alnum", lower=True))
    grams = gram_crc32(data, start, end, first, most)
    return first, [(word, crc % np.uint32(buckets)) for word, crc in grams]


def count_buckets(df: DataFrame, text: str = "text", most: int = MOST_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    arrow_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "t", SLICE):
                for _, bucket in _features(part.column("t"), most, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    each = df.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "bucket int, n bigint")
    # At most one row a bucket comes back.
    rows = each.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in rows]] = [r.n for r in rows]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's ratio of shares, floored."""
    buckets = len(documents)
    over, under = float(documents.sum()) + buckets, float(target.sum()) + buckets
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * over / ((s + 1.0) * under))) for s, t in zip(documents, target)],
        np.int64,
    )


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text", most: int = MOST_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight``, the floored mean gain."""
    arrow_batches(docs.sparkSession)
    kept = [f for f in docs.schema if f.name not in WEIGHED.names]
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE):
                first, grams = _features(part.column(text), most, buckets)
                features, total = np.zeros(len(first) - 1, np.int64), np.zeros(len(first) - 1, np.int64)
                for word, bucket in grams:
                    at = np.searchsorted(word, first)
                    sums = np.concatenate([[0], np.cumsum(shared.value[bucket])])
                    features += np.diff(at)
                    total += sums[at[1:]] - sums[at[:-1]]
                mean = np.where(features > 0, total // np.maximum(features, 1), 0)
                columns = [part.column(f.name) for f in kept]
                columns += [pa.array(np.diff(first).astype(np.int64)), pa.array(features), pa.array(mean)]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *WEIGHED.names])

    source = docs.withColumn(text, F.col(text).cast("string")).select(*(f.name for f in kept))
    fields = [T.StructField(f.name, T.StringType()) if f.name == text else f for f in kept]
    return source.mapInArrow(weigh, T.StructType([*fields, *WEIGHED.fields]))


def noise(id_: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variable that follows from the id, floored."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(
    docs: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """Weighed ``docs`` with ``score`` and ``rank``: 1, 2, 3 for those drawn, null for the others."""
    row = fresh(docs, "row")
    # Written before it is cut into ranges: rows must keep their numbers whatever is run again.
    scored = checkpointed(
        docs.drop("rank").withColumn("score", F.col("weight") + noise(F.col(id_col), seed))
        .withColumn(row, F.monotonically_increasing_id())
    )
    enough = F.col("n_words") >= least_words
    order = F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col(row).asc()
    found, total = numbered(scored.where(enough), "rank", *order)
    found = found.withColumn("rank", F.when(F.col("rank") <= total * percent // 100, F.col("rank")))
    return found.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))).drop(row)


def importance_resample(
    docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", id_col: str = "doc_id",
    percent: int = PERCENT, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features``, ``weight``, ``score`` and the ``rank`` of those drawn."""
    gain = gains(count_buckets(docs, text), count_buckets(target, target_text))
    return drawn(weighed(docs, gain, text), id_col, percent, least_words)


def resampling_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per document: number of features, weight, score and rank; texts stay where they are."""
    docs = docs.select("doc_id", "text")
    gain = gains(count_buckets(docs), count_buckets(target))
    return drawn(weighed(docs, gain).drop("text")).select("doc_id", "n_features", "weight", "score", "rank")


def report_sql() -> str:
    """SQL for ``resampling_report``, with the checksum taken byte by byte."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH byte_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, _:
    xor(c >> 1, 3988292384 * (c & 1)))) AS t),
worded AS MATERIALIZED (
  SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark)),
features AS MATERIALIZED (
  SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM worded),
hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(0, strlen(f)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM features), byte_table),
counted AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM features JOIN hashed USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + {BUCKETS})::DOUBLE
    / ((s + 1.0::DOUBLE) * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM counted),
weighed AS (
  SELECT doc_id, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight
  FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296)))::BIGINT AS score
  FROM worded LEFT JOIN weighed USING (doc_id) WHERE side = 0),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS total
  FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
  CASE WHEN place <= total * {PERCENT} // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)"""
