"""Benchmark decontamination: search every benchmark window in FM-indexes of the training shards.

A shard is a slice of a task's documents. Its text is the sequence of benchmark-vocabulary words, cut
where another word stands and where a document ends; runs too short for any window are left out, as
nothing can occur in them. Every window of the benchmark is searched backwards in the shard's index, its
occurrences are located through sampled suffix positions, and overlapping ones are merged to spans.
There is no shuffle. The benchmark goes to the tasks in blocks of bounded size, each checked on all
documents; usually it is one block.

Cases: a null or empty text has no words, no hits and no items; rows that repeat give equal rows; a
benchmark item without words has no window; an item without id marks words but is not listed; an empty
benchmark hits nothing. Other columns pass through, except those with the name of a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewatch.llm.fm_index import FmIndex
from brinewatch.llm.tables import arrow_batches
from brinewatch.llm.words import byte_table, list_column, slices, words

#: Benchmark text that is sent to the tasks at once; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 32 << 20
#: Bytes of text in one shard.
SHARD_BYTES = 4 << 20

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("span_start", T.ArrayType(T.IntegerType())),
        T.StructField("span_end", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.LongType())),
    ]
)


class Patterns:
    """All windows of a block of the benchmark as sequences of vocabulary numbers."""

    def __init__(self, item_ids: list[int | None], texts: list[str | None], window: int):
        _, found = words(pa.array(texts, pa.string()), *byte_table("alnum", lower=True))
        self.vocabulary = np.unique(found.hash)
        symbol = np.searchsorted(self.vocabulary, found.hash) + 1
        self.item_ids = np.array([-1 if i is None else i for i in item_ids], np.int64)
        self.listed = np.array([i is not None for i in item_ids], bool)
        length = np.minimum(found.count, window)
        number = np.where(length > 0, found.count - length + 1, 0)
        item = np.repeat(np.arange(len(length)), number)
        inner = np.arange(len(item)) - np.repeat(np.cumsum(number) - number, number)
        start = found.first[:-1][item] + inner
        cut = length[item]
        across = np.arange(window)
        rows = np.where(
            across < cut[:, None], symbol[np.minimum(start[:, None] + across, max(len(symbol) - 1, 0))], 0
        ) if len(symbol) else np.zeros((0, window), np.int64)
        # Each distinct window is searched once, for all items that have it.
        self.windows, which = np.unique(rows, axis=0, return_inverse=True)
        self.lengths = (self.windows > 0).sum(axis=1)
        pairs = np.unique(np.stack([which.ravel(), item], axis=1), axis=0)
        self.owner_from = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.owner = pairs[:, 1]
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and the number of the range that each comes from."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    return low[which] + inner, which


def shard_text(found, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """The words to index and, for each, its word number; 0 separates runs."""
    place = np.searchsorted(patterns.vocabulary, found.hash)
    place = np.minimum(place, max(len(patterns.vocabulary) - 1, 0))
    known = patterns.vocabulary[place] == found.hash if len(patterns.vocabulary) else np.zeros(len(place), bool)
    # A run is a stretch of known words within one text.
    joins = known.copy()
    joins[1:] &= known[:-1]
    joins[:1] = False
    firsts = found.first[:-1]
    joins[firsts[firsts < len(joins)]] = False
    run = np.cumsum(~joins)
    length = np.bincount(run[known], minlength=run[-1] + 1 if len(run) else 1)
    long = known & (length[run] >= patterns.shortest)
    at = np.flatnonzero(long)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = run[at[1:]] != run[at[:-1]]
    spot = np.arange(len(at)) + np.cumsum(new)
    text, source = np.zeros(spot[-1] + 1, np.int64), np.zeros(spot[-1] + 1, np.int64)
    text[spot], source[spot] = place[at] + 1, at
    return text, source


def search_shard(column: pa.Array, patterns: Patterns) -> dict[str, pa.Array]:
    """Words, merged hit spans and items of each text of a shard."""
    _, found = words(column, *byte_table("alnum", lower=True))
    rows = len(column)
    hit = np.zeros(len(found.hash) + 1, np.int32)
    pairs = np.zeros((0, 2), np.int64)
    text, source = shard_text(found, patterns) if len(patterns.windows) else (np.zeros(0), None)
    if len(text):
        index = FmIndex(text, len(patterns.vocabulary) + 1)
        low, high = index.search(patterns.windows, patterns.lengths)
        order, which = ranges(low, high)
        first = source[index.locate(order)]
        np.add.at(hit, first, 1)
        np.add.at(hit, first + patterns.lengths[which], -1)
        document = np.searchsorted(found.first, first, side="right") - 1
        inside = np.unique(np.stack([document, which], axis=1), axis=0)
        owner, back = ranges(patterns.owner_from[inside[:, 1]], patterns.owner_from[inside[:, 1] + 1])
        pairs = np.unique(np.stack([inside[back, 0], patterns.owner[owner]], axis=1), axis=0)
        pairs = pairs[patterns.listed[pairs[:, 1]]]
        pairs = np.unique(np.stack([pairs[:, 0], patterns.item_ids[pairs[:, 1]]], axis=1), axis=0)
    inside = np.cumsum(hit)[:-1] > 0
    owner = found.text_of()
    joined = np.zeros(len(inside), bool)
    joined[1:] = inside[1:] & inside[:-1] & (owner[1:] == owner[:-1])
    starts = np.flatnonzero(inside & ~joined)
    ends = np.flatnonzero(inside & ~np.append(joined[1:], False)) + 1
    count = np.bincount(owner[starts], minlength=rows)
    base = found.first[owner[starts]]
    return {
        "n_words": pa.array(found.count.astype(np.int64)),
        "span_start": list_column(pa.array((starts - base).astype(np.int32)), count),
        "span_end": list_column(pa.array((ends - base).astype(np.int32)), count),
        "items": list_column(pa.array(pairs[:, 1]), np.bincount(pairs[:, 0], minlength=rows)),
    }


def _search(docs: DataFrame, patterns, text: str) -> DataFrame:
    kept = [f for f in docs.schema if f.name not in RESULT.names]
    shared = docs.sparkSession.sparkContext.broadcast(patterns)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in slices(batch, text, SHARD_BYTES):
                result = search_shard(shard.column(text), shared.value)
                columns = [shard.column(f.name) for f in kept] + [result[n] for n in RESULT.names]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *RESULT.names])

    return docs.mapInArrow(mapped, T.StructType([*kept, *RESULT.fields]))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, the merged removal spans ``[span_start, span_end)`` in words, and ``items``."""
    arrow_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = size // block_bytes + 1
    block = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    result = None
    for number in range(blocks):
        rows = (items.where(block == number) if blocks > 1 else items).collect()
        patterns = Patterns([r.i for r in rows], [r.t for r in rows], window)
        if result is None:
            result = _search(docs, patterns, text)
        else:  # a further block of an oversized benchmark: search again and merge with what was found
            before = {n: f"_before_{n}" for n in ("span_start", "span_end", "items")}
            result = _merged(_search(result.withColumnsRenamed(before), patterns, text), before)
    return result


def _merged(df: DataFrame, before: dict[str, str]) -> DataFrame:
    """Unite the spans and items of two searches."""
    both = F.array_sort(
        F.concat(
            F.arrays_zip(F.col("span_start").alias("a"), F.col("span_end").alias("b")),
            F.arrays_zip(F.col(before["span_start"]).alias("a"), F.col(before["span_end"]).alias("b")),
        )
    )
    # Start a span where the next one begins behind all before it, else lengthen the last.
    merged = F.aggregate(
        both,
        F.expr("cast(array() as array<struct<a:int,b:int>>)"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["a"] <= F.element_at(done, -1)["b"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["a"].alias("a"),
                        F.greatest(F.element_at(done, -1)["b"], x["b"]).alias("b"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return (
        df.withColumn("_m", merged)
        .withColumn("span_start", F.transform("_m", lambda x: x["a"]))
        .withColumn("span_end", F.transform("_m", lambda x: x["b"]))
        .withColumn("items", F.array_union("items", before["items"]))
        .drop("_m", *before.values())
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: hit words, the items found in it and a digest of their ids."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate(
        F.zip_with("span_start", "span_end", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x
    )
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
