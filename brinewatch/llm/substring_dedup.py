"""Repeated passages by seed and extend: winnowed anchors, extended both ways to whole windows.

Words are stretches without white space. A window is ``length`` consecutive words of one document; it is a
repeat if the same words also start earlier (a smaller id, or earlier in the document). Its anchor is the
least hash among its six-word seeds, so equal windows have equal anchors at equal places. A document
sends one row for each anchor with the windows around it that it stands for, not one for each window.

* Seed: one grouped minimum over anchors tells which occur in several documents, and whether the text
  around them is the same everywhere. The documents' rows are joined to those anchors.
* Extend: where the surroundings are the same everywhere, all windows of the anchor repeat, but for the
  first document. Where they differ, the documents are read again and the anchor is extended to both
  sides, window by window, each against the least document with that extension. An extension is a
  grouped minimum again, so occurrences are never paired with each other.
* Keep: windows that repeat are united to maximal spans.

Ids order documents only. Ranges are kept by row, told apart by a hash of id and text, so rows that share
an id, or have none, never get each other's ranges; copies of a row get equal ones, held once.

Cases: a null or empty text has no words; fewer words than a window repeat nothing; of rows with the same id
the windows that start at an earlier word come first, at the same word none does; rows without id come
after all others; ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewatch.llm.tables import arrow_batches
from brinewatch.llm.words import Words, buffers, byte_table, mix, slices, windows_hash, words
from brinewatch.session import checkpointed

LENGTH = 20
SEED = 6
#: Stands for a missing id, behind all ids.
LAST = 2**63 - 1


def window_starts(found: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``(text, first word)`` of every window."""
    number = np.maximum(found.count - length + 1, 0)
    text = np.repeat(np.arange(len(number)), number)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    return text, found.first[:-1][text] + inner


def anchors(found: Words, length: int, seed: int) -> dict[str, np.ndarray]:
    """For each anchor its text, its hash, its first window and how many it stands for, and their hash."""
    text, start = window_starts(found, length)
    if not len(start):
        none = np.zeros(0, np.int64)
        return dict(text=none, anchor=none, span=none, start=none, n=none, again=none.astype(bool))
    seeds, windows = windows_hash(found.hash, seed), windows_hash(found.hash, length)
    # The low bits give way to the place within the window: one minimum finds value and place.
    width = length - seed + 1
    bits = np.uint64((width - 1).bit_length())
    least = np.full(len(windows), np.iinfo(np.uint64).max, np.uint64)
    cleared = (seeds >> bits) << bits
    for i in range(width):
        np.minimum(least, cleared[i : i + len(windows)] | np.uint64(i), out=least)
    offset = (least[start] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    place = start + offset
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(start)))
    # Both outer windows cover all words between them, as they overlap.
    outer = windows[start[at]] ^ mix(windows[start[at] + n - 1] + n.astype(np.uint64))
    span = mix(outer + offset[at].astype(np.uint64))
    owner = text[at]
    _, first = np.unique(span ^ mix(owner.astype(np.uint64)), return_index=True)
    again = np.ones(len(at), bool)
    again[first] = False
    # What its own document repeats needs no partner: such rows are spread instead of meeting at the anchor.
    anchor = np.where(again, mix(span + start[at].astype(np.uint64)), seeds[place[at]])
    return dict(
        text=owner, anchor=anchor.view(np.int64), span=span.view(np.int64),
        start=start[at] - found.first[owner], n=n, again=again,
    )


def _rows(part: pa.RecordBatch, found: dict[str, np.ndarray]) -> pa.RecordBatch:
    ids, row = (part.column(c).to_numpy()[found["text"]] for c in ("id", "row"))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids), pa.array(row), pa.array(found["anchor"]), pa.array(found["span"]),
            pa.array(found["start"].astype(np.int32)), pa.array(found["n"].astype(np.int32)), pa.array(found["again"]),
        ],
        ["id", "row", "anchor", "span", "start", "n", "again"],
    )


def _occurrences(length: int, seed: int):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, found = words(part.column("text"), *byte_table("nonspace", lower=False))
                yield _rows(part, anchors(found, length, seed))

    return mapped


def _open_windows(length: int):
    """(id, row, text, ranges) to the windows of open ranges, once per row: (window, id, row, start, again)."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, found = words(part.column("text"), *byte_table("nonspace", lower=False))
                owner, start, n = flat_ranges(part.column("open"))
                each = np.repeat(np.arange(len(n)), n)
                first = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                hashes = windows_hash(found.hash, length)
                text = owner[each]
                # Nothing but rows of equal hashes may hold ranges that this one does not.
                fits = first + length <= found.count[text]
                text, first = text[fits], first[fits]
                window = hashes[found.first[text] + first] if len(first) else np.zeros(0, np.uint64)
                order = np.lexsort((first, text))
                text, first, window = text[order], first[order], window[order]
                _, once = np.unique(window ^ mix(text.astype(np.uint64)), return_index=True)
                again = np.ones(len(window), bool)
                again[once] = False
                ids, row = (part.column(c).to_numpy()[text] for c in ("id", "row"))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(window.view(np.int64)), pa.array(ids), pa.array(row),
                        pa.array(first.astype(np.int32)), pa.array(again),
                    ],
                    ["window", "id", "row", "start", "again"],
                )

    return mapped


def flat_ranges(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, start, n)`` of a list column that alternates starts and counts; null is an empty list."""
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64) // 2
    flat = np.asarray(column.flatten()).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), flat[0::2], flat[1::2]


def _kept(length: int, with_text: bool):
    """(id, text, ...ranges) to what is left: the kept words joined by one space."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, found = words(part.column("text"), *byte_table("nonspace", lower=False))
                total = len(found.hash)
                cover = np.zeros(total + 1, np.int64)
                for name in ("closed", "late"):
                    owner, start, n = flat_ranges(part.column(name))
                    fits = start + n + length - 1 <= found.count[owner]
                    owner, start, n = owner[fits], start[fits], n[fits]
                    first = found.first[owner] + start
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + n + length - 1, -1)
                gone = np.cumsum(cover)[:total] > 0
                data, at = buffers(part.column("text"))
                raw = data.tobytes()
                removed = np.bincount(found.text_of()[gone], minlength=part.num_rows)
                texts = []
                for i in range(part.num_rows):
                    low, high = found.first[i], found.first[i + 1]
                    if removed[i]:
                        stay = np.flatnonzero(~gone[low:high]) + low
                        texts.append(b" ".join(raw[a:b] for a, b in zip(found.start[stay], found.end[stay])))
                    else:
                        texts.append(b" ".join(raw[at[i] : at[i + 1]].split()) if high > low else b"")
                result = (
                    pa.array([t.decode() for t in texts], pa.string())
                    if with_text
                    else pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc"), pa.array(found.count.astype(np.int64)),
                        pa.array(removed.astype(np.int64)), result,
                    ],
                    ["doc", "n_words", "n_removed", "kept"],
                )

    return mapped


def _by_document(ranges: DataFrame, **lists) -> DataFrame:
    """One row per row hash with a flat list (start, n, start, n, ...) for each condition, copies' ranges once."""
    pair = F.array("start", "n")
    return ranges.groupBy("row").agg(
        *(F.flatten(F.collect_set(F.when(which, pair))).alias(name) for name, which in lists.items())
    )


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    seed: int = SEED,
    with_text: bool = True,
) -> DataFrame:
    """``(id_col, n_words, n_removed, kept)`` for every row; ``kept`` is the text left, or its SHA-256."""
    arrow_batches(docs.sparkSession)
    source = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"),
        F.col(id_col).cast("long").alias("doc"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).withColumn("row", F.xxhash64("id", "text"))
    found = source.select("id", "row", "text").mapInArrow(
        _occurrences(length, seed),
        "id bigint, row bigint, anchor bigint, span bigint, start int, n int, again boolean",
    )
    place = F.struct("id", "start")
    repeated = (
        found.where("not again")
        .groupBy("anchor")
        .agg(
            F.min(place).alias("least"), F.max(place).alias("most"),
            F.min("span").alias("low"), F.max("span").alias("high"),
        )
        .where("least < most or low < high")
        .select("anchor", "least", (F.col("low") < F.col("high")).alias("mixed"))
    )
    later = F.col("again") | (place > F.col("least"))
    seeded = found.join(repeated, "anchor", "left").where(F.col("mixed") | later)
    open_ = F.col("mixed") & ~F.col("again")
    ranges = checkpointed(_by_document(seeded, open=open_, closed=F.coalesce(~open_, F.lit(True))))
    # The texts are dealt out by row once; extension and the final step both read that one exchange.
    dealt = source.repartition("row")
    wide = dealt.join(ranges, "row", "left")
    windows = wide.where(F.size("open") > 0).select("id", "row", "text", "open").mapInArrow(
        _open_windows(length), "window bigint, id bigint, row bigint, start int, again boolean"
    )
    first = windows.where("not again").groupBy("window").agg(F.min(place).alias("least"), F.max(place).alias("most"))
    first = first.where("least < most").select("window", "least")
    late = windows.join(first, "window", "left").where(later).withColumn("n", F.lit(1))
    late = _by_document(late, late=F.lit(True))
    result = wide.join(late, "row", "left").select("doc", "text", "closed", "late")
    kept = result.mapInArrow(_kept(length, with_text), "doc bigint, n_words bigint, n_removed bigint, kept string")
    return kept.withColumnRenamed("doc", id_col)


def repeat_report(docs: DataFrame) -> DataFrame:
    """One row per document: words, removed words, and a digest of the words that stay."""
    return remove_repeats(docs, with_text=False).withColumnRenamed("kept", "kept_sha256")
