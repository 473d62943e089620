"""Quality scores by Bradley-Terry ranking: preference pairs, logistic loss on feature differences.

A labelled good document is preferred to a labelled bad one. The model's strength of a document is linear
in features of its whole text (byte frequencies, letter case, repetition of words, pairs of words and
lines, lengths); its weights minimise the logistic loss of the strength differences over all pairs of a good
and a bad document. The cut is a quantile of the strengths of all labelled documents, at the share of bad ones;
the score is logistic in the strength and shifted so that the cut has score 0.3.

Every labelled document takes part, and every pair. Their number is no matter, as the loss depends on strengths
only: documents are counted along a grid of strengths, each shared by the two points around it, and points
are paired in place of documents (the loss of a pair is off by 3e-5 at most). Spark's tasks make the counts and
the sums of features; the driver gets one number for each feature or occupied point of the grid.

Cases: a null text counts as empty and is scored like one; repeated rows score alike; without labels, or
with labels of one kind only, no pair exists and every document gets the share of good labels (0.5
without any).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewatch.llm.labelled import chosen_labels
from brinewatch.llm.tables import arrow_batches, fresh, held_out
from brinewatch.llm.words import buffers, byte_table, hash_ranges, slices, windows_hash, words
from brinewatch.operators.distribution import distribution
from brinewatch.session import checked_broadcast, checkpointed

CUT_SCORE = 0.3
#: Points of the grid to one unit of strength.
GRID = 32
#: Up to so many labelled rows are summed in one piece, more by Spark's tasks; the sums are the same.
FEW_ROWS = 20_000
#: Steps that the search for the weights remembers.
MEMORY = 10
#: Printable ASCII bytes have a frequency each; all others share one.
_FIRST, _LAST = 0x20, 0x7F


def _distinct_share(owner: np.ndarray, hashes: np.ndarray, texts: int, total: np.ndarray) -> np.ndarray:
    """Distinct values over all values, for each text; 1 where there are none."""
    key = np.unique((owner.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)))
    distinct = np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=texts)
    return np.where(total > 0, distinct / np.maximum(total, 1), 1.0)


def features(column: pa.Array) -> np.ndarray:
    """One row of features for each text."""
    raw, at = buffers(column)
    size = np.diff(at)
    texts = len(size)
    owner = np.repeat(np.arange(texts), size)
    classes = np.where((raw >= _FIRST) & (raw < _LAST), raw - (_FIRST - 1), 0).astype(np.int64)
    width = _LAST - _FIRST + 1
    counts = np.bincount(owner * width + classes, minlength=texts * width).reshape(texts, width)
    share = counts / np.maximum(size, 1)[:, None]
    letters = {c: ord(c) - _FIRST + 1 for c in "AZaz"}
    upper = counts[:, letters["A"] : letters["Z"] + 1].sum(axis=1)
    lower = counts[:, letters["a"] : letters["z"] + 1].sum(axis=1)
    data, found = words(column, *byte_table("nonspace", lower=True))
    n = found.count
    belongs = found.text_of()
    pairs = windows_hash(found.hash, 2) if len(found.hash) > 1 else np.zeros(0, np.uint64)
    within = belongs[1:] == belongs[:-1]
    lines_at = np.flatnonzero(raw == 10)
    line_start = np.sort(np.concatenate([at[:-1], lines_at + 1]))
    line_end = np.append(line_start[1:], len(raw))
    line_owner = np.minimum(np.searchsorted(at, line_start, side="right") - 1, texts - 1)
    some = line_end - line_start > 1
    lines = hash_ranges(raw, line_start[some], line_end[some])
    lengths = (found.end - found.start).astype(np.float64)
    mean = np.bincount(belongs, lengths, texts) / np.maximum(n, 1)
    square = np.bincount(belongs, lengths**2, texts) / np.maximum(n, 1)
    tail = data[np.maximum(found.end - 1, 0)] if len(found.end) else np.zeros(0, np.uint8)
    alnum = byte_table("alnum", lower=False)[0]
    odd_end = np.bincount(belongs, ~alnum[tail], texts) / np.maximum(n, 1)
    lone = np.bincount(belongs, (lengths == 1) & ~alnum[tail], texts) / np.maximum(n, 1)
    more = np.stack(
        [
            np.log1p(n), np.log1p(size), mean, np.sqrt(np.maximum(square - mean**2, 0)),
            upper / np.maximum(upper + lower, 1), odd_end, lone,
            _distinct_share(belongs, found.hash, texts, n),
            _distinct_share(belongs[:-1][within], pairs[within], texts, np.maximum(n - 1, 0)),
            _distinct_share(line_owner[some], lines, texts, np.bincount(line_owner[some], minlength=texts)),
            np.log1p(np.bincount(line_owner[some], minlength=texts)),
        ],
        axis=1,
    )
    return np.concatenate([np.sqrt(share), more], axis=1)


@dataclass
class Ranking:
    """Strength = weights . standardised features; the score is logistic around the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float
    constant: float | None = None

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        shift = np.log(CUT_SCORE / (1 - CUT_SCORE))
        z = (self.strength(x) - self.cut) / self.spread + shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: What a block of rows (features, labels) adds to which sums.
Part = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _summed(at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place, which = np.unique(at, return_inverse=True)
    return place, np.bincount(which, value, len(place))


class _Rows:
    """Labelled rows in arrays."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        self.x, self.label = x, label

    def sums(self, part: Part) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the sums, ascending, and the sums over all rows."""
        return _summed(*part(self.x, self.label))

    def cut(self, strength: Callable[[np.ndarray], np.ndarray], share: float) -> tuple[float, float]:
        """A quantile of the strengths, and their deviation."""
        found = strength(self.x)
        return float(np.quantile(found, share)), float(found.std())


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(batch.column("x").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
    return x, np.asarray(batch.column("label"))


class _SparkRows:
    """Labelled rows in a table, ``(label, x)``; each task adds up its own, Spark the tasks' sums."""

    def __init__(self, table: DataFrame):
        self.table = table

    def sums(self, part: Part) -> tuple[np.ndarray, np.ndarray]:
        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, value = np.zeros(0, np.int64), np.zeros(0)
            for batch in batches:
                if batch.num_rows:
                    more = part(*_arrays(batch))
                    at, value = _summed(np.concatenate([at, more[0]]), np.concatenate([value, more[1]]))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(value)], ["at", "value"])

        rows = self.table.mapInArrow(mapped, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value"))
        found = rows.toArrow().sort_by("at")
        return np.asarray(found.column("at")), np.asarray(found.column("value"))

    def cut(self, strength: Callable[[np.ndarray], np.ndarray], share: float) -> tuple[float, float]:
        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(strength(_arrays(batch)[0]))], ["strength"])

        found = distribution(self.table.mapInArrow(mapped, "strength double"), "strength", [], linear={"cut": share}).first()
        return found["cut"], found["std"] * float(np.sqrt((found["n"] - 1) / found["n"]))


def _lost(margin: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -margin)


def _pair_losses(rows: _Rows | _SparkRows, standard: Callable, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean loss over all pairs; points of the grid, each with a label, and the loss of one document there."""

    def counts(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = standard(x) @ weights * GRID
        low = np.floor(place).astype(np.int64)
        share = place - low
        return np.concatenate([2 * low + label, 2 * (low + 1) + label]), np.concatenate([1 - share, share])

    at, count = rows.sums(counts)
    # Python's shift and remainder go down, so they undo the above for negative points too.
    point, good = (at >> 1) / GRID, at % 2 == 1
    loss = np.zeros(len(at))
    for mine, sign in ((good, 1.0), (~good, -1.0)):
        own, other, many = np.flatnonzero(mine), point[~mine], count[~mine]
        for block in np.array_split(own, len(own) // 256 + 1):
            loss[block] = _lost(sign * (point[block][:, None] - other)) @ (many / many.sum())
    return float(loss[good] @ count[good] / count[good].sum()), at, loss


def _pair_slope(
    rows: _Rows | _SparkRows, standard: Callable, weights: np.ndarray, at: np.ndarray, loss: np.ndarray, sizes: np.ndarray
) -> np.ndarray:
    """How the mean loss over all pairs changes with the weights."""

    def slopes(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = standard(x)
        first = 2 * np.floor(z @ weights * GRID).astype(np.int64) + label
        # The two points around a document; rounding may differ from the pass before, by a point without loss.
        low, high = (np.minimum(np.searchsorted(at, first + k), len(at) - 1) for k in (0, 2))
        pull = (loss[high] - loss[low]) * GRID / sizes[label]
        return np.arange(z.shape[1]), pull @ z

    return rows.sums(slopes)[1]


def _fit(rows: _Rows | _SparkRows, width: int, steps: int, decay: float) -> Ranking:
    """Bradley-Terry over all pairs, by steps that remember how the slope has changed (L-BFGS)."""
    at, found = rows.sums(lambda x, label: (np.append(label, np.arange(width) + 2), np.append(np.ones(len(x)), x.sum(axis=0))))
    sizes = np.zeros(width + 2)
    sizes[at] = found
    sizes, mean = sizes[:2], sizes[2:]
    n = sizes.sum()
    if not sizes.all():
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0, float(sizes[1] / n) if n else 0.5)
    mean = mean / n
    scale = np.sqrt(rows.sums(lambda x, label: (np.arange(width), ((x - mean) ** 2).sum(axis=0)))[1] / n)
    scale = np.where(scale > 1e-9, scale, 1.0)

    def standard(x: np.ndarray) -> np.ndarray:
        return np.clip((x - mean) / scale, -8, 8)

    def loss_at(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        mean_loss, at, loss = _pair_losses(rows, standard, weights)
        return mean_loss + decay / 2 * float(weights @ weights), at, loss

    def slope_at(weights: np.ndarray, at: np.ndarray, loss: np.ndarray) -> np.ndarray:
        return _pair_slope(rows, standard, weights, at, loss, sizes) + decay * weights

    weights, past = np.zeros(width), []
    least, *grid = loss_at(weights)
    slope = slope_at(weights, *grid)
    for _ in range(steps):
        way = -_inverse(slope, past)
        falls, size = float(slope @ way), 1.0 if past else 1 / max(1.0, float(np.abs(slope).sum()))
        if falls > -1e-6:
            break
        while True:
            there = weights + size * way
            value, *grid = loss_at(there)
            if value <= least + 1e-4 * size * falls or size < 1e-3:
                break
            size /= 2
        if value >= least:
            break
        after = slope_at(there, *grid)
        moved, bent = there - weights, after - slope
        if moved @ bent > 1e-12:
            past = [*past[1 - MEMORY :], (moved, bent)]
        weights, least, slope = there, value, after
    # The order of additions must not tell.
    weights = np.round(weights, 9)
    cut, deviation = rows.cut(lambda x: standard(x) @ weights, float(sizes[0] / n))
    return Ranking(mean, scale, weights, cut, deviation / 4 or 1.0)


def _inverse(slope: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The slope times the inverse curvature, as far as the past steps tell it."""
    out, shares = slope.copy(), []
    for moved, bent in reversed(past):
        shares.append((moved @ out) / (moved @ bent))
        out -= shares[-1] * bent
    if past:
        moved, bent = past[-1]
        out *= (moved @ bent) / (bent @ bent)
    for (moved, bent), share in zip(past, reversed(shares)):
        out += (share - (bent @ out) / (moved @ bent)) * moved
    return out


def fit_ranking(x: np.ndarray, label: np.ndarray, steps: int = 60, decay: float = 1e-3) -> Ranking:
    """Bradley-Terry over all pairs of a row labelled 1 and one labelled 0."""
    return _fit(_Rows(x, label), x.shape[1], steps, decay)


def train_ranking(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text",
    few_rows: int = FEW_ROWS, steps: int = 60, decay: float = 1e-3,
) -> Ranking:
    """Fit on all labelled documents that are not held out; their features are made in Spark's tasks.

    Texts are never shuffled: labels that fit are broadcast, others meet the features of all documents.
    """
    arrow_batches(docs.sparkSession)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text"))
                flat = pa.array(x.ravel().astype(np.float32))
                offsets = pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(offsets, flat)], ["id", "x"])

    chosen, fits = checked_broadcast(chosen_labels(labels, label, id_col).where(F.col("label").isin(0, 1)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    if fits:
        texts = texts.join(chosen, "id", "left_semi")
    kind = texts.schema["id"].dataType.simpleString()
    table = checkpointed(texts.mapInArrow(mapped, f"id {kind}, x array<float>").join(chosen, "id").select("label", "x"))
    width = features(pa.array([""])).shape[1]
    if table.count() > few_rows:
        return _fit(_SparkRows(table), width, steps, decay)
    rows = table.toArrow()
    flat = rows.column("x").combine_chunks().flatten()
    return fit_ranking(np.asarray(flat, dtype=np.float64).reshape(-1, width), np.asarray(rows.column("label")), steps, decay)


def quality_scores(docs: DataFrame, model: Ranking, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the quality score of every row; a column of that name is replaced."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name != score]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                result = pa.array(shared.value.score(features(part.column(text))))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), result], [*(f.name for f in kept), score]
                )

    return docs.mapInArrow(mapped, T.StructType([*kept, T.StructField(score, T.DoubleType())]))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: whether it is held out, its score, and whether it passes."""
    model = train_ranking(docs, labels)
    scored = quality_scores(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    score = fresh(docs, "score")
    return quality_scores(docs, train_ranking(docs, labels), score=score).where(F.col(score) >= CUT_SCORE).drop(score)
