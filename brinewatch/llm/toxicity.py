"""Toxicity scores by a factorization machine over hashed terms.

A document is the set of its hashed terms: lower-cased words of the whole text, and beginnings of words, as
endings vary. Its score is logistic in ``w0 + sum(w_i) + sum over pairs <v_i, v_j>``: the vectors ``v`` learn what
two terms mean together, such as an insult with the mention of a group, which no sum of weights can.

Cases: a null text counts as empty, its score is that of ``w0``; repeated rows score alike; without labels
the score is 0.5; ids may be null (then not held out).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewatch.llm.labelled import MAX_LABELLED, labelled_sample
from brinewatch.llm.tables import arrow_batches, held_out
from brinewatch.llm.words import byte_table, hash_ranges, list_column, slices, words

BITS, FACTORS = 18, 8
#: Beginnings of words that are terms too, in bytes.
BEGINNINGS = (4, 5, 6)
#: A term must occur in so many documents of the sample to have a weight and a vector.
LEAST_DOCUMENTS = 5
#: Terms learn at full pace if the labels of their documents lie so many deviations away from what the share of
#: toxic ones leads to expect, others at the square of their part of it, and at this least part.
FULL_PACE, LEAST_PACE = 6.0, 0.02


def terms(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """``(text, term)`` for each distinct hashed term of each text, ordered."""
    data, found = words(column, *byte_table("alnum", lower=True))
    owner = found.text_of()
    texts, hashed = [owner], [found.hash]
    for size in BEGINNINGS:
        long = np.flatnonzero(found.end - found.start > size)
        texts.append(owner[long])
        hashed.append(hash_ranges(data, found.start[long], found.start[long] + size) + np.uint64(size))
    text = np.concatenate(texts).astype(np.uint64)
    key = np.unique((text << np.uint64(bits)) | (np.concatenate(hashed) >> np.uint64(64 - bits)))
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def _sums(values: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Row sums of ``values`` by text; ``text`` is ordered."""
    out = np.zeros((texts, *values.shape[1:]), values.dtype)
    if len(text):
        edge = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        out[text[edge]] = np.add.reduceat(values, edge, axis=0)
    return out


@dataclass
class FactorizationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, text: np.ndarray, term: np.ndarray, texts: int) -> np.ndarray:
        # Terms without a weight or vector add nothing.
        known = (self.linear[term] != 0) | self.factors[term].any(axis=1)
        text, term = text[known], term[known]
        v = self.factors[term]
        both = _sums(v, text, texts) ** 2 - _sums(v**2, text, texts)
        return self.bias + _sums(self.linear[term], text, texts) + 0.5 * both.sum(axis=1)

    def score(self, column: pa.Array) -> np.ndarray:
        margin = self.margin(*terms(column), len(column))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit_machine(
    text: np.ndarray, term: np.ndarray, label: np.ndarray, bits: int = BITS, epochs: int = 12, rate: float = 0.1,
    decay: float = 2e-4, batch: int = 256,
) -> FactorizationMachine:
    """Adagrad on the logistic loss in small batches of documents; the seed is fixed."""
    size, texts = 1 << bits, len(label)
    random = np.random.default_rng(11)
    linear = np.zeros(size, np.float32)
    if not texts:
        return FactorizationMachine(0.0, linear, np.zeros((size, FACTORS), np.float32))
    share = min(max(float(label.mean()), 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    documents = np.bincount(term, minlength=size)
    toxic = np.bincount(term[label.astype(bool)[text]], minlength=size)
    # How many deviations the toxic documents with a term lie away from what the share leads to expect.
    apart = np.abs(toxic - share * documents) / np.sqrt(share * (1 - share) * documents + 1)
    used = documents >= max(min(LEAST_DOCUMENTS, texts), 1)
    # All terms learn, but what may be chance learns slowly, so that many such terms do not outweigh the others.
    pace = (np.clip(apart / FULL_PACE, LEAST_PACE, 1.0) ** 2).astype(np.float32)
    factors = np.where(used[:, None], random.normal(0, 0.01, (size, FACTORS)), 0).astype(np.float32)
    keep = used[term]
    text, term = text[keep], term[keep]
    begin = np.searchsorted(text, np.arange(texts + 1, dtype=text.dtype))
    seen_linear, seen_factors, seen_bias = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = random.permutation(texts)
        for low in range(0, texts, batch):
            chosen = order[low : low + batch]
            count = begin[chosen + 1] - begin[chosen]
            row = np.repeat(np.arange(len(chosen)), count)
            at = begin[chosen][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            ids = term[at]
            v = factors[ids]
            total = _sums(v, row, len(chosen))
            margin = bias + _sums(linear[ids], row, len(chosen)) + 0.5 * (total**2 - _sums(v**2, row, len(chosen))).sum(1)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[chosen]).astype(np.float32)
            distinct, which = np.unique(ids, return_inverse=True)
            g_linear = np.bincount(which, slope[row], len(distinct)) + decay * linear[distinct]
            pull = slope[row, None] * (total[row] - v)
            g_factors = np.stack([np.bincount(which, pull[:, f], len(distinct)) for f in range(FACTORS)], axis=1)
            g_factors = g_factors + decay * factors[distinct]
            seen_linear[distinct] += g_linear**2
            seen_factors[distinct] += g_factors**2
            linear[distinct] -= rate * pace[distinct] * g_linear / np.sqrt(seen_linear[distinct])
            factors[distinct] -= 0.2 * rate * pace[distinct, None] * g_factors / np.sqrt(seen_factors[distinct])
            g_bias = float(slope.sum())
            seen_bias += g_bias**2
            bias -= rate * g_bias / np.sqrt(seen_bias)
    return FactorizationMachine(bias, linear, factors)


def train_machine(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text",
    most: int = MAX_LABELLED,
) -> FactorizationMachine:
    """Fit on a bounded sample of labelled documents; their terms are hashed in Spark's tasks."""
    arrow_batches(docs.sparkSession)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, term = terms(part.column("text"))
                listed = list_column(pa.array(term.astype(np.int32)), np.bincount(text, minlength=part.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), listed], ["id", "label", "terms"]
                )

    sample = labelled_sample(docs, labels, label, id_col, text, most)
    kind = sample.schema["id"].dataType.simpleString()
    rows = sample.mapInArrow(mapped, f"id {kind}, label int, terms array<int>").toArrow().sort_by("id")
    listed = rows.column("terms").combine_chunks()
    if not len(rows):
        return fit_machine(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    # Numbers of 32 bits: the sample's terms are the largest thing the driver holds.
    label, sizes, term = np.asarray(rows.column("label")), np.asarray(listed.value_lengths()), np.asarray(listed.flatten())
    del rows
    return fit_machine(np.repeat(np.arange(len(label), dtype=np.int32), sizes), term, label)


def toxicity_scores(docs: DataFrame, model: FactorizationMachine, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the toxicity score of every row; a column of that name is replaced."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name != score]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                result = pa.array(shared.value.score(part.column(text)).astype(np.float64))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), result], [*(f.name for f in kept), score]
                )

    return docs.mapInArrow(mapped, T.StructType([*kept, T.StructField(score, T.DoubleType())]))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: whether it is held out, its score, and whether it counts as toxic."""
    scored = toxicity_scores(docs.select("doc_id", "text"), train_machine(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
