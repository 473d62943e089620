"""The labelled documents that classifiers are fitted on: all of them, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewatch.llm.tables import held_out

#: Labelled rows a model is fitted on at most, chosen by a hash of the id; the fit needs no more.
MAX_LABELLED = 20_000


def chosen_labels(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, label)`` of all labelled ids that are not held out.

    An id with several labels takes the least; null labels and ids do not count.
    """
    return (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .where(~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(F.col(label).cast("int")).alias("label"))
    )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text: str = "text",
    most: int = MAX_LABELLED,
) -> DataFrame:
    """``(id, text, label)`` of at most ``most`` labelled documents that are not held out.

    The sample has a fixed bound, so it is broadcast to find its texts; of documents that share an id the
    sample keeps all.
    """
    chosen = chosen_labels(labels, label, id_col).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("id", "text", "label")
