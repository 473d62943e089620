"""Near-duplicate classes by ProbMinHash of weighted word shingles, banding and exact verification.

Every shingle of five words (lower-cased letters and digits) has a Poisson process of arrivals whose rate
is its weight, 1 + ln(occurrences). Each arrival falls on one of the signature's places, which keep their
earliest arrival; a shingle stops as soon as its next arrival comes later than all places' records. Two
texts agree in a place with the probability of their probability Jaccard similarity. That may lie far below
the plain one where one text repeats a passage more often, so a text with repeated shingles also has the
bands of the signature that gives every shingle weight 1, whose places agree with the probability of the plain
Jaccard similarity. The arrivals are the same, so the two signatures of a text without repeats are equal.

Texts with equal shingles are one node, so copies cost one row each. Nodes that share a band are candidates.
Within a band one member is the centre and meets the others; that repeats with other centres for bands that
still hold several components, and at last the pairs of different components left in a band are compared.
From the second round on, pairs are left out that cannot reach the threshold: a shingle that no other
member of such bands has is in no intersection, so the number of shared shingles bounds the similarity. So no
band is expanded into all its pairs, and no link that would join two components is lost. A candidate is a
link when the exact Jaccard similarity of its sets of shingles reaches the threshold. Classes are the
connected components of links.

Cases: a text of fewer than five words is one shingle; a text without words, or null, is in no class but
its own; a row without id matches copies only and names no class; repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewatch.llm.components import components
from brinewatch.llm.tables import arrow_batches
from brinewatch.llm.words import byte_table, list_column, mix, slices, windows_hash, words
from brinewatch.session import checkpointed

SHINGLE = 5
SIMILARITY = 0.8
#: At plain similarity 0.8 a pair shares none of the 20 bands of 4 places of weight 1 with a probability of 3e-5.
BANDS, ROWS = 20, 4
#: Rounds in which a band's members meet one centre, before the pairs left over are compared: any member
#: first, then the one with the largest share of shingles that others have, then another one.
CENTRE_ROUNDS = 3

_TOP = np.uint64(48)
_LOW = np.uint64((1 << 48) - 1)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, shingle, occurrences)``, ordered, one entry for each distinct shingle of each text."""
    _, found = words(column, *byte_table("alnum", lower=True))
    count, first = found.count, found.first[:-1]
    number = np.maximum(count - k + 1, 0)
    text = np.repeat(np.arange(len(count)), number)
    start = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    shingle = windows_hash(found.hash, k)[start] if len(start) else np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = np.array(
            [windows_hash(found.hash[first[i] : first[i] + count[i]], count[i])[0] for i in short], np.uint64
        )
        text, shingle = np.concatenate([text, short]), np.concatenate([shingle, whole])
    # 16 bits for the text within its slice, 48 for the shingle: one sort orders both.
    key, times = np.unique((text.astype(np.uint64) << _TOP) | (shingle >> np.uint64(16)), return_counts=True)
    return (key >> _TOP).astype(np.int64), key & _LOW, times


def signatures(
    text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, places: int
) -> np.ndarray:
    """ProbMinHash: for each text and place the shingle (32 bits of it) that arrives there first."""
    record = np.full(texts * places, np.inf)
    holder = np.zeros(texts * places, np.uint32)
    clock = np.zeros(len(text))
    live = np.arange(len(text))
    arrival = 0
    while len(live):
        arrival += 1
        draw = mix(shingle[live] + np.uint64(arrival * 0xA0761D6478BD642F % 2**64))
        clock[live] -= np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight[live]
        place = text[live] * places + (mix(draw) % np.uint64(places)).astype(np.int64)
        when = clock[live]
        np.minimum.at(record, place, when)
        won = record[place] == when
        holder[place[won]] = mix(shingle[live[won]]).astype(np.uint32)
        # Early termination: nothing later than the text's latest record can change it.
        owners, which = np.unique(text[live], return_inverse=True)
        latest = record.reshape(texts, places)[owners].max(axis=1)
        live = live[when < latest[which]]
    return holder.reshape(texts, places)


def _sums(values: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Sums modulo 2^64 of the values of each text."""
    total = np.zeros(texts, np.uint64)
    if len(values):
        edge = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        total[text[edge]] = np.add.reduceat(values, edge)
    return total


def node_keys(text: np.ndarray, shingle: np.ndarray, times: np.ndarray, texts: int) -> list[bytes | None]:
    """128 bits that are equal for texts with equal shingles and occurrences; None without any."""
    one = _sums(mix(shingle + np.uint64(1) + (times.astype(np.uint64) << _TOP)), text, texts)
    two = _sums(mix(mix(shingle + np.uint64(7)) ^ times.astype(np.uint64)), text, texts)
    some = np.bincount(text, minlength=texts) > 0
    raw = np.stack([one, two], axis=1).astype(">u8").tobytes()
    return [raw[16 * i : 16 * i + 16] if some[i] else None for i in range(texts)]


def _bands(held: np.ndarray) -> np.ndarray:
    """A hash of each band's places, one row of bands for each text."""
    band = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1), len(held), axis=0)
    for i in range(ROWS):
        band = mix(band ^ held[:, i::ROWS].astype(np.uint64))
    return band


def band_lists(text: np.ndarray, shingle: np.ndarray, times: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bands, one list behind the other, and how many each has: of weight 1, then weighted ones that differ."""
    plain = _bands(signatures(text, shingle, np.ones(len(text)), texts, BANDS * ROWS))
    weighted = plain.copy()
    uneven = np.bincount(text[times > 1], minlength=texts) > 0
    if uneven.any():
        mine = uneven[text]
        number = np.cumsum(uneven) - 1
        held = signatures(number[text[mine]], shingle[mine], 1 + np.log(times[mine]), int(uneven.sum()), BANDS * ROWS)
        weighted[uneven] = _bands(held)
    some = np.bincount(text, minlength=texts) > 0
    keep = np.concatenate([np.ones_like(plain, bool), weighted != plain], axis=1) & some[:, None]
    return np.concatenate([plain, weighted], axis=1)[keep], keep.sum(axis=1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, node, bands)."""
    for batch in batches:
        for part in slices(batch, "text"):
            for at in range(0, part.num_rows, 1 << 15):
                piece = part.slice(at, 1 << 15)
                rows = piece.num_rows
                text, shingle, times = shingle_sets(piece.column("text"))
                band, number = band_lists(text, shingle, times, rows)
                bands = list_column(pa.array(band.view(np.int64)), number)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(node_keys(text, shingle, times, rows), pa.binary()), bands],
                    ["id", "node", "bands"],
                )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (node, shingles); 32 bits of each shingle are kept."""
    for batch in batches:
        for part in slices(batch, "text"):
            for at in range(0, part.num_rows, 1 << 15):
                piece = part.slice(at, 1 << 15)
                text, shingle, times = shingle_sets(piece.column("text"))
                kept = pa.array((shingle >> np.uint64(16)).astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node_keys(text, shingle, times, piece.num_rows), pa.binary()),
                        list_column(kept, np.bincount(text, minlength=piece.num_rows)),
                    ],
                    ["node", "shingles"],
                )


def _links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) whose sets reach the similarity; written, as later steps use it twice."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"
    )
    shared = F.size(F.array_intersect("x", "y"))
    total = F.size("x") + F.size("y") - shared
    return checkpointed(both.where(shared >= F.lit(similarity) * total).select("a", "b"))


def _relabel(members: DataFrame, links: DataFrame) -> DataFrame:
    """Give the members of linked components one component."""
    ends = [members.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")).distinct() for x in "ab"]
    joined = links.join(ends[0], "a").join(ends[1], "b").select("ca", "cb")
    renamed = components(joined, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = members.join(renamed, "component", "left")
    rest = [c for c in members.columns if c != "component"]
    return checkpointed(moved.select(*rest, F.coalesce("to", "component").alias("component")))


def _mixed(members: DataFrame) -> DataFrame:
    """Members of bands that hold several components."""
    mixed = members.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    return members.join(mixed.where("x < y").select("band"), "band")


def _bounded(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Members with the number of their shingles, and of those that other members have as well.

    A member without enough of the latter for any partner goes. Counting by a hash of the node can only
    overstate what it shares.
    """
    nodes = members.select("node").distinct()
    listed = sets.join(nodes, "node").select("node", F.xxhash64("node").alias("k"), "shingles")
    each = listed.select("k", F.explode("shingles").alias("s"))
    common = each.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s")
    shared = each.join(common, "s").groupBy("k").agg(F.count(F.lit(1)).alias("shared"))
    sized = listed.select("node", "k", F.size("shingles").alias("size")).join(shared, "k")
    able = sized.where(F.col("shared") >= F.lit(similarity) * F.col("size")).select("node", "size", "shared")
    return checkpointed(members.join(able, "node"))


def _possible(size: str, shared: str, other_size: str, other_shared: str, similarity: float):
    """Whether two sets can reach the similarity, given what each shares with any other."""
    most = F.least(shared, other_shared)
    return most >= F.lit(similarity) * (F.col(size) + F.col(other_size) - most)


def _with_centre(members: DataFrame, turn: int, similarity: float) -> DataFrame:
    """Pairs of each mixed band's centre with the members of other components."""
    first = F.xxhash64("node", F.lit(turn))
    known = "shared" in members.columns
    order = F.struct(-F.col("shared") / F.col("size"), first) if known and turn == 1 else first
    parts = ["node", "component", *(["size", "shared"] if known else [])]
    centre = F.min_by(F.struct(*(F.col(c).alias(f"c_{c}") for c in parts)), order)
    mixed = members.groupBy("band").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), centre.alias("c")
    )
    met = members.join(mixed.where("x < y").select("band", "c.*"), "band").where("component <> c_component")
    if known:
        met = met.where(_possible("size", "shared", "c_size", "c_shared", similarity))
    return met.select(F.least("c_node", "node").alias("a"), F.greatest("c_node", "node").alias("b"))


def _left_over(members: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """All possible pairs of different components that share a band, each in the first band it shares."""
    left = _mixed(members).join(nodes.select("node", "bands"), "node")
    other = left.select(*(F.col(c).alias(f"o_{c}") for c in ("band", "node", "component", "size", "shared", "bands")))
    able = _possible("size", "shared", "o_size", "o_shared", similarity)
    able = able & (F.element_at(F.array_intersect("bands", "o_bands"), 1) == F.col("band"))
    pairs = left.join(other, (F.col("band") == F.col("o_band")) & (F.col("component") < F.col("o_component")) & able)
    return pairs.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """``(id_col, class_id)`` for every row; ``class_id`` is the least id of its near-duplicate class."""
    arrow_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    sketch = checkpointed(source.mapInArrow(_sketch, f"id {kind}, node binary, bands array<bigint>"))
    # One node for all copies; any copy's bands will do.
    nodes = sketch.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "bands")).alias("one")
    )
    nodes = checkpointed(nodes.select("node", F.col("one.id").alias("id"), F.col("one.bands").alias("bands")))
    banded = nodes.select(F.explode("bands").alias("band"), "node")
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    members = checkpointed(banded.join(shared, "band").select("band", "node", F.col("node").alias("component")))
    # Texts of candidates only; texts are read again rather than keeping all sets.
    wanted = members.select("node").distinct().join(nodes.select("node", "id"), "node").select("id").distinct()
    again = source.join(wanted, "id", "left_semi").select("text")
    sets = again.mapInArrow(_sets, "node binary, shingles array<int>").where("node is not null")
    sets = checkpointed(sets.groupBy("node").agg(F.first("shingles").alias("shingles")))
    everyone, tested = members, None
    for turn in range(CENTRE_ROUNDS + 1):
        if turn == 1:
            members = _bounded(_mixed(members), sets, similarity)
        last = turn == CENTRE_ROUNDS
        pairs = (_left_over(members, nodes, similarity) if last else _with_centre(members, turn, similarity)).distinct()
        pairs = checkpointed(pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs)
        tested = pairs if tested is None else tested.union(pairs)
        if pairs.isEmpty():
            continue
        links = _links(pairs, sets, similarity)
        if links.isEmpty():
            continue
        everyone = _relabel(everyone, links)
        if turn:
            again = everyone.select("node", "component").distinct()
            members = checkpointed(members.drop("component").join(again, "node"))
        else:
            members = everyone
    members = everyone
    joined = members.select("node", "component").distinct()
    grouped = nodes.select("node", "id").join(joined, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    least = grouped.groupBy("component").agg(F.min("id").alias("class_id"))
    classes = grouped.join(least, "component").select("node", "class_id")
    return (
        sketch.select("id", "node")
        .join(classes, "node", "left")
        .select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"))
    )
