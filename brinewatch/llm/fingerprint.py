"""Document fingerprints: a homomorphic multiset hash of paragraphs, in SQL functions only.

A text's pieces are its paragraphs (lines), cut further at sentence ends. Each piece is hashed to a wide
vector and the vectors are summed lane by lane, each lane modulo a power of two. So the order of pieces does
not matter, equal multisets have equal vectors, and a piece is inserted or deleted by adding or subtracting
its vector. There are counting lanes, where a hash bit says whether the piece counts, lanes of 31 random bits, and
one that counts all pieces, each modulo 2^31. Two lanes share a number. A text has less than 2^31 bytes and so less
than 2^30 pieces: copies of a piece never cancel out, and no text's counts wrap.

The likeness of two fingerprints is the cosine of their counting lanes as +1/-1 sums, which estimates the
cosine of the multisets of pieces: 1 for equal ones, about 0 for unrelated ones.

Rows are ordered by id, then by a hash of the text, so that an id of many rows, or a missing one, takes many ranges.

Cases: a null or empty text has no pieces and the zero vector; likeness of two zero vectors is 1, of a zero
vector and another 0; rows with equal ids are ordered by their texts' hashes; rows without id come first.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of two counting lanes, in steps of 31 that one 64-bit hash gives.
COUNTING = 60
#: Numbers of two random lanes.
RANDOM = 12
#: Two lanes of 31 bits.
WIDTH = 31
LANES = (0, WIDTH)
_ONES = sum(1 << s for s in LANES)
_LOW = sum(((1 << (WIDTH - 1)) - 1) << s for s in LANES)
_TOP = sum((1 << (WIDTH - 1)) << s for s in LANES)
_ALL = (1 << (2 * WIDTH)) - 1
#: Rows of one range of ids, about, and the number of ranges from which on ranges grow instead.
BUCKET_ROWS, MOST_RANGES = 1000, 250_000


def pieces(text: Column) -> Column:
    """Paragraphs, cut after sentence ends; white space around them and empty ones do not count."""
    cut = F.transform(F.split(text, r"\n+|(?<=[.?])\s+", -1), lambda p: F.trim(p))
    return F.filter(cut, lambda p: F.length(p) > 0)


def piece_vector(piece: Column) -> Column:
    """The numbers that a piece adds: counting lanes from bits of a few hashes, then random lanes."""
    numbers = [
        F.shiftrightunsigned(F.xxhash64(piece, F.lit(i // WIDTH)), i % WIDTH).bitwiseAND(F.lit(_ONES))
        for i in range(COUNTING)
    ]
    numbers += [F.xxhash64(piece, F.lit(100 + i)).bitwiseAND(F.lit(_ALL)) for i in range(RANDOM)]
    return F.array(*numbers, F.lit(_ONES))


def lane_sum(a: Column, b: Column) -> Column:
    """Add two lanes modulo 2^31 each: the low 30 bits with carry, the top bit apart."""
    low = a.bitwiseAND(F.lit(_LOW)) + b.bitwiseAND(F.lit(_LOW))
    return low.bitwiseXOR(a.bitwiseXOR(b).bitwiseAND(F.lit(_TOP)))


def insert(vector: Column, piece: Column) -> Column:
    """The vector of a multiset with one more piece."""
    return F.zip_with(vector, piece_vector(piece), lane_sum)


def delete(vector: Column, piece: Column) -> Column:
    """The vector of a multiset with one piece less: add each lane's negative, one more than its complement."""
    negative = lambda x: lane_sum(x.bitwiseXOR(F.lit(_ALL)), F.lit(_ONES))
    return F.zip_with(vector, piece_vector(piece), lambda v, x: lane_sum(v, negative(x)))


def fingerprint_vector(text: Column) -> Column:
    zero = F.array_repeat(F.lit(0).cast("long"), COUNTING + RANDOM + 1)
    return F.aggregate(pieces(text), zero, insert)


def shown(vector: Column) -> Column:
    """The whole vector as hexadecimal text."""
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def signs(vector: Column) -> Column:
    """Counting lanes as sums of +1 and -1 over all pieces, modulo 2^31 around zero."""
    lane = lambda x, s: F.shiftright(x, s).bitwiseAND(F.lit((1 << WIDTH) - 1))
    count = lane(F.element_at(vector, -1), 0)
    flat = F.flatten(F.transform(F.slice(vector, 1, COUNTING), lambda x: F.array(*(lane(x, s) for s in LANES))))
    return F.transform(flat, lambda ones: F.pmod(2 * ones - count + (1 << (WIDTH - 1)), F.lit(1 << WIDTH)) - (1 << (WIDTH - 1)))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two arrays of signed lanes, at least 0."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v
    )
    both = F.sqrt(dot(a, a) * dot(b, b))
    equal = F.when(a == b, 1.0).otherwise(0.0)
    return F.when(both > 0, F.least(F.greatest(dot(a, b) / both, F.lit(0.0)), F.lit(1.0))).otherwise(equal)


def with_next(docs: DataFrame, id_col: str, values: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with the ``values`` of the next row by ``id_col`` (after the last one the first's), as ``next_*``.

    Rows are dealt into ranges of ids, and of hashes of the first value below an id that fills several ranges, by
    one exchange. The ranges begin at ids and hashes of the table, so the first rows of a range are known by
    them: they also go to the range before, behind its own rows, where a window's lead finds them. The first
    range's go behind the last range.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    total, least = docs.agg(F.count(F.lit(1)), F.min(key)).first()
    if not total:
        least = 0
    ranges = min(max(total // bucket_rows, 1), MOST_RANGES)
    share = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx(key, share, 100_000).alias("b")).first()["b"] if share else []
    times = Counter(found or [])
    keyed = docs.withColumn("_key", key).withColumn("_hash", F.xxhash64(values[0]))
    # An id that is several quantiles is cut at hashes: evenly, then at the least hash that occurs in each part.
    cut = {k: n + 1 for k, n in times.items() if n > 1}
    parts = []
    if cut:
        many = docs.sparkSession.createDataFrame([(k, n) for k, n in cut.items()], "_key bigint, _parts bigint")
        # The hash's upper 31 bits in signed order, from 0.
        part = F.floor((F.shiftright("_hash", 33) + (1 << 30)) * F.col("_parts") / (1 << 31))
        firsts = keyed.select("_key", "_hash").join(F.broadcast(many), "_key").groupBy("_key", part.alias("p"))
        parts = [(r["_key"], r["h"]) for r in firsts.agg(F.min("_hash").alias("h")).collect()]
    pairs = sorted({(k, -(2**63)) for k in (least, *times) if k not in cut} | set(parts))
    bounds, hashes = (np.array(x, dtype=np.int64) for x in zip(*pairs))
    # Look up in two steps of about the square root of the number of bounds.
    step = int(np.ceil(np.sqrt(len(bounds))))
    reached = lambda ids, low: F.size(F.filter(
        ids, lambda b, i: (b < F.col("_key")) | ((b == F.col("_key")) & (F.get(low, i) <= F.col("_hash")))
    ))
    coarse = reached(F.lit(bounds[::step]), F.lit(hashes[::step]))
    begin = (coarse - 1) * step + 1
    fine = reached(F.slice(F.lit(bounds), begin, step), F.slice(F.lit(hashes), begin, step))
    keyed = keyed.withColumn("_range", (coarse - 1) * step + fine)
    own_hash = F.element_at(F.lit(hashes), F.col("_range"))
    first = (F.element_at(F.lit(bounds), F.col("_range")) == F.col("_key")) & (
        (own_hash == F.col("_hash")) | (own_hash == -(2**63))
    )
    before = F.when(F.col("_range") > 1, F.col("_range") - 1).otherwise(F.lit(len(bounds)))
    own = F.struct(F.lit(0).alias("turn"), F.col("_range").alias("range"))
    copy = F.struct(F.when(F.col("_range") > 1, 1).otherwise(2).alias("turn"), before.alias("range"))
    placed = keyed.withColumn("_at", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))))
    order = Window.partitionBy("_at.range").orderBy("_at.turn", "_key", "_hash", *values)
    leads = {f"next_{v}": F.lead(v).over(order) for v in values}
    return placed.withColumns(leads).where("_at.turn = 0").drop("_key", "_hash", "_range", "_at")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and likenesses to it and to the next document's.

    The edited text has its last half replaced by as many first characters of the next document.
    """
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vectors = source.withColumn("vector", fingerprint_vector(F.col("text")))
    near = with_next(vectors, "doc_id", ["text", "vector"])
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.left("text", size - half), F.left("next_text", half))
    done = near.select("doc_id", size.cast("long").alias("n_chars"), edited.alias("edited"), "vector", "next_vector")
    done = done.withColumn("edited_vector", fingerprint_vector(F.col("edited")))
    signed = {f"{v}_signs": signs(F.col(v)) for v in ("vector", "edited_vector", "next_vector")}
    done = done.withColumns(signed)
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("vector")).alias("fingerprint"),
        shown(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector_signs"), F.col("edited_vector_signs")).alias("near_edited"),
        likeness(F.col("vector_signs"), F.col("next_vector_signs")).alias("near_next"),
    )
