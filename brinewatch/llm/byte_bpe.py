"""Byte-level byte-pair encoding with a two-tier lookup, and decoding.

A text is cut into pre-tokens by the rules of the tokenizer's pattern, worked out on arrays of character
classes for many texts at once. The first tier looks all pre-tokens up in a minimal perfect hash of the
vocabulary: a pre-token that is a piece is done. The second tier merges the bytes of all others: neighbours in a
linked list, candidate pairs in a heap by rank and place, until no pair is a piece. Decoding strings the
bytes of the ids' pieces together.

The vocabulary is of fixed size and broadcast; texts are never shuffled, and a lost task is simply run again.

Cases: a null or empty text has no ids and decodes to no bytes; very long texts and pre-tokens cost n log n;
repeated rows give equal rows; a row without id is a row like others; an empty table gives no rows; other
columns pass through, except those with the name of a result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewatch.llm.tables import arrow_batches
from brinewatch.llm.words import buffers, hash_ranges, mix, slices

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE = 1 << 20
#: Merged pre-tokens that a task remembers at most, and their greatest length in bytes.
REMEMBERED, SHORT = 300_000, 64
#: Keys of a bucket of the perfect hash, on average, and shifts that are tried at once, first and later.
BUCKET_KEYS, FIRST_TRIED, MOST_TRIED = 4, 32, 4096
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Planes from here on hold no letters and no numbers.
LAST_LETTERS = 0x40000

_ODD = np.uint64(0x9E3779B97F4A7C15)

RESULT = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.BinaryType()),
    ]
)


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a rank file, by rank."""
    with open(path, "rb") as file:
        ranks = dict((int(n), base64.b64decode(piece)) for piece, n in map(bytes.split, file))
    return [ranks[n] for n in range(len(ranks))]


def character_classes(pattern: str) -> np.ndarray:
    """The class of every code point, as the tokenizer library's own Unicode tables have it.

    Behind ``a`` or ``1`` a character belongs to the same pre-token if it is a letter or a number. Whether
    it does shows in a vocabulary of single bytes and of each of the two with one byte behind it.
    """
    points = np.array([c for c in range(128, LAST_LETTERS) if not 0xD800 <= c < 0xE000])
    characters = [chr(c) for c in points]
    out = np.full(0x110000, OTHER, np.uint8)
    out[[c for c in points if chr(c).isspace()]] = SPACE
    for kind, before in ((LETTER, b"a"), (NUMBER, b"1")):
        pieces = [bytes([b]) for b in range(256)] + [before + bytes([b]) for b in range(0xC2, 0xF5)]
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={p: n for n, p in enumerate(pieces)}, special_tokens={})
        ids = np.array(probe.encode_ordinary("\n" + "\n".join(before.decode() + c for c in characters)))
        out[points[ids[np.flatnonzero(ids == 0x0A) + 1] >= 256]] = kind
    for c in range(128):
        text = chr(c)
        out[c] = LETTER if text.isalpha() else NUMBER if text.isdigit() else SPACE if text in "\t\n\v\f\r " else OTHER
    return out


@dataclass
class Pieces:
    """The vocabulary: pieces behind each other, and a minimal perfect hash from a piece to its id."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    #: By slot: the piece's hash and id. By bucket: what is added to a hash, or minus the slot and one.
    hash: np.ndarray
    id: np.ndarray
    shift: np.ndarray

    @staticmethod
    def of(pieces: list[bytes]) -> Pieces:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        length = np.array([len(p) for p in pieces], np.int64)
        start = np.cumsum(length) - length
        key = hash_ranges(data, start, start + length)
        if len(np.unique(key)) < len(key):
            raise ValueError("pieces repeat")
        slot, shift = _perfect_hash(key)
        by_slot = np.empty_like(key)
        by_slot[slot] = key
        ids = np.empty(len(key), np.int64)
        ids[slot] = np.arange(len(key))
        return Pieces(data, start, length, by_slot, ids, shift)

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The ids of byte ranges that are pieces, -1 for others."""
        key = hash_ranges(data, start, end)
        at = _slots(key, self.shift[key % np.uint64(len(self.shift))], len(self.hash))
        found, length = self.id[at], end - start
        same = (self.hash[at] == key) & (self.length[found] == length)
        # For up to eight bytes of one length, different bytes have different hashes.
        long = np.flatnonzero(same & (length > 8))
        if len(long):
            inner = np.arange(int(length[long].sum())) - np.repeat(np.cumsum(length[long]) - length[long], length[long])
            ours = data[np.repeat(start[long], length[long]) + inner]
            theirs = self.data[np.repeat(self.start[found[long]], length[long]) + inner]
            same[long] = np.logical_and.reduceat(ours == theirs, np.cumsum(length[long]) - length[long])
        return np.where(same, found, -1)

    def text(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids' pieces behind each other, and the length of each."""
        length = self.length[ids]
        inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        return self.data[np.repeat(self.start[ids], length) + inner], length


def _slots(key: np.ndarray, shift: np.ndarray, slots: int) -> np.ndarray:
    moved = mix(key + shift.astype(np.uint64) * _ODD) % np.uint64(slots)
    return np.where(shift < 0, -shift - 1, moved.astype(np.int64))


def _perfect_hash(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A slot for each of the distinct hashes, as many slots as hashes, and the shift of each bucket.

    Buckets are placed by size, each with the first shift that moves all its keys to free slots; keys that
    are alone in their bucket take what is left.
    """
    n = len(key)
    bucket = (key % np.uint64(max(n // BUCKET_KEYS, 1))).astype(np.int64)
    shift = np.zeros(max(n // BUCKET_KEYS, 1), np.int64)
    members = np.split(np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=len(shift)))[:-1])
    slot, free = np.full(n, -1, np.int64), np.ones(n, bool)
    for b in sorted(range(len(members)), key=lambda b: -len(members[b])):
        keys = members[b]
        if len(keys) < 2:
            break
        tried, more = 0, FIRST_TRIED
        while slot[keys[0]] < 0:
            shifts = np.arange(tried, tried + more)
            moved = (mix(key[keys][None, :] + shifts[:, None].astype(np.uint64) * _ODD) % np.uint64(n)).astype(np.int64)
            for first in np.flatnonzero(free[moved].all(axis=1)):
                if len(set(moved[first].tolist())) == len(keys):
                    slot[keys], shift[b] = moved[first], shifts[first]
                    free[moved[first]] = False
                    break
            tried, more = tried + more, min(4 * more, MOST_TRIED)
    left = iter(np.flatnonzero(free))
    for b, keys in enumerate(members):
        if len(keys) == 1:
            place = int(next(left))
            slot[keys[0]], shift[b] = place, -place - 1
    return slot, shift


def pre_tokens(data: np.ndarray, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts begin; text ``i`` is ``data[at[i]:at[i + 1]]``.

    Runs of letters, of numbers and of other signs are pre-tokens, with a blank in front of them if there
    is one; ``'s``, ``'t``, ``'re``, ``'ve``, ``'m``, ``'ll`` and ``'d`` are, where no such run holds their
    quote; so is white space, apart from its last sign if something follows.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[place]
    point = lead.astype(np.int32)
    wide = np.flatnonzero(lead >= 0x80)
    if len(wide):
        tail = np.concatenate([data, np.zeros(3, np.uint8)])
        one, two, three = (tail[place[wide] + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
        first = point[wide]
        point[wide] = np.where(
            first < 0xE0, (first & 0x1F) << 6 | one,
            np.where(first < 0xF0, (first & 0x0F) << 12 | one << 6 | two, (first & 0x07) << 18 | one << 12 | two << 6 | three),
        )
    kind = classes[point]
    # One more sign behind the last, so that every sign has two behind it.
    new = np.zeros(len(place) + 2, bool)
    new[np.searchsorted(place, at)] = True
    start = new.copy()
    start[1:-2] |= kind[1:] != kind[:-1]
    blank_end = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~new[1:-2])
    start[blank_end] = True
    joined = blank_end[lead[blank_end] == 0x20]
    start[joined + 1] = False
    quote = np.flatnonzero((lead == 0x27) & start[:-2])
    if len(quote):
        sign = np.append(lead, np.zeros(2, np.uint8))
        second = np.where(new[quote + 1], 0, sign[quote + 1])
        third = np.where((second == 0) | new[np.minimum(quote + 2, len(place) + 1)], 0, sign[np.minimum(quote + 2, len(place) + 1)])
        short = np.isin(second, np.frombuffer(b"stmd", np.uint8))
        long = ((third == ord("e")) & ((second == ord("r")) | (second == ord("v")))) | ((second == ord("l")) & (third == ord("l")))
        start[quote[short | long] + 1] = False
        start[quote[long] + 2] = False
        start[quote[short] + 2] = True
        start[np.minimum(quote[long] + 3, len(place))] = True
    return place[start[: len(place)]]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a byte string that is no piece: the pair of least rank is merged first, the leftmost of equals.

    A part is known by its first byte. ``end`` and ``before`` link the parts; ``pair`` holds the rank of a
    part with the part behind it, -1 for none, and tells which entries of the heap still hold.
    """
    n, rank_of = len(piece), ranks.get
    end, before = list(range(1, n + 1)), list(range(-1, n))
    pair = [rank_of(piece[a : a + 2], -1) for a in range(n - 1)]
    pair.append(-1)
    heap = [rank * n + a for a, rank in enumerate(pair) if rank >= 0]
    heapq.heapify(heap)
    while heap:
        rank, a = divmod(heapq.heappop(heap), n)
        if pair[a] != rank:
            continue
        b = end[a]
        c = end[a] = end[b]
        pair[a] = pair[b] = -1
        before[c] = a
        if c < n:
            pair[a] = rank_of(piece[a : end[c]], -1)
            if pair[a] >= 0:
                heapq.heappush(heap, pair[a] * n + a)
        if a:
            p = before[a]
            pair[p] = rank_of(piece[p:c], -1)
            if pair[p] >= 0:
                heapq.heappush(heap, pair[p] * n + p)
    out, a = [], 0
    while a < n:
        out.append(ranks[piece[a : end[a]]])
        a = end[a]
    return out


class Encoder:
    """Encodes columns of texts in a task; merged pre-tokens are remembered."""

    def __init__(self, pieces: Pieces, classes: np.ndarray):
        self.pieces, self.classes = pieces, classes
        raw = pieces.data.tobytes()
        self.ranks = {raw[s : s + k]: n for n, (s, k) in enumerate(zip(pieces.start.tolist(), pieces.length.tolist()))}
        self.known: dict[bytes, list[int]] = {}

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and where each text's begin."""
        data, at = buffers(column)
        start = pre_tokens(data, at, self.classes)
        end = np.append(start[1:], len(data))
        found = self.pieces.find(data, start, end) if len(start) else np.zeros(0, np.int64)
        missed = np.flatnonzero(found < 0)
        raw = data.tobytes() if len(missed) else b""
        missing = [raw[a:b] for a, b in zip(start[missed].tolist(), end[missed].tolist())]
        merged = [self.known.get(piece) or self._merged(piece) for piece in missing]
        count = np.ones(len(start), np.int64)
        count[missed] = [len(m) for m in merged]
        place = np.concatenate([[0], np.cumsum(count)])
        ids = np.repeat(found, count)
        inside = np.repeat(found < 0, count)
        ids[inside] = np.fromiter(chain.from_iterable(merged), np.int64, int(count[missed].sum()))
        return ids, place[np.searchsorted(start, at)]

    def _merged(self, piece: bytes) -> list[int]:
        ids = merge(piece, self.ranks)
        if len(piece) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids


def _binaries(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def byte_bpe_round_trip(docs: DataFrame, pieces: list[bytes], pattern: str, text: str = "text") -> DataFrame:
    """``docs`` without their ``text``, with ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded``."""
    arrow_batches(docs.sparkSession)
    kept = [f for f in docs.schema if f.name not in (*RESULT.names, text)]
    shared = docs.sparkSession.sparkContext.broadcast((Pieces.of(pieces), character_classes(pattern)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                ids, at = encoder.encode(part.column(text))
                data, length = encoder.pieces.text(ids)
                ends = np.concatenate([[0], np.cumsum(length)])[at]
                columns = [part.column(f.name) for f in kept]
                columns += [pa.array(np.diff(at)), _binaries(ids.astype("<u4"), at * 4), _binaries(data, ends)]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *RESULT.names])

    source = docs.select(*(f.name for f in kept), F.col(text).cast("string").alias(text))
    return source.mapInArrow(work, T.StructType([*kept, *RESULT.fields]))


def byte_bpe_report(docs: DataFrame, pieces: list[bytes], pattern: str) -> DataFrame:
    """One row per document: number of tokens, digests of the ids and of the decoded bytes."""
    done = byte_bpe_round_trip(docs.select("doc_id", "text"), pieces, pattern)
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
