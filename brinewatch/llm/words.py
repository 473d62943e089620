"""Words of whole texts as numpy arrays, taken straight from Arrow's UTF-8 buffers.

A record batch is cut into slices of bounded size, so memory follows the slice (or the longest single
text), not the batch. Word rules are byte rules: every byte of a non-ASCII character belongs to a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text makes a slice of its own.
SLICE_BYTES = 2 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def byte_table(word: str, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(is_word, folded)`` for each byte; ``word`` is ``alnum`` or ``nonspace``."""
    is_word = np.zeros(256, dtype=bool)
    if word == "alnum":
        for a, b in (("0", "9"), ("A", "Z"), ("a", "z")):
            is_word[ord(a) : ord(b) + 1] = True
        is_word[128:] = True
    else:
        is_word[:] = True
        is_word[[0x20, *range(0x09, 0x0E)]] = False
    folded = np.arange(256, dtype=np.uint8)
    if lower:
        folded[ord("A") : ord("Z") + 1] += 32
    return is_word, folded


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch by bytes of ``text``; every slice has at least one row."""
    _, at = buffers(batch.column(text))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(at, at[row] + max_bytes, side="right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield batch.slice(row, end - row)
        row = end


@dataclass
class Words:
    """The words of some texts: byte ranges, 64-bit hashes, and the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes a step for all ranges that still have some."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    length = end - start
    h = mix(length.astype(np.uint64) + _ODD)
    live, step = np.arange(len(start)), 0
    while len(live):
        rest = length[live] - step
        chunk = eight[start[live] + step]
        short = rest < 8
        cut = (np.uint64(1) << (np.where(short, rest, 0) * 8).astype(np.uint64)) - np.uint64(1)
        chunk = np.where(short, chunk & cut, chunk)
        h[live] = mix(h[live] ^ chunk) * _ODD
        step += 8
        live = live[rest > 8]
    return mix(h)


def word_spans(column: pa.Array, is_word: np.ndarray, folded: np.ndarray) -> tuple[np.ndarray, ...]:
    """The folded bytes of a string column, starts and ends of its words, and the first word of each text."""
    data, at = buffers(column)
    data = folded[data]
    inside = is_word[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = at[(at > 0) & (at < len(data))]
    before[edges], after[edges - 1] = False, False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return data, start, end, np.searchsorted(start, at)


def words(column: pa.Array, is_word: np.ndarray, folded: np.ndarray) -> tuple[np.ndarray, Words]:
    """The folded bytes of a string column and its words."""
    data, start, end, first = word_spans(column, is_word, folded)
    return data, Words(start, end, hash_ranges(data, start, end), first)


def windows_hash(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive values, regardless of texts; ``len(h) - k + 1`` of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * _ODD
        out ^= out >> np.uint64(31)
    return mix(out)


def list_column(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the number of values of each row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)
