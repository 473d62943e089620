"""CRC-32 of many byte ranges at once, by position.

A CRC is linear over XOR but for a constant that depends on the length. So the checksum of a range is the
XOR of what each byte contributes at its distance from the range's end, and of the constant of its length.
Contributions are precomputed for distances below ``DEPTH``. A byte further away contributes as in a block
of ``DEPTH`` bytes, and the block's value is then carried on over the bytes behind it; carrying on over
2^k bytes is a linear map of 32 bits, kept as four tables of 256 values.
"""

from __future__ import annotations

import functools

import numpy as np

#: Distances from the end with a table of their own; a power of two.
DEPTH = 64
#: The reflected polynomial of CRC-32 (a fixed value).
_POLYNOMIAL = np.uint32(0xEDB88320)
_ONES = np.uint32(0xFFFFFFFF)
#: Lengths below this share a table of constants.
_SHORT = 256


@functools.cache
def position_table() -> np.ndarray:
    """``[distance * 256 + byte]``: the contribution of a byte that so many bytes follow."""
    table = np.zeros((DEPTH, 256), np.uint32)
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = (value >> np.uint32(1)) ^ np.where(value & np.uint32(1), _POLYNOMIAL, np.uint32(0))
    table[0] = value
    for d in range(1, DEPTH):
        table[d] = (table[d - 1] >> np.uint32(8)) ^ table[0][table[d - 1] & np.uint32(255)]
    return table.reshape(-1)


def _apply(maps: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = maps[0][value & np.uint32(255)]
    for byte in (1, 2, 3):
        out = out ^ maps[byte][(value >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


@functools.cache
def _carry(power: int) -> np.ndarray:
    """The map of a checksum over 2^``power`` zero bytes, by byte of the checksum."""
    if power == 0:
        one = np.arange(256, dtype=np.uint32)
        first = position_table()[:256]
        return np.stack([first] + [one << np.uint32(8 * (byte - 1)) for byte in (1, 2, 3)])
    half = _carry(power - 1)
    return np.stack([_apply(half, half[byte]) for byte in range(4)])


def carried(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Checksums ``value`` carried on over ``count`` zero bytes each."""
    value, left, power = value.copy(), count.copy(), 0
    while left.any():
        odd = np.flatnonzero(left & 1)
        value[odd] = _apply(_carry(power), value[odd])
        left >>= 1
        power += 1
    return value


def length_constant(length: np.ndarray) -> np.ndarray:
    """The checksum of so many zero bytes."""
    if not len(length):
        return np.zeros(0, np.uint32)
    distinct = np.unique(np.minimum(length, _SHORT))
    constant = np.zeros(_SHORT + 1, np.uint32)
    constant[distinct] = carried(np.full(len(distinct), _ONES), distinct) ^ _ONES
    out = constant[np.minimum(length, _SHORT)]
    long = np.flatnonzero(length >= _SHORT)
    out[long] = carried(np.full(len(long), _ONES), length[long]) ^ _ONES
    return out


def contributions(data: np.ndarray, start: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """The XOR of what the bytes of consecutive ranges contribute.

    ``start`` holds where each range begins in ``data`` (from 0, none empty), ``distance`` how many bytes
    follow each byte in its own range or in what the range is a part of.
    """
    if not len(start):
        return np.zeros(0, np.uint32)
    each = position_table()[((distance & (DEPTH - 1)) << 8) | data]
    if distance.max() < DEPTH:
        return np.bitwise_xor.reduceat(each, start)
    # Long ranges fold by blocks: each block's value is carried on over the whole blocks behind it.
    block = np.union1d(start, np.flatnonzero((distance & (DEPTH - 1)) == DEPTH - 1))
    value = np.bitwise_xor.reduceat(each, block)
    far = np.flatnonzero(distance[block] >= DEPTH)
    value[far] = carried(value[far], distance[block[far]].astype(np.int64) // DEPTH * DEPTH)
    return np.bitwise_xor.reduceat(value, np.searchsorted(block, start))


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of the byte ranges ``[start, end)``, which may overlap or be empty."""
    out = np.zeros(len(start), np.uint32)
    some = np.flatnonzero(end > start)
    length = (end - start)[some]
    first = np.cumsum(length) - length
    back = np.arange(int(length.sum())) - np.repeat(first, length)
    distance = np.repeat(length - 1, length) - back
    out[some] = contributions(data[np.repeat(start[some], length) + back], first, distance) ^ length_constant(length)
    return out


def gram_crc32(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, most: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Checksums of all runs of 1 to ``most`` consecutive words of a text, joined by one space.

    Words are the byte ranges ``[start, end)`` of ``data``; ``first`` holds the first word of each text.
    For each number of words: the number of the run's first word, and the checksum.

    The words are laid out behind each other with a space after each. A run is its first word and that
    space, at their distances from the run's end, and the run of the words behind it, whose value is known.
    """
    words = len(start)
    if not words:
        return []
    length = end - start
    at = np.cumsum(length + 1) - (length + 1)
    size = int(at[-1] + length[-1] + 1)
    # Places of the words' bytes among the spaced ones; distances fit 32 bits as slices do.
    places = np.arange(size, dtype=np.int32 if size < 2**31 else np.int64)
    letters = np.ones(size, bool)
    last = (at + length - 1).astype(places.dtype)
    letters[last + 1] = False
    letters = np.flatnonzero(letters)
    spaced = np.full(size, 0x20, np.uint8)
    spaced[letters] = data[letters + np.repeat(start - at, length)]
    word_of_text = np.repeat(first[1:], np.diff(first))
    out, behind = [], None
    for n in range(1, most + 1):
        # Runs that leave their text are worked out as well, but not returned.
        final = last[np.minimum(np.arange(words) + n - 1, words - 1)]
        if n == 1:
            distance = np.repeat(final, length) - places[letters]
            value = contributions(spaced[letters], np.cumsum(length) - length, distance)
        else:
            distance = np.maximum(np.repeat(final, length + 1) - places, 0)
            value = contributions(spaced, at, distance) ^ np.append(behind[1:], np.uint32(0))
        behind = value
        inside = np.flatnonzero(np.arange(words) + n <= word_of_text)
        out.append((inside, value[inside] ^ length_constant(final[inside] + 1 - at[inside])))
    return out
