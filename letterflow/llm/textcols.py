"""Text columns as NumPy arrays: UTF-8 bytes, words and their hashes, a bounded block at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
U64 = np.uint64
#: The white space that parts words: blank and 0x09 to 0x0D.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32
IDENTITY = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all of its bits (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n random 64-bit numbers that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 0x1000193 + 1))


_BYTE_VALUE = stream(11, 256) | U64(1)
_STEP = U64(0xD1342543DE82EF95)
_BACK = U64(pow(int(_STEP), -1, 1 << 64))
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, step in enumerate((_STEP, _BACK)):
            p = np.full(n, step, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each row begins (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, begins, data = column.buffers()
    at = np.frombuffer(begins, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def blocks(at: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most so many bytes, or one row."""
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def byte_values(seed: int) -> np.ndarray:
    """A random odd number for each byte."""
    return stream(11 + seed, 256) | U64(1)


def words(raw: np.ndarray, at: np.ndarray, fold: np.ndarray = LOWER_AZ, space: np.ndarray = _IS_SPACE,
          value: np.ndarray = _BYTE_VALUE):
    """Words of a block: hash, begin, end (byte positions), and where each row's words begin."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, np.zeros(len(at), np.int64)
    inside = ~space[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    begins = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    forth, back = _power(n + 1)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(value[fold[raw]] * forth[:n], out=total[1:])
    hashed = mix((total[ends] - total[begins]) * back[begins] + (ends - begins).astype(U64))
    return hashed, begins, ends, np.searchsorted(begins, at)


def rows_of(first: np.ndarray) -> np.ndarray:
    """For each item the row it belongs to, given where each row's items begin."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(hashed: np.ndarray, first: np.ndarray, width: int = 5):
    """Hashes of the runs of `width` words of each row; a row with fewer words has one run, of them all."""
    count = np.diff(first)
    runs = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begin = np.zeros(len(count) + 1, np.int64)
    np.cumsum(runs, out=begin[1:])
    out = np.zeros(begin[-1], U64)
    start = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], runs)
    length = np.repeat(np.minimum(count, width), runs)
    padded = np.concatenate([hashed, np.zeros(width, U64)])
    factor = stream(23, width) | U64(1)
    for k in range(width):
        out += np.where(length > k, padded[start + k] * factor[k], U64(0))
    return mix(out + length.astype(U64)), begin


def distinct(hashed: np.ndarray, begin: np.ndarray):
    """Sorted distinct hashes of each row."""
    kept, sizes = [], np.zeros(len(begin), np.int64)
    for i in range(len(begin) - 1):
        own = np.sort(hashed[begin[i]:begin[i + 1]])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        kept.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(kept) if kept else np.zeros(0, U64)), np.cumsum(sizes)
