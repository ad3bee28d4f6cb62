"""Vectorised hashing of Arrow text columns, shared by the operators that read whole texts.

Nothing here makes a Python object per word or character: a column's own buffers are viewed as
numpy arrays and worked through in chunks of whole documents, so that memory stays bounded.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; one longer document makes a chunk of its own.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def byte_codes() -> np.ndarray:
    """A pseudo-random code for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One code for two in this order. Shifts between the products keep patterned inputs from cancelling, as they can in sums of powers."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x += b
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def doubled(codes: np.ndarray, size: int) -> np.ndarray:
    """A code for each ``size`` adjoining codes, ``size`` a power of two."""
    s = 1
    while s < size:
        codes = join(codes[:-s], codes[s:]) if len(codes) > s else codes[:0]
        s *= 2
    return codes


def sliding(codes: np.ndarray, size: int) -> np.ndarray:
    """A code for each ``size`` adjoining codes."""
    s = 1 << size.bit_length() - 1
    half = doubled(codes, s)
    n = len(codes) - size + 1
    if n <= 0:
        return half[:0]
    return join(half[:n], half[size - s : size - s + n]) if size > s else half


#: Ranges of more bytes are hashed one by one.
LANES = 256


def range_codes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A code for each range of bytes: eight at a time, those still going on; very long ones by BLAKE2."""
    padded = np.append(buf, np.zeros(8, np.uint8))
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    at, left, live = start, size, None
    if len(size) and size.max() > LANES:
        long = size > LANES
        for k in np.flatnonzero(long).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(buf[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
        live = np.flatnonzero(~long)
        at, left = start[live], size[live]
    while True:
        lane = eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64)))
        lane = np.where(left > 0, lane, np.uint64(0))
        if live is None:
            out = join(out, lane)
            live = np.flatnonzero(left > 8)
        else:
            out[live] = join(out[live], lane)
            live = live[left > 8]
        if not len(live):
            return out
        at, left = at[left > 8] + 8, left[left > 8] - 8


def exact_numbers(buf: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 that are equal where the ranges' bytes are, and one range of each: equal codes are confirmed on the bytes."""
    _, first, number = np.unique(codes, return_index=True, return_inverse=True)
    odd = ~same_ranges(buf, start, end, np.arange(len(codes)), first[number])
    if odd.any():
        seen: dict[bytes, int] = {}
        for k in np.flatnonzero(np.isin(number, number[odd])).tolist():
            number[k] = seen.setdefault(buf[start[k] : end[k]].tobytes(), len(first) + len(seen))
        _, first, number = np.unique(number, return_index=True, return_inverse=True)
    return number, first


def same_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """Whether ranges a[k] and b[k] hold the same bytes."""
    size = end[a] - start[a]
    out = size == end[b] - start[b]
    todo = np.flatnonzero(out & (a != b) & (size > 0))
    sums = np.cumsum(size[todo])
    at = 0
    while at < len(todo):
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most, side="right")))
        rows = todo[at:to]
        n = size[rows]
        heads = np.cumsum(n) - n
        inner = np.arange(n.sum()) - np.repeat(heads, n)
        out[rows] = np.logical_and.reduceat(buf[inner + np.repeat(start[a[rows]], n)] == buf[inner + np.repeat(start[b[rows]], n)], heads)
        at = to
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its rows' offsets in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of at most ``most`` bytes together, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@cache
def lowered() -> np.ndarray:
    """Each byte, A-Z as a-z."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


@cache
def separators(kind: str) -> np.ndarray:
    """Which bytes end a word: ``space`` (the six of ASCII) or ``alnum`` (all of ASCII but letters and digits)."""
    out = np.zeros(256, dtype=bool)
    if kind == "space":
        out[[32, *range(9, 14)]] = True
    else:
        out[:128] = True
        out[48:58] = out[65:91] = out[97:123] = False
    return out


def words(data: np.ndarray, offsets: np.ndarray, kind: str = "space", lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows that adjoin in ``data``: each word's first byte and end, its hash, and the rows' offsets among the words."""
    base = offsets[0]
    buf, offsets = data[base : offsets[-1]], offsets - base
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~separators(kind)[buf]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty(len(buf), dtype=bool)
    before[1:], before[0] = inside[:-1], False
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(len(buf), dtype=bool)
    after[:-1], after[-1] = inside[1:], False
    after[edges[1:] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start + base, end + base, range_codes(lowered()[buf] if lower else buf, start, end), np.searchsorted(start, offsets).astype(np.int64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w adjoining items."""
    s = 1
    while 2 * s <= w:
        x = np.minimum(x[:-s], x[s:])
        s *= 2
    return np.minimum(x[: len(x) - (w - s)], x[w - s :]) if w > s else x


def trim() -> None:
    """Give freed memory back to the system, so that workers that wait for their next task stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run):
    """``run`` over batches, after which what it freed is given back."""

    def through(batches):
        yield from run(batches)
        trim()

    return through
