"""Vectorised work on the bytes of Arrow string columns: words, word hashes, n-grams.

Everything here runs inside Spark tasks on one block of a batch at a time; a block holds whole
documents and about ``BLOCK`` bytes, so memory is bounded by the longest document.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
#: Rows a block at most.
BLOCK_ROWS = 1 << 17
#: The bytes that separate words.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True

#: Start values and scramblers of the two hash lanes; arbitrary fixed values.
_START = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)
_SCRAMBLE = ((0xD6E8FEB86659FD93, 32), (0xFF51AFD7ED558CCD, 31))
#: Spans of more bytes than this are hashed by BLAKE2 one by one.
LONG_SPAN = 512
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def release() -> None:
    """Give memory that a task has freed back to the system, because Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which frees memory when a task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with nulls as empty strings and 64-bit offsets."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, bytes, offsets) of consecutive rows of about ``size`` bytes."""
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, i + BLOCK_ROWS, len(texts))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` bytes; a run never crosses a document's border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    a, z = offsets[:-1][full], offsets[1:][full] - 1
    first[a], last[z] = inside[a], inside[z]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _scramble(x: np.ndarray, lane: int) -> np.ndarray:
    factor, shift = _SCRAMBLE[lane]
    for _ in range(2):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(shift))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes after eight go through a keyed, non-linear scramble.

    The two lanes are independent, so a pair of both is a hash of 128 bits."""
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    size = end - start
    h = _scramble(_START[lane] + size.astype(np.uint64), lane)
    long = np.flatnonzero(size > LONG_SPAN)
    live, at = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(live):
        left = size[live] - at
        h[live] = _scramble(h[live] ^ (eight[start[live] + at] & _MASKS[np.minimum(left, 8)]), lane)
        at += 8
        live = live[left > 8]
    for k in long.tolist():
        digest = hashlib.blake2b(data[start[k] : end[k]], digest_size=16, key=b"spans").digest()
        h[k] = int.from_bytes(digest[8 * lane : 8 * lane + 8], "little")
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a block, and for each document its first word's number (n + 1 values)."""
    start, end = spans(~IS_SPACE[data], offsets)
    return start, end, np.searchsorted(start, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)


@lru_cache(maxsize=64)
def _multipliers(n: int, lane: int = 0) -> np.ndarray:
    return np.random.default_rng(n + 1000 * lane).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def ngrams(hashes: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive values (document borders are the caller's matter)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(size, np.uint64)
    for k, m in enumerate(_multipliers(n, lane)):
        total += hashes[k : k + size] * m
    return _scramble(total, lane)


def distinct(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places, in order, of the first of each distinct (row, a, b); rows ascend, a and b are the lanes of one hash."""
    if not len(a):
        return np.zeros(0, np.int64)
    key = a ^ mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    x, y = order[1:][same], order[:-1][same]
    if ((a[x] != a[y]) | (b[x] != b[y]) | (row[x] != row[y])).any():  # one lane doesn't tell them apart
        order = np.lexsort((b, a, row))
        x, y = order[1:], order[:-1]
        same = (a[x] == a[y]) & (b[x] == b[y]) & (row[x] == row[y])
    head = np.insert(~same, 0, True)
    return np.sort(np.minimum.reduceat(order, np.flatnonzero(head)))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for all s, n."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)
