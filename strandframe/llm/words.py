"""Words and word shingles of whole texts, hashed with numpy over a whole Arrow batch at once.

A word is a run of bytes other than the six ASCII white-space bytes (0x20, 0x09-0x0D) of the UTF-8 text, with A-Z
lower-cased. Null and empty texts have no words. Hashes are 64 bits wide and depend on nothing but the words.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: One odd multiplier for each place of a shingle.
_PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
#: Bytes hashed at once; the working arrays take about 40 times as much.
STEP = 1 << 18

_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = _inverses = np.zeros(0, dtype=np.uint64)


def freeing(run):
    """A function for mapInArrow that gives freed memory back to the system when its task ends: Python workers are used
    again and again, and idle ones would keep the most that any task has needed."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def freeing_groups(run):
    """The same for applyInArrow, after each group."""

    @functools.wraps(run)
    def group(key, table):
        try:
            return run(key, table)
        finally:
            give_back()

    return group


def freeing_cogroups(run):
    """The same for applyInArrow on two sides."""

    @functools.wraps(run)
    def pair(left, right):
        try:
            return run(left, right)
        finally:
            give_back()

    return pair


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << max(16, (n - 1).bit_length())
        full = np.full(size, _BASE, dtype=np.uint64)
        full[0] = 1
        _powers = np.multiply.accumulate(full)
        full = np.full(size, _INVERSE, dtype=np.uint64)
        full[0] = 1
        _inverses = np.multiply.accumulate(full)
    return _powers, _inverses


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n+1 offsets; nulls are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0]


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word of ``raw`` and its hash; no word may touch another text's."""
    space = _SPACE[raw]
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    powers, inverses = _tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[_LOWER[raw]] * powers[: len(raw)], out=total[1:])
    value = (total[end] - total[start]) * inverses[start]
    return start, mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_batches(column: pa.Array):
    """(first row, hashes, counts): word hashes of consecutive rows, and how many each row has.

    A block holds about STEP bytes, or one longer text; a text over STEP bytes is hashed in steps cut at white space.
    """
    raw, at = _raw(column)
    n, row = len(at) - 1, 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + STEP, side="right")) - 1)
        if last == row + 1 and at[last] - at[row] > STEP:
            parts, begin, end = [], int(at[row]), int(at[last])
            while begin < end:
                stop = min(end, begin + STEP)
                while stop < end and not _SPACE[raw[stop]]:
                    gap = np.flatnonzero(_SPACE[raw[stop : stop + STEP]])
                    stop = min(end, stop + (int(gap[0]) if len(gap) else STEP))
                parts.append(_word_hashes(raw[begin:stop])[1])
                begin = stop
            hashes = np.concatenate(parts)
            yield row, hashes, np.array([len(hashes)])
        else:
            # A separator after each text keeps words of neighbours apart.
            size = np.diff(at[row : last + 1])
            shift = np.arange(last - row)
            padded = np.full(int(at[last] - at[row]) + last - row, 32, dtype=np.uint8)
            target = np.ones(len(padded), dtype=bool)
            ends = np.cumsum(size) + shift
            target[ends] = False
            padded[target] = raw[at[row] : at[last]]
            start, hashes = _word_hashes(padded)
            counts = np.diff(np.searchsorted(start, ends), prepend=0)
            yield row, hashes, counts
        row = last


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash for each run of ``size`` words in order; fewer words make one shingle, none none."""
    if not len(words):
        return words
    width = min(size, len(words))
    places = _PLACES if size <= len(_PLACES) else mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    count = len(words) - width + 1
    total = words[:count] * places[0]
    for i in range(1, width):
        total += words[i : i + count] * places[i]
    return mix(total + np.uint64(width))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    values = np.sort(values)
    if len(values) > 1:
        values = values[np.concatenate(([True], values[1:] != values[:-1]))]
    return values


def shingle_sets(column: pa.Array, size: int = 5):
    """(row, sorted distinct shingle hashes) for every row of a string column, in order."""
    for first, hashes, counts in word_batches(column):
        whole = shingle_hashes(hashes, size) if len(hashes) >= size else None
        end = 0
        for i, count in enumerate(counts.tolist()):
            begin, end = end, end + count
            if count >= size:
                yield first + i, distinct(whole[begin : end - size + 1])
            else:
                yield first + i, shingle_hashes(hashes[begin:end], size)


def pack(values: np.ndarray, width: int = 8) -> bytes:
    """Sorted unsigned integers as differences of the fewest whole bytes; ``unpack`` restores them."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=values.dtype.type(0)).astype("<u8")
    width = next(w for w in range(1, 9) if w == 8 or int(gaps.max()) >> (8 * w) == 0)
    return bytes([width]) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width = blob[0]
    body = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    gaps = np.zeros((len(body), 8), np.uint8)
    gaps[:, :width] = body
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64)
