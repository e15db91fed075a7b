"""Texts of a record batch as one array of UTF-8 bytes, and words as ranges of it.

Everything here works on whole batches with array operations; a null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are worked on at once. Array operations take some tens of bytes of memory for each.
CHUNK = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the n + 1 places where texts begin and end."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32, len(column) + 1 + column.offset) if places else np.zeros(1)
    offsets = offsets[column.offset :].astype(np.int64)
    if len(offsets) < len(column) + 1:
        offsets = np.zeros(len(column) + 1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    bytes_ = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return bytes_, offsets - first


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `limit` bytes of text; a longer text is a run of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        start = 0
        while start < len(size):
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every range, one range after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    return np.repeat(starts - begin, lengths) + np.arange(total)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well spread 64-bit function of every value."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        factors = np.full(max(n, CHUNK) + 1, _BASE if which == "up" else _BACK, np.uint64)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if n <= 4 * CHUNK:
            _powers[which] = have
    return have[:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every range of `values`, equal for equal contents wherever they stand."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power("up", n), out=total[1:])
    return mixed((total[ends] - total[starts]) * _power("down", n + 1)[starts] + (ends - starts).astype(np.uint64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches without ASCII white space: starts, ends, and for each text the place of its first word (n + 1)."""
    blank = _SPACE[data]
    begin = ~blank
    begin[1:] &= blank[:-1] | False
    inner = offsets[:-1][(offsets[:-1] < offsets[1:])]
    begin[inner] = ~blank[inner]
    starts = np.flatnonzero(begin)
    stop = ~blank
    stop[:-1] &= blank[1:]
    last = offsets[1:][(offsets[:-1] < offsets[1:])] - 1
    stop[last] = ~blank[last]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)
