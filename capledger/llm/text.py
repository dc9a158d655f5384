"""Words of whole Arrow columns at once, in numpy.

A word is a maximal run of letters and digits of the lower-cased text. ASCII signs,
and the signs and spaces of the Unicode blocks Latin-1, General Punctuation and CJK
Symbols, part words; every other character belongs to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20
BATCH_ROWS = 1_000
BATCH_BYTES = 16 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_BYTE_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def small_batches(spark: SparkSession) -> None:
    """Lowers an Arrow batch to ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` for this session: rows hold
    whole texts here, and each Python worker and its task hold a batch at a time."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdecimal() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser, in wrapping arithmetic."""
    x = (x ^ np.uint64(seed & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES) + 1
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows and about ``most`` bytes; a longer row is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n, first + rows)
        yield first, last
        first = last


@dataclass
class Words:
    start: np.ndarray  # first byte of each word
    end: np.ndarray
    first: np.ndarray  # number of the first word of each text, and the count of all at the end
    hashes: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def in_word(data: np.ndarray) -> np.ndarray:
    inside = _IN_WORD[data]
    high = np.flatnonzero(data == 0xC2)
    if len(high):  # U+0080 to U+00BF but for the letters ª, µ and º
        high = high[high + 1 < len(data)]
        high = high[~np.isin(data[high + 1], (0xAA, 0xB5, 0xBA))]
        inside[high] = inside[high + 1] = False
    for lead, following in ((0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        high = np.flatnonzero(data == lead)
        high = high[high + 2 < len(data)]
        high = high[np.isin(data[high + 1], following)]
        inside[high] = inside[high + 1] = inside[high + 2] = False
    return inside


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; equal runs have equal hashes."""
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of texts that lie behind each other in ``data``."""
    inside = in_word(data)
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False  # a word never reaches into the next text
    start = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(start, end, np.searchsorted(start, offsets), hash_runs(data, start, end))
