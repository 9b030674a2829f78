"""Whole Arrow batches of text as byte arrays: words, hashes and shingles by numpy inside Spark tasks.

Everything here works on one slice of a batch at a time (``SLICE_BYTES``, or one
longer text), so a task's memory follows the slice and not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64
_MIX1, _MIX2, _STEP = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53), U64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true for byte values inside the inclusive spans."""
    out = np.zeros(256, bool)
    for lo, hi in spans:
        out[lo : hi + 1] = True
    return out


#: Bytes of words that end at a space or at an ASCII control from tab to carriage return.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words of ASCII letters, digits and everything beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over a 64-bit word."""
    h = h ^ (h >> U64(33))
    h = h * _MIX1
    h ^= h >> U64(33)
    h *= _MIX2
    h ^= h >> U64(33)
    return h


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive combination of two hashes."""
    return mix(a * U64(3) + _STEP + mix(b + _STEP))


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of the base or its inverse; only those that a slice of usual size needs are kept for the next one."""
    if kind in _powers and len(_powers[kind]) >= n:
        return _powers[kind][:n]
    step = np.full(max(n, SLICE_BYTES + 1), _BASE if kind == "up" else _BASE_INV, np.uint64)
    step[0] = 1
    np.multiply.accumulate(step, out=step)
    if n <= SLICE_BYTES + 1:
        _powers[kind] = step
    return step[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column, texts end to end, and n + 1 offsets; null is empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts of up to ``most`` bytes of the column, one longer text at least."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()  # a worker lives on; what its batches took goes back to the system


def byte_runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of the table's bytes; runs don't cross from text to text."""
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """The words of a batch of texts: byte spans, 64-bit hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: np.ndarray):
        self.data, n = LOWER[data], len(data)
        self.start, self.end = byte_runs(self.data, offsets, word)
        self.at = np.searchsorted(self.start, offsets)  # word number of each text's first word, and the total
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[self.data] * _power("up", n), out=self.total[1:])
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans, by their lower-cased bytes alone."""
        return mix((self.total[end] - self.total[start]) * _power("down", len(self.total))[start] + (end - start).astype(np.uint64) * _STEP)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words and n + 1 offsets by text; a shorter, non-empty text is one run."""
        n_words = self.counts()
        n_runs = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
        offsets = np.concatenate([[0], np.cumsum(n_runs)])
        first = np.repeat(self.at[:-1] - offsets[:-1], n_runs) + np.arange(offsets[-1])
        most = np.minimum(n_words, k)
        length = np.repeat(most, n_runs)
        h = mix(length.astype(np.uint64))
        for j in range(k):
            if (short := int(np.count_nonzero(length <= j))) == 0:
                h = chain(h, self.hash[first + j])
            elif short < len(h):
                on = length > j
                h[on] = chain(h[on], self.hash[first[on] + j])
        return h, offsets


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for counts[0] values, then from starts[1] on, and so on."""
    if len(counts) == 0:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1])
