"""Arrow batches of text as flat numpy byte arrays.

The text operators that run in Python look at whole batches of documents at
once: one byte array, one offset array, vectorised passes over both.  A batch
is cut into slices of about ``SLICE_BYTES`` so that memory depends on the
slice (or on the longest single text), never on the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

#: The six ASCII white-space bytes; everything else belongs to a word.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODE = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def text_index(names: list[str], text_col: str) -> int:
    return names.index(text_col)


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``limit`` bytes of text each, at least one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    start, n = 0, batch.num_rows
    while start < n:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def flatten(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is an empty one."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def owner(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the text that holds each byte position."""
    return np.searchsorted(offsets, positions, "right") - 1


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that do not cross texts."""
    n = len(inside)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of anything but ASCII white space."""
    return runs(~WHITE[data], offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and owning texts of the pieces between line feeds."""
    feeds = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], feeds + 1])
    texts = np.concatenate([np.arange(len(offsets) - 1), owner(feeds, offsets)])
    order = np.lexsort((starts, texts))
    starts, texts = starts[order], texts[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.ones(len(starts), bool)
    last[:-1] = texts[1:] != texts[:-1]
    ends[last] = offsets[texts[last] + 1]
    return starts, ends, texts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _POWERS[k] = np.cumprod(row)
    up, down = _POWERS[0][:n], _POWERS[1][:n]
    if n > 16 * SLICE_BYTES:  # not kept for the sake of one giant text
        _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    return up, down


class SpanHash:
    """64-bit hashes of any byte spans of one array, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data] * up[:-1], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts])


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hash of each ``size`` consecutive values."""
    n = max(0, len(values) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out + values[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out)
