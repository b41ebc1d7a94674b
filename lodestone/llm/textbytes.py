"""Vectorised work on batches of UTF-8 texts: words, lines and 64-bit substring hashes in numpy.

A batch column is cut into blocks of whole texts of about ``BLOCK`` bytes, so memory follows the block
(or the longest single text), never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words `[^\x20\x09-\x0D]+`.
WORD = ~_SPACE
#: Bytes of runs of ASCII letters and digits and of all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * BLOCK)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base & _MASK, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        return cls.up, cls.down


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) for blocks of whole texts; null: empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    if pa.types.is_large_string(column.type):
        off = np.frombuffer(column.buffers()[1], np.int64)
    else:
        column = column.cast(pa.string())
        off = np.frombuffer(column.buffers()[1], np.int32)
    off = off[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, offsets of the rows in them) of the maximal runs of true bytes, cut at row borders."""
    n = len(member)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = member[:-1]
    after[:-1] = member[1:]
    first, last = off[:-1], off[1:] - 1
    before[first[first < n]] = False
    after[last[last >= 0]] = False
    starts = np.flatnonzero(member & ~before)
    ends = np.flatnonzero(member & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix(buf: np.ndarray) -> np.ndarray:
    up, _ = _Powers.upto(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=out[1:])
    return out


def hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each substring [start, end) that depends on its bytes alone. sums: prefix() of the block."""
    _, down = _Powers.upto(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def ngrams(words: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of n consecutive words, offsets of the rows in them); rows of fewer words have none."""
    count = np.maximum(np.diff(off) - (n - 1), 0)
    new = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(new[-1]) + np.repeat(off[:-1] - new[:-1], count)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(_BASE) + words[at + k]) if k else words[at]
    return h, new


def sums_by_row(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The sum of each row's values; 0 for a row that has none."""
    total = np.concatenate((np.zeros(1, np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[off[1:]] - total[off[:-1]]
