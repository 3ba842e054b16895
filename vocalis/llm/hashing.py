"""Rabin-Karp hashes of words and word windows, vectorised over Arrow buffers.

All arithmetic is modulo 2^64.  A byte enters through a table of fixed random
values, a word hash is the polynomial of its bytes, finished with a mixing
step, and a window hash is the polynomial of its word hashes, taken from
prefix sums: ``(S[i + w] - S[i]) * B**-i``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_B1 = 0x9E3779B97F4A7C15                     # odd: it has an inverse
_B2 = 0xD6E8FEB86659FD93
_BLOCK = 1 << 20


def _inverse(b: int) -> int:
    return pow(b, -1, 1 << 64)


class _Powers:
    def __init__(self, base: int):
        self.base, self.have = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.have) < n:
            steps = np.full(max(n, 2 * len(self.have)), np.uint64(self.base))
            steps[0] = 1
            self.have = np.multiply.accumulate(steps)
        return self.have[:n]


_P1, _P2, _I2 = _Powers(_B1), _Powers(_B2), _Powers(_inverse(_B2))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column; nulls are empty."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    data, lens = [], []
    for a in parts:
        if not len(a):
            continue
        width = np.int64 if pa.types.is_large_binary(a.type) or pa.types.is_large_string(a.type) else np.int32
        off = np.frombuffer(a.buffers()[1], width)[a.offset:a.offset + len(a) + 1].astype(np.int64)
        raw = a.buffers()[2]
        b = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        data.append(b[off[0]:off[-1]])
        lens.append(np.diff(off))
    if not data:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    lens = np.concatenate(lens)
    return np.concatenate(data), np.concatenate([[0], np.cumsum(lens)])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text and their end) of the words of all texts."""
    inside = ~_SPACE[data]
    n = len(data)
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[cuts] = inside[cuts]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[cuts - 1] = inside[cuts - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray,
                table: np.ndarray = _BYTES) -> np.ndarray:
    """Hash of each word, in blocks of about a million bytes."""
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(s, s[i] + _BLOCK)))
        lens = e[i:j] - s[i:j]
        at = np.cumsum(lens) - lens
        total = int(lens.sum())
        pos = np.arange(total) - np.repeat(at, lens)
        vals = table[data[np.repeat(s[i:j], lens) + pos]]
        vals *= _P1.upto(int(lens.max()))[pos]
        out[i:j] = np.add.reduceat(vals, at) + lens.astype(np.uint64)
        i = j
    return mix(out)


def lower_table() -> np.ndarray:
    return _BYTES[LOWER]


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; the caller keeps those inside a text."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64)
    out = np.empty(n - width + 1, np.uint64)
    for a in range(0, len(out), _BLOCK):
        b = min(len(out), a + _BLOCK)
        part = h[a:b + width - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _P2.upto(len(part)), out=total[1:])
        out[a:b] = (total[width:] - total[:-width]) * _I2.upto(b - a)
    return mix(out)


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Sorted hashes as byte planes of their gaps: the high planes are zeros
    that the shuffle's compression removes."""
    gaps = np.diff(sorted_hashes, prepend=np.uint64(0))
    return gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack32(sorted_values: np.ndarray) -> bytes:
    """``pack`` for sorted values below 2^32."""
    gaps = np.diff(sorted_values, prepend=np.uint64(0))
    return gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack32(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint64)
