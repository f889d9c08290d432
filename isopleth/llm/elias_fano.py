"""Elias-Fano coding of nondecreasing integers (Elias 1974, Fano 1971).

``n`` values below ``u`` take about ``2 + log2(u / n)`` bits each: the low bits
are packed, the high bits are a unary bit string.  A directory of every 256th
set bit gives ``select`` without a table of 64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQBII")
_EVERY = 256


def encode(values: np.ndarray) -> bytes:
    """Bytes that hold ``values``, nondecreasing and not negative; may be empty."""
    values = np.asarray(values, np.uint64)
    n, last = len(values), int(values[-1]) if len(values) else 0
    low = max(0, ((last + 1) // n).bit_length() - 1) if n else 0
    bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    lows = np.packbits(bits.ravel(), bitorder="little").tobytes()
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    unary[ones] = 1
    highs = np.packbits(unary, bitorder="little").tobytes()
    marks = ones[::_EVERY].astype("<u4").tobytes()
    return _HEAD.pack(n, last, low, len(lows), len(highs)) + lows + highs + marks


class EliasFano:
    """Reader of what ``encode`` made: ``values()`` for all, ``select(i)`` for one."""

    def __init__(self, data: bytes):
        self.n, self.last, self.low, a, b = _HEAD.unpack_from(data)
        at = _HEAD.size
        self.lows = np.frombuffer(data, np.uint8, a, at)
        self.highs = np.frombuffer(data, np.uint8, b, at + a)
        self.marks = np.frombuffer(data, "<u4", -(-self.n // _EVERY), at + a + b)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64)
        bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        low = (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return (high << np.uint64(self.low)) | low

    def select(self, i: int) -> int:
        """Value number ``i`` from 0, reading the bits after the nearest mark only."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.marks[i // _EVERY]), i % _EVERY
        while left:
            here = np.flatnonzero(np.unpackbits(self.highs[(at + 1) // 8 : (at + 1) // 8 + 64], bitorder="little"))
            here = here[here >= (at + 1) % 8]
            step = min(left, len(here))
            if step:
                at, left = (at + 1) // 8 * 8 + int(here[step - 1]), left - step
            else:
                at = ((at + 1) // 8 + 64) * 8 - 1
        start = i * self.low
        piece = np.unpackbits(self.lows[start // 8 : (start + self.low + 7) // 8], bitorder="little")
        low = sum(int(b) << k for k, b in enumerate(piece[start % 8 : start % 8 + self.low]))
        return (at - i) << self.low | low
