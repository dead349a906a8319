"""Elias-Fano coding of non-decreasing integers with a select structure."""

from __future__ import annotations

import struct

import numpy as np

#: Every so many ones the place of a one is stored, so that select reads one block only.
SAMPLE = 512
_HEAD = struct.Struct("<QQB")


class EliasFano:
    """``n`` values below ``universe``: low bits packed, high bits in unary; about 2 + log2(universe / n) bits each.

    ``select(i)`` gives value i. The place of every ``SAMPLE``-th one of the high part is kept, so a
    select unpacks the bits between two samples. Empty sequences and repeated values are allowed.
    """

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits = n, universe, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        low_bits = max(0, (int(universe) // max(n, 1)).bit_length() - 1)
        shift = np.uint64(low_bits)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> shift).astype(np.int64) + np.arange(n)
        raised = np.zeros((int(universe) >> low_bits) + n + 1, dtype=np.uint8)
        raised[ones] = 1
        return cls(n, int(universe), low_bits, low, np.packbits(raised, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), dtype=np.int64)
        at = index[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (at & 7)) & 1
        return (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, index) -> np.ndarray:
        """The values at the given positions."""
        index = np.atleast_1d(np.asarray(index, dtype=np.int64))
        high = np.empty(len(index), dtype=np.int64)
        block = index // SAMPLE
        for b in np.unique(block):
            first = int(self.samples[b])
            last = int(self.samples[b + 1]) if b + 1 < len(self.samples) else len(self.high) * 8 - 1
            bits = np.unpackbits(self.high[first >> 3 : (last >> 3) + 1], bitorder="little")
            ones = np.flatnonzero(bits) + (first & ~7)
            ones = ones[ones >= first]
            here = block == b
            high[here] = ones[index[here] - b * SAMPLE] - index[here]
        return (high << self.low_bits) | self._low(index)

    def to_bytes(self) -> bytes:
        parts = (self.low.tobytes(), self.high.tobytes(), self.samples.tobytes())
        return _HEAD.pack(self.n, self.universe, self.low_bits) + b"".join(struct.pack("<Q", len(p)) + p for p in parts)

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence stored at ``at`` and the place after it."""
        n, universe, low_bits = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        parts = []
        for kind in (np.uint8, np.uint8, np.dtype("<u4")):
            (size,) = struct.unpack_from("<Q", data, at)
            at += 8
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(n, universe, low_bits, *parts), at
