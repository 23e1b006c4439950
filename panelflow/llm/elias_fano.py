"""Elias-Fano coding of non-decreasing integers: about 2 + log2(range / n) bits each, any one found by a select."""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256  # every so many values the place of its bit is stored
_HEAD = struct.Struct("<QQQBxxxxxxx")  # n, first value, bytes of the upper part, low bits


class EliasFano:
    """``n`` values above ``first``: low bits packed, high bits in unary, sampled places for select."""

    def __init__(self, n: int, first: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.first, self.low_bits, self.low, self.high, self.samples = n, first, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, "<u8"))
        if (np.diff(values) < 0).any():
            raise ValueError("values must not decrease")
        first = int(values[0])
        offset = (values - first).view(np.uint64)
        low_bits = max(0, (int(offset[-1]) // n).bit_length() - 1)
        ones = (offset >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) // 8 + 1, np.uint8)
        np.bitwise_or.at(high, ones // 8, (1 << (ones % 8)).astype(np.uint8))
        low = np.zeros(0, np.uint8)
        if low_bits:
            bits = (offset[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        return cls(n, first, low_bits, low, high, ones[::SAMPLE].astype("<u8"))

    def _low(self, begin: int, stop: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(stop - begin, np.int64)
        a, b = begin * self.low_bits, stop * self.low_bits
        bits = np.unpackbits(self.low[a // 8:(b + 7) // 8], bitorder="little")[a % 8:a % 8 + b - a]
        return (bits.reshape(-1, self.low_bits).astype(np.int64) << np.arange(self.low_bits)[None, :]).sum(axis=1)

    def slice(self, begin: int, stop: int) -> np.ndarray:
        """Values ``begin`` to ``stop`` - 1, read from the nearest sample on."""
        stop = min(stop, self.n)
        if begin >= stop:
            return np.zeros(0, np.int64)
        place = int(self.samples[begin // SAMPLE])
        till = -(-stop // SAMPLE)
        end = int(self.samples[till]) // 8 + 1 if till < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[place // 8:end], bitorder="little")) + place // 8 * 8
        ones = ones[ones >= place]
        skip = begin - begin // SAMPLE * SAMPLE
        ones = ones[skip:skip + stop - begin]
        return self.first + ((ones - np.arange(begin, stop)) << self.low_bits) + self._low(begin, stop)

    def select(self, i: int) -> int:
        """The value at place ``i``."""
        return int(self.slice(i, i + 1)[0])

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.first & (1 << 64) - 1, len(self.high), self.low_bits)
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The structure stored at ``at``, and where it ends."""
        n, first, high_bytes, low_bits = _HEAD.unpack_from(raw, at)
        first -= (first >> 63) << 64
        at += _HEAD.size
        low_bytes, samples = -(-n * low_bits // 8), -(-n // SAMPLE)
        low = np.frombuffer(raw, np.uint8, low_bytes, at)
        high = np.frombuffer(raw, np.uint8, high_bytes, at + low_bytes)
        at += low_bytes + high_bytes
        return cls(n, first, low_bits, low, high, np.frombuffer(raw, "<u8", samples, at)), at + 8 * samples
