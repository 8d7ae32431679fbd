"""Elias-Fano codes of ascending integers, with sampled select."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Every so many values, the place of its bit is kept.
SAMPLE = 64
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass(frozen=True)
class EliasFano:
    """n ascending values below 2**64: ``low_bits`` low bits of each as they are, the rest in unary."""

    n: int
    low_bits: int
    lows: bytes
    highs: bytes
    samples: bytes

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n, values = len(values), np.asarray(values).astype(np.uint64)
        if not n:
            return cls(0, 0, b"", b"", b"")
        low_bits = max(0, int(int(values[-1]) // n).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(place[-1]) + 1, np.uint8)
        high[place] = 1
        pack = lambda x: np.packbits(x.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, low_bits, pack(bits), pack(high), place[::SAMPLE].astype("<u4").tobytes())

    def _value(self, i: np.ndarray, place: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(self.lows, np.uint8)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = ((raw[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)
        return (place - i).astype(np.uint64) << np.uint64(self.low_bits) | bits.sum(1, dtype=np.uint64)

    def all(self) -> np.ndarray:
        """All values, as unsigned 64-bit integers."""
        if not self.n:
            return np.zeros(0, np.uint64)
        place = np.flatnonzero(np.unpackbits(np.frombuffer(self.highs, np.uint8), bitorder="little"))
        return self._value(np.arange(self.n), place)

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE]), i % SAMPLE
        if left:
            raw = np.frombuffer(self.highs, np.uint8)
            byte = place >> 3
            left -= int(_POP[raw[byte] >> (place & 7) >> 1])
            while left > 0:
                byte += 1
                left -= int(_POP[raw[byte]])
            ones = np.flatnonzero(np.unpackbits(raw[byte : byte + 1], bitorder="little"))
            place = byte * 8 + int(ones[len(ones) - 1 + left])
        return int(self._value(np.array([i]), np.array([place]))[0])

    def first_not_below(self, value: int) -> int:
        """How many values are less than ``value``: a binary search by ``select``."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            if self.select(mid) < value:
                low = mid + 1
            else:
                high = mid
        return low
