"""Elias-Fano encoding of non-decreasing integers."""

from __future__ import annotations

import struct

import numpy as np

#: One select sample for so many ones of the upper bits.
SAMPLE = 128
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class EliasFano:
    """n values up to u in about 2 + log2(u / n) bits each.

    The low bits of a value are packed side by side; its high bits h are a one at place
    h + i of a bit string. select(i) starts at the nearest sampled one and counts bytes.
    """

    def __init__(self, n: int, low_width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_width, self.low, self.high, self.samples = n, low_width, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(1, n)).bit_length() - 1)
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(places[-1]) + 1) if n else 0, dtype=np.uint8)
        bits[places] = 1
        shifts = np.arange(width, dtype=np.uint64)
        low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(n, width, np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def _low_of(self, i: int) -> int:
        at = i * self.low_width
        first, last = at // 8, (at + self.low_width + 7) // 8
        return (int.from_bytes(self.low[first:last].tobytes(), "little") >> (at % 8)) & ((1 << self.low_width) - 1)

    def select(self, i: int) -> int:
        """The value at place i, from the sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE  # ones still to pass after the sampled one
        at, byte = place // 8, int(self.high[place // 8]) >> (place % 8) << (place % 8)
        while left >= (ones := int(_POPCOUNT[byte])):
            left -= ones
            at += 1
            byte = int(self.high[at])
        for _ in range(left):
            byte &= byte - 1
        place = at * 8 + (byte & -byte).bit_length() - 1
        return ((place - i) << self.low_width) | self._low_of(i)

    def values(self) -> np.ndarray:
        """All values, as uint64."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.uint64)[: self.n]
        high = (places - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_width)
        if not self.low_width:
            return high
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_width].reshape(self.n, self.low_width)
        return high | (bits.astype(np.uint64) << np.arange(self.low_width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_width, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[EliasFano, int]:
        """The structure and the number of bytes it took."""
        size = struct.calcsize("<QBQQQ")
        n, width, n_low, n_high, n_samples = struct.unpack("<QBQQQ", raw[:size])
        low = np.frombuffer(raw, np.uint8, n_low, size)
        high = np.frombuffer(raw, np.uint8, n_high, size + n_low)
        samples = np.frombuffer(raw, "<u4", n_samples, size + n_low + n_high)
        return cls(n, width, low, high, samples), size + n_low + n_high + 4 * n_samples
