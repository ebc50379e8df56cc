"""Elias-Fano coding of ascending numbers, with a select structure."""

from __future__ import annotations

import numpy as np

# One of so many upper bits has its place noted.
SAMPLE = 256


class EliasFano:
    """n ascending numbers up to u in about n * (2 + log2(u / n)) bits.

    The lower bits of each number lie side by side. The upper bits are one bit
    vector, in which number i sets bit upper(i) + i, so the place of the ith set
    bit gives the upper part. `samples` has the place of every 256th set bit:
    select(i) starts there and reads on.
    """

    def __init__(self, n: int, width: int, lower: bytes, upper: bytes, samples: bytes):
        self.n, self.width, self.lower, self.upper, self.samples = n, width, lower, upper, samples

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        numbers = np.asarray(numbers, dtype=np.int64)
        n = len(numbers)
        if not n:
            return cls(0, 0, b"", b"", b"")
        if numbers[0] < 0 or (numbers[1:] < numbers[:-1]).any():
            raise ValueError("the numbers must ascend from 0 or more")
        width = max(0, int(numbers[-1]) // n).bit_length() - 1
        width = max(0, width)
        bits = ((numbers[:, None] >> np.arange(width)) & 1).astype(np.uint8)
        places = (numbers >> width) + np.arange(n)
        upper = np.zeros(int(places[-1]) + 1, dtype=np.uint8)
        upper[places] = 1
        return cls(
            n,
            width,
            np.packbits(bits.ravel(), bitorder="little").tobytes(),
            np.packbits(upper, bitorder="little").tobytes(),
            places[::SAMPLE].astype("<u4").tobytes() if places[-1] < 2**32 else places[::SAMPLE].astype("<u8").tobytes(),
        )

    def _low(self, i: int) -> int:
        at = i * self.width
        word = int.from_bytes(self.lower[at // 8 : (at + self.width + 7) // 8], "little")
        return word >> at % 8 & ((1 << self.width) - 1)

    def _place(self, i: int) -> int:
        size = len(self.samples) // (-(-self.n // SAMPLE))
        at = int.from_bytes(self.samples[i // SAMPLE * size :][:size], "little")
        left = i % SAMPLE
        byte = at // 8
        word = self.upper[byte] & (0xFF << at % 8)  # set bits from the noted one on
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = self.upper[byte]
        for _ in range(left):
            word &= word - 1
        return 8 * byte + (word & -word).bit_length() - 1

    def select(self, i: int) -> int:
        """Number i, reading a few bytes."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return (self._place(i) - i) << self.width | self._low(i)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.upper, np.uint8), bitorder="little"))[: self.n]
        bits = np.unpackbits(np.frombuffer(self.lower, np.uint8), bitorder="little", count=self.n * self.width)
        lower = bits.reshape(self.n, self.width).astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))
        return (places - np.arange(self.n)) << self.width | lower
