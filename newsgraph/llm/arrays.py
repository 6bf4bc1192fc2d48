"""Hashes over byte and word arrays, vectorised; used inside tasks."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]  # A-Z like a-z
_BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xC2B2AE3D27D4EB4F}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}

_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    if kind not in _powers or len(_powers[kind][0]) < n:
        size = max(n, 1 << 16)
        base, inverse = _BASE[kind], pow(_BASE[kind], -1, 1 << 64)
        made = []
        for x in (base, inverse):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[kind] = (made[0], made[1])
    return _powers[kind][0][:n], _powers[kind][1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class RangeHash:
    """Hash of any range of a sequence of 64-bit values from prefix sums of a polynomial."""

    def __init__(self, values: np.ndarray, kind: str):
        up, self.down = powers(kind, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def sliding(self, width: int) -> np.ndarray:
        """The hash of every range of this width."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:-width]) * self.down[:n])


def _drawn(prime: int) -> tuple[np.uint64, int, np.ndarray]:
    values = _RNG.integers(1, prime, 256, np.uint64)
    values[65:91] = values[97:123]  # A-Z like a-z
    return np.uint64(prime), int(_RNG.integers(1 << 20, prime)), values


_PRIME_HASHES = tuple(_drawn(prime) for prime in ((1 << 31) - 1, (1 << 31) - 19))


def _prime_powers(prime: np.uint64, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo a prime and of its inverse, by doubling."""
    key = f"modulo {prime}"
    if key not in _powers or len(_powers[key][0]) < n:
        size = max(n, 1 << 16)
        made = []
        for x in (base, pow(base, -1, int(prime))):
            steps = np.ones(1, np.uint64)
            while len(steps) < size:
                steps = np.concatenate([steps, steps * np.uint64(pow(x, len(steps), int(prime))) % prime])
            made.append(steps[:size])
        _powers[key] = (made[0], made[1])
    return _powers[key][0][:n], _powers[key][1][:n]


def byte_hash(data: np.ndarray, lower: bool = False) -> RangeHash:
    return RangeHash((_LOWER if lower else _BYTE)[data], "byte")


class WordHash:
    """Hashes of byte ranges in which no two contents are bound to collide: polynomials modulo two primes, each with a
    drawn base and drawn byte values. A sum modulo 2**64 meets for certain on some long words, whatever its base."""

    def __init__(self, data: np.ndarray):
        self.parts = []
        for prime, base, values in _PRIME_HASHES:
            up, down = _prime_powers(prime, base, len(data) + 1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values[data] * up[:-1] % prime, out=sums[1:])
            self.parts.append((prime, sums, down))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        (p, first, down), (q, second, under) = self.parts
        high = (first[end] - first[start]) % p * down[start] % p
        low = (second[end] - second[start]) % q * under[start] % q
        return mix(high << np.uint64(32) | low)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the range of words of each text. Words never cross texts."""
    inside = ~_BREAK[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)
