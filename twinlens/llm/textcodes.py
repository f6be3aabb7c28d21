"""Texts as arrays of code points, with rolling hashes, for vectorised text operators."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit integers (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=2)
def code_values(family: int = 0) -> np.ndarray:
    """A fixed pseudo-random 64-bit value for each code point; each family has others."""
    return mix64(np.arange(0x110000, dtype=np.uint64) + U64(0x632BE59BD9B4E019) * U64(2 * family + 1))


_POWERS = [np.zeros(0, dtype=np.uint64)] * 2


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if n > len(_POWERS[0]):
        size = 1 << max(12, int(n - 1).bit_length())
        for i, base in enumerate((_BASE, _BASE_INV)):
            x = np.full(size, U64(base))
            x[0] = 1
            _POWERS[i] = np.multiply.accumulate(x)
    return _POWERS


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def prefix_hash(c: np.ndarray, family: int = 0) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span; one longer than ``c``."""
    up, _ = powers(len(c) + 1)
    out = np.zeros(len(c) + 1, dtype=np.uint64)
    np.cumsum(code_values(family)[c] * up[: len(c)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), equal for equal code points wherever they stand."""
    _, down = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))
