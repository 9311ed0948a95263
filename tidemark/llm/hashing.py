"""Vectorised polynomial hashes, modulo 2**64, of ranges of a byte buffer."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A fixed random value for each byte.
_BYTES = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """``base`` to the powers 0 .. n - 1."""
    have = _POWERS[base]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _POWERS[base] = have if len(have) <= 1 << 22 else _POWERS[base]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefixes(data: bytes) -> np.ndarray:
    """Prefix sums whose differences, shifted back, are the hashes of ranges."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * powers(len(data)), out=out[1:])
    return out


def ranges(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [starts, ends); equal ranges of one length have equal hashes."""
    raw = (prefix[ends] - prefix[starts]) * powers(len(prefix), _INVERSE)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def every(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ranges of ``size`` bytes."""
    n = len(prefix) - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((prefix[size:] - prefix[:n]) * powers(n, _INVERSE))
