"""64-bit hashes of byte strings inside numpy arrays, the same on every machine."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, up to n at least."""
    global _powers, _inverses
    while len(_powers) <= n:
        k = len(_powers)
        with np.errstate(over="ignore"):
            _powers = np.concatenate([_powers, _powers * np.uint64(pow(BASE, k, 1 << 64))])
            _inverses = np.concatenate([_inverses, _inverses * np.uint64(pow(INVERSE, k, 1 << 64))])
    return _powers, _inverses


def prefixes(data: np.ndarray) -> np.ndarray:
    """Running sums of a polynomial in the bytes of ``data``; one longer than it."""
    powers, _ = _grown(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=out[1:])
    return out


def between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from starts to ends, from the running sums of prefixes()."""
    _, inverses = _grown(len(sums))
    return mixed((sums[ends] - sums[starts]) * inverses[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the input changes about half of the bits of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
