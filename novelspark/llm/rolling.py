"""Rolling hashes of byte strings with numpy: any substring's hash from two prefix values, all in arithmetic modulo 2**64."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd, so that its powers can be undone.
BASE = 0x9E6C63D0876A3F6B
INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), kept from call to call."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 20), base, U)
        steps[0] = 1
        held = _powers[base] = np.multiply.accumulate(steps)
    return held[:n]


class Prefixes:
    """of(starts, ends): a hash for each data[start:end]; equal strings have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.sums = np.zeros(self.n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * powers(BASE, self.n), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * powers(INVERSE, self.n + 1)[starts])

    def of_all(self, length: int) -> np.ndarray:
        """For each start at which length bytes are left."""
        m = max(0, self.n - length + 1)
        return mixed((self.sums[length : length + m] - self.sums[:m]) * powers(INVERSE, self.n + 1)[:m])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xA24BAED4963EE407)
    x ^= x >> U(32)
    return x


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each width consecutive values, by doubling."""
    m, have = x, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[:-rest], m[rest:]) if rest else m
