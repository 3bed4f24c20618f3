"""Rolling hashes of a byte buffer, and minima of neighbours, which pick the positions that stand for windows."""

from __future__ import annotations

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Rolling:
    """Polynomial hashes modulo 2^64: of T[i:i+n], the sum of letter(T[i+j]) * base^j. Equal strings have equal hashes.

    They pick positions and sort out strings that can't be equal. Different strings may have equal ones (pairs of
    Thue-Morse words do, whatever the base), so equality never rests on them.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.letters = rng.integers(0, 2**64, 256, U)
        self.base = int(rng.integers(0, 2**63)) * 2 + 1
        self.up = self.down = np.ones(1, U)

    def reach(self, n: int) -> None:
        """Powers of the base and of its inverse up to n."""
        if len(self.up) <= n:
            size = 1 << n.bit_length()
            for name, x in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                p = np.full(size + 1, x, U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def sums(self, buffer: np.ndarray) -> np.ndarray:
        self.reach(len(buffer))
        out = np.zeros(len(buffer) + 1, U)
        np.cumsum(self.letters[buffer] * self.up[: len(buffer)], out=out[1:])
        return out

    def each(self, sums: np.ndarray, n: int) -> np.ndarray:
        """Hashes of length n at every position."""
        m = len(sums) - n
        return (sums[n:] - sums[:m]) * self.down[:m]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours: prefix and suffix minima within blocks of w."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(U).max, U)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
