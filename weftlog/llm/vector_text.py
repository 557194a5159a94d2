"""Words, hashes and shingles of many texts at once, as numpy arrays over one byte buffer."""

from __future__ import annotations

import functools

import numpy as np

M = np.uint64
#: Separators of words: space and bytes 9 to 13.
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower case, and every ASCII byte that is no letter or digit is a space.
PLAIN = LOWER.copy()
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all."""
    x = (x ^ (x >> M(30))) * M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> M(27))) * M(0x94D049BB133111EB)
    return x ^ (x >> M(31))


#: A random value for each byte.
CODES = mix(np.arange(1, 257, dtype=np.uint64) * M(BASE))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def upto(base: int) -> np.ndarray:
        out = np.full(n, base % 2**64, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return upto(BASE), upto(pow(BASE, -1, 2**64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = _powers(1 << max(20, int(n).bit_length()))
    return p[:n], q[:n]


class Words:
    """Words of `texts` (bytes or None): starts, ends (bytes in buf), doc (index of the text)."""

    def __init__(self, texts: list, table: np.ndarray | None = None):
        raw = b" ".join([t or b"" for t in texts]) + b" "
        buf = np.frombuffer(raw, np.uint8)
        self.buf = table[buf] if table is not None else buf
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        self.first = np.concatenate(([0], np.cumsum(sizes)))  # of each text in buf
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = ~WHITE[self.buf]
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.bounds = np.searchsorted(self.starts, self.first)  # words of text i: bounds[i] to bounds[i + 1]
        self.n = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.buf, self.starts, self.ends)


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    p, _ = powers(len(buf))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(CODES[buf] * p)))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """Polynomial hashes of spans of a buffer, from prefix sums; equal bytes, equal hash."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = prefix_sums(buf) if sums is None else sums
    _, q = powers(len(buf) + 1)
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64) * M(BASE))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` consecutive values, in their order."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * M(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(out)
