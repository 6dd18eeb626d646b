"""Word shingles of a text as a sorted array of 64-bit hashes.

A-Z are lower-cased, words are runs without ASCII white space. The hash of a shingle is a pair of polynomials over the bytes of its words modulo
2 ** 31 - 1, at two bases drawn once, taken from prefix sums over the whole text, so all shingles of a text come from a few numpy passes. Two
different shingles of n bytes share a hash with probability (n / 2 ** 31) ** 2 over the draw of the bases; unlike modulo a power of two there are no words
that collide for every base.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
BASE = 0x9E3779B97F4A7C15
PRIME = (1 << 31) - 1
BASES = (1_482_907_663, 906_331_217)  # drawn at random below PRIME
STRETCH = 1 << 24
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RollingHash:
    """Hashes of spans of one byte string modulo 2 ** 64, for choices and lookups that are checked otherwise: strings can be made that collide.
    Powers are kept and grow with the longest string."""

    def __init__(self) -> None:
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) <= n:
            size = max(n + 1, 2 * len(self._up), 1 << 16)
            for name, base in (("_up", BASE), ("_down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, np.uint64(base))
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self._up, self._down

    def sums(self, data: np.ndarray) -> np.ndarray:
        up, _ = self._powers(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = self._powers(len(sums))
        return _mix((sums[end] - sums[start]) * down[start])


class PrimeHash:
    """Hashes of spans of one byte string by two polynomials modulo ``PRIME``; powers are kept and grow with the longest string."""

    def __init__(self) -> None:
        self._up = [np.ones(1, np.uint64) for _ in BASES]
        self._down = [np.ones(1, np.uint64) for _ in BASES]

    @staticmethod
    def _fold(x: np.ndarray) -> np.ndarray:
        """The residues of numbers below 2 ** 64, below 2 ** 31 + 8."""
        x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
        return (x & np.uint64(PRIME)) + (x >> np.uint64(31))

    def _powers(self, n: int) -> None:
        if len(self._up[0]) > n:
            return
        size = max(n + 1, 2 * len(self._up[0]), 1 << 16)
        for powers, roots in ((self._up, BASES), (self._down, [pow(b, -1, PRIME) for b in BASES])):
            for i, root in enumerate(roots):
                out, held = np.ones(size, np.uint64), 1
                while held < size:
                    more = min(held, size - held)
                    out[held : held + more] = out[:more] * np.uint64(pow(root, held, PRIME)) % np.uint64(PRIME)
                    held += more
                powers[i] = out

    def sums(self, data: np.ndarray) -> list[np.ndarray]:
        self._powers(len(data))
        values = data.astype(np.uint64) + np.uint64(1)
        out = []
        for up in self._up:
            sums = np.zeros(len(data) + 1, np.uint64)
            # terms are below 2 ** 39, so a stretch of 2 ** 24 of them and a residue stay below 2 ** 64
            for s in range(0, len(data), STRETCH):
                e = min(s + STRETCH, len(data))
                np.cumsum(values[s:e] * up[s:e], out=sums[s + 1 : e + 1])
                if s:
                    sums[s + 1 : e + 1] += sums[s] % np.uint64(PRIME)
            out.append(sums)
        return out

    def spans(self, sums: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        parts = []
        for s, down in zip(sums, self._down, strict=True):
            value = self._fold(self._fold(s[end]) + np.uint64(2 * PRIME) - self._fold(s[start]))
            value = self._fold(value * down[start])
            parts.append(np.where(value >= PRIME, value - np.uint64(PRIME), value))
        return _mix(parts[0] | parts[1] << np.uint64(31))


def shingle_set(text: str | None, hashing: PrimeHash, words: int = WORDS) -> np.ndarray:
    """Distinct shingles, ascending; a text with fewer words is one shingle, one without words none."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    sums = hashing.sums(np.frombuffer(joined, np.uint8))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(words, len(parts))
    return np.unique(hashing.spans(sums, starts[: len(parts) - k + 1], ends[k - 1 :]))
