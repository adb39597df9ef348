"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
MULT = tuple(U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.cache
def word_marks() -> np.ndarray:
    """For each code point whether it belongs to words (letters, marks, digits)."""
    import unicodedata
    return np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), bool, 0x110000)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each lower-cased word, in order: the sum of position-mixed characters."""
    if not text:
        return np.empty(0, U)
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = word_marks()[cps]
    first = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(first):
        return np.empty(0, U)
    at = np.flatnonzero(inside)
    begins = np.searchsorted(at, first)
    pos = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
    return mixed(np.add.reduceat(mixed(cps[at].astype(U) | (pos.astype(U) << U(32))), begins))


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of all words where there are fewer than k."""
    w = word_hashes(text or "")
    n = len(w)
    if not n:
        return w
    k = min(k, n)
    out = np.zeros(n - k + 1, U)
    for j in range(k):
        out += w[j:n - k + 1 + j] * MULT[j % len(MULT)] + U(j)
    return np.unique(mixed(out))
