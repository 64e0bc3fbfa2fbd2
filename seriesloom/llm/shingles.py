"""Word hashes and word shingles of whole texts, vectorised; used inside tasks only.

Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

A = np.uint64(0x9E3779B97F4A7C15)
B = np.uint64(0xC2B2AE3D27D4EB4F)
#: Texts are taken through the vectorised code about so many bytes at a time.
BLOCK_BYTES = 1 << 20

_LOWER = bytes(range(256)).lower()
#: A-Z lower-cased; all ASCII characters but letters and digits become blanks.
_WORD = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in _LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each bit of the input reaches all bits of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blank_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and everything beyond ASCII, A-Z lower-cased; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


def blocks(texts: list[str | None]):
    """Ranges of texts of about BLOCK_BYTES together, in order."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BLOCK_BYTES:
            yield range(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield range(at, len(texts))


def hash_words(words: list[bytes]) -> np.ndarray:
    out = np.empty(len(words), dtype=object)
    out[:] = words
    return pd.util.hash_array(out, categorize=False)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of ``k`` words, by position; empty if there are fewer words.

    Word hashes are uniform already, so a weighted sum of them is as well.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = h[:n] * B
    for j in range(1, k):
        x = x * A + h[j : j + n] * B
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x
