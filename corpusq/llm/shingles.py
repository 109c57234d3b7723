"""Words and word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
#: Odd multipliers of a shingle's words.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def word_hashes(text: bytes) -> np.ndarray:
    """xxHash64 of each word `[^\\x20\\x09-\\x0D]+`, A-Z in lower case; equal on all machines."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of the text's 5-word shingles; of all words if there are fewer."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    k = min(n, SHINGLE)
    out = h[: n - k + 1] * MIX[0]
    for j in range(1, k):
        out ^= out >> np.uint64(29)
        out = (out + h[j : n - k + 1 + j]) * MIX[j]
    out ^= out >> np.uint64(32)
    return np.unique(out + np.uint64(k))
