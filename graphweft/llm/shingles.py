"""Word shingles of texts as XXH64 hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SEED = 42
_FEW = 1 << 15


def shingle_hashes(text: str | None, words_per_shingle: int) -> Iterator[np.ndarray]:
    """The XXH64 of each run of words of a text, some at a time; a shorter text is one run, no words give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return
    n = max(1, len(words) - words_per_shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _FEW):
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _FEW], ends[at : at + _FEW])], dtype="<u8")


def shingle_set(text: str | None, words_per_shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order; none for a text without words."""
    return np.unique(np.concatenate([np.empty(0, "<u8"), *shingle_hashes(text, words_per_shingle)]))
