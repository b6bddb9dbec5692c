"""Words, word shingles and their hashes, for whole Arrow batches at a time."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    """word -> 64-bit hash, remembered; forgets everything beyond ``most`` words, so that memory stays bounded."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the output (uint64)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(texts: list, cache: WordHashes, width: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts of at least ``min_words`` (and ``width``) words.

    Returns (positions of those texts, flat hashes sorted within each text, start of each text's run)."""
    keep, flat, lens = [], [], []
    least = max(min_words, width)
    for i, t in enumerate(texts):
        w = words(t)
        if len(w) >= least:
            keep.append(i)
            lens.append(len(w))
            flat.append(np.fromiter(map(cache.__getitem__, w), np.uint64, len(w)))
    if not keep:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w, n = np.concatenate(flat), np.array(lens)
    doc = np.repeat(np.arange(len(n)), n)
    total = len(w) - width + 1
    h = np.zeros(total, np.uint64)
    for k in range(width):
        h = (h ^ w[k : k + total]) * (_A if k % 2 else _B) + _C
    h, doc = mix(h), np.where(doc[:total] == doc[width - 1 :], doc[:total], -1)
    h, doc = h[doc >= 0], doc[doc >= 0]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[first], doc[first]
    return np.array(keep), h, np.searchsorted(doc, np.arange(len(n)))
