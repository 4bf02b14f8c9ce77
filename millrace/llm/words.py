"""Words and shingles of texts as flat numpy arrays.

Words are the longest runs of letters and digits in the lower-cased text; `_` is no letter. A shingle is
a run of successive words, held as a 64-bit mix of its words' 64-bit hashes.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable

import numpy as np

WORD = re.compile(r"[^\W_]+")
_KEEP = 1_000_000  # words a worker remembers before it starts anew

U = np.uint64
_MIX = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _MIX[0]
    x = (x ^ (x >> U(27))) * _MIX[1]
    return x ^ (x >> U(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > _KEEP:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the number of words of each text."""
    known = sys.__dict__.setdefault("_millrace_words", None)
    if known is None:
        known = sys._millrace_words = _Hashes()
    get, parts, sizes = known.__getitem__, [], []
    for text in texts:
        found = WORD.findall(text.lower())
        sizes.append(len(found))
        parts.append(np.fromiter(map(get, found), dtype=np.uint64, count=len(found)))
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)), np.array(sizes, dtype=np.int64)


def shingles(hashes: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, hash) of every run of `width` words inside one text; start counts over all texts."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    n = len(hashes) - width + 1
    text = np.repeat(np.arange(len(sizes)), sizes)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        mixed = splitmix(mixed + hashes[k : k + n] + _MIX[2])
    starts = np.flatnonzero(text[:n] == text[width - 1 :])
    return text[starts], starts, mixed[starts]


def distinct(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, value) in order of both, with their multiplicities."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(text)))


def needed(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest intersection that a set of n members can have with one of similarity num/den or more: ceil(n * num / den)."""
    return -(-n * num // den)
