"""A compressed full-text index over words (an FM-index) in numpy.

The texts of a shard stand end to end, a separator after each. Suffixes are sorted by prefix doubling. Of their order the index keeps the
Burrows-Wheeler transform as a wavelet matrix, a bit vector for each bit of a symbol with sampled counts, so a step of backward search is a rank
in each, for any number of patterns at once; and the text of every STEP-th suffix, which the others reach by walking back. Beside it stand the texts'
words in as few bits as the vocabulary needs, for exact comparison.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

STEP = 2  # words between the sampled positions of a text; its first word is always one
_U = np.uint64


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array, by prefix doubling; settled suffixes leave the sort. Ranks are 32-bit, as an index is bounded in size."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable").astype(np.int32)
    first = np.ones(n, dtype=bool)
    ordered = symbols[order]
    first[1:] = ordered[1:] != ordered[:-1]
    del ordered
    rank = np.empty(n, dtype=np.int32)
    starts = np.flatnonzero(first).astype(np.int32)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    size = np.diff(np.append(starts, n))
    open_ = order[np.repeat(size > 1, size)]
    del first, order
    width = 1
    while len(open_):
        key = rank[open_].astype(np.int64) * (n + 1)
        ahead = open_.astype(np.int64) + width
        inside = ahead < n
        key[inside] += rank[ahead[inside]].astype(np.int64) + 1
        del ahead, inside
        by = np.argsort(key, kind="stable").astype(np.int32)
        open_, key = open_[by], key[by]
        del by
        new = np.ones(len(open_), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        old = (key // (n + 1)).astype(np.int32)
        del key
        new_old = np.ones(len(open_), dtype=bool)
        new_old[1:] = old[1:] != old[:-1]
        at, sub = np.flatnonzero(new_old).astype(np.int32), np.flatnonzero(new).astype(np.int32)
        size = np.diff(np.append(sub, np.int32(len(open_))))
        old += np.repeat(sub, size)
        old -= np.repeat(at, np.diff(np.append(at, np.int32(len(open_)))))
        rank[open_] = old
        del old, new, new_old, at, sub
        open_ = open_[np.repeat(size > 1, size)]
        width *= 2
    order = np.empty(n, dtype=np.int32)
    order[rank] = np.arange(n, dtype=np.int32)
    return order


def bit_vector(bits: np.ndarray) -> dict[str, np.ndarray]:
    """Bits in 64-bit words, with counts of ones before each block of 512 bits and, inside it, before each word."""
    padded = np.zeros(-(-(len(bits) + 1) // 512) * 512, dtype=bool)
    padded[: len(bits)] = bits
    words = np.packbits(padded, bitorder="little").view(_U)
    each = np.bitwise_count(words).astype(np.int64).reshape(-1, 8)
    inside = np.cumsum(each, axis=1) - each
    blocks = np.cumsum(each.sum(axis=1)) - each.sum(axis=1)
    return {"words": words, "blocks": blocks.astype(np.uint32), "inside": inside.ravel().astype(np.uint16)}


def ones_before(v: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    k = at >> 6
    below = (_U(1) << (at & 63).astype(_U)) - _U(1)
    return v["blocks"][at >> 9].astype(np.int64) + v["inside"][k] + np.bitwise_count(v["words"][k] & below)


def bit_at(v: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    return (v["words"][at >> 6] >> (at & 63).astype(_U) & _U(1)).astype(bool)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """values in `width` bits each, as bytes with room for a read of eight at the end."""
    parts = []
    for at in range(0, len(values), 1 << 17):
        part = values[at : at + (1 << 17)].astype(np.uint32)
        parts.append(np.packbits((part[:, None] >> np.arange(width, dtype=np.uint32) & 1).astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate([*parts, np.zeros(8, dtype=np.uint8)])


def unpack(packed: np.ndarray, width: int, begin: int, end: int) -> np.ndarray:
    bit = np.arange(begin, end, dtype=np.int64) * width
    raw = packed[(bit >> 3)[:, None] + np.arange(8)].view("<u8").ravel()
    return (raw >> (bit & 7).astype(_U) & _U((1 << width) - 1)).astype(np.int64)


class WordIndex:
    """Index of texts given as 64-bit word hashes; texts are numbered from 0. parts: arrays by name, which hold all of it."""

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.parts = parts
        self.vocabulary, self.first, self.begin, self.labels = (parts[k] for k in ("vocabulary", "first", "begin", "labels"))
        self.width = max(1, int(len(self.vocabulary)).bit_length())
        vector = lambda name: {k: parts[f"{name}.{k}"] for k in ("words", "blocks", "inside")}
        self.levels = [vector(f"level{k}") for k in range(self.width)]
        self.marks = vector("marks")

    @cached_property
    def base(self) -> np.ndarray:
        """Where every symbol's run begins after the last level."""
        symbols = np.arange(len(self.first) - 1, dtype=np.int64)
        return self._down(symbols, np.zeros(len(symbols), dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(self.levels):
            ones = ones_before(level, at)
            at = np.where(symbol >> (self.width - 1 - k) & 1, self.parts["zeros"][k] + ones, at - ones)
        return at

    @classmethod
    def build(cls, hashes: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray) -> WordIndex:
        """hashes: word hashes in portions, which are used up."""
        vocabulary = np.unique(np.concatenate([np.unique(h) for h in hashes] or [np.zeros(0, dtype=_U)]))
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        inside = np.ones(begin[-1], dtype=bool)
        inside[begin[1:] - 1] = False
        ids = np.empty(int(sizes.sum()), dtype=np.int32)
        at = 0
        while hashes:
            portion = hashes.pop(0)
            ids[at : at + len(portion)] = np.searchsorted(vocabulary, portion) + 1
            at += len(portion)
        symbols = np.zeros(begin[-1], dtype=np.int32)
        symbols[inside] = ids
        del ids, inside
        width = max(1, int(len(vocabulary)).bit_length())
        parts = {"vocabulary": vocabulary, "begin": begin, "labels": labels, "text": pack(symbols, width), "first": np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(vocabulary) + 1))])}
        order = suffix_order(symbols)
        sampled = np.zeros(len(symbols), dtype=bool)
        sampled[begin[:-1]] = True
        sampled[::STEP] = True
        marks = sampled[order]
        parts["sampled"] = (np.searchsorted(begin, order[marks], "right") - 1).astype(np.int32)
        parts |= {f"marks.{k}": v for k, v in bit_vector(marks).items()}
        order -= 1
        left = symbols[order]  # the transform; the suffix at 0 is preceded by the last separator
        del order, symbols, marks, sampled
        zeros = np.zeros(width, dtype=np.int64)
        for k in range(width):
            one = (left >> (width - 1 - k) & 1).astype(bool)
            zeros[k] = len(one) - one.sum()
            parts |= {f"level{k}.{n}": v for n, v in bit_vector(one).items()}
            left = np.concatenate([left[~one], left[one]])
        return cls(parts | {"zeros": zeros})

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The index's symbols of the words; -1 for words that no indexed text holds."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, -1)

    def words_of(self, text: int) -> np.ndarray:
        """Hashes of the words of a text."""
        return self.vocabulary[unpack(self.parts["text"], self.width, int(self.begin[text]), int(self.begin[text + 1]) - 1) - 1]

    def start(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with the symbol."""
        return self.first[symbol], self.first[symbol + 1]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A step of backward search: rows of the suffixes that begin with the symbol followed by the pattern so far."""
        shift = self.first[symbol] - self.base[symbol]
        return self._down(symbol, low) + shift, self._down(symbol, high) + shift

    def windows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each pattern, a line of symbols; an empty range if it occurs nowhere. Lines should be sorted from their end: patterns with the same
        last words share the steps up to them."""
        at = np.zeros(len(words), dtype=np.int64)
        low, high = (x[:1] for x in (np.zeros(1, dtype=np.int64), np.full(1, len(self.first) and self.first[-1])))
        for k in range(words.shape[1] - 1, -1, -1):
            new = np.ones(len(words), dtype=bool)
            new[1:] = (at[1:] != at[:-1]) | (words[1:, k] != words[:-1, k])
            heads = np.flatnonzero(new)
            symbol, low, high = words[heads, k], low[at[heads]], high[at[heads]]
            if k == words.shape[1] - 1:
                low, high = self.start(symbol)
            else:
                go = np.flatnonzero(low < high)
                low, high = low.copy(), high.copy()
                low[go], high[go] = self.extend(symbol[go], low[go], high[go])
            at = np.cumsum(new) - 1
        return low[at], high[at]

    def texts_at(self, rows: np.ndarray) -> np.ndarray:
        """The text of each row's suffix: of the nearest sampled position before it, found by walking back in lockstep."""
        out = np.empty(len(rows), dtype=np.int64)
        left, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(left):
            there = bit_at(self.marks, at)
            out[left[there]] = self.parts["sampled"][ones_before(self.marks, at[there])]
            left, at = left[~there], at[~there]
            symbol = np.zeros(len(at), dtype=np.int64)
            for k, level in enumerate(self.levels):
                one, ones = bit_at(level, at), ones_before(level, at)
                symbol = symbol << 1 | one
                at = np.where(one, self.parts["zeros"][k] + ones, at - ones)
            at = self.first[symbol] + at - self.base[symbol]
        return out
