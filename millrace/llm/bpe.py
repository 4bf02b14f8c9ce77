"""Encoding with a public byte-level BPE by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged across, so the text may be cut
there with certainty, provided the cut cannot change the pre-tokenizer's view of either side. The
fragments are encoded independently (each distinct one once per worker) and their ids concatenated.

A cut between bytes x and y is used when
  * the pair (x, y) occurs inside no token,
  * y starts a character (it is no UTF-8 continuation byte),
  * y is no apostrophe: after a cut it could open a contraction such as 's,
  * x ends no white space: the pre-tokenizer looks ahead from white space only.
The pre-tokenizer never looks behind, so scanning from such a cut equals scanning through it.
"""

from __future__ import annotations

import base64
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER_DIR = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")

# The published pre-tokenizer pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Last bytes of the UTF-8 forms of white space (ASCII, U+0085, U+00A0, U+1680, U+180E, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000).
SPACE_ENDS = [*range(9, 14), *range(28, 33), 0x85, 0xA0, *range(0x80, 0x8B), 0x8E, 0xA8, 0xA9, 0xAF, 0x9F]

_WORDS = 4  # fragments up to 32 bytes are told apart as four machine words
_SLICE = 4 << 20  # bytes of text handled at once
_CACHE = 400_000  # fragments kept by a worker before its cache starts anew


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def cut_table(ranks: dict[bytes, int]) -> np.ndarray:
    """table[x << 8 | y]: whether a cut between bytes x and y is certain."""
    table = np.ones(65536, dtype=bool)
    for token in ranks:
        for x, y in zip(token, token[1:]):
            table[x << 8 | y] = False
    grid = table.reshape(256, 256)
    grid[:, 0x80:0xC0] = False
    grid[:, ord("'")] = False
    grid[SPACE_ENDS, :] = False
    return table


class FragmentEncoder:
    """Encodes Arrow string columns; holds the ids of every distinct fragment seen so far."""

    def __init__(self, path: str) -> None:
        import tiktoken

        ranks = read_ranks(path)
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cuts = cut_table(ranks)
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.begin: list[int] = []
        self.count: list[int] = []

    def _slot(self, fragment: bytes) -> int:
        slot = self.slots.get(fragment)
        if slot is None:
            ids = self.encode(fragment.decode("utf-8"))
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), dtype=np.int32)])
            self.ids[self.used : self.used + len(ids)] = ids
            slot = self.slots[fragment] = len(self.begin)
            self.begin.append(self.used)
            self.count.append(len(ids))
            self.used += len(ids)
        return slot

    def _fragments(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and slots of the fragments of the texts lying at offsets in raw."""
        buf = np.frombuffer(raw, dtype=np.uint8)
        size = len(buf)
        inner = np.flatnonzero(self.cuts[buf[:-1].astype(np.uint16) << 8 | buf[1:]]) + 1
        mark = np.zeros(size + 1, dtype=bool)
        mark[inner] = True
        mark[offsets] = True
        mark[size] = False
        starts = np.flatnonzero(mark)
        lengths = np.diff(np.append(starts, size))
        padded = np.concatenate([buf, np.zeros(8 * _WORDS + 8, dtype=np.uint8)])
        view = np.ndarray(shape=(size + 8 * _WORDS,), dtype="<u8", buffer=padded.data, strides=(1,))
        words, mixed = [], lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        for k in range(_WORDS):
            left = np.clip(lengths - 8 * k, 0, 8).astype(np.uint64)
            mask = np.where(left == 8, full, (np.uint64(1) << (left * np.uint64(8) & np.uint64(63))) - np.uint64(1))
            w = view[starts + 8 * k] & mask
            words.append(w)
            mixed = (mixed ^ w) * np.uint64(0xFF51AFD7ED558CCD)
            mixed ^= mixed >> np.uint64(32)
        slots = np.full(len(starts), -1, dtype=np.int64)
        short = np.flatnonzero(lengths <= 8 * _WORDS)
        if len(short):
            _, first, inverse = np.unique(mixed[short], return_index=True, return_inverse=True)
            head = short[first]
            same = lengths[short] == lengths[head[inverse]]
            for w in words:
                same &= w[short] == w[head[inverse]]
            ends = starts + lengths
            of_head = np.fromiter((self._slot(raw[a:b]) for a, b in zip(starts[head].tolist(), ends[head].tolist())), dtype=np.int64, count=len(head))
            slots[short[same]] = of_head[inverse[same]]
        for i in np.flatnonzero(slots < 0).tolist():  # long fragments, and any whose mixed word collided
            slots[i] = self._slot(raw[starts[i] : starts[i] + lengths[i]])
        return starts, lengths, slots

    def __call__(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the ids' offsets by text (one more than texts)."""
        if not len(raw):
            return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
        if len(self.begin) > _CACHE:
            self._clear()
        starts, _, slots = self._fragments(raw, offsets)
        counts = np.array(self.count, dtype=np.int64)[slots]
        out = np.concatenate([[0], np.cumsum(counts)])
        index = np.repeat(np.array(self.begin, dtype=np.int64)[slots] - out[:-1], counts) + np.arange(out[-1])
        return self.ids[index], out[np.searchsorted(starts, offsets)]


def text_slices(column: pa.Array, most: int = _SLICE) -> Iterator[tuple[bytes, np.ndarray]]:
    """Consecutive slices of an Arrow string column as bytes and offsets from 0; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, len(column))
        raw = data.slice(int(at[i]), int(at[j] - at[i])).to_pybytes() if data is not None and at[j] > at[i] else b""
        yield raw, at[i : j + 1] - at[i]
        i = j


def worker_encoder(path: str) -> FragmentEncoder:
    """One encoder per Python worker and vocabulary, kept between tasks."""
    kept = sys.__dict__.setdefault("_millrace_encoders", {})
    if path not in kept:
        kept[path] = FragmentEncoder(path)
    return kept[path]


def encode_column(column: pa.Array, encoder: FragmentEncoder) -> pa.Array:
    ids, sizes = [], [np.zeros(1, dtype=np.int64)]
    total = 0
    for raw, offsets in text_slices(column):
        values, ends = encoder(raw, offsets)
        ids.append(values)
        sizes.append(ends[1:] + total)
        total += len(values)
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(flat, type=pa.int32()))


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids ARRAY<INT>) of each row, without special tokens; special strings in a text are ordinary text.

    Nulls: a null text and an empty text both give an empty array, never null; a null key stays null.
    Blank texts have the ids of their white space. Repeated rows give repeated results; an empty table
    gives an empty result; other columns are ignored. Nothing is shuffled.
    """
    path = f"{folder}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), encode_column(part.column(1), encoder)], names=[key, "ids"])

    picked = df.select(df[key], df[text].cast("string"))
    kind = dict(picked.dtypes)[key]
    return picked.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_column(column: pa.Array, encoder: FragmentEncoder) -> np.ndarray:
    """Number of ids of each text."""
    counts = [np.diff(encoder(raw, offsets)[1]) for raw, offsets in text_slices(column)]
    return np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
