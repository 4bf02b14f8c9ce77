"""Evaluation texts inside training text, by template canonicalisation.

Numbers, names and units become typed placeholders; windows of successive template words are hash-joined with those of the
test items, and the slots of each met window are checked for consistency. A window whose slots agree word by word is a verbatim
passage; one whose slots agree up to a one-to-one renaming is a re-parameterised question.

There are two templates, both made of the words of a window alone. The plain one looks at lower-cased words: a number begins with a digit, a unit
is the word after a number inside the window; so a verbatim passage meets its window however it is written. The other also takes capitalised words
for names, and finds passages with other names.

Items are indexed by tasks in shards of bounded size, written to the shared folder with the places of their windows in a filter. Documents are read
once, without a shuffle; those with a window that passes the filter are stored and searched in every shard. The driver holds no item.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import artefacts
from millrace.llm.words import U, WORD, splitmix
from millrace.session import spread, stored, stored_path

ITEM_BYTES = 8 << 20  # item text in one shard
_HITS = 100_000  # met windows compared at once
# Symbols of the placeholders; words have 61-bit hashes above them.
NUMBER, UNIT, NAME = 1, 2, 3
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


class _Words(dict):
    """Word as written -> hash of the lower-cased word << 3 | capitalised << 1 | begins with a digit."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = (xxhash.xxh3_64_intdigest(word.lower()) >> 3 | 4) << 3 & (1 << 64) - 1 | word[0].isupper() << 1 | word[0].isdigit()
        return value


def read_words(texts: list[str], known: _Words) -> tuple[np.ndarray, np.ndarray]:
    get, parts, sizes = known.__getitem__, [], []
    for text in texts:
        # a few characters change under lower-casing in a way that depends on the text around them
        found = WORD.findall(text.lower()) if "İ" in text or "Σ" in text else WORD.findall(text)
        sizes.append(len(found))
        parts.append(np.fromiter(map(get, found), dtype=np.uint64, count=len(found)))
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)), np.array(sizes, dtype=np.int64)


def _power(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64."""
    if len(_POWERS.get(base, ())) < n:
        each = np.full(max(n, 1024), base, dtype=np.uint64)
        each[0] = 1
        _POWERS[base] = np.cumprod(each)
    return _POWERS[base][:n]


def _rolled(symbols: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of each run of `width` symbols, modulo 2^64: one running sum, whatever the width."""
    n = len(symbols) - width + 1
    run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(symbols * _power(_BASE, len(symbols)))])
    return (run[width:] - run[:n]) * _power(pow(_BASE, -1, 1 << 64), n)


def windows(flat: np.ndarray, sizes: np.ndarray, width: int, names: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, slots) of every window inside one text; slots tells which words of all texts a window takes for placeholders, whose first word is never a unit."""
    if len(flat) < width:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(len(flat), dtype=bool)
    text = np.repeat(np.arange(len(sizes)), sizes)
    number, capital = (flat & U(1)).astype(bool), (flat >> U(1) & U(1)).astype(bool) & names
    unit = np.concatenate([[False], number[:-1]]) & ~number
    word = flat >> U(3)
    opening = np.where(number, U(NUMBER), np.where(capital & ~number, U(NAME), word))
    symbols = np.where(unit, U(UNIT), opening)
    n = len(flat) - width + 1
    # inside the window, a word is a unit by the number before it, which the window's first word doesn't see
    hashes = splitmix(_rolled(symbols, width) + opening[:n] - symbols[:n])
    start = np.flatnonzero(text[:n] == text[width - 1 :])
    return start, hashes[start], number | unit | capital


def consistent(ours: np.ndarray, theirs: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether each line of words is the other up to a one-to-one renaming of its slots, with a word at least that is no slot."""
    same = ours == theirs
    pattern = (ours[:, :, None] == ours[:, None, :]) == (theirs[:, :, None] == theirs[:, None, :])
    return (same | slots).all(axis=1) & ~slots.all(axis=1) & (pattern | ~(slots[:, :, None] & slots[:, None, :])).all(axis=(1, 2))


def index_items(keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray, width: int, names: bool) -> dict[str, np.ndarray]:
    """The template windows of items as sorted hashes with their places, for each template, and the items' words."""
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = {"keys": keys, "begin": begin, "words": flat >> U(3)}
    every = []
    for k in range(1 + names):
        start, h, _ = windows(flat, sizes, width, bool(k))
        by = np.argsort(h, kind="stable")
        out |= {f"hashes{k}": h[by], f"starts{k}": start[by]}
        every.append(h)
    return out | {"places": artefacts.filter_places(np.concatenate(every))}


def search(index: dict[str, np.ndarray], flat: np.ndarray, sizes: np.ndarray, width: int, names: bool) -> dict[str, np.ndarray]:
    """text, item, verbatim, reworded: the windows of every text and item that share some."""
    reach = np.arange(width)
    text = np.repeat(np.arange(len(sizes)), sizes)
    word, found = flat >> U(3), []
    for k in range(1 + names):
        start, h, slots = windows(flat, sizes, width, bool(k))
        table = index[f"hashes{k}"]
        if not len(start) or not len(table):
            continue
        left = np.searchsorted(table, h)
        met = table[np.minimum(left, len(table) - 1)] == h
        start, left = start[met], left[met]
        count = np.searchsorted(table, h[met], "right") - left
        ends = np.cumsum(count)
        begin = 0
        while begin < len(start):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _HITS, "right")))
            own = count[begin:end]
            place = index[f"starts{k}"][np.repeat(left[begin:end] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
            at = np.repeat(start[begin:end], own)
            ours, theirs = word[at[:, None] + reach], index["words"][place[:, None] + reach]
            open_ = slots[at[:, None] + reach]
            open_[:, 0] &= (flat[at] & U(1)).astype(bool) | (bool(k) & (flat[at] >> U(1) & U(1)).astype(bool))
            equal = (ours == theirs).all(axis=1)
            other = ~equal
            other[other] = consistent(ours[other], theirs[other], open_[other])
            good = equal | other
            found.append(np.stack([text[at[good]], np.searchsorted(index["begin"], place[good], "right") - 1, at[good], place[good], other[good]], axis=1))
            begin = end
    if not found:
        return {n: np.zeros(0, dtype=np.int64) for n in ("text", "item", "verbatim", "reworded")}
    rows = np.unique(np.concatenate(found), axis=0)  # a window may meet the same place by both templates
    pair, inverse = np.unique(rows[:, :2], axis=0, return_inverse=True)
    inverse = inverse.ravel()
    reworded = np.bincount(inverse, weights=rows[:, 4], minlength=len(pair)).astype(np.int64)
    return {"text": pair[:, 0], "item": index["keys"][pair[:, 1]], "verbatim": np.bincount(inverse, minlength=len(pair)) - reworded, "reworded": reworded}


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", width: int = 12, names: bool = True, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(key, item_key, verbatim, reworded): how many windows of `width` successive words each document shares with each item.

    verbatim counts pairs of windows with equal words, reworded those equal up to a one-to-one renaming of their numbers and units, and with `names` of
    their names; a window of slots only is no reworded one. Null keys and null texts match nothing; texts of fewer than `width` words neither; an item text under several ids comes out
    under each; repeated rows give one row; very long texts are used whole; empty tables give an empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    held = items.select(items[item_key].cast("bigint").alias("i"), items[text].cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    path = stored_path(spark, "items")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, number = _Words(), TaskContext.get().partitionId(), 0
        keys, parts, sizes, filled = [], [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            return artefacts.pieces(f"{task}-{number}", index_items(np.concatenate(keys), np.concatenate(parts), np.concatenate(sizes), width, names))

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                flat, n = read_words(part.column(1).to_pylist(), known)
                keys.append(part.column(0).to_numpy())
                parts.append(flat)
                sizes.append(n)
                filled += part.column(1).nbytes
                if filled >= item_bytes:
                    yield from done()
                    number, keys, parts, sizes, filled = number + 1, [], [], [], 0
        if keys:
            yield from done()

    held.mapInArrow(build, artefacts.PIECE).write.option("compression", "zstd").parquet(path)
    heads = spark.read.schema(artefacts.PIECE).parquet(path).where("at = 0 AND array = 'places'").select("shard", "length").orderBy("shard").collect()  # a row for item_bytes of text
    bits = artefacts.filter_bits(sum(r.length for r in heads))
    rows = documents.select(documents[key].cast("bigint").alias("k"), documents[text].cast("string").alias("t")).where("k IS NOT NULL AND t IS NOT NULL")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                flat, sizes = read_words(batch.column(1).to_pylist(), known)
                met = artefacts.kept(path, "filter", lambda: artefacts.load_filter(path, bits))
                good = np.zeros(len(sizes), dtype=bool)
                text_of = np.repeat(np.arange(len(sizes)), sizes)
                for k in range(1 + names):
                    start, h, _ = windows(flat, sizes, width, bool(k))
                    good[text_of[start[artefacts.passes(met, bits, h)]]] = True
                yield batch.filter(pa.array(good))

    left = stored(spread(rows).mapInArrow(select, "k bigint, t string"), "possible")

    def part(shard: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Words()
            for whole in batches:
                for i in range(0, whole.num_rows, 500):
                    batch = whole.slice(i, 500)
                    index = artefacts.kept(path, shard, lambda: {n: v for _, n, v in artefacts.read(path, shard)})
                    out = search(index, *read_words(batch.column(1).to_pylist(), known), width, names)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out["text"])), *(pa.array(out[n], type=pa.int64()) for n in ("item", "verbatim", "reworded"))], names=["k", "i", "verbatim", "reworded"])

        return spread(left).mapInArrow(run, "k bigint, i bigint, verbatim bigint, reworded bigint")

    none = spark.createDataFrame([], "k bigint, i bigint, verbatim bigint, reworded bigint")
    found = reduce(DataFrame.unionByName, [part(r.shard) for r in heads], none)
    return found.groupBy(F.col("k").alias(key), F.col("i").alias(item_key)).agg(F.max("verbatim").alias("verbatim"), F.max("reworded").alias("reworded"))
