"""Reading level of documents: classic readability formulas by sentence, the median of their grades, and a vote of the running text's sentences.

Syllables are counted by hyphenation-style rules: vowel groups, parted where two vowels are two syllables, without silent endings. Each
sentence gets the median grade of Flesch-Kincaid, Gunning fog, SMOG, Coleman-Liau and ARI. Two cuts turn grades into levels 1 to 3; they are
fitted on a bounded sample of labelled documents. A document has the level that most of its sentences have; quotations don't vote, formulas vote for 3.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import clean_lang
from millrace.session import spread

LABELS = 20_000  # labelled documents at most that the cuts are fitted on, by hash of the key
# Cuts used when there are no labels: end of the primary grades, end of college grades.
CUTS = (5.0, 19.0)
_GRID = 0.5  # grades are voted on in steps of this size
_STEPS = 128

_VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿ"
_GROUP = re.compile(f"[{_VOWELS}]+")
_HIATUS = re.compile("(?<![tsc])i[ao]|e[ou](?!s$)|u[ao]|ii|io(?!n)|ye[^s]|yi|(?<=[aeiou][^aeiou])ea$")
_SILENT = re.compile("[^aeiouyl]e$|[^aeioutd]ed$|[^aeiouscgzxj]es$|[aeiou]le$")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d[\d.,]*")
_BREAK = re.compile(r"(?<=[.!?…])[\"”»'’)]*\s+(?=\S)|(?<=[.!?])(?=<)|\n\s*(?=[^a-zß-ÿ\s])|\n\s*\n\s*")
_FORMULA = re.compile(r"\$|\\[a-zA-Z]+|[∑∫√≤≥∂∞]")
_TAG = re.compile(r"<[^<>]*>")
_QUOTE = re.compile(r"(?m)^\s*>.*$|[\"“][^\"“”\n]{80,}[\"”]")  # quoted lines, and quotations longer than a remark


def syllables(word: str) -> int:
    w = word.lower()
    n = len(_GROUP.findall(w)) + len(_HIATUS.findall(w)) - len(_SILENT.findall(w))
    return max(1, n)


class _Measures(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        letters = sum(map(str.isalnum, word))
        value = self[word] = (1 if word[0].isdigit() else syllables(word)) << 16 | letters
        return value


def sentences(text: str) -> list[str]:
    """Sentences of the running text, without markup and quotations."""
    if "<" in text:
        text = _TAG.sub("\n", text)
    return [s for s in _BREAK.split(_QUOTE.sub("\n", text)) if s and not s.isspace()]


def grade_counts(texts: list[str]) -> np.ndarray:
    """int[texts, steps]: how many sentences of each text have which median grade, in steps of _GRID from 0."""
    known = sys.__dict__.setdefault("_millrace_measures", None)
    if known is None:
        known = sys._millrace_measures = _Measures()
    get = known.__getitem__
    owner, sizes, formula, parts = [], [], [], []

    for i, text in enumerate(texts):
        for s in sentences(text):
            found = _WORD.findall(s)
            if found:
                owner.append(i)
                sizes.append(len(found))
                formula.append(_FORMULA.search(s) is not None)
                parts.append(np.fromiter(map(get, found), dtype=np.int64, count=len(found)))
    out = np.zeros((len(texts), _STEPS), dtype=np.int64)
    if not parts:
        return out
    flat, n = np.concatenate(parts), np.array(sizes, dtype=np.float64)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    syllable, letters = flat >> 16, flat & 0xFFFF
    s = np.add.reduceat(syllable, at)
    c = np.add.reduceat(letters, at)
    many = np.add.reduceat((syllable >= 3).astype(np.int64), at)
    # The coefficients of the published formulas, for one sentence.
    grades = np.stack([
        0.39 * n + 11.8 * s / n - 15.59,
        0.4 * (n + 100 * many / n),
        1.043 * np.sqrt(30.0 * many) + 3.1291,
        5.88 * c / n - 29.6 / n - 15.8,
        4.71 * c / n + 0.5 * n - 21.43,
    ])
    grade = np.where(formula, _STEPS * _GRID, np.median(grades, axis=0))
    step = np.clip(grade / _GRID, 0, _STEPS - 1).astype(np.int64)
    np.add.at(out, (np.array(owner), step), 1)
    return out


def vote(counts: np.ndarray, low: int, high: int) -> np.ndarray:
    """Level of each text by the cuts' steps; ties go to the higher level, a text without sentences to 2."""
    below = counts[:, :low].sum(axis=1)
    above = counts[:, high:].sum(axis=1)
    mid = counts.sum(axis=1) - below - above
    level = np.where((above >= mid) & (above >= below), 3, np.where(mid >= below, 2, 1))
    return np.where(counts.sum(axis=1) == 0, 2, level)


def fit_cuts(counts: np.ndarray, levels: np.ndarray) -> tuple[int, int]:
    """Steps of the two cuts with the fewest errors on the labels; the middle of the best ones."""
    if len(np.unique(levels)) < 3:
        return int(CUTS[0] / _GRID), int(CUTS[1] / _GRID)
    low, high = (int(c / _GRID) for c in CUTS)
    for _ in range(3):
        errors = [(vote(counts, k, high) != levels).sum() for k in range(2, high)]
        best = [k for k in range(2, high) if errors[k - 2] == min(errors)]
        low = best[len(best) // 2]
        errors = [(vote(counts, low, k) != levels).sum() for k in range(low + 1, _STEPS - 1)]
        best = [k for k in range(low + 1, _STEPS - 1) if errors[k - low - 1] == min(errors)]
        high = best[len(best) // 2]
    return low, high


def _readable(documents: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    return documents.select(documents[key].cast("bigint").alias("k"), documents[text].alias("t"), clean_lang(documents[lang]).alias("l")).where("k IS NOT NULL AND l = 'en' AND length(t) >= 400").select("k", "t")


def reading_levels(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", labels_used: int = LABELS) -> DataFrame:
    """(key, level, sentences, median_grade) of each English document of 400 characters or more.

    Null keys, texts and languages, shorter texts and other languages give no row; very long texts are read whole; repeated rows
    give one row; with no labels fixed cuts hold; an empty table gives an empty result; other columns are ignored. Only the cuts
    are fitted, on labels_used labelled documents at most, chosen by hash; a document labelled twice counts with both labels.
    """
    rows = _readable(documents, key, text, lang)
    chosen = labels.select(labels[key].cast("bigint").alias("k"), labels["level"].cast("int").alias("level")).where("k IS NOT NULL AND level BETWEEN 1 AND 3").orderBy(F.xxhash64("k"), "level").limit(labels_used)  # 12 bytes a row

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = grade_counts(batch.column(2).to_pylist())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * _STEPS), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["k", "level", "counts"])

    known = rows.join(F.broadcast(chosen), "k").select("k", "level", "t").mapInArrow(measure, "k bigint, level int, counts array<bigint>").orderBy("k", "level").collect()
    counts = np.array([r.counts for r in known], dtype=np.int64).reshape(len(known), _STEPS)
    low, high = fit_cuts(counts, np.array([r.level for r in known], dtype=np.int64))

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                counts = grade_counts(batch.column(1).to_pylist())
                total = counts.sum(axis=1)
                middle = (np.cumsum(counts, axis=1) * 2 >= np.maximum(total, 1)[:, None]).argmax(axis=1) * _GRID
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vote(counts, low, high).astype(np.int32)), pa.array(total), pa.array(middle)], names=[key, "level", "sentences", "median_grade"])

    return spread(rows).mapInArrow(level, f"`{key}` bigint, level int, sentences bigint, median_grade double").dropDuplicates([key])
