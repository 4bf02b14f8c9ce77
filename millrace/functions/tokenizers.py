"""Byte-level BPE tokenizers in Arrow batches: fitting on bounded texts, counting and encoding.

A tokenizer travels as its JSON text and is built once per Python worker.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import sys
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Special tokens with ids 0 to 3.
SPECIAL_TOKENS = ["<unk>", "<pad>", "<bos>", "<eos>"]
# Artefacts that a tokenizer's fingerprint covers; the digest runs over them in this order.
ARTEFACTS = ["tokenizer.json", "tokenizer.model", "added_tokens.json", "special_tokens_map.json", "tokenizer_config.json", "vocab.json", "merges.txt"]

_WORD = re.compile(r"\w+|[^\w\s]")


class WhitespaceTokenizer:
    """Anything with encode(text) -> list can stand for a tokenizer; this one splits words and marks."""

    def encode(self, text: str) -> list[str]:
        return _WORD.findall(text)


def fit_bpe(texts: Iterable[str], vocabulary: int, least: int = 2) -> str:
    """A byte-level BPE as JSON; the same texts in the same order give the same tokenizer. No texts give the byte alphabet."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

    own = Tokenizer(models.BPE(unk_token=SPECIAL_TOKENS[0]))
    own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    own.decoder = decoders.ByteLevel()
    trainer = trainers.BpeTrainer(vocab_size=vocabulary, min_frequency=least, special_tokens=SPECIAL_TOKENS, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False)
    own.train_from_iterator(texts, trainer)
    return own.to_str()


_PAIR = 24  # bits of a symbol in a pair's number


def byte_words(texts: list[str]) -> list[list[str]]:
    """The words of each text as the tokenizers of fit_bpe split it, in their byte alphabet."""
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    return [[w for w, _ in split(t)] for t in texts]


def fit_bpe_words(words: Iterable[tuple[str, int]], vocabulary: int, least: int = 2) -> str:
    """fit_bpe of texts that hold these words (distinct, in the byte alphabet) so often; time and memory go by the words, not by their counts.

    The steps are the library's: the most frequent pair, then the smallest; every entry of the queue brings the words that it was pushed for, and a
    token that two pairs spell has one id.
    """
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
    names = SPECIAL_TOKENS + alphabet
    ids = {t: i for i, t in enumerate(names)}
    held = [(w, n) for w, n in words if n > 0]
    symbols, counts = [[ids[c] for c in w] for w, _ in held], [n for _, n in held]
    pairs: dict[int, int] = {}
    where: dict[int, set[int]] = defaultdict(set)
    for i, (w, n) in enumerate(zip(symbols, counts)):
        for a, b in zip(w, w[1:]):
            k = a << _PAIR | b
            pairs[k] = pairs.get(k, 0) + n
            where[k].add(i)
    entries: list = list(where.values())
    queue = [(-pairs[k], k, at) for at, k in enumerate(where)]
    heapq.heapify(queue)
    merges: list[tuple[str, str]] = []
    low = (1 << _PAIR) - 1
    while len(ids) < vocabulary and queue:
        count, k, at = queue[0]
        if -count != pairs[k]:
            if pairs[k] > 0:
                heapq.heapreplace(queue, (-pairs[k], k, at))
            else:
                heapq.heappop(queue)
            continue
        if -count < max(1, least):
            break
        heapq.heappop(queue)
        a, b = k >> _PAIR, k & low
        token = names[a] + names[b]
        new = ids.setdefault(token, len(names))
        if new == len(names):
            names.append(token)
        merges.append((names[a], names[b]))
        where = defaultdict(set)
        for i in entries[at]:
            w, n = symbols[i], counts[i]
            j, end = 0, len(w) - 1
            while j < end:
                if w[j] == a and w[j + 1] == b:
                    if j:
                        left = w[j - 1] << _PAIR
                        pairs[left | a] -= n
                        pairs[left | new] = pairs.get(left | new, 0) + n
                        where[left | new].add(i)
                    w[j : j + 2] = [new]
                    end -= 1
                    if j < end:
                        right = w[j + 1]
                        pairs[b << _PAIR | right] -= n
                        pairs[new << _PAIR | right] = pairs.get(new << _PAIR | right, 0) + n
                        where[new << _PAIR | right].add(i)
                j += 1
        entries[at] = ()
        for pair, touched in where.items():
            if pairs[pair] > 0:
                heapq.heappush(queue, (-pairs[pair], pair, len(entries)))
                entries.append(touched)
    own = Tokenizer(models.BPE(vocab=ids, merges=merges, unk_token=SPECIAL_TOKENS[0]))
    own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    own.decoder = decoders.ByteLevel()
    own.add_special_tokens(SPECIAL_TOKENS)
    return own.to_str()


def word_lengths(json_text: str, words: list[str]) -> np.ndarray:
    """Tokens of each word of the byte alphabet; the tokenizer isn't kept, as each round has others."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(json_text)
    split = own.model.tokenize
    return np.fromiter((len(split(w)) for w in words), dtype=np.int64, count=len(words))


def load(json_text: str):
    """The tokenizer of a JSON text, kept by the worker under its digest."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    kept = sys.__dict__.setdefault("_millrace_tokenizers", {})
    name = hashlib.sha256(json_text.encode()).hexdigest()
    if name not in kept:
        if len(kept) > 64:
            kept.clear()
        kept[name] = Tokenizer.from_str(json_text)
    return kept[name]


def bpe_costs(df: DataFrame, key: str, text: str, experts: list[str], name: str = "costs") -> DataFrame:
    """df's other columns and `name`, the number of tokens of the text under each tokenizer (without special tokens); null texts have null.

    All experts run in one pass over the batch, so documents aren't multiplied or shuffled.
    """
    kept = [c for c in df.columns if c != text]
    fields = ", ".join(f"`{c}` {t}" for c, t in df.select(*kept).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [load(e) for e in experts]
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                texts = batch.column(len(kept)).to_pylist()
                counts = np.array([[len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)] for t in own], dtype=np.int64).T
                costs = pa.array([None if t is None else row for t, row in zip(texts, counts.tolist())], type=pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], costs], names=[*kept, name])

    return df.select(*kept, text).mapInArrow(run, f"{fields}, `{name}` array<bigint>")


def bpe_ids(df: DataFrame, text: str, json_text: str, name: str = "ids") -> DataFrame:
    """df's other columns and `name`, the text's tokens without special ones; null for null, an empty array for an empty text."""
    kept = [c for c in df.columns if c != text]
    fields = ", ".join(f"`{c}` {t}" for c, t in df.select(*kept).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(json_text)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                texts = batch.column(len(kept)).to_pylist()
                found = own.encode_batch([x or "" for x in texts], add_special_tokens=False)
                ids = pa.array([None if t is None else f.ids for t, f in zip(texts, found)], type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], ids], names=[*kept, name])

    return df.select(*kept, text).mapInArrow(run, f"{fields}, `{name}` array<int>")


def _fingerprint(content: F.Column, names: F.Column, revision: F.Column, path: F.Column, hash_path: bool) -> F.Column:
    """'sha256:' and the digest of the revision followed by names and contents; by the path if there is no artefact and hash_path is set."""
    parts = F.aggregate(F.arrays_zip(names.alias("n"), content.alias("c")), F.encode(F.lit(""), "UTF-8"), lambda done, x: F.concat(done, F.encode(x["n"], "UTF-8"), x["c"]))
    body = F.when(F.size(names) > 0, parts).otherwise(F.encode(path if hash_path else F.lit(""), "UTF-8"))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.encode(F.coalesce(revision, F.lit("")), "UTF-8"), body), 256))


def fingerprints(spark: SparkSession, folders: DataFrame, hash_path: bool = True) -> DataFrame:
    """(path, revision, artefacts, fingerprint) of each (path, revision) of folders; path is a folder on any storage, or one file.

    The digest covers the revision ('' for null), then name and bytes of every artefact there is, in the order of ARTEFACTS. A path without any is
    digested itself if hash_path is set, else the revision alone. Null paths give no row; a path under two revisions gives two rows.
    """
    named = folders.where("path IS NOT NULL").select("path", "revision").distinct()
    found: dict[str, list[tuple[str, str]]] = {}
    for (path,) in named.select("path").distinct().collect():  # a row a tokenizer
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if system.exists(at):
            whole = not system.getFileStatus(at).isDirectory()
            found[path] = [(at.getName(), path)] if whole else [(n, f"{path.rstrip('/')}/{n}") for n in ARTEFACTS if system.exists(spark._jvm.org.apache.hadoop.fs.Path(at, n))]
    files = [(p, k, n, f) for p, held in found.items() for k, (n, f) in enumerate(held)]
    if not files:
        held = spark.createDataFrame([], "path string, names array<string>, contents array<binary>")
    else:
        listed = spark.createDataFrame([(p, k, n, str(spark._jvm.org.apache.hadoop.fs.Path(f).toUri().getPath())) for p, k, n, f in files], "path string, k int, name string, at string")
        read = spark.read.format("binaryFile").load(sorted({f for *_, f in files})).select(F.regexp_replace("path", "^[a-zA-Z0-9+.-]+:(//[^/]*)?(?=/)", "").alias("at"), "content")
        parts = listed.join(read, "at").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", "name", "content"))).alias("parts"))  # seven files at most
        held = parts.select("path", F.col("parts.name").alias("names"), F.col("parts.content").alias("contents"))
    out = named.join(held, "path", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>"))).withColumn("contents", F.coalesce("contents", F.array().cast("array<binary>")))
    return out.select("path", "revision", F.col("names").alias("artefacts"), _fingerprint(F.col("contents"), F.col("names"), F.col("revision"), F.col("path"), hash_path).alias("fingerprint"))


def fingerprint(folder: str, revision: str | None = None, hash_path: bool = True) -> str:
    """fingerprints() of one local path, on the driver."""
    held = [folder] if os.path.isfile(folder) else [p for n in ARTEFACTS if os.path.isfile(p := os.path.join(folder, n))]
    body = b"".join(os.path.basename(p).encode() + open(p, "rb").read() for p in held) or (folder.encode() if hash_path else b"")
    return "sha256:" + hashlib.sha256((revision or "").encode() + body).hexdigest()
