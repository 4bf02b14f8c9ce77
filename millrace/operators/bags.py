"""Texts as counts of their tokenizer words, so that fitting and costing go by distinct words and not by texts.

A byte-level BPE never merges across the words of its pre-tokenizer. So what a text costs is a sum over its words, and what a fit learns is set by the words' counts.
Texts are read once, into chunks with the words of each text by number; a table beside them holds every distinct word once. A round fits its tokenizers on summed
counts and encodes each distinct word once with each. Nothing is kept for a document between rounds: labels and weights follow from the words' costs.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import sys
import weakref
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.tokenizers import byte_words, fit_bpe_words, word_lengths
from millrace.session import spread, stored, stored_path

CHUNK = 4 << 20  # characters of text in a chunk
_UNIT = 10**9  # weights count in these parts
_BITS = 20  # leading bits of a race by which its rank is looked for


@dataclass
class Bags:
    """chunks: texts by the number of their words; words: the path of (hash, word), by hash; fits: paths of the last fits."""

    chunks: DataFrame
    words: str
    key: str
    kind: str
    fits: list[str] = field(default_factory=list)


@dataclass
class State:
    """Where labels and weights come from: stored labels (weights are one or none), or the words' costs and what an assignment adds to them.

    groups: with labels, those of each expert's texts; else the expert's own number. draws: for each expert the last (race, key) of those that get one repeat more than the whole part of their weight.
    """

    experts: int
    labels: str | None = None
    costs: str | None = None
    extra: list[float] = field(default_factory=list)
    temperature: float = 0.0
    top: int = 1
    groups: list[tuple[int, ...]] | None = None
    draws: dict[int, tuple[float, str]] = field(default_factory=dict)


def _dataset(path: str):
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (None, path)
    return ds.dataset(folder, filesystem=system, format="parquet")


def _kept(name: tuple, make, most: int = 4):
    """What make() gives, held by the Python worker; the oldest beyond `most` go."""
    held = sys.__dict__.setdefault("_millrace_bags", {})
    if name not in held:
        while len(held) >= most:
            del held[next(iter(held))]
        held[name] = make()
    return held[name]


def _spaces() -> str:
    """The characters that the pre-tokenizer takes as white space: two of them in a row are parted."""
    near = [chr(i) for i in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    return "".join(c for c in near if len(byte_words([f"a{c}{c}a"])[0]) == 4 or c == " ")


def _numbered(texts: Iterator[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct strings, the numbers of all of them end to end, and how many each list has."""
    known: dict = defaultdict(itertools.count().__next__)
    flat, sizes = [], []
    for found in texts:
        flat.append(np.fromiter(map(known.__getitem__, found), dtype=np.int32, count=len(found)))
        sizes.append(len(found))
    return list(known), np.concatenate(flat) if flat else np.zeros(0, np.int32), np.array(sizes, dtype=np.int64)


def _word_hash(word: str, salt: int) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little", signed=True)


def _bag(texts: list[str], pattern: re.Pattern, salt: int) -> dict:
    # pieces from white space to before the next: the pre-tokenizer never joins across these, nor looks behind
    pieces, flat, sizes = _numbered(pattern.findall(t) for t in texts)
    words, parts, widths = _numbered(iter(byte_words(pieces)))
    first = np.cumsum(widths) - widths
    wide = widths[flat] if len(flat) else np.zeros(0, np.int64)
    ends = np.cumsum(wide)
    each = parts[np.repeat(first[flat] - (ends - wide), wide) + np.arange(int(wide.sum()))] if len(flat) else np.zeros(0, np.int32)
    both = np.repeat(np.repeat(np.arange(len(texts)), sizes), wide) * max(len(words), 1) + each
    pairs, counts = np.unique(both, return_counts=True)
    at = np.bincount(pairs // max(len(words), 1), minlength=len(texts))
    return {
        "words": words, "hashes": np.array([_word_hash(w, salt) for w in words], dtype=np.int64).tobytes(), "ids": (pairs % max(len(words), 1)).astype(np.int32).tobytes(),
        "counts": counts.astype(np.int32).tobytes(), "sizes": at.astype(np.int64).tobytes(), "bytes": np.array([len(t.encode()) for t in texts], dtype=np.int64).tobytes(),
    }


_known: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def bags_of(texts: DataFrame, key: str, text: str) -> Bags:
    """The bags of (key, text), made once for a DataFrame; null texts are left out."""
    held = _known.setdefault(texts, {})
    if (key, text) not in held:
        held[key, text] = next(b for salt in itertools.count() if (b := _made(texts, key, text, salt)))
    return held[key, text]


def _made(texts: DataFrame, key: str, text: str, salt: int) -> Bags | None:
    """Nothing if two words share a hash."""
    kind, most = dict(texts.dtypes)[key], CHUNK
    schema = f"chunk bigint, keys array<{kind}>, names array<string>, words array<string>, hashes binary, ids binary, counts binary, sizes binary, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        space = _spaces()
        pattern = re.compile(f"[{space}]*[^{space}]+|[{space}]+")
        chunk, keys, names, own, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def row() -> pa.RecordBatch:
            held = pa.concat_arrays(keys)
            columns = {"chunk": pa.array([chunk]), "keys": pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), "names": pa.array([names], pa.list_(pa.string()))}
            columns |= {k: pa.array([v], pa.list_(pa.string()) if k == "words" else pa.binary()) for k, v in _bag(own, pattern, salt).items()}
            return pa.RecordBatch.from_pydict(columns)

        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                keys.append(pa.concat_arrays([batch.column(0)]))
                names += batch.column(1).to_pylist()
                new = batch.column(2).to_pylist()
                own += new
                size += sum(map(len, new))
                if size >= most:
                    yield row()
                    chunk, keys, names, own, size = chunk + 1, [], [], [], 0
        if own:
            yield row()

    rows = texts.where(F.col(text).isNotNull()).select(F.col(key), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.col(text))
    chunks = stored(spread(rows).mapInArrow(run, schema), "bags")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, hashes in zip(batch.column(0), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(hashes, np.int64)), words.values], names=["hash", "word"])

    path = stored_path(texts.sparkSession, "words")
    chunks.select("words", "hashes").mapInArrow(listed, "hash bigint, word string").distinct().repartition(1).sortWithinPartitions("hash").write.parquet(path)
    found = texts.sparkSession.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("hash").alias("d")).first()
    return Bags(chunks, path, key, kind) if found.n == found.d else None


def _hashes(path: str) -> np.ndarray:
    return _kept((path, "hashes"), lambda: _dataset(path).to_table(columns=["hash"])["hash"].to_numpy())


def _costs(path: str, experts: int) -> np.ndarray:
    """Tokens of each word (a row) under each expert."""

    def make() -> np.ndarray:
        found = {r["e"]: np.frombuffer(r["costs"], np.int32) for b in _dataset(path).to_batches(columns=["e", "costs"]) for r in b.to_pylist()}
        return np.stack([found[e] for e in range(experts)], axis=1)

    return _kept((path, "costs"), make)


def _labels(path: str, chunk: int, n: int) -> np.ndarray:
    import pyarrow.dataset as ds

    out = np.full(n, -1, dtype=np.int64)
    for r in _dataset(path).to_table(columns=["at", "labels"], filter=ds.field("chunk") == chunk).to_pylist():  # one row
        out[r["at"]] = r["labels"]
    return out


class Chunk:
    """A chunk's texts under a state: costs, adjusted costs, labels, weights and repeats."""

    COLUMNS = ["chunk", "names", "hashes", "ids", "counts", "sizes", "bytes"]

    def __init__(self, row: dict, words: str) -> None:
        self.number, self.names = row["chunk"], row["names"]
        self.ids, self.counts = np.frombuffer(row["ids"], np.int32), np.frombuffer(row["counts"], np.int32)
        self.sizes, self.bytes = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["bytes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.places = np.searchsorted(_hashes(words), np.frombuffer(row["hashes"], np.int64))

    def costs(self, path: str, experts: int) -> np.ndarray:
        own = _costs(path, experts)[self.places]
        out = np.zeros((len(self.sizes), experts), dtype=np.int64)
        for e in range(experts):
            sums = np.concatenate([[0], np.cumsum(np.multiply(own[:, e][self.ids], self.counts, dtype=np.int64))])
            out[:, e] = sums[self.ends] - sums[self.ends - self.sizes]
        return out

    def labels(self, s: State) -> np.ndarray:
        return _labels(s.labels, self.number, len(self.sizes)) if s.labels else np.argmin(self.costs(s.costs, s.experts) + np.array(s.extra), axis=1)

    def assigned(self, s: State) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """Costs, labels (-1 for none) and weights."""
        n = len(self.sizes)
        if s.labels:
            labels = _labels(s.labels, self.number, n)
            return None, labels, np.stack([np.isin(labels, g) for g in s.groups or [(e,) for e in range(s.experts)]], axis=1).astype(np.float64)
        costs = self.costs(s.costs, s.experts)
        adjusted = costs + np.array(s.extra)
        labels = np.argmin(adjusted, axis=1)
        if s.temperature <= 0 or s.top <= 1:
            return costs, labels, (labels[:, None] == np.arange(s.experts)).astype(np.float64)
        least = adjusted.min(axis=1, keepdims=True)
        logits = -((adjusted - least) / np.maximum(least, 1.0)) / s.temperature
        order = np.argsort(-logits, axis=1, kind="stable")[:, : s.top]
        raw = np.zeros_like(logits)
        np.put_along_axis(raw, order, np.exp(np.take_along_axis(logits, order, axis=1)), axis=1)
        return costs, labels, raw / raw.sum(axis=1, keepdims=True)

    def races(self, parts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts and experts of the weights that have a fraction, and their races: as in integer_repeats."""
        rest = parts % _UNIT
        d, e = np.nonzero(rest)
        digest = np.array([int(hashlib.md5(f"{seed}:{k}:{self.names[i]}".encode()).hexdigest()[:13], 16) for i, k in zip(d.tolist(), e.tolist())], dtype=np.float64)
        return d, e, -np.log((digest + 1) / float(16**13 + 1)) / (rest[d, e] / _UNIT)

    def repeats(self, s: State, oversample: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights, and how often each text counts for each expert."""
        _, _, weights = self.assigned(s)
        parts = in_parts(weights, oversample)
        whole = parts // _UNIT
        if s.draws:
            d, e, race = self.races(parts, seed)
            last = np.array([s.draws.get(k, (-1.0, ""))[0] for k in range(s.experts)])[e]
            whole[d, e] += race < last
            for i in np.flatnonzero(race == last).tolist():
                whole[d[i], e[i]] += self.names[d[i]] <= s.draws[e[i]][1]
        return weights, whole


def in_parts(weights: np.ndarray, oversample: float) -> np.ndarray:
    return np.floor(weights * oversample * _UNIT + 0.5).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], words: str) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk(batch.slice(i, 1).to_pylist()[0], words)


def stored_labels(bags: Bags, labels: DataFrame, experts: int) -> State:
    """The state in which texts have the labels (key, expert_id) and weigh one; those without a label weigh nothing."""
    places = bags.chunks.select("chunk", F.posexplode("keys").alias("at", "_k")).join(labels.select(F.col(bags.key).alias("_k"), "expert_id"), "_k").groupBy("chunk", "at").agg(F.min("expert_id").alias("label"))
    path = stored_path(labels.sparkSession, "labels")
    places.groupBy("chunk").agg(F.collect_list(F.struct("at", "label")).alias("s")).select("chunk", F.col("s.at").alias("at"), F.col("s.label").alias("labels")).write.parquet(path)
    return State(experts, labels=path)


def _total(found: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, where = np.unique(found, return_inverse=True)
    out = np.zeros(len(ids), dtype=np.int64)
    np.add.at(out, where, n)
    return ids, out


def fitted(bags: Bags, s: State, vocabulary: int, least_frequency: int, oversample: float, seed: int) -> str:
    """The path of (e, tokenizer, digest, costs): a tokenizer for each expert, fitted in one task on the summed counts, and what each word costs under it.

    Texts count by their repeats; an expert without a repeat gets its heaviest text. The same counts as in one of the last fits give its tokenizer again.
    """
    import pyarrow.dataset as ds

    before = list(bags.fits)
    words, experts = bags.words, s.experts
    least = max(1, round(least_frequency * oversample))
    schema = f"e int, w double, k {bags.kind}, ids binary, n binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = defaultdict(list)
        heaviest: dict[int, tuple] = {}
        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field("keys").type.value_type
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                keys = row.column(row.schema.get_field_index("keys")).flatten()
                chunk = Chunk(row.drop_columns(["keys"]).to_pylist()[0], words)
                weights, n = chunk.repeats(s, oversample, seed)
                for e in range(experts):
                    if n[:, e].any():
                        per = np.bincount(chunk.ids, np.repeat(n[:, e], chunk.sizes) * chunk.counts.astype(np.float64), len(chunk.places)).astype(np.int64)  # exact below 2^53
                        at = np.flatnonzero(per)
                        sums[e].append((chunk.places[at], per[at]))
                    elif e not in sums and weights[:, e].any():
                        most = np.flatnonzero(weights[:, e] == weights[:, e].max())
                        d = min(most.tolist(), key=lambda d: keys[d].as_py())
                        own = slice(chunk.ends[d] - chunk.sizes[d], chunk.ends[d])
                        new = (-float(weights[d, e]), keys[d].as_py(), chunk.places[chunk.ids[own]], chunk.counts[own].astype(np.int64))
                        heaviest[e] = min(heaviest.get(e, new), new, key=lambda x: x[:2])
        rows = [(e, None, None, *_total(*map(np.concatenate, zip(*x)))) for e, x in sums.items()]
        rows += [(e, -x[0], x[1], x[2], x[3]) for e, x in heaviest.items() if e not in sums]
        for e, w, k, ids, n in rows:
            yield pa.RecordBatch.from_arrays([pa.array([e], pa.int32()), pa.array([w], pa.float64()), pa.array([k], kind), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["e", "w", "k", "ids", "n"])

    def row(e: int, tokenizer: str, digest: str, costs: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e], pa.int32()), pa.array([tokenizer]), pa.array([digest]), pa.array([costs], pa.binary())], names=["e", "tokenizer", "digest", "costs"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, heaviest = [], []
        for r in itertools.chain.from_iterable(b.to_pylist() for b in batches):
            ids, n = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["n"], np.int64)
            e = r["e"]
            if r["w"] is None:
                some.append((ids, n))
            elif r["w"] >= 0:
                heaviest.append((-r["w"], r["k"], ids, n))
        if not some and heaviest:
            some = [min(heaviest, key=lambda x: x[:2])[2:]]
        ids, n = _total(*map(np.concatenate, zip(*some))) if some else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        digest = hashlib.blake2b(b"%d %d " % (vocabulary, least) + ids.tobytes() + n.tobytes()).hexdigest()
        for same in before:
            for r in _dataset(same).to_table(columns=["tokenizer", "costs"], filter=ds.field("digest") == digest).slice(0, 1).to_pylist():
                yield row(e, r["tokenizer"], digest, r["costs"])
                return
        every = _dataset(words)

        def counted() -> Iterator[tuple[str, int]]:
            at = 0
            for b in every.to_batches(columns=["word"]):
                own = slice(*np.searchsorted(ids, [at, at + b.num_rows]))
                yield from zip(b.column(0).take(pa.array(ids[own] - at)).to_pylist(), n[own].tolist())
                at += b.num_rows

        tokenizer = fit_bpe_words(counted(), vocabulary, least)
        costs = [word_lengths(tokenizer, b.column(0).to_pylist()).astype(np.int32) for b in every.to_batches(columns=["word"])]
        yield row(e, tokenizer, digest, np.concatenate([np.zeros(0, np.int32), *costs]).tobytes())

    rows = bags.chunks.select(*Chunk.COLUMNS, "keys").mapInArrow(count, schema)
    every = rows.sparkSession.range(experts).select(F.col("id").cast("int").alias("e"), F.lit(-1.0).alias("w"), F.lit(None).cast(bags.kind).alias("k"), F.lit(b"").alias("ids"), F.lit(b"").alias("n"))
    path = stored_path(rows.sparkSession, "experts")
    rows.unionByName(every).repartitionById(experts, F.col("e")).mapInArrow(fit, "e int, tokenizer string, digest string, costs binary").write.parquet(path)
    bags.fits[:] = [*bags.fits[-2:], path]
    return path


def experts_of(bags: Bags, path: str) -> list[str]:
    return [r.tokenizer for r in bags.chunks.sparkSession.read.parquet(path).select("e", "tokenizer").orderBy("e").collect()]  # a row an expert


def sums(bags: Bags, s: State, before: State | None, oversample: float, seed: int) -> dict[str, dict]:
    """Of a state, by label: bytes, documents, tokens; changed against the labels before; the parts of all weights by expert, and of their whole numbers; races by their leading bits."""
    words = bags.words
    schema = pa.schema([("what", pa.string()), ("e", pa.int32()), ("bin", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, words):
            costs, labels, weights = chunk.assigned(s)
            parts = in_parts(weights, oversample)
            out: list[tuple] = []
            for e in range(s.experts):
                mine = labels == e
                broken = parts[parts[:, e] % _UNIT > 0, e]
                out += [("parts", e, 0, int((broken % _UNIT).sum())), ("whole", e, 0, int((broken // _UNIT).sum()))]
                if mine.any():
                    out += [("documents", e, 0, int(mine.sum())), ("bytes", e, 0, int(chunk.bytes[mine].sum()))]
                    if costs is not None:
                        out.append(("tokens", e, 0, int(costs[mine, e].sum())))
            if before is not None:
                was = chunk.labels(before)
                out += [("changed", 0, 0, int(((was != labels) & (was >= 0)).sum())), ("both", 0, 0, int((was >= 0).sum()))]
            d, e, race = chunk.races(parts, seed)
            bins, n = np.unique(race.view(np.int64) >> (64 - _BITS) | e.astype(np.int64) << _BITS, return_counts=True)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array(["races"] * len(bins), pa.string()), pa.array((bins >> _BITS).astype(np.int32)), pa.array(bins & ((1 << _BITS) - 1)), pa.array(n.astype(np.int64))], schema=schema)

    found = bags.chunks.select(*Chunk.COLUMNS).mapInArrow(run, "what string, e int, bin bigint, n bigint").groupBy("what", "e", "bin").agg(F.sum("n").alias("n")).toArrow()  # bounded by experts and bins
    held: dict[str, dict] = defaultdict(dict)
    for what, e, b, n in zip(*(c.to_pylist() for c in found.columns)):
        held[what][(e, b) if what == "races" else e] = n
    return held


def drawn(bags: Bags, s: State, found: dict[str, dict], oversample: float, seed: int) -> dict[int, tuple[float, str]]:
    """State.draws: as many repeats more as make an expert's total the rounded (half to even) sum of its weights."""
    words, wanted = bags.words, {}
    for e, rest in found["parts"].items():
        owed, half = divmod(rest, _UNIT)
        owed += half * 2 > _UNIT or (half * 2 == _UNIT and (owed + found["whole"][e]) % 2 == 1)
        for b, n in sorted((b, n) for (k, b), n in found["races"].items() if k == e):
            if 0 < owed <= n:
                wanted[e] = (b, owed)
            owed -= n
    if not wanted:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, words):
            d, e, race = chunk.races(in_parts(chunk.assigned(s)[2], oversample), seed)
            own = np.flatnonzero(race.view(np.int64) >> (64 - _BITS) == np.array([wanted.get(k, (-1, 0))[0] for k in range(s.experts)], dtype=np.int64)[e])
            yield pa.RecordBatch.from_arrays([pa.array(e[own].astype(np.int32)), pa.array(race[own]), pa.array([chunk.names[i] for i in d[own]], pa.string())], names=["e", "race", "name"])

    near = bags.chunks.select(*Chunk.COLUMNS).mapInArrow(run, "e int, race double, name string").toArrow()  # one bin of each expert
    by: dict[int, list] = defaultdict(list)
    for e, race, name in zip(*(c.to_pylist() for c in near.columns)):
        by[e].append((race, name))
    return {e: sorted(by[e])[owed - 1] for e, (_, owed) in wanted.items()}


def rows_of(bags: Bags, s: State, where: State | None = None) -> DataFrame:
    """(key, bytes, costs, expert_id, weights) of the texts; where: only of those that have a label there, which is then the expert_id."""
    words, key = bags.words, bags.key
    fields = f"`{bags.key}` {bags.kind}, bytes bigint, costs array<bigint>, expert_id int, weights array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                chunk = Chunk(row.drop_columns(["keys"]).to_pylist()[0], words)
                costs, labels, weights = chunk.assigned(s)
                if where is not None:
                    labels = chunk.labels(where)
                offsets = pa.array(np.arange(len(labels) + 1, dtype=np.int32) * s.experts)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (costs, weights)]
                out = pa.RecordBatch.from_arrays([row.column(row.schema.get_field_index("keys")).flatten(), pa.array(chunk.bytes), lists[0], pa.array(labels.astype(np.int32)), lists[1]], names=[key, "bytes", "costs", "expert_id", "weights"])
                yield out if where is None else out.filter(pa.array(labels >= 0))

    return bags.chunks.select(*Chunk.COLUMNS, "keys").mapInArrow(run, fields)


def tokens_of(bags: Bags, s: State, path: str) -> dict[int, int]:
    """What all texts of each expert cost under the tokenizer of the same number at path."""
    words = bags.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, words):
            own = np.where(chunk.assigned(s)[2] > 0, chunk.costs(path, s.experts), 0).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(s.experts, dtype=np.int32)), pa.array(own)], names=["e", "n"])

    return {r.e: r.n for r in bags.chunks.select(*Chunk.COLUMNS).mapInArrow(run, "e int, n bigint").groupBy("e").agg(F.sum("n").alias("n")).collect()}  # a row an expert


def prior_terms(sizes: dict[int, int], experts: int, least: float, weight: float) -> list[float]:
    """What prior_costs adds under the priors of bytes by expert (as in priors)."""
    total = sum(sizes.values())
    own = [sizes.get(e, 0) for e in range(experts)]
    active = [bool(total) and b / total >= least for b in own]
    if not any(active):
        active = [e == own.index(max(own)) for e in range(experts)]
    return [-weight * math.log((b + 1) / (total + experts)) if a else math.inf for b, a in zip(own, active)]
