"""Texts of evaluation splits that also stand, exactly or almost, in the training split.

The distinct evaluation texts are divided into shards of bounded size, each with a compressed full-text index and the counts of its windows by
their places. The training texts are streamed once, without a shuffle: a text of n distinct windows of successive words can lack at most
n - ceil(n s) of them in a partner of similarity s, so one with more windows than that outside all places has no partner in any shard.

Which shards the others have to be searched in follows from their rare windows. Put all windows in one order, the rarest places first. Texts of m and
n windows and of similarity s share a = ceil((m + n) s / (1 + s)) of them or more, and of the first K that they share each stands among the first
m - a + K of the one text and the first n - a + K of the other. These beginnings are short if the sizes are alike, so few pairs of texts
share K windows in them; a training text goes through backward search in the shards of such pairs, and in no other.

Windows that follow one another and occur equally often, always in each other's company, make a maximal match: one step of backward search
more tells. A match is located once and counts with all its windows. The rarest matches are located, so many that every partner holds enough of
them; their texts are compared window by window and the windows that follow one another merged into spans. A longest match alone would
show a window's longest partner only, so matches are parted where the set of texts changes. Nothing is cut off.
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
from millrace.llm.fmindex import WordIndex, unpack
from millrace.llm.words import needed, shingles, word_hashes
from millrace.operators.hotkeys import spread_join
from millrace.session import spread, stored, stored_path

COMMON = 8  # windows that partners must share in the beginnings of both, rarest first
EXTRA = 10  # a text has one window in so many located beyond those that every partner must share one of
_OCCURRENCES = 1_000_000  # located at once
_LOW = np.uint64(0xFFFF)
_PRESENT = 27  # bits of a window that tell whether a task's shards may have it: 16 MB
SHARD_BYTES = 16 << 20  # text in one index; an index takes about 1.3 bytes a byte of text in memory
TASK_BYTES = 32 << 20  # of packed words, of the shards whose rare windows one task holds; those take up to four times as much


def text_classes(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Exact copies put together: (cls, text), one row a distinct text, and (key, cls); cls is the smallest key.

    A record written several times counts once; null keys and null texts are left out. The text is shuffled
    once, after combining copies on the map side, so a text that fills a third of the rows does no harm.
    """
    rows = df.select(df[key].cast("bigint").alias("key"), df[text].cast("string").alias("text")).where("key IS NOT NULL AND text IS NOT NULL").withColumn("h", F.unhex(F.md5("text")))
    # the members come from a pass of their own over keys and hashes, so the texts are stored nowhere
    classes = rows.groupBy("h").agg(F.min("key").alias("cls"), F.count("*").alias("n"))
    members = spread_join(rows.select("key", "h").distinct(), classes.select("h", "cls"), ["h"], classes.select("h", "n")).select("key", "cls")
    return rows.groupBy("h").agg(F.min("key").alias("cls"), F.first("text").alias("text")).select("cls", "text"), stored(members, "members")


def build_indexes(texts: DataFrame, width: int, least_words: int, shard_bytes: int, path: str) -> None:
    """Write the indices of (cls, text) and the places of their windows below path, as pieces.

    Texts stay in the partition they are in; a task begins a new shard after every shard_bytes of text, and keeps words, not texts, while it reads.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, labels, hashes, sizes, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            n = np.concatenate(sizes)
            flat = np.concatenate(hashes)
            text, _, value = shingles(flat, n, width)
            places, times = np.unique((value[(n >= least_words)[text]] >> np.uint64(32)).astype(np.uint32), return_counts=True)
            counts = np.minimum(times, 65535).astype(np.uint16)
            del flat, text, value, times
            index = WordIndex.build(hashes, n, np.concatenate(labels))
            yield from artefacts.pieces(f"{task}-{number}", {"places": places, "counts": counts} | index.parts)

        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                h, n = word_hashes(batch.column(1).to_pylist())
                hashes.append(h)
                sizes.append(n)
                labels.append(batch.column(0).to_numpy())
                held += batch.column(1).nbytes
                if held >= shard_bytes:
                    yield from done()
                    number, labels, hashes, sizes, held = number + 1, [], [], [], 0
        if sizes:
            yield from done()

    texts.select("cls", "text").mapInArrow(build, artefacts.PIECE).write.option("compression", "zstd").parquet(path)


def _ascending(x: np.ndarray) -> np.ndarray:
    """Distinct values in order."""
    x = np.sort(x)
    return x[np.diff(x, prepend=-1) != 0]


def _summed(x: np.ndarray, amount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, none negative, with the sums of their amounts."""
    by = np.argsort(x, kind="stable")
    starts = np.flatnonzero(np.diff(x[by], prepend=-1))
    return x[by][starts], np.add.reduceat(amount[by], starts) if len(starts) else amount[:0]


def _distinct_windows(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each window, in order of texts and places, is the first of its value in its text."""
    order = np.lexsort((value, text))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (value[order][1:] != value[order][:-1])
    first = np.zeros(len(order), dtype=bool)
    first[order[new]] = True
    return first


def in_order(counts: np.ndarray, bits: int, text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, value, times): the distinct windows of each text, the rarest first by the counts of their places, then by value."""
    times = counts[(value >> np.uint64(64 - bits)).astype(np.int64)]
    order = np.lexsort((value, text << 16 | times))
    text, value, times = text[order], value[order], times[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new], times[new]


def beginnings(text: np.ndarray, n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(which, most): the windows, in order, that some partner may share among its first COMMON, and the windows that such a partner has at most. n by text."""
    rank = np.arange(len(text)) - (np.cumsum(n) - n)[text]
    which = np.flatnonzero(rank < (n - needed(n, num, den) + COMMON)[text])
    own = n[text[which]]
    return which, (num + den) * (own + COMMON - 1 - rank[which]) // num - own


def possible(counts: np.ndarray, bits: int, hashes: np.ndarray, sizes: np.ndarray, width: int, num: int, den: int, least_words: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Whether each text holds enough windows that some evaluation text may hold; the distinct windows of each; the beginnings of those texts."""
    text, _, value = shingles(hashes, sizes, width)
    text, value, times = in_order(counts, bits, text, value)
    n = np.bincount(text, minlength=len(sizes))
    met = np.bincount(text[times > 0], minlength=len(sizes))
    good = (sizes >= least_words) & (n > 0) & (met >= needed(n, num, den))
    which, most = beginnings(text, n, num, den)
    rows = good[text[which]] & (times[which] > 0)  # a place without a count has no window of an evaluation text
    which, most = which[rows], most[rows]
    by = np.argsort(value[which])
    return good, n, {"value": value[which][by], "text": text[which][by], "most": most[by]}


def postings(counts: np.ndarray, bits: int, index: WordIndex, width: int, num: int, den: int, least_words: int) -> dict[str, np.ndarray]:
    """The beginnings of a shard's texts: keys, ascending, of 48 bits of a window and the size of the largest partner; number and windows of the text."""
    sizes = np.diff(index.begin) - 1
    words = unpack(index.parts["text"], index.width, 0, int(index.begin[-1]))
    words = index.vocabulary[words[words > 0] - 1]
    text, _, value = shingles(words, sizes, width)
    good = (sizes >= least_words)[text]
    text, value, _ = in_order(counts, bits, text[good], value[good])
    n = np.bincount(text, minlength=len(sizes))
    which, most = beginnings(text, n, num, den)
    key = value[which] & ~_LOW | np.minimum(most, int(_LOW)).astype(np.uint64)
    by = np.argsort(key)
    own = text[which][by]
    return {"key": key[by], "own": own.astype(np.int32), "n": n[own].astype(np.int32)}


def with_present(post: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Postings with a bit filter of their windows."""
    filter_ = np.zeros(1 << (_PRESENT - 6), dtype=np.uint64)
    at = (post["key"] >> np.uint64(64 - _PRESENT)).astype(np.int64)
    starts = np.flatnonzero(np.diff(at >> 6, prepend=-1))
    if len(starts):
        filter_[at[starts] >> 6] = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), starts)
    return post | {"present": filter_}


def load_postings(path: str, own: list[str]) -> dict[str, np.ndarray]:
    """The postings of some shards in one order; shard has the place in `own` of each."""
    parts: list[dict[str, np.ndarray]] = [{n: v for _, n, v in artefacts.read(path, shard)} for shard in own]
    shard = np.repeat(np.arange(len(own), dtype=np.int32), [len(x["key"]) for x in parts])
    first = np.cumsum([0] + [int(x["own"].max(initial=-1)) + 1 for x in parts])
    out = {"key": np.concatenate([x["key"] for x in parts]), "own": np.concatenate([x["own"] + np.int32(f) for x, f in zip(parts, first)]), "n": np.concatenate([x["n"] for x in parts]), "shard": shard}
    del parts
    by = np.argsort(out["key"], kind="stable").astype(np.int32)
    for k in out:
        out[k] = out[k][by]
    return with_present(out)


def shards_of(post: dict[str, np.ndarray], n: np.ndarray, rows: dict[str, np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shard), distinct: the shards with texts that share COMMON windows of the beginnings, or as many as a partner must, with a text of n windows."""
    here = np.flatnonzero(artefacts.passes(post["present"], _PRESENT, rows["value"]))  # most windows are in none of a few shards
    text, value = rows["text"][here], rows["value"][here]
    own = n[text]
    low = np.searchsorted(post["key"], value & ~_LOW | np.minimum(own, int(_LOW)).astype(np.uint64))
    met = np.flatnonzero(post["key"][np.minimum(low, len(post["key"]) - 1)] | _LOW == value | _LOW) if len(post["key"]) else low[:0]
    span = np.searchsorted(post["key"], value[met] | _LOW, "right") - low[met]
    met, span = met[span > 0], span[span > 0]
    by = np.argsort(text[met], kind="stable")
    met, span = met[by], span[by]
    text, own, low, most = text[met], own[met], low[met], rows["most"][here[met]]
    wide = int(post["own"].max(initial=0)) + 1
    least = np.minimum(COMMON, needed(n, num, den))
    texts, shards = [], []
    # a few texts at a time: their occurrences bound the memory
    ends = np.flatnonzero(np.diff(text, append=-1)) + 1
    filled, begin = np.cumsum(span), 0
    while begin < len(text):
        last = np.searchsorted(filled[ends - 1], (filled[begin - 1] if begin else 0) + _OCCURRENCES, "right")
        end = int(ends[max(last - 1, np.searchsorted(ends, begin, "right"))])
        times = span[begin:end]
        row = np.repeat(np.arange(begin, end), times)
        at = np.arange(len(row)) + np.repeat(low[begin:end] - (np.cumsum(times) - times), times)
        m = post["n"][at]
        keep = (m <= most[row]) & (m * den >= own[row] * num) & (m * num <= own[row] * den)
        row, at = row[keep], at[keep]
        pair, first, hits = np.unique(text[row] * wide + post["own"][at], return_index=True, return_counts=True)
        first = first[hits >= least[pair // wide]]
        if len(first):
            both = _ascending(text[row[first]] << 32 | post["shard"][at[first]])
            texts.append(both >> 32)
            shards.append(both & 0xFFFFFFFF)
        begin = end
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(texts or none), np.concatenate(shards or none)


class Batch:
    """Training texts made ready once for a search in any number of shards."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, width: int, num: int, den: int, least_words: int) -> None:
        self.width, self.num, self.den, self.least, self.texts = width, num, den, least_words, len(sizes)
        text, start, value = shingles(hashes, sizes, width)
        good = (sizes >= least_words)[text]
        self.text, self.start, self.value = text[good], start[good], value[good]
        self.first = _distinct_windows(self.text, self.value)
        self.n = np.bincount(self.text[self.first], minlength=len(sizes))
        self.slack = self.n - needed(self.n, num, den)  # windows that a partner may lack
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=len(sizes)))])
        self.vocabulary, self.word = np.unique(hashes, return_inverse=True)
        distinct, at, self.inverse = np.unique(self.value, return_index=True, return_inverse=True)
        self.place = (distinct >> np.uint64(32)).astype(np.uint32)
        self.windows = np.stack([self.word[self.start[at] + k] for k in range(width)], axis=1)  # the words of each distinct window


def match_texts(index: WordIndex, places: np.ndarray, batch: Batch) -> dict[str, np.ndarray]:
    """Every (key, cls) whose window sets have a similarity of num/den or more, with their counts and merged spans; key is the text's number.

    places are those of the shard's windows: windows that aren't among them, and texts with too many of those, aren't searched.
    """
    text, start, value, first, n, slack, inverse = batch.text, batch.start, batch.value, batch.first, batch.n, batch.slack, batch.inverse
    width, num, den, least_words = batch.width, batch.num, batch.den, batch.least
    none = {k: np.zeros(0, dtype=np.int64) for k in ("key", "cls", "shared", "total", "spans", "longest")}
    if not len(text) or not len(index.vocabulary):
        return none
    at = np.minimum(np.searchsorted(places, batch.place), len(places) - 1) if len(places) else None
    here = places[at] == batch.place if len(places) else np.zeros(len(batch.place), dtype=bool)
    hopeful = (np.bincount(text[first & ~here[inverse]], minlength=batch.texts) <= slack)[text]
    if not hopeful.any():
        return none
    here[np.bincount(inverse[hopeful], minlength=len(here)) == 0] = False
    symbol = index.ids(batch.vocabulary)
    # occurrences of every such window, by backward search
    words = symbol[batch.windows]
    known = np.flatnonzero(here & (words > 0).all(axis=1))
    known = known[np.lexsort([words[known, k] for k in range(width)])]  # the last word first: neighbours share steps and parts of the index
    low, high = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    if len(known):
        low[known], high[known] = index.windows(words[known])
    times = (high - low)[inverse]
    absent = np.bincount(text[first & (times == 0)], minlength=batch.texts)
    alive = hopeful & (absent <= slack)[text] & (times > 0)
    if not alive.any():
        return none
    # maximal matches: a window goes on with the one before it if all occurrences of either are occurrences of both
    joined = np.zeros(len(text), dtype=bool)
    joined[1:] = alive[1:] & (text[1:] == text[:-1]) & (times[1:] == times[:-1])
    ask = np.flatnonzero(joined)
    if len(ask):
        a, b = index.extend(symbol[batch.word[start[ask] - 1]], low[inverse[ask]], high[inverse[ask]])
        joined[ask] = b - a == times[ask]
    match = np.cumsum(~joined) - 1
    weight = np.bincount(match[alive & first], minlength=match[-1] + 1)
    head = np.flatnonzero(~joined)  # a match's first window; any of its windows has the match's texts
    head = head[(weight > 0) & alive[head]]
    if not len(head):
        return none
    # the rarest matches of each text: slack + 1 windows of them meet every partner once, each further one once more
    order = head[np.lexsort((times[head], text[head]))]
    owner, load = text[order], weight[match[order]]
    begins = np.searchsorted(owner, owner)
    before = np.cumsum(load) - load
    before = before - before[begins] + absent[owner]  # windows that occur nowhere are the rarest
    take = np.minimum(n, slack + 1 + n // EXTRA)
    chosen = before < take[owner]
    order, owner, load = order[chosen], owner[chosen], load[chosen]
    sought = absent + np.bincount(owner, weights=load, minlength=batch.texts).astype(np.int64)
    span = times[order]
    mine, theirs = [], []
    # a few texts at a time: their occurrences bound the memory, however many there are in all
    ends = np.flatnonzero(np.diff(owner, append=-1)) + 1
    filled, begin = np.cumsum(span), 0
    while begin < len(order):
        last = np.searchsorted(filled[ends - 1], (filled[begin - 1] if begin else 0) + _OCCURRENCES, "right")
        end = int(ends[max(last - 1, np.searchsorted(ends, begin, "right"))])
        part, n_part = order[begin:end], span[begin:end]
        rows = np.repeat(low[inverse[part]] - np.concatenate([[0], np.cumsum(n_part)[:-1]]), n_part) + np.arange(n_part.sum())
        wide = len(index.labels)
        hit = _ascending(np.repeat(np.arange(len(part)), n_part) * wide + index.texts_at(rows))  # a text once a match
        pair, hits = _summed(owner[begin:end][hit // wide] * wide + hit % wide, load[begin:end][hit // wide])
        m, t = pair // wide, pair % wide
        keep = hits >= (sought - slack)[m]
        mine.append(m[keep])
        theirs.append(t[keep])
        begin = end
    mine, theirs = (np.concatenate(x) for x in (mine, theirs))
    if not len(mine):
        return none
    out = {k: [] for k in none}
    begin_w = batch.begin
    grams: dict[int, np.ndarray] = {}
    for m, t in zip(mine.tolist(), theirs.tolist()):
        own = grams.get(t)
        if own is None:
            part = index.words_of(t)
            own = grams[t] = np.unique(shingles(part, np.array([len(part)]), width)[2]) if len(part) >= least_words else np.zeros(0, dtype=np.uint64)
        if not len(own):
            continue
        run = value[begin_w[m] : begin_w[m + 1]]  # windows in the order of the text
        ours = run[first[begin_w[m] : begin_w[m + 1]]]
        place = np.minimum(np.searchsorted(own, ours), len(own) - 1)
        shared = int((own[place] == ours).sum())
        total = len(own) + len(ours) - shared
        if shared * den < total * num:
            continue
        hit = own[np.minimum(np.searchsorted(own, run), len(own) - 1)] == run
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        lengths = edge[1::2] - edge[::2] + width - 1
        for k, x in (("key", m), ("cls", index.labels[t]), ("shared", shared), ("total", total), ("spans", len(lengths)), ("longest", lengths.max())):
            out[k].append(x)
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def copied(found: dict[str, np.ndarray], which: np.ndarray, keys: np.ndarray) -> dict[str, np.ndarray]:
    """Results by number of a distinct text given to every key that holds it; which has each key's text."""
    by = np.argsort(which, kind="stable")
    first, last = np.searchsorted(which[by], found["key"]), np.searchsorted(which[by], found["key"], "right")
    times = last - first
    row = np.repeat(np.arange(len(times)), times)
    place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
    return {k: keys[by[place]] if k == "key" else v[row] for k, v in found.items()}


def cross_split(evaluation: DataFrame, training: DataFrame, eval_key: str = "doc_id", train_key: str = "ord", text: str = "text", width: int = 3, num: int = 3, den: int = 5, least_words: int = 30, shard_bytes: int = SHARD_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(eval_key, train_key, shared, total, spans, longest): all cross-split pairs of similarity num/den or more.

    shared and total count distinct windows in both and in either; spans is the number of maximal runs of the training
    text that the evaluation text shares window by window, longest the words of the longest. Null keys, null texts and texts of
    fewer than least_words words have no partner; records written again count once; copies of an evaluation text all come out with each
    partner; very long texts are used whole; if either table is empty so is the result; other columns are ignored.
    """
    spark = evaluation.sparkSession
    texts, members = text_classes(evaluation, eval_key, text)
    path = stored_path(spark, "index")
    size = evaluation.agg(F.coalesce(F.sum(F.octet_length(evaluation[text].cast("string"))), F.lit(0))).first()[0]  # copies too, so a shard may hold less
    # few large shards cost less to search than many small ones; where partitions are larger, tasks part them
    build_indexes(texts.coalesce(max(1, -(-int(size) // shard_bytes))), width, least_words, 2 * shard_bytes, path)
    built = spark.read.schema(artefacts.PIECE).parquet(path)
    heads = built.where("at = 0 AND array IN ('places', 'text')").groupBy("shard").agg(*(F.max(F.when(F.col("array") == n, F.col("length"))).alias(n) for n in ("places", "text")))
    shards = sorted(((r.shard, r.text, r.places) for r in heads.collect()), key=lambda x: (-x[1], x[0]))  # a row for shard_bytes of text
    bits = artefacts.count_bits(sum(p for *_, p in shards))
    rows = training.select(training[train_key].cast("bigint").alias("k"), training[text].cast("string").alias("t")).where("k IS NOT NULL AND t IS NOT NULL")

    def counts() -> np.ndarray:
        return artefacts.kept(path, "filter", lambda: artefacts.load_counts(path, bits))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                column = batch.column(1).dictionary_encode()
                good, n, begun = possible(counts(), bits, *word_hashes(column.dictionary.to_pylist()), width, num, den, least_words)
                copy = column.indices.to_numpy()
                batch, copy = batch.filter(pa.array(good[copy])), copy[good[copy]]
                # beginnings stand in the first row of a batch, for all of it
                arrays = (np.array([len(copy), len(n), len(begun["value"])]), batch.column(0).to_numpy(), copy, n, begun["value"].view(np.int64), begun["text"] << 32 | np.minimum(begun["most"], 0xFFFFFFFF))
                packed = [b"".join(np.ascontiguousarray(x, dtype=np.int64).tobytes() for x in arrays)] if len(copy) else []
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed + [None] * (len(copy) - 1), type=pa.binary())], ["k", "t", "begun"])

    left = stored(spread(rows).mapInArrow(select, "k bigint, t string, begun binary"), "possible")
    names = [shard for shard, *_ in shards]
    post = stored_path(spark, "postings")

    def post_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                index = WordIndex({n: v for _, n, v in artefacts.read(path, names[k])})
                yield from artefacts.pieces(names[k], postings(counts(), bits, index, width, num, den, least_words))

    spark.range(0, len(names), 1, max(1, len(names))).mapInArrow(post_shards, artefacts.PIECE).write.option("compression", "zstd").parquet(post)

    def route(own: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for packed in whole.column(0):
                    raw = np.frombuffer(packed.as_buffer(), dtype=np.int64)
                    keys, copy, n, value, rest = np.split(raw[3:], np.cumsum([raw[0], raw[0], raw[1], raw[2]]))
                    held = artefacts.kept(post, own[0], lambda: load_postings(post, own))
                    t, shard = shards_of(held, n, {"value": value.view(np.uint64), "text": rest >> 32, "most": rest & 0xFFFFFFFF}, num, den)
                    found = copied({"key": t, "shard": shard}, copy, keys)
                    yield pa.RecordBatch.from_pydict({"k": pa.array(found["key"]), "shard": pa.array([own[s] for s in found["shard"].tolist()], type=pa.string())})

        return spread(left.where("begun IS NOT NULL").select("begun")).mapInArrow(run, "k bigint, shard string")

    groups: list[list[str]] = [[]]
    filled = 0
    for shard, size, _ in shards:
        if groups[-1] and filled + size > task_bytes:
            groups.append([])
            filled = 0
        groups[-1].append(shard)
        filled += size
    routed = reduce(DataFrame.unionByName, map(route, groups)).dropDuplicates(["k", "shard"])
    # stored, since ranges are found in a pass of their own; they part a shard that many texts go to
    routed = stored(left.select("k", "t").join(stored(routed, "routes"), "k"), "routed").repartitionByRange("shard", "k").sortWithinPartitions("shard")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            which = whole.column(2).dictionary_encode()
            for s, shard in enumerate(which.dictionary.to_pylist()):
                here = whole.filter(pa.array(which.indices.to_numpy() == s))
                index = artefacts.kept(path, shard, lambda s=shard: WordIndex({n: v for _, n, v in artefacts.read(path, s)}))
                for i in range(0, here.num_rows, 2000):
                    batch = here.slice(i, 2000)
                    column = batch.column(1).dictionary_encode()  # copies are searched once
                    out = match_texts(index, index.parts["places"], Batch(*word_hashes(column.dictionary.to_pylist()), width, num, den, least_words))
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, type=pa.int64()) for k, v in copied(out, column.indices.to_numpy(), batch.column(0).to_numpy()).items()})

    pairs = routed.select("k", "t", "shard").mapInArrow(search, "key bigint, cls bigint, shared bigint, total bigint, spans bigint, longest bigint").dropDuplicates(["key", "cls"])
    pairs = stored(pairs.withColumnRenamed("key", "train"), "pairs")
    found = spread_join(members, pairs, ["cls"], members.groupBy("cls").agg(F.count("*").alias("n")))
    return found.select(F.col("key").alias(eval_key), F.col("train").alias(train_key), "shared", "total", "spans", "longest")
