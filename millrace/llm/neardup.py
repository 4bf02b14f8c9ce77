"""Near-duplicate texts: ProbMinHash signatures, banding, exact verification.

Elements (word shingles) arrive as Poisson processes whose rate is their weight; each arrival falls on one
register, a register keeps the element that came first, and a text's processes end once every register
holds an earlier arrival. Two texts agree in a register with a probability equal to the probability
Jaccard similarity of their weights, which for weight 1 is the Jaccard similarity of the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.words import U, distinct, shingles, splitmix, word_hashes
from millrace.operators.hotkeys import spread_join
from millrace.session import spread, stored

ROWS, BANDS = 4, 48  # of similar_pairs: at similarity 0.6 a pair shares a band with probability 0.9987, at 0.65 0.9999, at 0.7 0.999997
GROUP_ROWS, GROUP_BANDS = 5, 24  # of similar_groups: at similarity 0.8 0.99993, at 0.85 1 - 2e-6
BLOCK = 256  # members of a bucket that meet in one unit of work
SAMPLED = 32  # a class in so many is looked at to find the hot buckets
HOT = 4096  # a bucket with more than 1 / HOT of the sampled rows is hot


def probminhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """uint64[texts, registers]: the element that arrived first at each register; text ascends and (text, element) is distinct."""
    first = np.full(texts * registers, np.inf)
    holder = np.zeros(texts * registers, dtype=np.uint64)
    clock = np.zeros(len(element))
    last = np.full(texts, np.inf)
    step = 0
    while len(text):
        step = (step + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        z = splitmix(element + U(step))
        clock = clock - np.log1p(-(z >> U(11)).astype(np.float64) / 9007199254740992.0) / weight
        place = text * registers + (splitmix(z) % U(registers)).astype(np.int64)
        np.minimum.at(first, place, clock)
        won = first[place] == clock
        holder[place[won]] = element[won]
        ends = np.unique(text)
        last[ends] = first.reshape(texts, registers)[ends].max(axis=1)
        alive = clock < last[text]
        text, element, weight, clock = text[alive], element[alive], weight[alive], clock[alive]
    return holder.reshape(texts, registers)


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(signature), bands))
    for r in range(rows):
        keys = splitmix(keys * U(31) + signature[:, r::rows][:, :bands])
    return keys.view(np.int64)


def signed_texts(df: DataFrame, key: str, text: str, width: int, least_words: int, rows: int, bands: int) -> DataFrame:
    """(key, h BINARY, bands ARRAY<BIGINT>) of each row with a key and a text; h is the text's MD5, bands is empty for a text without enough words
    or without a shingle. Texts go into Arrow batches where they are read and are not shuffled; copies in a batch are signed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                coded = batch.column(2).dictionary_encode()
                hashes, sizes = word_hashes(coded.dictionary.to_pylist())
                text, _, value = shingles(hashes, sizes, width)
                text, value, _ = distinct(text, value)
                good = (sizes >= least_words)[text]
                text, value = text[good], value[good]
                kept, dense = np.unique(text, return_inverse=True)
                keys = np.zeros((0, bands), dtype=np.int64)
                if len(kept):
                    keys = band_keys(probminhash(dense, value, np.ones(len(text)), len(kept), rows * bands), rows, bands)
                at = np.full(len(sizes), -1)
                at[kept] = np.arange(len(kept))
                place = at[coded.indices.to_numpy()]
                ends = np.concatenate([[0], np.cumsum(np.where(place >= 0, bands, 0))]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[place[place >= 0]].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed], names=["key", "h", "bands"])

    kept = df.select(df[key].cast("bigint").alias("key"), df[text].cast("string").alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    return spread(kept.select("key", F.unhex(F.md5("text")).alias("h"), "text")).mapInArrow(run, "key bigint, h binary, bands array<bigint>")


def text_classes(df: DataFrame, key: str, text: str, width: int, least_words: int, rows: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """Exact copies put together: (cls, n, bands), one row a distinct text, and (key, cls); cls is the smallest key, n the rows with that text, records written again among them.

    A record written several times counts once; null keys and null texts are left out. What is shuffled by the text's hash are its
    signature, after combining copies on the map side, and keys, dealt out where a text has very many records.
    """
    signed = signed_texts(df, key, text, width, least_words, rows, bands)
    classes = stored(signed.groupBy("h").agg(F.min("key").alias("cls"), F.count("*").alias("n"), F.first("bands").alias("bands")), "classes")
    keyed = df.select(df[key].cast("bigint").alias("key"), F.unhex(F.md5(df[text].cast("string"))).alias("h")).where("key IS NOT NULL AND h IS NOT NULL").distinct()
    return classes.select("cls", "n", "bands"), stored(spread_join(keyed, classes.select("h", "cls"), ["h"], classes.select("h", "n")).select("key", "cls"), "members")


def bucket_pairs(rows: DataFrame, block: int | None = None) -> DataFrame:
    """(a, b), a < b, of all members of one bucket, from distinct (bucket, cls); a pair comes once for each bucket it shares.

    Hot buckets are told by the rows of a sample of classes, at most HOT of them; their members go straight into blocks of about `block`
    members. The rows of the others are shuffled once by bucket, where buckets of one member end and large ones are divided
    into blocks too. Any two blocks of a bucket meet as a unit of their own. Every row takes part whatever the sample says.
    """
    block = block or BLOCK
    seen = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "cls"), F.lit(SAMPLED)) == 0).groupBy("bucket").agg(F.count("*").alias("c"))
    total = seen.agg(F.sum("c").alias("total"))  # one row
    hot = seen.join(F.broadcast(total), F.col("c") * HOT > F.col("total")).where("c > 1").select("bucket", F.ceil(F.col("c") * SAMPLED / block).cast("int").alias("blocks"))
    hot = F.broadcast(hot)
    cold = rows.join(hot, "bucket", "left_anti").withColumn("n", F.count("*").over(W.partitionBy("bucket"))).where("n > 1")
    cold = cold.select("bucket", "cls", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = rows.join(hot, "bucket").select("bucket", "cls", "blocks").unionByName(cold).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    placed = stored(placed, "placed")
    left = placed.select("bucket", F.col("cls").alias("x"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    right = placed.select("bucket", F.col("cls").alias("y"), F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"))
    met = left.join(right, ["bucket", "i", "j"]).where("i < j OR x < y")
    return met.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _similar_sets(texts: list[str], a: np.ndarray, b: np.ndarray, width: int, num: int, den: int) -> np.ndarray:
    """Whether the shingle sets of texts a[i] and b[i] have an intersection of num/den of their union or more."""
    text, _, value = shingles(*word_hashes(texts), width)
    text, value, _ = distinct(text, value)
    size = np.bincount(text, minlength=len(texts))
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    _, rank = np.unique(value, return_inverse=True)
    wide = int(rank.max(initial=0)) + 1
    held = text * wide + rank  # ascending
    n = size[a]
    at = np.repeat(begin[a] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    asked = np.repeat(b, n) * wide + rank[at]
    place = np.minimum(np.searchsorted(held, asked), max(len(held) - 1, 0))
    both = np.bincount(np.repeat(np.arange(len(a)), n), weights=held[place] == asked if len(held) else None, minlength=len(a)).astype(np.int64)
    return (both > 0) & (both * den >= (n + size[b] - both) * num)


def texts_of(df: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(cls, text) of the records that stand for the classes wanted (cls); a broadcast of numbers if they are few, else the one shuffle of their texts."""
    rows = df.select(df[key].cast("bigint").alias("cls"), df[text].cast("string").alias("text"))
    return rows.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The (a, b) whose shingle sets reach the similarity, from distinct (a, b) and (cls, text), both stored; exact.

    A text with very many partners is dealt out, so no task gets all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # as many pairs at once as have 16 MB of text: the more, the more often a text is met again
            ends = np.cumsum(pc.add(pc.binary_length(whole.column(2)), pc.binary_length(whole.column(3))).to_numpy())
            begin = 0
            while begin < whole.num_rows:
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + (16 << 20), "right")))
                batch, begin = whole.slice(begin, end - begin), end
                coded = pa.chunked_array([batch.column(2), batch.column(3)]).combine_chunks().dictionary_encode()
                which = coded.indices.to_numpy()
                good = _similar_sets(coded.dictionary.to_pylist(), which[: batch.num_rows], which[batch.num_rows :], width, num, den)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    links = pairs
    for side in ("a", "b"):
        counts = links.groupBy(side).agg(F.count("*").alias("n"))
        pairs = spread_join(pairs, texts.select(F.col("cls").alias(side), F.col("text").alias(f"text_{side}")), [side], counts, deal=["a", "b"])
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def similar_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, num: int = 3, den: int = 5, least_words: int = 30) -> DataFrame:
    """(key_a, key_b), key_a < key_b: all records whose shingle sets have a Jaccard similarity of num/den or more.

    Candidates come from banded ProbMinHash signatures (recall by similarity: see BANDS), every candidate is
    verified exactly, and links between distinct texts are then given to all records that hold the texts.
    Null keys, null texts and texts of fewer than least_words words (empty ones too) have no partner; a record
    written again counts once; equal texts under different keys are partners; very long texts are used
    whole; an empty table gives an empty result; other columns are ignored.
    """
    classes, members = text_classes(df, key, text, width, least_words, ROWS, BANDS)
    classes = classes.where(F.size("bands") > 0)
    pairs = stored(bucket_pairs(classes.select(F.explode("bands").alias("bucket"), "cls")).distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    links = verified(pairs, stored(texts_of(df, key, text, wanted), "texts"), width, num, den)
    sizes = classes.select("cls", "n")
    within = bucket_pairs(members.join(sizes.where("n > 1").select("cls"), "cls", "left_semi").select(F.col("cls").alias("bucket"), F.col("key").alias("cls"))).toDF("x", "y")
    for side, name in (("a", "x"), ("b", "y")):
        own = members.select(F.col("cls").alias(side), F.col("key").alias(name))
        links = spread_join(own, links, [side], sizes.select(F.col("cls").alias(side), "n"))
    return links.select("x", "y").unionByName(within).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def star_links(rows: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Verified links enough to connect what all links within the buckets connect, from (bucket, cls) of buckets with several members, stored.

    Each member of a bucket is held against the bucket's smallest member. Two members that are both similar to it need
    no link of their own. A member that is not is paired with the whole bucket, in blocks, so nothing is lost,
    while a bucket of like texts costs one link a member however large it is.
    """
    heads = rows.groupBy("bucket").agg(F.min("cls").alias("a"), F.count("*").alias("n"))
    spokes = spread_join(rows, heads.select("bucket", "a"), ["bucket"], heads.select("bucket", "n"))
    spokes = stored(spokes.where("cls > a").select("bucket", "a", F.col("cls").alias("b")), "spokes")
    pairs = stored(spokes.select("a", "b").distinct(), "pairs")
    near = stored(verified(pairs, texts, width, num, den), "near")
    far = stored(spokes.join(near, ["a", "b"], "left_anti").select("bucket", F.col("b").alias("cls")), "far")
    # pairs of a far member with any other member but the head, each found from the far side; only of buckets with a far member
    blocks = heads.join(far.select("bucket").distinct(), "bucket", "left_semi").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "n")
    blocks = stored(blocks, "blocks")
    sized = lambda d: spread_join(d, blocks.select("bucket", "blocks"), ["bucket"], blocks.select("bucket", "n"))
    out = sized(far).select("bucket", F.col("cls").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    rest = sized(spokes.select("bucket", "b")).select("bucket", F.col("b").alias("y"), F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("i"))
    more = out.join(rest, ["bucket", "i"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    more = stored(more.distinct().join(near, ["a", "b"], "left_anti"), "more")
    return near.unionByName(verified(more, texts, width, num, den))


def components(links: DataFrame) -> DataFrame:
    """(cls, root) of every linked class, root the smallest of its component: large-star and small-star rounds until nothing changes.

    Each round is a table in the shared folder. The links of a class with very many of them, as the root of a large component has, are dealt out.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        large = spread_join(both.where("v > u"), least.select("u", "m"), ["u"], least.select("u", "n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        starred = spread_join(large, low.select("u", "m"), ["u"], low.select("u", "n"))
        small = starred.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = stored(small.where("u <> v").distinct(), "edges")
        if after.count() == edges.count() and not after.join(edges, ["u", "v"], "left_anti").limit(1).count():
            return after.select(F.col("u").alias("cls"), F.col("v").alias("root"))
        edges = after


def similar_groups(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 4, den: int = 5, least_words: int = 5) -> DataFrame:
    """(key, group_id, copies): the group of every record with a text; group_id is the smallest key of the group.

    A group is a component of the graph of verified links; copies is the number of records with exactly this
    text. Candidates are sought and verified by the similarity of sets, so a repeated passage counts once. A text too short for a shingle is alone with its copies. Null keys and texts give no row;
    records written again count once; empty tables give an empty result.
    """
    classes, members = text_classes(df, key, text, width, least_words, GROUP_ROWS, GROUP_BANDS)
    rows = classes.select(F.explode("bands").alias("bucket"), "cls")
    counts = stored(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "counts")  # combined on the map side
    rows = stored(spread_join(rows, counts.select("bucket"), ["bucket"], counts), "rows")
    texts = stored(texts_of(df, key, text, rows.select("cls").distinct()), "texts")
    roots = components(star_links(rows, texts, width, num, den))
    sizes = members.groupBy("cls").agg(F.count("*").alias("n"))
    told = stored(sizes.join(roots, "cls", "left").select("cls", "n", F.coalesce("root", "cls").alias("root")), "told")
    out = spread_join(members, told.select("cls", "root", F.col("n").alias("copies")), ["cls"], told.select("cls", "n"))
    return out.select(F.col("key").alias(key), F.col("root").alias("group_id"), "copies")
