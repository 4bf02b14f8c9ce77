"""Near-duplicates and cross-split search against brute force."""

import math
import random
import re

import numpy as np
import pytest

from millrace.llm import crosssplit, neardup
from millrace.llm.crosssplit import cross_split
from millrace.llm.fmindex import WordIndex, suffix_order
from millrace.llm.neardup import bucket_pairs, components, probminhash, similar_groups, similar_pairs, star_links
from millrace.llm.words import distinct, shingles, word_hashes

WORDS = [f"w{i}" for i in range(400)]


def made(seed, n=60):
    """Texts with edited, shuffled and exact copies; nulls, empty, short and long ones."""
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) for _ in range(rng.randint(30, 90))] for _ in range(n)]
    out = []
    for words in base:
        out.append(words)
        for _ in range(rng.randint(0, 3)):
            new = list(words)
            for _ in range(rng.randint(0, 5)):
                new[rng.randrange(len(new))] = rng.choice(WORDS)
            if rng.random() < 0.3:
                k = rng.randrange(len(new))
                new = new[k:] + new[:k]
            out.append(new)
    texts = [" ".join(w) if i % 3 else ", ".join(w).upper() + "_" for i, w in enumerate(out)]
    return texts + [None, "", "  ", "too short", "the same ten words " * 3, "the same ten words " * 3, " ".join(rng.choice(WORDS) for _ in range(20_000))]


def sets(text, width, least):
    w = re.findall(r"[^\W_]+", text.lower()) if text is not None else []
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= least else set()


def near(a, b, num, den):
    both = len(a & b)
    return bool(a) and bool(b) and both * den >= (len(a) + len(b) - both) * num


def frame(spark, texts, key):
    rows = [(i, t, "clash", "clash", -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:7] + [(None, texts[0], "c", "c", 0)], f"{key} bigint, text string, cls string, h string, grams int")


def test_pairs_equal_brute_force(spark):
    texts = made(1)
    got = sorted((r.doc_id_a, r.doc_id_b) for r in similar_pairs(frame(spark, texts, "doc_id")).collect())
    s = [sets(t, 3, 30) for t in texts]
    assert got == [(a, b) for a in range(len(s)) for b in range(a + 1, len(s)) if near(s[a], s[b], 3, 5)]
    assert similar_pairs(frame(spark, texts, "doc_id").limit(0)).count() == 0


def test_groups_equal_components(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 2)
    texts = made(2)
    got = {r.doc_id: (r.group_id, r.copies) for r in similar_groups(frame(spark, texts, "doc_id")).collect()}
    live = [i for i, t in enumerate(texts) if t is not None]
    s = {i: sets(texts[i], 5, 5) for i in live}
    root = {i: i for i in live}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in live:
        for b in live:
            if a < b and (texts[a] == texts[b] or near(s[a], s[b], 4, 5)):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: (find(i), sum(texts[j] == texts[i] for j in live)) for i in live}
    assert similar_groups(frame(spark, texts, "doc_id").limit(0)).count() == 0


def test_groups_of_texts_that_repeat_a_passage(spark):
    rng = random.Random(8)
    texts = []
    for i in range(12):
        words = [f"w{i}x{rng.randrange(10**6)}" for _ in range(404)]
        texts += [" ".join(words), " ".join(words[:100] + words[100:124] * 50 + words[124:])]
    for a, b in zip(texts[::2], texts[1::2]):
        assert near(sets(a, 5, 5), sets(b, 5, 5), 4, 5)
    got = {r.doc_id: r.group_id for r in similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(24)}


def test_cross_split_equals_brute_force(spark, monkeypatch):
    a, b = made(3, 40), made(4, 20) + made(3, 40)[:70] + made(3, 40)[:9] * 2
    s, t = [sets(x, 3, 30) for x in a], [sets(x, 3, 30) for x in b]
    want = sorted((i, j) for i in range(len(s)) for j in range(len(t)) if near(s[i], t[j], 3, 5))
    for size, occurrences, packed in ((1 << 20, 4_000_000, 1 << 20), (4000, 50, 2000)):
        monkeypatch.setattr(crosssplit, "_OCCURRENCES", occurrences)
        rows = cross_split(frame(spark, a, "doc_id"), frame(spark, b, "ord"), shard_bytes=size, task_bytes=packed).collect()
        assert sorted((r.doc_id, r.ord) for r in rows) == want
        for r in rows:
            assert r.shared == len(s[r.doc_id] & t[r.ord]) and r.total == len(s[r.doc_id] | t[r.ord])
            assert (r.spans == 1) if r.shared == r.total == len(t[r.ord]) and a[r.doc_id] == b[r.ord] else r.spans >= 1
    assert cross_split(frame(spark, a, "doc_id").limit(0), frame(spark, b, "ord")).count() == 0
    assert cross_split(frame(spark, a, "doc_id"), frame(spark, b, "ord").limit(0)).count() == 0


def test_texts_of_common_sentences_are_searched_only_where_partners_are():
    """Every shard holds nearly all windows of all texts, yet a text goes to the shards of its partners and hardly to another."""
    rng = random.Random(11)
    sentences = [" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(150)]
    made = lambda: [rng.choice(sentences) + f" n{rng.randrange(10**4)}" for _ in range(12)]
    shards = [[made() for _ in range(80)] for _ in range(12)]
    texts = [made() for _ in range(200)] + [rng.sample(s := rng.choice(rng.choice(shards)), len(s)) for _ in range(40)]
    texts = [". ".join(t) for t in texts] + ["the same ten words " * 8]
    indexes, times = [], np.zeros(1 << 12, dtype=np.uint16)
    for shard in shards:
        h, n = word_hashes([". ".join(t) for t in shard] + ["the same ten words " * 8] * (shard is shards[3]))
        at, count = np.unique(shingles(h, n, 3)[2] >> np.uint64(52), return_counts=True)
        times[at.astype(np.int64)] += count.astype(np.uint16)
        indexes.append(WordIndex.build([h], n, np.arange(len(n))))
    posts = [crosssplit.with_present(crosssplit.postings(times, 12, index, 3, 3, 5, 30)) for index in indexes]
    good, n, begun = crosssplit.possible(times, 12, *word_hashes(texts), 3, 3, 5, 30)
    routes = {(t, k) for k, post in enumerate(posts) for t in crosssplit.shards_of(post | {"shard": np.zeros(len(post["key"]), dtype=np.int32)}, n, begun, 3, 5)[0].tolist()}
    held = [[sets(". ".join(t), 3, 30) for t in shard] + [sets("the same ten words " * 8, 3, 30)] * (shard is shards[3]) for shard in shards]
    own = [sets(t, 3, 30) for t in texts]
    want = {(i, k) for i, t in enumerate(own) for k, shard in enumerate(held) if any(near(t, s, 3, 5) for s in shard)}
    assert len(want) >= 41 and good.sum() > 200  # of 241, and each of those was searched in all twelve
    assert want <= routes
    assert len(routes) < 2 * len(want)


def test_suffixes_and_backward_search():
    rng = np.random.RandomState(0)
    for n, k in ((1, 1), (7, 1), (60, 2), (200, 5)):
        s = rng.randint(0, k, n).astype(np.int32)
        assert suffix_order(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    texts = [" ".join(rng.choice(WORDS[:6], 30)) for _ in range(20)] + [""]
    hashes, sizes = word_hashes(texts)
    index = WordIndex.build([hashes[:7], hashes[7:]], sizes, np.arange(len(texts)))
    assert all(index.words_of(t).tolist() == word_hashes([x])[0].tolist() for t, x in enumerate(texts))
    ids = index.ids(hashes)
    for width in (1, 2, 3):
        words = np.stack([ids[k : len(ids) - width + 1 + k] for k in range(width)], axis=1)[:40]
        low, high = index.windows(words)
        for w, a, b in zip(words.tolist(), low, high):
            found = sorted((t, i) for t, text in enumerate(texts) for i in range(len(text.split()) - width + 1) if index.ids(word_hashes([text])[0])[i : i + width].tolist() == w)
            assert b - a == len(found) and sorted(index.texts_at(np.arange(a, b)).tolist()) == [t for t, _ in found]
    assert index.ids(word_hashes(["nowhere"])[0]).tolist() == [-1]


def test_probminhash_estimates_probability_jaccard():
    a = {i: 1.0 + i % 3 for i in range(300)}
    b = {i: 1.0 + i % 5 for i in range(100, 400)}
    items = [(0, k, w) for k, w in a.items()] + [(1, k, w) for k, w in b.items()]
    keys = np.array([k * 2654435761 + 12345 for _, k, _ in items], dtype=np.uint64)
    got = probminhash(np.array([t for t, _, _ in items]), keys, np.array([w for *_, w in items]), 2, 4096)
    both = set(a) & set(b)
    everything = set(a) | set(b)
    want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in everything) for i in both)
    assert abs((got[0] == got[1]).mean() - want) < 0.04


def test_band_recall():
    s = 0.6
    assert 1 - (1 - s**neardup.ROWS) ** neardup.BANDS > 0.998


def test_hot_buckets_lose_no_pair(spark):
    rows = spark.createDataFrame([(7, i) for i in range(50)] + [(8, 1), (9, 1), (9, 3)], "bucket bigint, cls bigint")
    got = sorted((r.a, r.b) for r in bucket_pairs(rows, 4).collect())
    assert got == sorted([(a, b) for a in range(50) for b in range(a + 1, 50)] + [(1, 3)])


def test_star_links_connect_like_all_links(spark):
    rng = random.Random(3)
    grams = {i: sorted(set(rng.sample(range(40), 25)) | {100 * (i % 2) + k for k in range(60, 90)}) for i in range(40)}
    texts = spark.createDataFrame([(i, " ".join(f"w{k}" for k in v)) for i, v in grams.items()], "cls bigint, text string")
    rows = spark.createDataFrame([(b, i) for i in grams for b in (1, 2 + i % 3)], "bucket bigint, cls bigint")
    links = [(r.a, r.b) for r in star_links(rows, texts, 1, 3, 5).collect()]
    good = {(a, b) for a in grams for b in grams if a < b and near(set(grams[a]), set(grams[b]), 3, 5)}
    assert set(links) <= good

    def parts(edges):
        root = {i: i for i in grams}
        for _ in grams:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert parts(links) == parts(good)


def test_edited_texts_with_a_passage_repeated_fifty_times_are_grouped(spark):
    """A text and the same text with its first 20 words said 50 times more have nearly the same set of shingles."""
    rng = random.Random(5)
    texts = []
    for i in range(20):
        words = [f"t{i}w{rng.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(words), " ".join(words[:20] * 50 + words)]
    assert all(near(sets(a, 5, 5), sets(b, 5, 5), 4, 5) for a, b in zip(texts[::2], texts[1::2]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.group_id for r in similar_groups(rows).collect()} == {i: i // 2 * 2 for i in range(40)}
    assert similar_pairs(rows).count() == 20


def test_components_of_a_star_and_a_long_path(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)]
    got = {r.cls: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 3000)} | {5001 + i: 5000 for i in range(40)}


def test_components_of_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i % 10 != 9] + [(50, 51), (51, 50)], "a bigint, b bigint")
    assert {r.cls: r.root for r in components(edges).collect()} == {i: i // 10 * 10 for i in range(30) if i % 10} | {51: 50}


def test_words_and_shingles():
    hashes, sizes = word_hashes(["A_b, C-ß²", "", "İx"])
    assert sizes.tolist() == [4 if "²".isalnum() else 3, 0, 2]
    text, start, value = shingles(*word_hashes(["a b c a b c", "a b"]), 3)
    assert text.tolist() == [0] * 4 and start.tolist() == [0, 1, 2, 3]
    t, v, n = distinct(text, value)
    assert sorted(n.tolist()) == [1, 1, 2] and math.isclose(len(v), 3)


def test_no_executor_local_state():
    """Nothing may lean on a local checkpoint."""
    import pathlib

    root = pathlib.Path(neardup.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "localCheckpoint" in p.read_text()]


@pytest.mark.parametrize("copies", [400])
def test_a_third_of_all_rows_alike(spark, copies):
    texts = made(6, 20)
    one = " ".join(WORDS[:50])
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(10_000 + i, one) for i in range(copies)], "doc_id bigint, text string")
    assert similar_pairs(rows).where("doc_id_a >= 10000").count() == copies * (copies - 1) // 2
    assert similar_groups(rows).where("group_id = 10000").count() == copies
