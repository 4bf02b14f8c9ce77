import random
import re

import numpy as np

from millrace.llm import leaks
from millrace.llm.leaks import _Words, consistent, leaked_items, read_words, windows

ITEMS = [
    (1, "The register of Grelbo lists Harmi and Tofel as keepers of the garden since 1994. Then Grelbo paid 300 crowns to Harmi."),
    (2, "After 268 trials Klokle found the answer inside Kluriwe, where Dresodu had hidden 15 copies of the old map near the river bank."),
    (3, "The register of Grelbo lists Harmi and Tofel as keepers of the garden since 1994, he said."),
    (4, "short item"), (5, None), (6, ""),
]
SCHEMA = "doc_id bigint, text string, verbatim string, item_id string"


def brute(docs, items, width):
    out = set()
    for d, t in docs:
        for i, s in items:
            if t is not None and s is not None:
                a, b = re.findall(r"[^\W_]+", t.lower()), re.findall(r"[^\W_]+", s.lower())
                grams = {tuple(a[k : k + width]) for k in range(len(a) - width + 1)}
                if any(tuple(b[k : k + width]) in grams for k in range(len(b) - width + 1)):
                    out.add((d, i))
    return out


def test_verbatim_equals_brute_force(spark):
    rng = random.Random(9)
    docs = [(900, None), (901, ""), (902, "   "), (903, "İstanbul ΣΑΣ " + ITEMS[0][1].upper()), (904, "x " * 30_000 + ITEMS[1][1] + " y" * 30_000)]
    for n in range(120):
        words = re.findall(r"\S+", rng.choice(ITEMS[:3])[1])
        a = rng.randrange(len(words))
        cut = words[a : a + rng.randint(5, 25)]
        if rng.random() < 0.3:
            cut[rng.randrange(len(cut))] = "other"
        sep = rng.choice([" ", "\n", "_", " - "])
        docs.append((n, "prefix text " + sep.join(cut).swapcase() + " suffix"))
    rows = [(d, t, "clash", "clash") for d, t in docs]
    df = spark.createDataFrame(rows + rows[:9] + [(None, ITEMS[0][1], "c", "c")], SCHEMA)
    items = spark.createDataFrame(ITEMS + ITEMS[:1], "item_id bigint, text string")
    for size in (8 << 20, 50):
        got = {(r.doc_id, r.item_id) for r in leaked_items(df, items, item_bytes=size, names=False).where("verbatim > 0").collect()}
        assert got == brute(docs, ITEMS, 12)
    assert leaked_items(df.limit(0), items).count() == 0 and leaked_items(df, items.limit(0)).count() == 0


def test_reworded_needs_consistent_slots(spark):
    good = "The register of Bromta lists Zilka and Worde as keepers of the garden since 2050. Then Bromta paid 17 crowns to Zilka."
    bad = "The register of Bromta lists Bromta and Bromta as keepers of the garden since 2050. Then Worde paid 17 crowns to Zilka."
    other = "The register of Bromta lists Zilka and Worde as keepers of the kitchen since 2050. Then Bromta sold 17 crowns to Zilka."
    df = spark.createDataFrame([(1, good), (2, bad), (3, other)], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS[:1], "item_id bigint, text string")
    got = {r.doc_id: (r.verbatim, r.reworded) for r in leaked_items(df, items).collect()}
    # of 11 windows: all are renamed one to one in the first; the second names three keepers alike, so only the last 5 windows agree;
    # the third changes a word that is no slot, so only the window before it agrees
    assert {d: v[1] for d, v in got.items()} == {1: 11, 2: 5, 3: 1} and not any(v[0] for v in got.values())


def test_templates():
    flat, sizes = read_words([ITEMS[0][1], ITEMS[0][1].replace("1994", "7").replace("Harmi", "Bo"), "1 2 3"], _Words())
    plain, named = (windows(flat, sizes, 12, names) for names in (False, True))
    n = len(plain[0]) // 2
    assert n == 11 and named[1][:n].tolist() == named[1][n:].tolist() and plain[1][:n].tolist() != plain[1][n:].tolist()
    # a window that begins with a unit is the same whatever stands before it
    a, b = (windows(*read_words([t], _Words()), 3, False)[1] for t in ("300 crowns to pay", "of crowns to pay"))
    assert a[1] == b[1] and a[0] != b[0]
    one = np.array([[1, 2, 1, 9]]), np.array([[5, 6, 5, 9]]), np.array([[True, True, True, False]])
    assert consistent(*one).all() and not consistent(one[0], np.array([[5, 5, 5, 9]]), one[2]).any() and not consistent(np.array([[1, 1, 1, 9]]), one[1], one[2]).any()
    assert not consistent(one[0], np.array([[5, 6, 5, 8]]), one[2]).any() and not consistent(one[0], one[1], one[2] | True).any()


def test_planted_reparameterised_items_are_found(spark):
    """Every number and name of an item replaced consistently: all documents that hold such an item, and no others."""
    rng = random.Random(4)
    made = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)).capitalize()
    plain = [f"w{k}" for k in range(300)]
    plain = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(6)) for _ in plain]
    items, docs = [], []
    for i in range(60):
        a, b, n = made(), made(), rng.randrange(1000)
        frame = [rng.choice(plain) for _ in range(20)]
        fill = lambda a, b, n: " ".join([*frame[:4], a, *frame[4:8], str(n), "tarns", *frame[8:12], b, *frame[12:16], a, *frame[16:]])
        items.append((i, fill(a, b, n)))
        docs.append((i, "Before it. " + fill(made(), made(), rng.randrange(1000)) + " And after."))
    docs += [(1000 + k, " ".join(rng.choice(plain) for _ in range(60))) for k in range(60)]
    got = leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), item_bytes=3000)
    found = {(r.doc_id, r.item_id) for r in got.where("reworded > 0").collect()}
    assert found == {(i, i) for i in range(60)}


def test_many_hits_are_compared_in_portions(monkeypatch):
    monkeypatch.setattr(leaks, "_HITS", 3)
    flat, sizes = read_words(["a b c d e f a b c d e f a b c d e f"] * 2, _Words())
    index = leaks.index_items(np.array([5, 6]), flat, sizes, 6, True)
    got = leaks.search(index, flat, sizes, 6, True)
    assert got["verbatim"].tolist() == [29] * 4 and got["item"].tolist() == [5, 6, 5, 6]
