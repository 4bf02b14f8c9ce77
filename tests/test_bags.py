"""Fits and costs by distinct words against those by texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions.tokenizers import bpe_costs, byte_words, fit_bpe, fit_bpe_words, load, word_lengths
from millrace.operators import bags
from millrace.operators import discovery as D


def odd_texts(n: int, seed: int = 4) -> list[str]:
    r = random.Random(seed)
    letters = ["ab c", "abcd é'", "xyz. ,\n", "of the\t", " 　 aä", "᠎​\x1c\x85 e", "文字列 a1²"]
    return ["".join(r.choices(letters[i % len(letters)], k=r.randint(0, 70))) + r.choice(["", "  the end's\n\n é", "aaaaaaa"]) for i in range(n)]


@pytest.mark.parametrize("vocabulary,least", [(262, 1), (300, 2), (700, 1), (700, 4)])
def test_a_fit_on_words_is_the_librarys_on_texts(vocabulary, least):
    for seed in range(12):
        texts = odd_texts(60, seed)
        words = Counter(w for t in byte_words(texts) for w in t)
        assert fit_bpe_words(words.items(), vocabulary, least) == fit_bpe(texts, vocabulary, least)
    assert fit_bpe_words([], vocabulary, least) == fit_bpe([], vocabulary, least)


def test_bags_fit_and_cost_as_texts_do(spark, monkeypatch):
    monkeypatch.setattr(bags, "CHUNK", 700)  # many chunks
    texts = odd_texts(300)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(300, None)], "doc_id bigint, text string").repartition(3).cache()
    options = D.Options(vocabulary=420, seed=3)
    fit = lambda s: bags.fitted(held, s, options.vocabulary, options.least_frequency, options.oversample, options.seed)
    held = bags.bags_of(rows, "doc_id", "text")
    # two labels, one without documents, and documents without a label
    labels = rows.where("doc_id % 5 < 4").select("doc_id", (F.col("doc_id") % 2 * 2).cast("int").alias("expert_id"))
    start = bags.stored_labels(held, labels, 3)
    first = fit(start)
    one = rows.join(labels, "doc_id").withColumn("weights", D.one_hot(3))
    experts = bags.experts_of(held, first)
    assert experts == D.fit_experts(one, "doc_id", "text", 3, options)
    # soft weights: broken parts are drawn as in integer_repeats
    state = bags.State(3, None, first, [0.0, 1.0, 0.5], 0.3, 2)
    now = bags.sums(held, state, start, options.oversample, options.seed)
    state.draws = bags.drawn(held, state, now, options.oversample, options.seed)
    found = bags.rows_of(held, state).cache()
    want = {r.doc_id: r.costs for r in bpe_costs(rows.where("text IS NOT NULL"), "doc_id", "text", experts).collect()}
    assert {r.doc_id: r.costs for r in found.collect()} == want and len(want) == 300
    assert found.select(F.explode("weights").alias("w")).where("w > 0 AND w < 1").count() > 300 and len(state.draws) >= 2
    assert bags.experts_of(held, fit(state)) == D.fit_experts(rows.join(found.select("doc_id", "weights"), "doc_id"), "doc_id", "text", 3, options)
    own = F.get("costs", F.col("expert_id"))
    sums = found.groupBy("expert_id").agg(F.sum(own).alias("t"), F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
    assert now["tokens"] == {r.expert_id: r.t for r in sums} and now["bytes"] == {r.expert_id: r.b for r in sums} and now["documents"] == {r.expert_id: r.n for r in sums}
    assert now["changed"][0] == found.join(labels.withColumnRenamed("expert_id", "old"), "doc_id").where("old <> expert_id").count() and now["both"][0] == 240


def test_an_expert_without_a_repeat_has_its_heaviest_text(spark):
    rows = spark.createDataFrame([(i, f"{chr(97 + i)}xyz {i}" * 9) for i in range(12)], "doc_id bigint, text string")
    options = D.Options(vocabulary=300, oversample=0.01, least_frequency=1, seed=1)
    held = bags.bags_of(rows, "doc_id", "text")
    state = bags.stored_labels(held, rows.where("doc_id IN (10, 9)").select("doc_id", F.lit(0).alias("expert_id")), 1)
    assert bags.experts_of(held, D._fitted(held, state, options)) == [fit_bpe(["jxyz 9" * 9], 300, 1)] and len(bags.bags_of(rows, "doc_id", "text").fits) == 1


def test_converged_rounds_go_by_words_alone(spark, monkeypatch):
    rng = random.Random(7)
    pools = [["".join(rng.choice(letters) for _ in range(6)) for _ in range(25)] for letters in ("abcdef", "ghijkl")]
    rows = spark.createDataFrame([(i, " ".join(rng.choices(pools[i % 2], k=80))) for i in range(60)], "doc_id bigint, text string")
    for name in ("fit_experts", "bpe_costs"):  # both read every text in each round
        monkeypatch.setattr(D, name, None)
    found = D.discover_domains(rows, options=D.Options(max_experts=3, vocabulary=330, rounds=3, passes=1, prior_weight=0.0, penalty_fraction=0.0))
    labels = {r.doc_id: r.expert_id for r in found.documents.collect()}
    assert len(labels) == 60 and not {labels[i] for i in range(0, 60, 2)} & {labels[i] for i in range(1, 60, 2)} and len(found.history) <= 3


def test_words_have_the_lengths_of_their_texts():
    json_text = fit_bpe(odd_texts(50), 400)
    assert word_lengths(json_text, byte_words(["the  end's é"])[0]).sum() == len(load(json_text).encode("the  end's é").ids)
