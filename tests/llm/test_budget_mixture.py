import random
import re

from pyspark.sql import functions as F

from millrace.llm import budget, mixture

SCHEMA = "doc_id bigint, text string, source string, lang string, domain string, tokens string, h string"


def made(seed=1, n=200):
    rng = random.Random(seed)
    texts = ["one two, three", "é½ x_y!", "", "  ", None, "same text " * 50, "　blank　"]
    rows = [(i, rng.choice(texts), rng.choice(["a"] * 6 + ["b", "c", None]), rng.choice(["EN", " en-XA", "de", None]), rng.choice(["prose", None]), "clash", "clash") for i in range(n)]
    return rows + rows[:20]


def test_slices_equal_a_count(spark):
    rows = made()
    got = {(r.source, r.lang, r.domain): (r.records, r.distinct_texts, r.tokens) for r in budget.slice_totals(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {}
    for k, t, s, lang, d, *_ in {r[0]: r for r in rows}.values():
        want.setdefault((s, lang and lang.strip().lower().split("-")[0], d), []).append(t)
    assert got == {k: (len(v), len({t for t in v if t is not None}), sum(len(re.findall(r"\w+|[^\w\s]", t)) for t in v if t is not None)) for k, v in want.items()}
    assert budget.slice_totals(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shortfalls(spark):
    totals = spark.createDataFrame([("a", "en", "prose", 600), ("b", "en", None, 400)], "source string, lang string, domain string, tokens bigint")
    budgets = spark.createDataFrame([("a", "en", "prose", 600_000), ("a", "en", "prose", 600_001), ("b", "en", None, 1), ("z", "en", "code", 0), ("z", "en", "code", None)], "source string, lang string, domain string, requested_ppm bigint")
    got = sorted(((r.source, r.requested_ppm), r.tokens, r.short) for r in budget.slice_shortfalls(totals, budgets).collect() if r.requested_ppm is not None)
    assert got == [(("a", 600_000), 600, False), (("a", 600_001), 600, True), (("b", 1), 0, True), (("z", 0), 0, False)]
    assert budget.slice_shortfalls(totals.limit(0), budgets).where("short").count() == 0


def test_consumption_takes_the_last_checkpoint(spark):
    rows = [(1, "r", "s", 1, 10, {"0": 5, "x": 9}), (2, "r", "s", 1, 20, {"0": 7, "1": 2}), (2, "r", "s", 1, 20, {"0": 7, "1": 2}), (3, "r", "t", 21, 30, None), (4, "q", "s", 1, 5, {}), (5, "q", "t", 6, 9, {"0": 100})]
    df = spark.createDataFrame([(*r, None) for r in rows], "checkpoint_id bigint, run_name string, name string, start_training_step bigint, last_train_step bigint, consumed_tokens_per_tokenizer map<string,bigint>, saved_at timestamp")
    assert {r.tokenizer_id: r.consumed for r in budget.stage_consumption(df).collect()} == {0: 107, 1: 2}


def test_consumption_keeps_counters_that_the_last_checkpoint_lacks(spark):
    rows = [(1, "r", "s", 1, 10, {"0": 5, "1": 4}), (2, "r", "s", 1, 20, {"0": 7, "1": None}), (3, "r", "s", 1, 30, {"0": 9}), (4, "r", "t", 31, 40, {"2": 6}), (5, "r", "t", 31, 50, None), (6, "r", "u", 51, 60, {"1": 3}), (7, "r", "u", 51, 70, {})]
    df = spark.createDataFrame([(*r, None) for r in rows], "checkpoint_id bigint, run_name string, name string, start_training_step bigint, last_train_step bigint, consumed_tokens_per_tokenizer map<string,bigint>, saved_at timestamp")
    assert {r.tokenizer_id: r.consumed for r in budget.stage_consumption(df).collect()} == {0: 9, 1: 7, 2: 6}


def test_sainte_lague_equals_the_loop(spark):
    rng = random.Random(2)
    for n, seats in ((1, 5), (3, 7), (8, 100), (20, 1000)):
        weights = {f"s{i:02}": rng.choice([0.0, 1.0, 1.0, rng.random(), 5.0]) for i in range(n)}
        weights["s00"] = 2.0
        got = {r.source: r.quota for r in mixture.sainte_lague(spark.createDataFrame(list(weights.items()), "source string, target_weight double"), seats).collect()}
        want = dict.fromkeys(weights, 0)
        for _ in range(seats):
            best = min((k for k in weights if weights[k] > 0), key=lambda k: (-weights[k] / (2 * want[k] + 1), k))
            want[best] += 1
        assert got == want


def test_mixture_respects_targets_and_caps(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 300), rng.choice(["a"] * 7 + ["b", "b", "c"])) for i in range(1500)] + [(5000, None, "a"), (5001, "y", None), (5002, "y", "untargeted")]
    df = spark.createDataFrame([(*r, "c", -1, None) for r in rows + rows[:50]], "doc_id bigint, text string, source string, bytes string, bucket int, turn bigint")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 4), ("c", 0.15, 1), ("none", 0.05, 2)], "source string, target_weight double, max_repeats int")
    out = mixture.mixture(df, targets).collect()
    size = {i: len(t or "") for i, t, _ in rows}
    total = sum(size.values())
    caps, used = {"a": 1, "b": 4, "c": 1}, {}
    copies, shards = {}, {}
    for r in out:
        assert r.bytes == size[r.doc_id] > 0 and 0 <= r.copy < caps[r.source]
        copies.setdefault(r.doc_id, set()).add(r.copy)
        used[r.source] = used.get(r.source, 0) + r.bytes
        shards[r.shard, r.source] = shards.get((r.shard, r.source), 0) + r.bytes
    assert all(c == set(range(len(c))) for c in copies.values()) and sum(map(len, copies.values())) == len(out)
    quotas = {(r.shard, r.source): r.quota for r in mixture.shard_quotas(targets).collect()}
    assert sum(quotas.values()) == mixture.SEATS and all(abs(sum(q for (k, _), q in quotas.items() if k == n) - 1000) == 0 for n in range(10))
    assert all(abs(shards.get((k, "b"), 0) - q * total / mixture.SEATS) < 700 for (k, s), q in quotas.items() if s == "b" and k < 4)
    have = {s: sum(size[i] for i, _, x in rows if x == s) for s in caps}
    for s, w in (("a", 0.3), ("b", 0.5), ("c", 0.15)):
        want = min(w * total, caps[s] * have[s])
        assert want - 300 <= used[s] <= want + total / mixture.SEATS
    assert sorted(map(tuple, mixture.mixture(df.repartition(7), targets).collect())) == sorted(map(tuple, out))
    plan = mixture.mixture_plan(mixture.sized_records(df), targets)
    assert {r.source for r in mixture.unfilled(plan).collect()} == {r.source for r in plan.where("capped").collect()} and "none" in {r.source for r in mixture.unfilled(plan).collect()}
    shares = {r.source: r for r in mixture.mixture_shares(df, targets).collect()}
    assert shares["none"].used_bytes == 0 and not shares["none"].target_met and shares["a"].target_met
    assert mixture.mixture(df.limit(0), targets).count() == 0 and mixture.mixture(df, targets.limit(0)).count() == 0


def test_null_keys_are_one_record(spark):
    df = spark.createDataFrame([(None, "abc", "a"), (None, "abc", "a"), (1, " é ", "a")], "doc_id bigint, text string, source string")
    assert sorted((r.doc_id or 0, r.bytes) for r in mixture.sized_records(df).collect()) == [(0, 3), (1, 2)]
    assert budget.slice_totals(df.selectExpr("*", "'en' AS lang", "'x' AS domain")).first().records == 2


def test_no_partition_gets_a_hot_source(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("zz").alias("text"), F.lit("hot").alias("source"))
    targets = spark.createDataFrame([("hot", 1.0, 1)], "source string, target_weight double, max_repeats int")
    assert mixture.mixture(df, targets).count() == 4000
