"""Discovery of tokenizer domains: features, clusters, experts fitted in turns with assignments, splits and merges, learned routers.

Documents stay distributed; what the driver holds is one tokenizer for each expert and the sums of each round. Experts are fitted one task each
on the word counts of all their documents; costs, assignments, priors and the objective cover all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.tokenizers import bpe_costs, fit_bpe
from millrace.operators import bags
from millrace.operators.hotkeys import ranked
from millrace.operators.routing import prior_costs, priors, route, soft_weights
from millrace.session import cut


@dataclass
class Options:
    """Defaults of the published runs. sample: documents an expert is fitted on at most, by hash; None for all."""

    max_experts: int = 8
    vocabulary: int = 8192
    least_frequency: int = 2
    rounds: int = 12
    prior_weight: float = 8.0
    tolerance: float = 0.005
    temperature: float = 0.02
    decay: float = 0.9
    top_k: int = 2
    oversample: float = 2.0
    least_fraction: float = 0.01
    penalty_fraction: float = 0.005
    passes: int = 2
    split_candidates: int = 2
    merge_candidates: int = 4
    least_split: int = 20
    features: int = 256
    seed: int = 17
    sample: int | None = None


@dataclass
class Discovery:
    """documents: (doc_id, expert_id, costs, weights); experts: their tokenizers; the objective of each round."""

    documents: DataFrame
    experts: list[str]
    objective: float
    penalty: float
    converged: bool
    history: list[float] = field(default_factory=list)


def char_ngram_features(df: DataFrame, key: str, text: str, dimensions: int = 16_384, low: int = 3, high: int = 5) -> DataFrame:
    """(key, features ARRAY<FLOAT>): hashed character n-gram counts, L2 normalised; a text without n-grams, empty or null, has zeros."""

    step = 32  # texts hashed end to end, while the arrays stay in the cache

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                out = np.zeros((batch.num_rows, dimensions), dtype=np.float32)
                for r in range(0, len(texts), step):
                    some = texts[r : r + step]
                    code = np.frombuffer("".join(some).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
                    sizes = np.array([len(t) for t in some])
                    row = np.repeat(np.arange(len(some)) * dimensions, sizes)
                    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))  # characters to the text's end
                    for n in range(low, high + 1):
                        m = len(code) - n + 1
                        if m > 0:
                            h = np.full(m, n, dtype=np.uint64)
                            for k in range(n):
                                h ^= code[k : k + m]
                                h *= np.uint64(0x100000001B3)
                                h ^= h >> np.uint64(29)
                            h = h & np.uint64(dimensions - 1) if dimensions & (dimensions - 1) == 0 else h % np.uint64(dimensions)
                            at = (row[:m] + h.astype(np.int64))[left[:m] >= n]
                            out[r : r + step] += np.bincount(at, minlength=len(some) * dimensions).reshape(-1, dimensions)
                norm = np.linalg.norm(out, axis=1, keepdims=True)
                out /= np.where(norm > 0, norm, 1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dimensions), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=[key, "features"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, features array<float>")


def initial_labels(df: DataFrame, key: str, text: str, k: int, options: Options) -> DataFrame:
    """(key, expert_id): k-means over hashed n-grams; fewer clusters if there are fewer documents."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = char_ngram_features(df, key, text, options.features).select(key, array_to_vector(F.col("features").cast("array<double>")).alias("features"))
    features = cut(features)
    k = min(k, features.count())
    if k < 2:
        return features.select(key, F.lit(0).alias("expert_id"))
    return KMeans(k=k, seed=options.seed, featuresCol="features", predictionCol="expert_id").fit(features).transform(features).select(key, F.col("expert_id").cast("int").alias("expert_id"))


def integer_repeats(df: DataFrame, group: str, key: str, weight: str, oversample: float, seed: int, name: str = "repeats") -> DataFrame:
    """df with whole repeats of each row: the floor of weight * oversample, and one more for as many rows of a group as make its total the rounded
    (half to even) sum of weight * oversample.

    Those are drawn without replacement, with chances in proportion to what the floor leaves: the smallest -ln(u) / rest, u a digest of seed,
    group and key. Null weights are 0; a group's ranks come from ranges, so a large group is no single task; other columns are kept.
    """
    x = F.round(F.coalesce(F.col(weight), F.lit(0.0)) * oversample, 9).cast("decimal(27,9)")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), F.col(key).cast("string")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 1) / float(16**13 + 1)
    rows = df.withColumn("_x", x).withColumn("_whole", F.floor("_x")).withColumn("_rest", (F.col("_x") - F.col("_whole")).cast("double"))
    rows = rows.withColumn("_race", F.when(F.col("_rest") > 0, -F.log(u) / F.col("_rest")).otherwise(float("inf")))
    owed = rows.groupBy(F.col(group).alias("_g")).agg((F.bround(F.sum("_x"), 0) - F.sum("_whole")).cast("bigint").alias("_owed"))  # a row a group
    placed = ranked(rows, group, ["_race", key], "_rank").join(F.broadcast(owed), F.col(group).eqNullSafe(F.col("_g")))
    return placed.withColumn(name, F.col("_whole").cast("bigint") + (F.col("_rank") <= F.col("_owed")).cast("bigint")).select(*df.columns, name)


def weighted_rows(df: DataFrame, group: str, key: str, weight: str, repeats: str) -> DataFrame:
    """df's rows, each as often as it repeats, with `copy` from 1 on; a group without any repeat gives its heaviest row once, of equals that with the
    smallest key."""
    empty = df.groupBy(F.col(group).alias("_g")).agg(F.sum(repeats).alias("_n"), F.min_by(key, F.struct(-F.col(weight), F.col(key))).alias("_k")).where("_n = 0")  # a row a group
    first = df.join(F.broadcast(empty), F.col(group).eqNullSafe(F.col("_g")) & (F.col(key) == F.col("_k"))).withColumn("copy", F.lit(1)).select(*df.columns, "copy")
    some = df.where(F.col(repeats) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(repeats).cast("int"))))
    return some.unionByName(first)


def fit_experts(df: DataFrame, key: str, text: str, experts: int, options: Options) -> list[str]:
    """A tokenizer for each expert, from (key, text, weights): one task each, on all its documents or at most options.sample by hash.

    Texts stream through the task and repeat by their weight; an expert without a repeat gets its heaviest document.
    """
    rows = df.select(key, text, F.posexplode("weights").alias("e", "w")).where(f"w > 0 AND `{text}` IS NOT NULL")
    # weights with a fraction are drawn by keys and numbers alone; what isn't there has none
    parts = df.select(key, F.posexplode("weights").alias("e", "w")).where("w > 0")
    rest = lambda w: F.round(w * options.oversample, 9) - F.floor(F.round(w * options.oversample, 9))
    parts = parts.where(rest(F.col("w")) > 0)
    whole = F.floor(F.round(F.col("w") * options.oversample, 9)).cast("bigint")
    if parts.limit(1).count():
        drawn = integer_repeats(parts, "e", key, "w", options.oversample, options.seed, "n").select(key, "e", F.col("n").alias("_n"))
        whole = F.coalesce("_n", whole)
        rows = rows.join(drawn, [key, "e"], "left")
    rows = rows.withColumn("n", whole.cast("int")).select(key, text, "e", "w", "n")
    if options.sample is not None:
        from pyspark.sql import Window as W

        # first within hash buckets, so that no task ranks all documents of a large expert
        best = [F.desc(F.col("n") > 0), F.col("h")]
        rows = rows.withColumn("h", F.xxhash64(F.lit(options.seed), key)).withColumn("b", F.pmod("h", F.lit(64)))
        own = rows.withColumn("r", F.row_number().over(W.partitionBy("e", "b").orderBy(*best))).where(F.col("r") <= options.sample)
        rows = own.withColumn("r", F.row_number().over(W.partitionBy("e").orderBy(*best))).where(F.col("r") <= options.sample)
    least = max(1, round(options.least_frequency * options.oversample))
    vocabulary = options.vocabulary

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}

        def texts() -> Iterator[str]:
            for batch in batches:
                for k, t, e, w, n in zip(*(c.to_pylist() for c in batch.columns)):
                    seen["e"] = e
                    if n > 0:
                        seen["some"] = True
                        yield from [t] * n
                    elif "some" not in seen and ("heaviest" not in seen or (-w, k) < seen["heaviest"][0]):
                        seen["heaviest"] = ((-w, k), t)
            if "some" not in seen and "heaviest" in seen:
                yield seen["heaviest"][1]

        tokenizer = fit_bpe(texts(), vocabulary, least)
        if "e" in seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen["e"]], pa.int32()), pa.array([tokenizer])], names=["e", "tokenizer"])

    each = rows.select(key, text, "e", "w", "n").repartitionById(experts, F.col("e"))
    found = {r.e: r.tokenizer for r in each.mapInArrow(fit, "e int, tokenizer string").collect()}
    empty = fit_bpe([], options.vocabulary, least)
    return [found.get(e, empty) for e in range(experts)]


def _assigned(texts: DataFrame, key: str, text: str, experts: list[str], usage: DataFrame | None, temperature: float, options: Options) -> DataFrame:
    costed = bpe_costs(texts, key, text, experts)
    if usage is None:
        prior, active = [1.0 / len(experts)] * len(experts), [True] * len(experts)
    else:
        rows = usage.orderBy("expert_id").collect()  # one row an expert
        prior, active = [r.prior for r in rows], [r.active for r in rows]
    adjusted = prior_costs(F.col("costs").cast("array<double>"), prior, active, options.prior_weight)
    weights = soft_weights(F.col("_a"), temperature, min(options.top_k, sum(active)))
    return costed.withColumn("_a", adjusted).withColumn("expert_id", route("_a")).withColumn("weights", weights).drop("_a")


def converge(texts: DataFrame, key: str, text: str, labels: DataFrame, experts: int, options: Options, penalty: float) -> Discovery:
    """Fit and assign in turns until labels and objective settle; experts below the least fraction of bytes are dropped.

    If the rounds run out, the round with the best objective stands. Rounds that drop an expert don't count for that and may be made up for by one more
    for each expert, as long as no round has kept all of its experts. Fits and costs go by the words of all texts (bags), or by texts if options.sample bounds them.
    """
    if options.sample is not None:
        return _converge_texts(texts, key, text, labels, experts, options, penalty)
    o, found = options, bags.bags_of(texts, key, text)
    best: tuple | None = None
    history: list[float] = []
    state, temperature, extra, whole = bags.stored_labels(found, labels, experts), o.temperature, None, False
    old: dict[str, dict] | None = None
    for _ in range(max(o.rounds + experts, 1)):
        path = bags.fitted(found, state, o.vocabulary, o.least_frequency, o.oversample, o.seed) if old else _fitted(found, state, o)
        extra = extra or [-o.prior_weight * math.log(1.0 / experts)] * experts
        new = bags.State(experts, None, path, extra, temperature, min(o.top_k, sum(math.isfinite(x) for x in extra)))
        now = bags.sums(found, new, state if old else None, o.oversample, o.seed)
        kept = old is not None and set(now["documents"]) == set(old["documents"])
        history.append(float(sum(now["tokens"].values())) + penalty * len(now["tokens"]))
        changed = now["changed"].get(0, 0) / max(now["both"].get(0, 0), 1) if old else 1.0
        if best is None or history[-1] < best[1]:
            best = (new, history[-1], False)
        if old and changed <= o.tolerance and abs(history[-1] - history[-2]) < 1:
            best = (new, history[-1], True)
            break
        whole = whole or kept or len(now["documents"]) == experts
        if whole and len(history) >= o.rounds:
            break
        new.draws = bags.drawn(found, new, now, o.oversample, o.seed)
        extra = bags.prior_terms(now["bytes"], experts, o.least_fraction, o.prior_weight)
        state, old, temperature = new, now, temperature * o.decay
    return Discovery(cut(bags.rows_of(found, best[0])), bags.experts_of(found, best[0].costs), best[1], penalty, best[2], history)


def _converge_texts(texts: DataFrame, key: str, text: str, labels: DataFrame, experts: int, options: Options, penalty: float) -> Discovery:
    """converge by texts; each round's assignment is cut by a checkpoint."""
    state = texts.join(labels, key).withColumn("weights", one_hot(experts))
    best: Discovery | None = None
    history: list[float] = []
    previous, temperature, usage = None, options.temperature, None
    for _ in range(max(options.rounds + experts, 1)):
        fitted = fit_experts(state, key, text, experts, options)
        assigned = cut(_assigned(texts.withColumn("bytes", F.octet_length(text)), key, text, fitted, usage, temperature, options))
        usage = priors(assigned, experts, "bytes", "expert_id", options.least_fraction)
        sums = assigned.agg(F.sum(F.get("costs", F.col("expert_id"))).alias("t"), F.count_distinct("expert_id").alias("k")).first()
        objective = float(sums.t or 0) + penalty * (sums.k or 0)
        history.append(objective)
        changed = 1.0
        if previous is not None:
            old = previous.select(F.col(key).alias("_k"), F.col("expert_id").alias("_e"))
            changed = assigned.join(old, F.col(key) == F.col("_k")).agg(F.avg((F.col("expert_id") != F.col("_e")).cast("double"))).first()[0] or 0.0
        if best is None or objective < best.objective:
            best = Discovery(assigned, fitted, objective, penalty, False, history)
        if previous is not None and changed <= options.tolerance and abs(history[-1] - history[-2]) < 1:
            return Discovery(assigned, fitted, objective, penalty, True, history)
        previous, temperature = assigned, temperature * options.decay
        state = texts.join(assigned.select(key, "expert_id", "weights"), key)
    return best


def discover_domains(df: DataFrame, key: str = "doc_id", text: str = "text", options: Options | None = None) -> Discovery:
    """Domains of documents by description length: clusters, converged experts, then splits and merges while they pay, each refitted to convergence, and a final refit.

    A pass tries a split, then a merge. Clusters start from character n-grams. Null texts are left out. The penalty of an expert is the greater of its vocabulary and a share of all tokens.
    """
    o = options or Options()
    texts = cut(df.select(key, text).where(f"`{text}` IS NOT NULL"))
    n = texts.count()
    k = min(o.max_experts, max(1, n // o.least_split))
    total = texts.agg(F.sum(F.regexp_count(text, F.lit(r"\S+")))).first()[0] or 0
    penalty = max(o.vocabulary, total * o.penalty_fraction)
    found = converge(texts, key, text, initial_labels(texts, key, text, k, o), k, o, penalty)
    for _ in range(o.passes):
        changed = False
        for proposed in (split_labels, merge_labels):
            labels = proposed(texts, key, text, found, o, penalty)
            if labels is not None:
                found, changed = _refitted(texts, key, text, labels, o, penalty), True
        if not changed:
            break
    return _refitted(texts, key, text, found.documents.select(key, "expert_id"), o, penalty)


def _refitted(texts: DataFrame, key: str, text: str, labels: DataFrame, o: Options, penalty: float) -> Discovery:
    """The labels' experts, numbered without gaps, refitted to convergence."""
    ids = sorted(r[0] for r in labels.select("expert_id").distinct().collect())  # one row an expert
    dense = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("expert_id")).cast("int") - 1 if ids else F.col("expert_id")
    return converge(texts, key, text, labels.select(key, dense.alias("expert_id")), max(1, len(ids)), o, penalty)


def _sizes(found: Discovery) -> dict[int, tuple[int, int, int]]:
    """Documents, tokens and bytes of each expert."""
    own = F.get("costs", F.col("expert_id"))
    return {r.expert_id: (r.n, r.t, r.b) for r in found.documents.groupBy("expert_id").agg(F.count("*").alias("n"), F.sum(own).alias("t"), F.sum("bytes").alias("b")).collect()}


def _own_costs(texts: DataFrame, key: str, text: str, parts: DataFrame, experts: int, o: Options) -> DataFrame:
    """(key, expert_id, costs) of the documents that have a part (key, expert_id), under tokenizers fitted on the parts."""
    if o.sample is None:
        found = bags.bags_of(texts, key, text)
        state = bags.stored_labels(found, parts, experts)
        return bags.rows_of(found, bags.State(experts, None, _fitted(found, state, o), [0.0] * experts), state).select(key, "expert_id", "costs")
    own = texts.join(parts, key)
    return bpe_costs(own, key, text, fit_experts(own.withColumn("weights", one_hot(experts)), key, text, experts, o)).select(key, "expert_id", "costs")


def _fitted(found: bags.Bags, state: bags.State, o: Options) -> str:
    """bags.fitted of labels, which weigh one; only a broken oversample leaves something to draw."""
    if o.oversample != int(o.oversample):
        state.draws = bags.drawn(found, state, bags.sums(found, state, None, o.oversample, o.seed), o.oversample, o.seed)
    return bags.fitted(found, state, o.vocabulary, o.least_frequency, o.oversample, o.seed)


def split_labels(texts: DataFrame, key: str, text: str, found: Discovery, o: Options, penalty: float) -> DataFrame | None:
    """(key, expert_id) with the best split of an expert, or nothing if none pays or leaves least_split documents on both sides.

    Experts with the most tokens a byte are tried first; the tokenizers of all splits are fitted together. A split's documents go to the side whose tokenizer needs fewer tokens.
    """
    sizes = _sizes(found)
    if len(sizes) >= o.max_experts:
        return None
    labels, best, halves, tried = found.documents.select(key, "expert_id"), None, [], []
    able = [e for e, (n, _, _) in sizes.items() if n >= 2 * o.least_split]
    for e in sorted(able, key=lambda i: (-sizes[i][1] / max(sizes[i][2], 1), -i))[: o.split_candidates]:
        own = cut(initial_labels(texts.join(labels.where(F.col("expert_id") == e).select(key), key), key, text, 2, o))
        count = [r["count"] for r in own.groupBy("expert_id").count().collect()]
        if len(count) == 2 and min(count) >= o.least_split:
            halves.append(own.select(key, (F.col("expert_id") + 2 * len(tried)).alias("expert_id")))
            tried.append(e)
    if not tried:
        return None
    costs = _own_costs(texts, key, text, reduce(DataFrame.unionByName, halves), 2 * len(tried), o)
    split = F.floor(F.col("expert_id") / 2).cast("int")
    pair = costs.select(key, split.alias("split"), F.get("costs", 2 * split).alias("a"), F.get("costs", 2 * split + 1).alias("b"))
    sides = cut(pair.select(key, "split", (F.col("b") < F.col("a")).cast("int").alias("side"), F.least("a", "b").alias("c")))
    sums = sides.groupBy("split", "side").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()  # two rows a split
    for i, e in enumerate(tried):
        own = [r for r in sums if r.split == i]
        gain = sizes[e][1] - sum(r.c for r in own) - penalty
        if len(own) == 2 and min(r.n for r in own) >= o.least_split and gain > 0 and (best is None or gain > best[0]):
            best = (gain, sides.where((F.col("split") == i) & (F.col("side") == 1)).select(key, F.lit(max(sizes) + 1).alias("_new")))
    return None if best is None else labels.join(best[1], key, "left").select(key, F.coalesce("_new", "expert_id").alias("expert_id"))


def merge_labels(texts: DataFrame, key: str, text: str, found: Discovery, o: Options, penalty: float) -> DataFrame | None:
    """(key, expert_id) with the best merge of the merge_candidates pairs of smallest proxy, whose tokenizers are fitted together, or nothing if none pays."""
    from millrace.operators.routing import merge_proxies

    sizes = _sizes(found)
    if len(sizes) < 2 or o.merge_candidates <= 0:
        return None
    labels, best = found.documents.select(key, "expert_id"), None
    pairs = [(p.a, p.b) for p in merge_proxies(found.documents, len(found.experts)).orderBy("proxy", "a", "b").limit(o.merge_candidates).collect()]
    if o.sample is None:
        held = bags.bags_of(texts, key, text)
        state = bags.stored_labels(held, labels, len(pairs))
        state.groups = pairs
        merged = bags.tokens_of(held, state, _fitted(held, state, o))
    else:
        own = lambda p: labels.where(F.col("expert_id").isin(*p)).select(key, F.lit(0).alias("expert_id"))
        merged = {i: _own_costs(texts, key, text, own(p), 1, o).agg(F.sum(F.get("costs", F.lit(0)))).first()[0] for i, p in enumerate(pairs)}
    for i, (a, b) in enumerate(pairs):
        gain = sizes[a][1] + sizes[b][1] + penalty - merged[i]
        if gain > 0 and (best is None or gain > best[0]):
            best = (gain, a, b)
    return None if best is None else labels.select(key, F.when(F.col("expert_id") == best[2], best[1]).otherwise(F.col("expert_id")).alias("expert_id"))


def one_hot(experts: int) -> F.Column:
    return F.transform(F.sequence(F.lit(0), F.lit(experts - 1)), lambda i: F.when(i == F.col("expert_id"), 1.0).otherwise(0.0))


def _once(texts: DataFrame, key: str, text: str, labels: DataFrame, experts: int, o: Options, penalty: float) -> Discovery:
    """One fit and one assignment under given labels."""
    fitted = fit_experts(texts.join(labels, key).withColumn("weights", one_hot(experts)), key, text, experts, o)
    assigned = cut(_assigned(texts.withColumn("bytes", F.octet_length(text)), key, text, fitted, None, o.temperature, o))
    sums = assigned.agg(F.sum(F.get("costs", F.col("expert_id"))).alias("t"), F.count_distinct("expert_id").alias("k")).first()
    return Discovery(assigned, fitted, float(sums.t or 0) + penalty * (sums.k or 0), penalty, False)


def learned_router(train: DataFrame, predict: DataFrame, key: str, text: str, label: str, dimensions: int = 1024, sample: int = 50_000) -> DataFrame:
    """(key, learned): routes predicted from hashed character n-grams by logistic regression, fitted on at most `sample` labelled documents by hash.

    With a single label no model is fitted.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    labels = [r[0] for r in train.select(label).distinct().limit(2).collect()]
    if len(labels) < 2:
        return predict.select(key, F.lit(labels[0] if labels else None).cast("int").alias("learned"))
    vector = lambda d: char_ngram_features(d, key, text, dimensions).select(key, array_to_vector(F.col("features").cast("array<double>")).alias("features"))
    chosen = train.orderBy(F.xxhash64(key)).limit(sample)
    data = cut(vector(chosen).join(chosen.select(key, F.col(label).cast("double").alias("label")), key))
    model = LogisticRegression(maxIter=30, regParam=1e-4).fit(data)
    return model.transform(vector(predict)).select(key, F.col("prediction").cast("int").alias("learned"))
