"""Costs of documents under several tokenizers (experts), routes, responsibilities and reports.

An expert is a column expression that counts tokens, or a vocabulary encoded in Arrow batches; costs are an array with an entry per expert, so
routing needs no join and no shuffle. The native experts word, char and byte can be written in SQL as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import budget_tokens, byte_length, col, let
from millrace.session import stored

EXPERTS = ("word", "char", "byte")


def native_costs(text: Column | str) -> Column:
    """[budget tokens, ceil(characters / 3), ceil(bytes / 4)]; null for null."""
    t = col(text)
    return F.when(t.isNotNull(), F.array(budget_tokens(t), F.ceil(F.char_length(t) / 3).cast("bigint"), F.ceil(byte_length(t) / 4).cast("bigint")))


def route(costs: Column | str) -> Column:
    """The cheapest expert's number; ties go to the lowest; null for null or no costs."""
    c = col(costs)
    return F.when(F.size(c) > 0, F.array_position(c, F.array_min(c)) - 1).cast("int")


def cost_of(costs: Column | str, expert: Column | str) -> Column:
    """The cost under one expert; null if there is no such expert."""
    return F.get(col(costs), col(expert))


def long_costs(df: DataFrame, key: str, costs: str) -> DataFrame:
    """(key, expert_id, tokens), a row for each document and expert."""
    return df.select(key, F.posexplode(costs).alias("expert_id", "tokens"))


def priors(df: DataFrame, experts: int, bytes_: str = "bytes", label: str = "expert_id", least: float = 0.01) -> DataFrame:
    """(expert_id, bytes, prior, active) of every expert: prior (bytes + 1) / (total + K); active from a share of `least` on, or the
    largest (the lowest of the largest) if none is."""
    spark = df.sparkSession
    ids = spark.range(experts).select(F.col("id").cast("int").alias("expert_id"))
    per = df.groupBy(F.col(label).alias("expert_id")).agg(F.sum(bytes_).alias("bytes"))
    w = W.partitionBy()
    out = ids.join(per, "expert_id", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    out = out.withColumn("prior", (F.col("bytes") + 1) / (F.sum("bytes").over(w) + experts))
    enough = F.coalesce(F.try_divide(F.col("bytes").cast("double"), F.sum("bytes").over(w)) >= least, F.lit(False))
    out = out.withColumn("_ok", enough).withColumn("_any", F.max(F.col("_ok").cast("int")).over(w))
    best = F.row_number().over(W.orderBy(F.desc("bytes"), "expert_id")) == 1
    return out.withColumn("_best", best).select("expert_id", "bytes", "prior", F.when(F.col("_any") == 1, F.col("_ok")).otherwise(F.col("_best")).alias("active"))


def prior_costs(costs: Column, prior: list[float], active: list[bool], weight: float = 8.0) -> Column:
    """costs - weight * ln(prior), infinite for inactive experts."""
    import math

    extra = F.array(*[F.lit(-weight * math.log(p) if a and p > 0 else math.inf) for p, a in zip(prior, active)])
    return F.zip_with(costs, extra, lambda c, e: c + e)


def soft_weights(costs: Column, temperature: float, top: int = 2) -> Column:
    """Softmax of -regret / temperature over the `top` cheapest experts, 0 for the others; regret is (cost - least) / max(least, 1).

    Ties at the edge of the top go to the lowest expert. With temperature 0 or one expert all weight is the cheapest's.
    """
    if temperature <= 0 or top <= 1:
        return let(costs, lambda c: let(F.array_position(c, F.array_min(c)), lambda best: F.transform(c, lambda _, i: F.when(i + 1 == best, 1.0).otherwise(0.0))))

    def logits(c: Column) -> Column:
        return let(F.array_min(c), lambda least: F.transform(c, lambda x: -((x - least) / F.greatest(least, F.lit(1.0))) / temperature))

    def raw(logit: Column) -> Column:
        order = F.slice(F.array_sort(F.transform(logit, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))), 1, top)
        return let(F.transform(order, lambda s: s["i"]), lambda kept: F.transform(logit, lambda x, i: F.when(F.array_contains(kept, i), F.exp(x)).otherwise(0.0)))

    def normal(r: Column) -> Column:
        return let(F.aggregate(r, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(r, lambda x: x / total))

    return let(costs, lambda c: let(logits(c), lambda g: let(raw(g), normal)))


def expert_summary(df: DataFrame, experts: int) -> DataFrame:
    """Of rows (expert_id, weights, bytes, tokens): documents, responsibility mass, overlap documents (weight without the route),
    bytes, tokens and bytes per token of every expert; experts without documents have zeros."""
    ids = df.sparkSession.range(experts).select(F.col("id").cast("int").alias("expert_id"))
    each = df.select(F.col("expert_id").alias("own"), "bytes", "tokens", F.posexplode("weights").alias("expert_id", "w"))
    mine = F.col("own") == F.col("expert_id")
    sums = each.groupBy("expert_id").agg(
        F.sum(mine.cast("int")).alias("documents"), F.sum("w").alias("mass"), F.sum(((F.col("w") > 0) & ~mine).cast("int")).alias("overlap"),
        F.sum(F.when(mine, F.col("bytes"))).alias("bytes"), F.sum(F.when(mine, F.col("tokens"))).alias("tokens"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = ids.join(sums, "expert_id", "left").select("expert_id", *map(zero, ("documents", "mass", "overlap", "bytes", "tokens")))
    return out.withColumn("bytes_per_token", F.col("bytes") / F.greatest("tokens", F.lit(1)))


def method_metrics(df: DataFrame, by: str, small: str, large: str, methods: list[str]) -> DataFrame:
    """Metrics of each method, by `by` and over all (null `by`), in one pass with grouping sets.

    df has a token column for each method. bytes, tokens, bytes per token, tokens per KiB, reduction against the small and the large
    baseline, and the share of documents that beat (fewer tokens) or equal the small one. Ratios without a denominator are null.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("t")) for m in methods]))
    rows = df.select(by, "bytes", F.col(small).alias("_s"), F.col(large).alias("_l"), pairs.alias("m")).select(by, "bytes", "_s", "_l", "m.*")
    aggregates = [
        F.count("*").alias("documents"), F.sum("bytes").alias("bytes"), F.sum("t").alias("tokens"), F.sum("_s").alias("_s"), F.sum("_l").alias("_l"),
        F.sum((F.col("t") < F.col("_s")).cast("int")).alias("_w"), F.sum((F.col("t") == F.col("_s")).cast("int")).alias("_t"),
    ]
    sets = rows.groupingSets([[F.col(by), F.col("method")], [F.col("method")]], by, "method").agg(*aggregates, F.grouping(by).alias("overall"))
    d = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 9)
    return sets.select(
        by, "method", "overall", "documents", "bytes", "tokens", d(F.col("bytes"), F.col("tokens")).alias("bytes_per_token"), d(F.col("tokens") * 1024, F.col("bytes")).alias("tokens_per_kib"),
        F.round(1 - F.try_divide(F.col("tokens").cast("double"), F.col("_s").cast("double")), 9).alias("reduction_small"), F.round(1 - F.try_divide(F.col("tokens").cast("double"), F.col("_l").cast("double")), 9).alias("reduction_large"),
        d(F.col("_w"), F.col("documents")).alias("win_rate"), d(F.col("_t"), F.col("documents")).alias("tie_rate"),
    )


def majority_router(df: DataFrame, feature: str, label: str) -> DataFrame:
    """(feature, learned): the most frequent label of each feature value, the lowest of equals."""
    counts = df.groupBy(feature, label).agg(F.count("*").alias("n"))
    return counts.groupBy(feature).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("learned"))


def router_report(df: DataFrame, experts: int) -> DataFrame:
    """(expert_id, learned_usage, oracle_usage, agreement, regret): usage zero-filled, agreement and regret over all documents.

    df: (learned, oracle, learned_tokens, oracle_tokens). regret is learned / max(oracle, 1) - 1.
    """
    ids = df.sparkSession.range(experts).select(F.col("id").cast("int").alias("expert_id"))
    use = lambda c: df.groupBy(F.col(c).alias("expert_id")).agg(F.count("*").alias(f"{c}_usage"))
    whole = df.agg(F.round(F.avg((F.col("learned") == F.col("oracle")).cast("double")), 9).alias("agreement"), F.round(F.sum("learned_tokens") / F.greatest(F.sum("oracle_tokens"), F.lit(1)) - 1, 9).alias("regret"))
    out = ids.join(use("learned"), "expert_id", "left").join(use("oracle"), "expert_id", "left").crossJoin(F.broadcast(whole))  # one row
    return out.select("expert_id", F.coalesce("learned_usage", F.lit(0)).alias("learned_usage"), F.coalesce("oracle_usage", F.lit(0)).alias("oracle_usage"), "agreement", "regret")


def merge_proxies(df: DataFrame, experts: int, label: str = "expert_id", costs: str = "costs") -> DataFrame:
    """(a, b, proxy) of every pair a < b of experts with documents: what their documents would cost more under the other.

    One pass of partial sums (a row for each label and expert), paired afterwards.
    """
    sums = df.select(label, F.posexplode(costs).alias("k", "c"), F.get(costs, F.col(label)).alias("own")).groupBy(F.col(label).alias("l"), "k").agg(F.sum(F.col("c") - F.col("own")).alias("extra"))
    sums = stored(sums, "sums")  # a row for each label and expert
    left = sums.select(F.col("l").alias("a"), F.col("k").alias("b"), F.col("extra").alias("x")).where("a < b")
    right = sums.select(F.col("l").alias("b"), F.col("k").alias("a"), F.col("extra").alias("y")).where("a < b")
    return left.join(right, ["a", "b"]).select("a", "b", (F.col("x") + F.col("y")).alias("proxy"))


def domain_markers(df: DataFrame, pattern: str, label: str = "expert_id", key: str = "doc_id", text: str = "text", characters: int = 20_000, least: int = 2, top: int = 20) -> DataFrame:
    """(label, marker, count, score, rank): the markers most typical of each label by log odds of document frequency.

    score = ln(((c + .5) / (n_k + 1)) / ((g + .5) / (N + 1))), c and g the label's and all documents with the marker. Order: score, count, marker, all descending.
    """
    marks = F.array_distinct(F.transform(F.regexp_extract_all(F.substring(text, 1, characters), F.lit(pattern), F.lit(0)), F.lower))
    # one pass over the texts: beside its markers each document has a null one, which counts the label's documents
    marked = df.where(F.col(text).isNotNull()).select(label, F.explode(F.concat(marks, F.array(F.lit(None).cast("string")))).alias("marker"))
    counts = stored(marked.groupBy(label, "marker").agg(F.count("*").alias("count")), "markers")
    local = counts.where("marker IS NOT NULL")
    everywhere = local.groupBy("marker").agg(F.sum("count").alias("g"))
    sizes = counts.where("marker IS NULL").select(label, F.col("count").alias("n"))
    total = sizes.agg(F.sum("n").alias("_all"))
    joined = local.where(F.col("count") >= least).join(everywhere, "marker").join(sizes, label).crossJoin(F.broadcast(total))  # one row
    score = F.round(F.ln(((F.col("count") + 0.5) / (F.col("n") + 1)) / ((F.col("g") + 0.5) / (F.col("_all") + 1))), 9)
    scored = joined.select(label, "marker", "count", score.alias("score"))
    rank = F.row_number().over(W.partitionBy(label).orderBy(F.desc("score"), F.desc("count"), F.desc("marker")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def residual_features(tokens: DataFrame, key: str = "doc_id", token: str = "token", pieces: str = "pieces", top: int = 256) -> DataFrame:
    """(key, token, value, unit): each document's strongest compression residuals count * max(pieces - 1, 1/4), and their L2 normalised form.

    tokens: a row for each occurrence. Ties go to the larger token.
    """
    counted = tokens.groupBy(key, token).agg((F.count("*") * F.greatest(F.max(pieces) - 1, F.lit(0.25))).alias("value"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("value"), F.desc(token)))
    kept = counted.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(W.partitionBy(key)))
    return kept.withColumn("unit", F.round(F.col("value") / norm, 9))
