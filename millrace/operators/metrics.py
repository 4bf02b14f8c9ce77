"""Metrics: likelihood, bootstrap intervals, domain losses and reweighting, tensor statistics, curves.

Undefined ratios are null where the published rule says none, NaN where it says NaN, and 0 where it says 0; each docstring names its case.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import let


def likelihood(df: DataFrame, by: list[str], nats: str = "nll_sum_nats", tokens: str = "predicted_tokens", bytes_: str = "source_bytes") -> DataFrame:
    """Sums and nats per token, perplexity (null from 80 nats on), nats and bits per byte, at every level of by's roll-up.

    Records without a likelihood are left out. Zero denominators give null. level counts the rolled-up columns.
    """
    rows = df.where(F.col(nats).isNotNull())
    sums = [F.count("*").alias("documents"), F.sum(tokens).alias("tokens"), F.sum(bytes_).alias("bytes"), F.sum(nats).alias("nats")]
    out = rows.rollup(*by).agg(*sums, F.grouping_id().alias("level")) if by else rows.agg(*sums).withColumn("level", F.lit(0))
    per_token, per_byte = F.try_divide("nats", "tokens"), F.try_divide("nats", "bytes")
    return out.select(
        *by, "level", "documents", "tokens", "bytes", F.round("nats", 4).alias("nats"), F.round(per_token, 8).alias("nats_per_token"), F.when(per_token < 80, F.round(F.exp(per_token), 6)).alias("perplexity"),
        F.round(per_byte, 8).alias("nats_per_byte"), F.round(per_byte / math.log(2), 8).alias("bits_per_byte"),
    )


# The distribution function of the Poisson distribution with mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def bootstrap_ratio(df: DataFrame, key: str, top: str, bottom: str, replicates: int = 500, confidence: float = 0.95, seed: int = 17) -> DataFrame:
    """(replicates, low, high, estimate) of sum(top) / sum(bottom) by resampling documents.

    Each document weighs Poisson(1) in each replicate, from a hash of its key, so the result depends on no partitioning. Every partition sends
    one row of sums a replicate, whatever its size. Quantiles interpolate linearly. No replicates or no documents give no row;
    nulls count 0.
    """
    if replicates <= 0:
        return df.sparkSession.createDataFrame([], "replicates int, low double, high double, estimate double")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(replicates), np.zeros(replicates)
        steps = (np.arange(replicates, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                batch = whole.slice(i, 4096)
                z = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)[:, None] + steps[None, :]
                for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    z = (z ^ (z >> np.uint64(shift))) * np.uint64(mult)
                u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 9007199254740992.0
                weight = np.searchsorted(_POISSON, u.ravel(), "right").reshape(u.shape)
                a += batch.column(1).to_numpy(zero_copy_only=False) @ weight
                b += batch.column(2).to_numpy(zero_copy_only=False) @ weight
        yield pa.RecordBatch.from_pydict({"r": pa.array(np.arange(replicates)), "a": pa.array(a), "b": pa.array(b)})

    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    parts = df.select(F.xxhash64(F.lit(seed), key).alias("h"), number(top).alias("a"), number(bottom).alias("b")).mapInArrow(sums, "r bigint, a double, b double")
    ratios = parts.groupBy("r").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select(F.try_divide("a", "b").alias("x")).where("x IS NOT NULL")
    edge = (1 - confidence) / 2
    whole = df.agg(F.try_divide(F.sum(number(top)), F.sum(number(bottom))).alias("estimate"))
    out = ratios.agg(F.count("*").cast("int").alias("replicates"), F.percentile("x", edge).alias("low"), F.percentile("x", 1 - edge).alias("high")).where("replicates > 0")
    return out.crossJoin(F.broadcast(whole))  # one row


def domain_losses(df: DataFrame, domains: int, loss: str = "loss", domain: str = "domain", sequence: int = 1) -> DataFrame:
    """(domain, samples, loss) of every domain: summed loss over samples * sequence length; 0 for a domain without samples."""
    ids = df.sparkSession.range(domains).select(F.col("id").cast("int").alias(domain))
    per = df.groupBy(domain).agg(F.count("*").alias("samples"), F.sum(loss).alias("_sum"))
    out = ids.join(per, domain, "left")
    return out.select(domain, F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce(F.try_divide(F.col("_sum"), F.col("samples") * sequence), F.lit(0.0)).alias("loss"))


def reweighted(losses: DataFrame, weights: list[float], rate: float = 1.0, smoothing: float = 1e-3) -> DataFrame:
    """(domain, loss, weight, dro): weights raised by exp(rate * excess loss), normalised in log space and smoothed towards uniform;
    dro is the weighted loss. One row a domain, so its window is small. Negative excess counts 0."""
    base = F.get(F.array(*map(F.lit, weights)), F.col("domain"))
    excess = F.greatest(F.col("loss"), F.lit(0.0))
    logit = F.ln(base) + rate * excess
    w = W.partitionBy()
    shifted = losses.withColumn("_l", logit).withColumn("_m", F.max("_l").over(w))
    log_sum = F.col("_m") + F.ln(F.sum(F.exp(F.col("_l") - F.col("_m"))).over(w))
    out = shifted.withColumn("weight", (1 - smoothing) * F.exp(F.col("_l") - log_sum) + smoothing / len(weights))
    return out.select("domain", "loss", F.col("weight"), F.sum(F.col("weight") * excess).over(w).alias("dro"))


def tensor_statistics(df: DataFrame, by: str, value: str) -> DataFrame:
    """mean, std (sample), min, max, l1, l2, zero fraction (below 1e-10) and excess kurtosis by the sample deviation; with a deviation of 0
    or fewer than two values, std and kurtosis are 0. Nulls are left out."""
    x = F.col(value).cast("double")
    # central moments from a second pass over the same rows' mean would shuffle twice; the fourth power sum about the mean is algebraic
    sums = df.where(F.col(value).isNotNull()).groupBy(by).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.sum(F.abs(x)).alias("l1"), F.sqrt(F.sum(x * x)).alias("l2"), F.avg((F.abs(x) < 1e-10).cast("double")).alias("zeros"), F.kurtosis(x).alias("_k"), F.var_pop(x).alias("_v"),
    )
    fourth = (F.col("_k") + 3) * F.col("_v") * F.col("_v")
    kurtosis = F.when(F.coalesce(F.col("std"), F.lit(0.0)) == 0, 0.0).otherwise(fourth / F.pow("std", F.lit(4)) - 3)
    return sums.select(by, "n", "mean", F.when(F.isnan("std"), 0.0).otherwise(F.col("std")).alias("std"), "min", "max", "l1", "l2", "zeros", kurtosis.alias("kurtosis"))


def cross_entropy(df: DataFrame, by: str, logit: str, target: Column, z_weight: float = 1e-4, clamp: float = 20.0) -> DataFrame:
    """(by, loss, log_z, z_loss) from long-form logits: max-shifted log-sum-exp less the target's logit; z loss from the clamped log Z."""
    top = df.groupBy(by).agg(F.max(logit).alias("_m"))
    z = df.join(top, by).groupBy(by).agg((F.first("_m") + F.ln(F.sum(F.exp(F.col(logit) - F.col("_m"))))).alias("log_z"), F.sum(F.when(target, F.col(logit))).alias("_t"))
    bound = F.greatest(F.least("log_z", F.lit(clamp)), F.lit(-clamp))
    return z.select(by, (F.col("log_z") - F.col("_t")).alias("loss"), "log_z", (z_weight * bound * bound).alias("z_loss"))


def top_k_routing(values: Column, k: int) -> Column:
    """[{expert, weight}]: softmax in double precision, then the k largest, heaviest first; ties to the lowest expert."""
    raw = let(F.array_max(values), lambda top: F.transform(values, lambda v: F.exp(v.cast("double") - top)))
    share = let(raw, lambda r: let(F.aggregate(r, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(r, lambda v, i: F.struct((-v / total).alias("w"), i.alias("e")))))
    return F.transform(F.slice(F.array_sort(share), 1, k), lambda s: F.struct(s["e"].alias("expert"), (-s["w"]).alias("weight")))


def masked_mean(value: Column, mask: Column) -> Column:
    """Aggregate: mean of the values under the mask; NaN if nothing is."""
    total = F.sum(F.when(mask, value).otherwise(0.0))
    count = F.sum(mask.cast("int"))
    return F.when(count > 0, total / count).otherwise(F.lit(float("nan")))


def trailing_mean(value: Column, order: str, width: int, by: list[str] = []) -> Column:
    """Mean of the last `width` values, of fewer at the start. The window holds one run's curve."""
    return F.avg(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(-(width - 1), 0))


def human_format(x: Column) -> Column:
    """Three significant digits, rounded half to even, with K, M, B, T, P or E for thousands; numbers below 1 have no unit."""
    v = x.cast("double")
    most = F.when(F.abs(v) > 0, F.floor(F.log10(F.abs(v)) + 1e-12)).otherwise(0)  # of the leading digit
    digits = F.bround(F.when(most >= 2, v / F.pow(F.lit(10.0), most - 2)).otherwise(v * F.pow(F.lit(10.0), 2 - most)))
    value = F.when(most >= 2, digits * F.pow(F.lit(10.0), most - 2)).otherwise(digits / F.pow(F.lit(10.0), 2 - most))
    unit = F.least(F.greatest(F.floor(F.log10(F.greatest(F.abs(value), F.lit(1.0))) / 3 + 1e-12), F.lit(0)), F.lit(6)).cast("int")
    text = F.format_string("%.9f", value / F.pow(F.lit(1000.0), unit))
    return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.get(F.array(*map(F.lit, ["", "K", "M", "B", "T", "P", "E"])), unit))


def format_percent(x: Column) -> Column:
    return F.format_string("%+.2f%%", x * 100)


def _times(a: Column, b: Column) -> Column:
    """a * b mod 2^32 of whole numbers below 2^32, by halves, so that nothing leaves a bigint."""
    high = F.shiftleft(F.pmod(F.shiftright(a, 16) * b, F.lit(65536)), 16)
    return F.pmod(high + F.pmod(a, F.lit(65536)) * b, F.lit(2**32))


def worker_seed(worker: Column, rank: Column) -> Column:
    """2^(1 + worker) * 3^(1 + rank) mod 2^32, of any worker and rank from 0 on; null for null.

    The power of 3 is the product of 3^(2^k) over the bits k of its exponent.
    """
    powers = F.array(*[F.lit(2 ** (1 + k) % 2**32).cast("bigint") for k in range(32)])
    two = F.when(worker.isNotNull(), F.coalesce(F.get(powers, worker.cast("int")), F.lit(0)))  # 2^32 and beyond leave nothing
    squares = F.array(*[F.lit(pow(3, 2**k, 2**32)).cast("bigint") for k in range(32)])
    bits = F.transform(squares, lambda p, k: F.when(F.pmod(F.floor((1 + rank) / F.pow(F.lit(2.0), k)), F.lit(2)) == 1, p).otherwise(F.lit(1).cast("bigint")))
    three = F.when(rank.isNotNull(), F.aggregate(bits, F.lit(1).cast("bigint"), _times))
    return _times(two, three)


def padded_vocabulary(size: Column, parallel: int, multiple: int, rule: str = "lcm") -> Column:
    """size rounded up to a multiple of lcm(parallel, multiple), or of their product."""
    step = math.lcm(parallel, multiple) if rule == "lcm" else parallel * multiple
    return (F.ceil(size / step) * step).cast("bigint")


def storage_bytes(vocabulary: Column) -> Column:
    """Bytes of a stored token id: 2 up to a vocabulary of 65,535, else 4."""
    return F.when(vocabulary <= 65535, 2).otherwise(4)


def parameter_estimate(layers: Column, hidden: Column, vocabulary: Column, intermediate: Column, tied: bool = True) -> Column:
    """Weights of a decoder: embeddings, attention (4 h^2), gated feed-forward (3 h i) and two norms a layer, final norm."""
    return vocabulary * hidden * (1 if tied else 2) + layers * (4 * hidden * hidden + 3 * hidden * intermediate + 2 * hidden) + hidden


def flops_estimate(layers: Column, hidden: Column, heads: Column, kv_heads: Column, vocabulary: Column, length: Column, intermediate: Column, batch: int = 1) -> Column:
    """Floating-point operations of a training step of a decoder: two for each multiply-add, the backward pass twice the forward one.

    A layer projects to queries, keys and values, compares and mixes every two positions, projects back, and has a gated feed-forward; the
    vocabulary's projection comes once. Null kv_heads are as many as heads.
    """
    wide = heads * F.floor(hidden / heads)
    projections = hidden * (2 * wide + 2 * F.coalesce(kv_heads, heads) * F.floor(hidden / heads))
    layer = projections + 2 * length * wide + 3 * hidden * intermediate
    return 3 * 2 * batch * length * (layers * layer + hidden * vocabulary)


def prefix_averages(df: DataFrame, name: str, value: str, prefixes: list[str]) -> DataFrame:
    """(prefix, average) of the values whose name contains 'prefix:'; 0 without any."""
    wanted = df.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix string")
    keys = [F.when(F.col(name).contains(p + ":"), p) for p in prefixes]
    rows = df.select(F.explode(F.array_compact(F.array(*keys))).alias("prefix"), F.col(value).alias("v"))
    return wanted.join(rows.groupBy("prefix").agg(F.avg("v").alias("a")), "prefix", "left").select("prefix", F.coalesce("a", F.lit(0.0)).alias("average"))
