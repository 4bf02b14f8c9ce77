"""Blending of datasets: sample orders by weights, their closed forms, split boundaries and consumption."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def normalized(weights: list[float]) -> list[float]:
    total = sum(weights)
    if total <= 0 or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative and must have a positive sum")
    return [w / total for w in weights]


def blend_index(spark: SparkSession, weights: list[float], samples: int, lengths: list[int] | None = None) -> DataFrame:
    """(i, dataset, sample): the dataset furthest behind its share at each step, and its running sample (modulo its length, if given).

    Step i takes the dataset with the greatest weight * max(i, 1) - taken, the first of equals. The fold's state is a count for each dataset and
    its rows are numbers only, so one task streams it; the samples are joined to it afterwards.
    """
    share = normalized(weights)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = [0] * len(share)
        for batch in batches:
            data, sample = [], []
            for i in batch.column(0).to_pylist():
                at = max(i, 1.0)
                best = max(range(len(share)), key=lambda d: (share[d] * at - taken[d], -d))
                data.append(best)
                sample.append(taken[best] % lengths[best] if lengths else taken[best])
                taken[best] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, type=pa.int32()), pa.array(sample, type=pa.int64())], names=["i", "dataset", "sample"])

    return spark.range(0, samples, 1, 1).withColumnRenamed("id", "i").mapInArrow(fold, "i bigint, dataset int, sample bigint")


def binned_blend(i: Column, bin_of: list[int], sizes: list[int], bias: list[int], lengths: list[int]) -> tuple[Column, Column]:
    """(dataset, sample) of step i without an index: bin i mod B belongs to a dataset, which is read on by its bins' number each round.

    bin_of has the dataset of each bin, sizes the number of bins of each dataset, bias a dataset's first sample.
    """
    bins = len(bin_of)
    first = [bin_of.index(d) if d in bin_of else 0 for d in range(len(sizes))]
    k = F.pmod(i, F.lit(bins)).cast("int")
    dataset = F.get(F.array(*map(F.lit, bin_of)), k)
    pick = lambda v: F.get(F.array(*[F.lit(x).cast("bigint") for x in v]), dataset)
    sample = F.pmod(pick(bias) + F.floor(i / bins) * pick(sizes) + (k - pick(first)), pick(lengths))
    return dataset, sample


def bins_by_weight(weights: list[float], bins: int) -> list[int]:
    """Dataset of each bin: int(weight * bins) bins each, the remainder to the last."""
    share = normalized(weights)
    sizes = [int(w * bins) for w in share]
    sizes[-1] += bins - sum(sizes)
    return [d for d, n in enumerate(sizes) for _ in range(n)]


def split_boundaries(splits: str, size: int) -> list[int]:
    """0 and the ends of train, validation and test, from three shares 'a,b,c' or 'a/b/c' of size rounded half to even; what the
    roundings overshoot or leave is taken from or given to every end."""
    shares = np.array(re.split("[,/]", splits), dtype=float)
    if len(shares) != 3 or shares.sum() <= 0 or (shares < 0).any():
        raise ValueError("splits must be three shares with a positive sum")
    ends = np.rint(shares / shares.sum() * size).astype(int).cumsum()
    return [0, *(ends + size - ends[-1]).tolist()]


def split_columns(size: Column, parts: tuple[float, float, float]) -> list[Column]:
    """split_boundaries of a column of sizes."""
    total = sum(parts)
    at = [F.lit(0).cast("bigint")]
    for p in parts:
        at.append(at[-1] + F.bround(size * (p / total)).cast("bigint"))
    over = at[-1] - size
    return [at[0]] + [x - over for x in at[1:]]


def overprovisioned(samples: Column, weight: Column, margin: float = 1.005) -> Column:
    return F.ceil(samples * weight * margin)


def largest_remainder(df: DataFrame, weight: str, total: int, order: str) -> DataFrame:
    """df with count: floor(weight share * total), one more for the largest fractions (ties to the first in order), summing to total."""
    w = W.partitionBy()
    exact = F.col(weight) / F.sum(weight).over(w) * total
    out = df.withColumn("_x", exact).withColumn("_f", F.floor("_x"))
    out = out.withColumn("_r", F.row_number().over(W.orderBy(F.desc(F.round(F.col("_x") - F.col("_f"), 9)), order)))
    more = F.col("_r") <= F.lit(total) - F.sum("_f").over(w)
    return out.withColumn("count", F.col("_f") + more.cast("bigint")).drop("_x", "_f", "_r")


def epoch_index(items: DataFrame, key: str, epochs: int, seed: int) -> DataFrame:
    """(epoch, key, shuffle): every item once an epoch, with the digest that orders it; order by (epoch, shuffle, key).

    Digests rather than a generator's permutation, so any part of the order can be had anywhere.
    """
    e = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")
    return items.select(key, e).select("epoch", key, F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("epoch"), F.col(key)), 256).alias("shuffle"))


def document_index(items: DataFrame, key: str, epochs: int, separate: bool, seed: int) -> DataFrame:
    """(position, key): every item `epochs` times, in the order of a digest of seed, part and epoch; if separate, the last epoch is shuffled on its own,
    after the others. An item's copies of the first part stand anywhere in it."""
    from millrace.operators.hotkeys import ranked

    rows = items.select(key, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("_e"))
    part = (F.col("_e") == epochs - 1).cast("int") if separate and epochs > 1 else F.lit(0)
    rows = rows.withColumn("_part", part).withColumn("_turn", F.sha2(F.concat_ws(":", F.lit(str(seed)), "_part", "_e", F.col(key).cast("string")), 256))
    return ranked(rows.withColumn("_all", F.lit(0)), "_all", ["_part", "_turn", key]).select((F.col("position") - 1).cast("bigint").alias("position"), key)


def needed_per_dataset(steps: int, batch: int, weights: list[float]) -> list[int]:
    return [int(steps * batch * w) for w in normalized(weights)]


def last_epoch_separate(per_epoch: int, samples: int, threshold: float = 0.8) -> bool:
    """Whether the last epoch, being used less than the threshold, is shuffled on its own."""
    if per_epoch <= 0:
        raise ValueError("an epoch must have samples")
    rest = samples - (math.ceil(samples / per_epoch) - 1) * per_epoch
    return rest < threshold * per_epoch
