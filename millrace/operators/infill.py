"""Fill-in-the-middle permutation, sentence and block mappings, decoding samplers. Random draws come from hashes of the row's key."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _generator(seed: int, *key) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(":".join(map(str, (seed, *key))).encode()).digest()[:8], "little"))


def permute_segment(ids: list[int], prefix: int, middle: int, suffix: int, generator: np.random.Generator, spm_rate: float = 0.5) -> list[int]:
    """One document cut at two places: prefix suffix middle (PSM), or with the suffix first (SPM)."""
    a, b = sorted(generator.integers(0, len(ids) + 1, size=2).tolist())
    p, m, s = ids[:a], ids[a:b], ids[b:]
    if generator.random() < spm_rate:
        return [prefix, suffix, *s, middle, *p, *m]
    return [prefix, *p, suffix, *s, middle, *m]


def infilled(df: DataFrame, key: str, ids: str, eos: int, prefix: int, middle: int, suffix: int, pad: int, rate: float = 0.5, spm_rate: float = 0.5, seed: int = 17) -> DataFrame:
    """(key, input_ids): each sequence's documents (parted by eos) permuted with the given chance, cut or padded to the old length.

    A null sequence stays null, an empty one empty; the same key gives the same result on any cluster.
    """

    def one(k, row: list[int] | None) -> list[int] | None:
        if row is None:
            return None
        generator, out, own = _generator(seed, k), [], []
        for t in [*row, None]:
            if t is None or t == eos:
                out += permute_segment(own, prefix, middle, suffix, generator, spm_rate) if own and generator.random() < rate else own
                out += [eos] if t == eos else []
                own = []
            else:
                own.append(t)
        return (out + [pad] * len(row))[: len(row)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(k, r) for k, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.list_(pa.int32()))], names=[key, "input_ids"])

    return df.select(key, F.col(ids).cast("array<int>").alias(ids)).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, input_ids array<int>")


def sentence_spans(df: DataFrame, key: str, lengths: str, target: int, short_rate: float = 0.1, least: int = 2, most_tokens: int = 512, seed: int = 17, reserve: int = 0) -> DataFrame:
    """(key, span, first, last, tokens, target): runs of successive sentences of about `target` tokens less `reserve` (a title, say).

    Documents with fewer than `least` sentences or one of more than most_tokens give none; some spans aim lower, by hash. A span closes
    once it reaches its aim and at least `least` sentences are in it and left, or at the document's end.
    """

    def one(k, sizes: list[int] | None) -> list[tuple]:
        if not sizes or len(sizes) < least or max(sizes) > most_tokens:
            return []
        generator, out, first, held = _generator(seed, k), [], 0, 0
        aim = lambda: max(1, (int(generator.integers(2, max(3, target))) if generator.random() < short_rate else target) - reserve)
        now = aim()
        for i, n in enumerate(sizes):
            held += n
            if (held >= now and i + 1 - first >= least and len(sizes) - i - 1 >= least) or i == len(sizes) - 1:
                out.append((len(out), first, i + 1, held, now))
                first, held, now = i + 1, 0, aim()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *s) for i, (k, z) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())) for s in one(k, z)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], type=pa.int64())), *(pa.array([r[c] for r in rows], type=pa.int32()) for c in range(1, 6))], names=[key, "span", "first", "last", "tokens", "target"])

    return df.select(key, lengths).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, span int, first int, last int, tokens int, target int")


def nucleus(df: DataFrame, by: str, item: str, logit: str, top_p: float = 0.9, top_k: int | None = None) -> DataFrame:
    """(by, item, probability): the tokens a sampler may draw, after top-k and then top-p, renormalised; ties to the lowest item.

    Top-p drops the least likely tokens whose cumulative probability, from below, is at most 1 - p. The most likely always stays.
    """
    w = W.partitionBy(by)
    order = w.orderBy(F.desc(logit), item)
    rows = df.withColumn("_r", F.row_number().over(order))
    rows = rows.where(F.col("_r") <= top_k) if top_k else rows
    e = F.exp(F.col(logit) - F.max(logit).over(w))
    rows = rows.withColumn("_p", e / F.sum(e).over(w))
    below = F.sum("_p").over(w.orderBy(logit, F.desc(item)).rowsBetween(W.unboundedPreceding, 0))
    kept = rows.withColumn("_c", below).where((F.col("_c") > 1 - top_p) | (F.col("_r") == 1))
    return kept.select(by, item, (F.col("_p") / F.sum("_p").over(w)).alias("probability"))


def drawn(df: DataFrame, by: str, item: str, probability: str, seed: int = 17) -> DataFrame:
    """(by, item): one item drawn for each group with its probability, by the smallest -ln(u) / p over hashed u."""
    u = (F.xxhash64(F.lit(seed), by, item).bitwiseAND(F.lit(0xFFFFFFFFFFFF)) + 1) / (2.0**48 + 1)
    return df.where(F.col(probability) > 0).groupBy(by).agg(F.min_by(item, -F.ln(u) / F.col(probability)).alias(item))
