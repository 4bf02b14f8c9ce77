"""Corpus curation: filters, hash splits, quotas, exclusion, held-out collection, shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import BUDGET_TOKEN, SPACE_RUN, budget_tokens, byte_length, col, strip
from millrace.operators.prefix import running_before
from millrace.session import stored

# Defaults of the published runs.
SALT, MIN_BYTES, EVAL_FRACTION = "dclm-stack-v1", 128, 0.01
_TWO64 = 18446744073709551616.0


def text_of(df: DataFrame, field: str = "text", fallback: str = "content") -> Column:
    """The stripped text: `field`, or `fallback` where it is null and the field is the default one. Null if neither is there."""
    names = [c for c in ([field, fallback] if field == "text" else [field]) if c in df.columns]
    return strip(F.coalesce(*[df[c] for c in names])) if names else F.lit(None).cast("string")


def long_enough(text: Column | str, least: int = MIN_BYTES) -> Column:
    """Whether the stripped text has that many UTF-8 bytes; null is not."""
    return F.coalesce(byte_length(strip(text)) >= least, F.lit(False))


def document_id(source: Column | str, text: Column | str, salt: str = SALT) -> Column:
    """SHA-256 of salt, source and stripped text with zero bytes between; null if either is null."""
    return F.sha2(F.concat(F.lit(salt), F.lit("\0"), col(source), F.lit("\0"), strip(text)), 256)


def unit_interval(digest: Column | str) -> Column:
    """A hexadecimal digest's first 64 bits as a number in [0, 1)."""
    return F.conv(F.substring(col(digest), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / _TWO64


def partition_of(digest: Column | str, eval_fraction: float = EVAL_FRACTION) -> Column:
    return F.when(unit_interval(digest) < eval_fraction, "eval").otherwise("train")


def split_documents(df: DataFrame, eval_fraction: float = EVAL_FRACTION, salt: str = SALT, least: int = MIN_BYTES) -> DataFrame:
    """df's long enough rows with document_id and partition; the filter comes before the hash, the hash before any tokenizing.

    Null texts and sources, empty and short texts drop out; equal texts of one source share an id and so a partition.
    """
    kept = df.where(long_enough(df["text"], least) & df["source"].isNotNull())
    return kept.withColumn("document_id", document_id("source", "text", salt)).withColumn("partition", partition_of("document_id", eval_fraction))


def quota_cut(df: DataFrame, group: list[str], tokens: str, quota: int, order: list[str], bucket: Column) -> DataFrame:
    """Each group's prefix, in its order, up to `quota` tokens: df with `kept`, the tokens kept of each row; the boundary row is clipped.

    Buckets wholly beyond the quota drop out before any row is ordered. Rows with null or no tokens never come out.
    """
    ran = running_before(df.where(F.col(tokens) > 0), group, bucket, order, tokens, "_before")
    return ran.where(F.col("_before") < quota).withColumn("kept", F.least(F.col(tokens), F.lit(quota) - F.col("_before"))).drop("_before")


def source_quotas(sources: DataFrame, total: int) -> DataFrame:
    """(source, weight, quota): int(total * weight / sum), the remainder to the last source by name; null weights count 0."""
    w = W.partitionBy()
    share = sources.select("source", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    share = share.withColumn("quota", F.floor(F.lit(total) * F.col("weight") / F.sum("weight").over(w)).cast("bigint"))
    last = F.col("source") == F.max("source").over(w)
    return share.withColumn("quota", F.when(last, F.col("quota") + total - F.sum("quota").over(w)).otherwise(F.col("quota")))


def interleaved(df: DataFrame, order: str, batch: int = 1) -> DataFrame:
    """df with `turn` and `place`: sources take turns of `batch` rows in order of a whole number, so the global order is (turn, source, place)."""
    ran = running_before(df.withColumn("_one", F.lit(1)), ["source"], order, [order], "_one", "place")
    return ran.withColumn("place", F.col("place").cast("bigint")).withColumn("turn", F.floor(F.col("place") / batch)).drop("_one")


def truncate_tokens(text: Column | str, budget: int) -> Column:
    """The longest prefix of at most `budget` budget-tokenizer tokens, without white space at the end.

    Between tokens there is only white space, so the prefix is a closed form of the pattern. Null gives null, a short text itself
    (stripped), an empty text the empty text.
    """
    return strip(F.regexp_extract(strip(text), rf"^(?:(?:{SPACE_RUN})?(?:{BUDGET_TOKEN})){{0,{budget}}}", 0))


def truncated(df: DataFrame, text: str, budget: str, key: str) -> DataFrame:
    """(key, text) cut to each row's own budget, in Arrow batches; for budgets that differ by row or are large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        token = re.compile(r"\w+|[^\w\s]")
        for batch in batches:
            out = []
            for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                end = None
                if t is not None and n is not None:
                    for i, m in enumerate(token.finditer(t)):
                        if i == n:
                            end = m.start()
                            break
                out.append(None if t is None else t[:end].strip())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.string())], names=[key, text])

    return df.select(key, text, budget).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, `{text}` string")


def truncate_utf8(text: Column | str, most: Column | int) -> Column:
    """The longest prefix of at most `most` UTF-8 bytes; a character cut in two is dropped. Null gives null."""
    n = F.lit(most) if isinstance(most, int) else most
    raw = F.encode(col(text), "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(raw, F.lit(1), F.greatest(n - k, F.lit(0))).cast("string")) for k in range(4)]
    return F.when(byte_length(text) <= n, col(text)).otherwise(F.coalesce(*cuts))


def preview(text: Column | str, characters: int = 240) -> Column:
    """White space runs as single spaces, the first `characters` characters."""
    return F.substring(strip(F.regexp_replace(col(text), SPACE_RUN, " ")), 1, characters)


def held_out(df: DataFrame, training: DataFrame, budget: int, key: str = "doc_id", least: int = MIN_BYTES) -> DataFrame:
    """(source, key, digest, text): the first texts of each source, by key, up to `budget` bytes, that training doesn't hold.

    Texts are stripped; short ones, those whose digest is in training, and repeats inside a source (the smallest key stays) drop out. The text that
    crosses the budget is cut to it and stays only if it is still long enough. Nulls drop out; empty tables give an empty result.
    """
    rows = df.select(df[key].alias(key), df["source"].alias("source"), strip(df["text"]).alias("text")).where(f"octet_length(text) >= {least} AND source IS NOT NULL AND `{key}` IS NOT NULL")
    rows = rows.withColumn("digest", F.sha2("text", 256))
    seen = training.select(F.sha2(strip(training["text"]), 256).alias("digest")).where("digest IS NOT NULL").distinct()
    first = rows.groupBy("source", "digest").agg(F.min(key).alias(key), F.first(byte_length("text")).alias("bytes"))
    fresh = stored(first.join(seen, "digest", "left_anti"), "fresh")  # read twice; without texts
    ran = running_before(fresh, ["source"], key, [key], "bytes").where(F.col("before") < budget)
    cut = ran.select("source", key, "digest", (F.lit(budget) - F.col("before")).alias("room"))
    texts = rows.select(F.col(key).alias("_k"), F.col("source").alias("_s"), F.col("digest").alias("_d"), "text").dropDuplicates(["_k", "_s", "_d"])
    out = cut.join(texts, (F.col(key) == F.col("_k")) & (F.col("source") == F.col("_s")) & (F.col("digest") == F.col("_d")))
    return out.withColumn("text", truncate_utf8("text", F.col("room").cast("int"))).where(F.octet_length("text") >= least).select("source", key, "digest", "text")


def fill_shards(df: DataFrame, order: str, count: str, budget: int) -> DataFrame:
    """(order, count, shard): next-fit shards in order; a row opens a new shard iff the shard holds something and would overflow.

    Inherently sequential: one task folds over (order, count) alone, 16 bytes a row, in streamed batches; texts never pass through it. A row
    larger than the budget gets a shard of its own; null counts count 0.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = 0, 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            upto = np.cumsum(n)
            out, at = np.empty(len(n), dtype=np.int64), 0
            while at < len(n):
                # rows up to `end` fit; the next one opens a shard, or has this one to itself if it holds nothing
                done = upto[at - 1] if at else 0
                end = int(np.searchsorted(upto, budget - held + done, "right"))
                if end <= at and held == 0:
                    end = at + 1
                end = max(end, at)
                out[at:end] = shard
                held += int(upto[end - 1] - done) if end > at else 0
                at = end
                if at < len(n) and held > 0:
                    shard, held = shard + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=[order, count, "shard"])

    pairs = df.select(F.col(order).cast("bigint").alias(order), F.coalesce(F.col(count), F.lit(0)).cast("bigint").alias(count))
    return pairs.repartition(1).sortWithinPartitions(order).mapInArrow(fold, f"`{order}` bigint, `{count}` bigint, shard bigint")


def source_summary(df: DataFrame) -> DataFrame:
    """(source, documents, tokens, bytes) of the texts of each source; null texts count as documents only."""
    return df.groupBy("source").agg(F.count("*").alias("documents"), F.coalesce(F.sum(budget_tokens("text")), F.lit(0)).alias("tokens"), F.coalesce(F.sum(byte_length("text")), F.lit(0)).alias("bytes"))


def first_fraction(df: DataFrame, group: str, order: str, fraction: float) -> DataFrame:
    """The first int(fraction * n) rows of each group in order; a negative fraction is an error."""
    if fraction < 0:
        raise ValueError("fraction must not be negative")
    sizes = df.groupBy(group).agg(F.count("*").alias("_n")).withColumnRenamed(group, "_g")
    ran = running_before(df.withColumn("_one", F.lit(1)), [group], order, [order], "_one", "_rank")
    return ran.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).where(F.col("_rank") < F.floor(F.col("_n") * fraction)).drop("_one", "_rank", "_n", "_g")


def budget_prefix(df: DataFrame, group: list[str], order: str, amount: str, budget: int) -> DataFrame:
    """Each group's rows before the first that would exceed the budget; that row ends the group, it isn't skipped."""
    ran = running_before(df, group, order, [order], amount)
    return ran.where(F.col("before") + F.coalesce(F.col(amount), F.lit(0)) <= budget).drop("before")


def batch_shards(position: Column, batch: int, limit: int) -> Column:
    """Shard of the row at a position (from 0) when shards are closed between batches only, once they hold `limit` rows or more."""
    per = -(-limit // batch)
    return F.floor(F.floor(position / batch) / per)
