"""Token budgets: each distinct text is tokenized once, exact counts are joined back to the records by the text's hash and totalled by slice."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import budget_tokens, clean_lang
from millrace.llm.bpe import TOKENIZER_DIR, count_column, worker_encoder


def _counted(texts: DataFrame, vocabulary: str | None, folder: str) -> DataFrame:
    """(h, tokens) of (h, text)."""
    if vocabulary is None:
        return texts.select("h", budget_tokens("text").alias("tokens"))
    path = f"{folder}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count_column(part.column(1), encoder))], names=["h", "tokens"])

    return texts.select("h", "text").mapInArrow(run, "h string, tokens bigint")


def record_tokens(records: DataFrame, keys: list[str], by: list[str], key: str = "doc_id", text: str = "text", vocabulary: str | None = None, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(*by, h, records, tokens): for each slice and distinct text, how many records hold it and the tokens of one.

    Each text is shuffled once, copies being combined on the map side, and tokenized once. keys are the columns of a record's key:
    records written again count once. A null text has 0 tokens.
    """
    marked = records.withColumn("h", F.md5(text))
    once = marked.groupBy(*keys).agg(*(F.first(c).alias(c) for c in [*by, "h"] if c not in keys))
    slices = once.groupBy(*by, "h").agg(F.count("*").alias("records"))
    texts = marked.where("h IS NOT NULL").groupBy("h").agg(F.first(text).alias("text"))
    return slices.join(_counted(texts, vocabulary, folder), "h", "left").select(*by, "h", "records", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def slice_totals(records: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", domain: str = "domain", vocabulary: str | None = None, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(source, lang, domain, records, distinct_texts, tokens) of every slice; lang is cleaned.

    Null fields make slices of their own; a null text counts as a record without tokens and as no distinct text; empty and
    blank texts have none of the budget tokenizer's tokens; records written again count once by their key (records with a
    null key are one record); an empty table gives no rows; columns of other names are ignored.
    """
    named = records.select(records[key].alias("key"), records[text].alias("text"), records[source].alias("source"), clean_lang(records[lang]).alias("lang"), records[domain].alias("domain"))
    by = ["source", "lang", "domain"]
    rows = record_tokens(named, ["key"], by, "key", "text", vocabulary, folder)
    return rows.groupBy(*by).agg(F.sum("records").alias("records"), F.count("h").alias("distinct_texts"), F.sum(F.col("records") * F.col("tokens")).alias("tokens"))


def slice_shortfalls(totals: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets with tokens, reached_ppm and short: whether the slice holds fewer tokens per million of all tokens than requested.

    A slice that no record falls in, or with a null field, holds 0 tokens. A null request is never short. With no tokens at all nothing is
    short. The totals join the budgets after aggregation, so a source with a third of all rows is one row here.
    """
    fields = ["source", "lang", "domain"]
    total = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    have = totals.select(*fields, "tokens").where(" AND ".join(f"{f} IS NOT NULL" for f in fields))
    joined = budgets.select(*fields, "requested_ppm").join(have, fields, "left").crossJoin(F.broadcast(total))  # one row
    tokens = F.coalesce("tokens", F.lit(0)).cast("decimal(38,0)")
    short = tokens * 1000000 < F.col("requested_ppm").cast("decimal(38,0)") * F.col("all_tokens")
    return joined.select(*fields, "requested_ppm", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.try_divide(tokens.cast("double") * 1000000, F.col("all_tokens")).alias("reached_ppm"), F.coalesce(short, F.lit(False)).alias("short"))


def stage_consumption(stages: DataFrame) -> DataFrame:
    """(tokenizer_id, consumed): tokens consumed per tokenizer over all runs and stages.

    Counters are cumulative inside a stage, so each tokenizer's latest counter of a stage counts (by last step, then save time, then id),
    also where the stage's later checkpoints leave it out or have it null; repeated rows don't matter. Null and empty maps, null
    counters, and keys that are no number, add nothing.
    """
    each = stages.select("run_name", "name", "start_training_step", F.struct("last_train_step", "saved_at", "checkpoint_id").alias("at"), F.explode("consumed_tokens_per_tokenizer").alias("k", "v"))
    last = each.where("v IS NOT NULL").groupBy("run_name", "name", "start_training_step", "k").agg(F.max_by("v", "at").alias("v"))
    pairs = last.select(F.expr("try_cast(k AS bigint)").alias("tokenizer_id"), "v")
    return pairs.where("tokenizer_id IS NOT NULL").groupBy("tokenizer_id").agg(F.sum("v").alias("consumed"))


def tokenizer_budget(records: DataFrame, routes: DataFrame, stages: DataFrame, registry: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(tokenizer_id, scored, tokens, consumed, epochs): exact tokens of the evaluation texts that each tokenizer's endpoint scored,
    against the tokens that its training consumed; epochs = consumed / tokens, null without tokens.

    Routes count once per (run, document); null endpoints are left out; every registered tokenizer has a row.
    """
    named = records.select(records["doc_id"].alias("key"), records["text"].alias("text"))
    each = record_tokens(named, ["key"], ["key"], "key", "text", vocabulary, folder).select(F.col("key").alias("doc_id"), "tokens")
    once = routes.where("endpoint_id IS NOT NULL").select("run_name", "doc_id", "endpoint_id").distinct()
    per_doc = once.groupBy("doc_id", "endpoint_id").agg(F.count("*").alias("n"))
    supply = per_doc.join(each, "doc_id").groupBy(F.col("endpoint_id").cast("bigint").alias("tokenizer_id")).agg(F.sum("n").alias("scored"), F.sum(F.col("n") * F.col("tokens")).alias("tokens"))
    ids = registry.select(F.col("id").cast("bigint").alias("tokenizer_id"))
    out = ids.join(supply, "tokenizer_id", "left").join(stage_consumption(stages), "tokenizer_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("tokenizer_id", zero("scored"), zero("tokens"), zero("consumed"), F.round(F.try_divide(F.coalesce("consumed", F.lit(0)).cast("double"), F.col("tokens")), 6).alias("epochs"))
