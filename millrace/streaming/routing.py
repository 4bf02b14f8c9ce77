"""Streams: JSON-lines shards routed as they arrive, running deduplication, the deficit schedule as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.routing import native_costs, route
from millrace.operators.schedule import DeficitSchedule


def read_shards(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of the JSON-lines files that appear in a folder."""
    return spark.readStream.schema("text string, source_document_index bigint").option("maxFilesPerTrigger", files_per_batch).json(path)


def routed_stream(rows: DataFrame) -> DataFrame:
    """Rows with tokenizer_id, the cheapest native expert; null texts are dropped."""
    return rows.where("text IS NOT NULL").withColumn("tokenizer_id", route(native_costs("text")))


def route_shards(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 16) -> StreamingQuery:
    """Route the files there are and stop. Started again with the same checkpoint it takes only new files; a batch that ran
    twice replaces its own folder, so no row comes twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("tokenizer_id").json(f"{target}/batch={number}")

    stream = routed_stream(read_shards(spark, source, files_per_batch))
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(rows: DataFrame, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """A stream without repeats of a text's digest; with a time column, digests older than the delay are forgotten."""
    marked = rows.where("text IS NOT NULL").withColumn("digest", F.sha2("text", 256))
    if time:
        return marked.withWatermark(time, delay).dropDuplicatesWithinWatermark(["digest"])
    return marked.dropDuplicates(["digest"])


def scheduled_stream(steps: DataFrame, weights: list[float], seed: int) -> DataFrame:
    """(run_name, step, tokenizer_id): each run's coming steps scheduled by weighted deficits, which are the stream's state.

    steps: a stream of (run_name, requests): how many steps a run asks for. Null requests ask for none.
    """

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = DeficitSchedule(weights, seed)
        if state.exists:
            step, *deficits = state.get
            own.step, own.deficits = int(step), list(deficits)
        for batch in batches:
            n = int(batch["requests"].fillna(0).sum())
            first = own.step
            chosen = own.take(n)
            if n:
                yield pd.DataFrame({"run_name": key[0], "step": range(first, first + n), "tokenizer_id": chosen})
        state.update((own.step, *own.deficits))

    state = "step bigint, " + ", ".join(f"d{i} double" for i in range(len(weights)))
    return steps.groupBy("run_name").applyInPandasWithState(fold, "run_name string, step bigint, tokenizer_id int", state, "append", "NoTimeout")


def event_totals(events: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Consumption per window and type of a stream of events (ts, event_type, value), late rows within the delay counted."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
