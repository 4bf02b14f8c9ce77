"""Folders of discovery runs: their reports written, and read back with checks.

A run has sample (JSON lines), assignments (CSV), responsibilities (Parquet), summary.json and tokenizers/expert_NN/tokenizer.json.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.files import exists, filesystem, read_text_file, write_text_file

# The columns of the assignments, in this order.
ASSIGNMENTS = ["doc_id", "source", "expert_id", "raw_bytes", "budget_tokens", "expert_tokens"]


def write_run(folder: str, documents: DataFrame, experts: list[str], summary: dict) -> dict:
    """Write a run's reports; returns the summary with its totals.

    documents: (doc_id, text, source, raw_bytes, budget_tokens, expert_id, costs, weights). summary: fields of the run itself (objective, converged,
    settings). Totals by source and expert are added. Existing files of the run are replaced.
    """
    tokens = F.coalesce(F.get("costs", F.col("expert_id")), F.lit(0))
    rows = documents.withColumn("expert_tokens", tokens)
    rows.select("doc_id", "text", "raw_bytes", "budget_tokens").write.mode("overwrite").json(f"{folder}/sample")
    rows.select(*ASSIGNMENTS).write.mode("overwrite").option("header", "true").csv(f"{folder}/assignments")
    rows.select("doc_id", F.col("weights").cast("array<float>").alias("responsibilities"), F.col("expert_id").cast("bigint").alias("hard_label")).write.mode("overwrite").parquet(f"{folder}/responsibilities")
    sizes = [F.count("*").alias("documents"), F.sum("budget_tokens").alias("budget_tokens"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("expert_tokens").alias("expert_tokens")]
    by_source = [r.asDict() for r in rows.groupBy("source").agg(*sizes).orderBy("source").collect()]  # a row a source
    by_expert = [r.asDict() for r in rows.groupBy("expert_id").agg(*sizes).orderBy("expert_id").collect()]  # a row an expert
    for r in by_expert:
        r["bytes_per_token"] = r["raw_bytes"] / max(r["expert_tokens"], 1)
    total = {f"sample_{k}": sum(r[k] for r in by_expert) for k in ("documents", "budget_tokens", "raw_bytes")}
    whole = {"sources": by_source, **total, "active_experts": len(experts), **summary, "experts": by_expert}
    for k, text in enumerate(experts):
        system, at = filesystem(f"{folder}/tokenizers/expert_{k:02d}")
        system.create_dir(at, recursive=True)
        write_text_file(f"{folder}/tokenizers/expert_{k:02d}/tokenizer.json", text)
    write_text_file(f"{folder}/summary.json", json.dumps(whole, indent=2, ensure_ascii=False) + "\n")
    return whole


def read_sample(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text, raw_bytes, budget_tokens) of a run's sample; fails if it isn't there or empty. Blank lines are passed over."""
    if not exists(f"{folder}/sample"):
        raise FileNotFoundError(f"{folder} has no sample")
    rows = spark.read.schema("doc_id bigint, text string, raw_bytes bigint, budget_tokens bigint").option("mode", "FAILFAST").json(f"{folder}/sample")
    if not rows.limit(1).count():
        raise ValueError(f"{folder} has an empty sample")
    return rows


def read_labels(spark: SparkSession, folder: str, documents: DataFrame) -> DataFrame:
    """(doc_id, expert_id) of all documents (doc_id); fails with up to 10 ids if some have no row in the assignments, or if rows have no document."""
    if not exists(f"{folder}/assignments"):
        raise FileNotFoundError(f"{folder} has no assignments")
    found = spark.read.schema("doc_id bigint, source string, expert_id int, raw_bytes bigint, budget_tokens bigint, expert_tokens bigint").option("header", "true").csv(f"{folder}/assignments").select("doc_id", "expert_id")
    both = documents.select(F.col("doc_id").alias("_d")).join(found, F.col("_d") == F.col("doc_id"), "full")
    faults = both.where("doc_id IS NULL OR _d IS NULL OR expert_id IS NULL OR expert_id < 0").select(F.coalesce("_d", "doc_id").alias("id"), F.col("_d").isNull().alias("unknown")).orderBy("id").limit(10).collect()
    if faults:
        kind = "unexpected" if any(r.unknown for r in faults) else "missing"
        raise ValueError(f"{kind} assignments for documents {[r.id for r in faults]}")
    return found


def read_experts(folder: str) -> list[str]:
    """The tokenizers of a run as JSON, in order of their folders' names; fails if there is none."""
    from pyarrow import fs

    system, at = filesystem(f"{folder}/tokenizers")
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    paths = sorted(f"{folder}/tokenizers/{f.base_name}/tokenizer.json" for f in found if f.base_name.startswith("expert_"))
    paths = [p for p in paths if exists(p)]
    if not paths:
        raise FileNotFoundError(f"{folder} has no tokenizers")
    return [read_text_file(p) for p in paths]
