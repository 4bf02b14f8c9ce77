"""Writers: JSON lines, sharded and partitioned tables, token streams, manifests, reports. Spark's commit protocol makes each write atomic."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.files import filesystem, read_text_file, write_text_file


def write_jsonl(df: DataFrame, path: str, compression: str | None = None) -> None:
    """One JSON object a row; non-ASCII characters as they are, null fields left out."""
    df.write.option("compression", compression or "none").json(path)


def write_shards(df: DataFrame, path: str, shard: str = "shard", form: str = "parquet") -> None:
    """A folder for each shard; rows of a shard are brought together first, so a shard is one file however many tasks there are."""
    df.repartition(shard).write.partitionBy(shard).format(form).save(path)


def write_curated(df: DataFrame, path: str) -> None:
    """Curated records by partition and source; existing partitions are replaced only where df has rows."""
    df.write.partitionBy("partition", "source").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_token_files(sequences: DataFrame, path: str, group: str, ids: str = "input_ids", token_bytes: int = 2, per_file: int = 1024) -> DataFrame:
    """(group, file, sequences, tokens) of the little-endian token files written below a path on storage that all executors reach: path/group/file.ds.

    sequences: (group, seq_id, ids). A file holds per_file successive sequences and is written by one task under a temporary name, then renamed;
    a task that runs again writes the same bytes.
    """
    kind = "<u2" if token_bytes == 2 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle, now, name, count, tokens, kind_of_group = None, None, "", 0, 0, None
        system, root = filesystem(path)

        def done():
            handle.close()
            system.move(name + suffix, name)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], type=kind_of_group), pa.array([now[1]]), pa.array([count]), pa.array([tokens])], names=[group, "file", "sequences", "tokens"])

        suffix = f".{TaskContext.get().taskAttemptId()}.tmp"
        for batch in batches:
            kind_of_group = batch.schema.field(0).type
            for g, f, row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (g, f) != now:
                    if handle:
                        yield done()
                    now, count, tokens = (g, f), 0, 0
                    system.create_dir(f"{root}/{g}", recursive=True)
                    name = f"{root}/{g}/{f:05d}.ds"
                    handle = system.open_output_stream(name + suffix)
                handle.write(np.asarray(row, dtype=kind).tobytes())
                count, tokens = count + 1, tokens + len(row)
        if handle:
            yield done()

    files = sequences.withColumn("file", F.floor(F.col("seq_id") / per_file)).select(group, "file", ids, "seq_id")
    placed = files.repartition(group, "file").sortWithinPartitions(group, "file", "seq_id").select(group, "file", ids)
    return placed.mapInArrow(write, f"`{group}` {dict(files.dtypes)[group]}, file bigint, sequences bigint, tokens bigint")


def write_indexed_parts(df: DataFrame, path: str, key: str, ids: str, token_bytes: int = 4, per_file: int = 100_000) -> DataFrame:
    """(part, documents, tokens) of the indexed token files written below path, part-00000.bin and .idx and so on, in order of key.

    Each part is written by one task, which streams its documents and keeps their sizes only; about per_file documents make a part. Null ids are an
    empty document. read_indexed reads a part.
    """
    from millrace.sources.readers import index_bytes

    kind = "uint16" if token_bytes == 2 else "int32"
    parts = max(1, -(-df.count() // per_file))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sizes = TaskContext.get().partitionId(), []
        system, root = filesystem(path)
        system.create_dir(root, recursive=True)
        name, suffix = f"{root}/part-{part:05d}", f".{TaskContext.get().taskAttemptId()}.tmp"
        with system.open_output_stream(name + ".bin" + suffix) as f:
            for batch in batches:
                for row in batch.column(0).to_pylist():
                    sizes.append(len(row or []))
                    f.write(np.asarray(row or [], dtype=kind).tobytes())
        with system.open_output_stream(name + ".idx" + suffix) as f:
            f.write(index_bytes(np.array(sizes, dtype=np.int32), kind))
        for end in (".bin", ".idx"):
            system.move(name + end + suffix, name + end)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(sizes)]), pa.array([sum(sizes)])], names=["part", "documents", "tokens"])

    return df.repartitionByRange(parts, key).sortWithinPartitions(key).select(ids).mapInArrow(write, "part int, documents bigint, tokens bigint")


def manifest(fields: dict) -> str:
    """A manifest as JSON with sorted keys."""
    return json.dumps(fields, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def write_manifest(path: str, fields: dict) -> None:
    write_text_file(path, manifest(fields))


def read_manifest(path: str, version: int = 1) -> dict:
    found = json.loads(read_text_file(path))
    if found.get("format_version") != version:
        raise ValueError(f"unknown format version {found.get('format_version')}")
    return found


def manifest_rows(df: DataFrame) -> DataFrame:
    """Each row of a small table as one JSON manifest, keys in order of name."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("manifest"))


def append_report(df: DataFrame, path: str) -> None:
    """Rows added to a CSV table with a header."""
    df.write.mode("append").option("header", "true").csv(path)


def document_counts(df: DataFrame, key: str, method: str, tokens: str, methods: list[str]) -> DataFrame:
    """Per-document token counts with a column for each method."""
    return df.groupBy(key).pivot(method, methods).agg(F.first(tokens))


def convert_tokenizer(json_text: str, folder: str, fields: dict) -> dict:
    """Write a tokenizer and its manifest; its four special tokens must exist and its vocabulary must be as large when read again."""
    from tokenizers import Tokenizer

    from millrace.functions.tokenizers import SPECIAL_TOKENS, fingerprint

    own = Tokenizer.from_str(json_text)
    missing = [t for t in SPECIAL_TOKENS if own.token_to_id(t) is None]
    if missing:
        raise ValueError(f"special tokens are missing: {missing}")
    os.makedirs(folder, exist_ok=True)
    own.save(os.path.join(folder, "tokenizer.json"))
    again = Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))
    if again.get_vocab_size() != own.get_vocab_size():
        raise ValueError("the vocabulary changed when read again")
    out = fields | {"format_version": 1, "original_vocab_size": own.get_vocab_size(), "special_token_ids": {t: own.token_to_id(t) for t in SPECIAL_TOKENS}, "tokenizer_fingerprint": fingerprint(folder)}
    write_manifest(os.path.join(folder, "manifest.json"), out)
    return out
