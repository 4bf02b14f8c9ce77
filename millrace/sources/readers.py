"""Readers: JSON lines, plain text, synthetic rows, registries, manifests, token streams and indexed token files."""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.sources.files import exists, filesystem, list_files, read_ranges, read_text_file
from millrace.sources.specs import Source

# The header of an indexed token file, and its type codes.
INDEX_MAGIC, INDEX_VERSION = b"MMIDIDX\x00\x00", 1
INDEX_TYPES = {1: "uint8", 2: "int8", 3: "int16", 4: "int32", 5: "int64", 6: "float64", 7: "float32", 8: "uint16"}


def read_jsonl(spark: SparkSession, path: str, text_field: str = "text", schema: str | None = None) -> DataFrame:
    """Rows of a JSON-lines file (compressed by suffix) that have the text field, with `source_file`; blank lines are passed over.

    A line that is no JSON fails the read; rows whose field is missing or null are left out. Text that is no UTF-8 is read with replacement characters.
    """
    rows = spark.read.schema(schema or f"`{text_field}` string").option("mode", "FAILFAST").json(path)
    return rows.where(F.col(text_field).isNotNull()).withColumn("source_file", F.input_file_name())


def read_text(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Lines of text files, folders read through; gz by suffix."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).text(path)


def read_source(spark: SparkSession, source: Source, root: str) -> DataFrame:
    """A source kept below `root` as DATASET[/CONFIG]/SPLIT.(parquet|jsonl), with its label; the text falls back to `content` if the field is the default."""
    base = os.path.join(root, source.dataset, *([source.config] if source.config else []), source.split)
    if exists(base + ".parquet"):
        rows = spark.read.parquet(base + ".parquet")
    else:
        rows = spark.read.json(base + ".jsonl")
    names = [c for c in ([source.text_field, "content"] if source.text_field == "text" else [source.text_field]) if c in rows.columns]
    if not names:
        raise ValueError(f"{source.label} has no field {source.text_field}")
    return rows.select(F.coalesce(*names).alias("text"), F.lit(source.label).alias("source"))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df with `shuffle`, a digest of seed and key whose order stands for a shuffled stream."""
    return df.withColumn("shuffle", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key)), 256))


# Word stock of the synthetic regimes.
_PROSE = "river morning letter garden window story people quiet winter market".split()
_CODE = "def return self value index result items count range print".split()
_MATHS = "sum integral theorem lemma proof matrix vector limit series kernel".split()


def synthetic_rows(spark: SparkSession, rows: int, seed: int, words: int = 60) -> DataFrame:
    """(doc_id, text, regime): prose, code and mathematics in turn, each word drawn by hash; the same on any cluster."""
    stock = F.when(F.col("doc_id") % 3 == 0, F.array(*map(F.lit, _PROSE))).when(F.col("doc_id") % 3 == 1, F.array(*map(F.lit, _CODE))).otherwise(F.array(*map(F.lit, _MATHS)))
    draw = F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), i), F.lit(10)).cast("int"))
    base = spark.range(rows).withColumnRenamed("id", "doc_id").withColumn("stock", stock).withColumn("draw", draw)
    text = F.array_join(F.transform("draw", lambda k: F.get(F.col("stock"), k)), " ")
    regime = F.get(F.array(F.lit("prose"), F.lit("code"), F.lit("maths")), (F.col("doc_id") % 3).cast("int"))
    return base.select("doc_id", text.alias("text"), regime.alias("regime"))


def dummy_batches(spark: SparkSession, rows: int, length: int, vocabulary: int, seed: int) -> DataFrame:
    """(sample, input_ids, position_ids): random tokens; positions as of documents of 4, 6 and length - 10 tokens."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("sample"), i), F.lit(vocabulary)).cast("int"))
    at = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when(i < 4, i).when(i < 10, i - 4).otherwise(i - 10))
    return spark.range(rows).withColumnRenamed("id", "sample").select("sample", ids.alias("input_ids"), at.alias("position_ids"))


def read_registry(path: str) -> list[dict]:
    """Tokenizers of a registry file (YAML, of which JSON is a part); ids must be 0, 1, ... in order; relative paths are the file's."""
    text = read_text_file(path)
    try:
        found = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("reading YAML needs the yaml package; JSON works without") from e
        found = yaml.safe_load(text)
    specs = found["tokenizers"] if isinstance(found, dict) else found
    if [s["id"] for s in specs] != list(range(len(specs))):
        raise ValueError("tokenizer ids must be 0 to K - 1 in order")
    for s in specs:
        p = s.get("tokenizer_name_or_path")
        if p and p.startswith("."):
            s["tokenizer_name_or_path"] = os.path.normpath(os.path.join(os.path.dirname(path), p))
    return specs


def endpoints_of(path: str) -> list[dict]:
    """Endpoints of a model's metadata; their ids must be contiguous from 0."""
    found = sorted(json.loads(read_text_file(path))["endpoints"], key=lambda e: e["id"])
    if [e["id"] for e in found] != list(range(len(found))):
        raise ValueError("endpoint ids must be contiguous")
    return found


def stream_header(path: str) -> tuple[str, int]:
    """(tokenizer, bytes a token) of a token stream's metadata: the first line is `name|size`."""
    name, size = read_text_file(path).split("\n", 1)[0].strip().rsplit("|", 1)
    return name, int(size)


def same_header(paths: list[str]) -> tuple[str, int]:
    found = {stream_header(p) for p in paths}
    if len(found) != 1:
        raise ValueError(f"folders differ: {sorted(found)}")
    return found.pop()


def match_paths(paths: list[str], root: str, pattern: str) -> list[str]:
    """Paths below root whose relative form matches the pattern wholly, sorted."""
    return sorted(p for p in paths if p.startswith(root) and re.fullmatch(pattern, p[len(root) :].lstrip("/")))


def read_token_stream(spark: SparkSession, path: str, length: int, token_bytes: int = 2, skip: int = 0, limit: int | None = None, at_once: int = 1024) -> DataFrame:
    """(file, context, input_ids): contexts of length + 1 tokens without overlap from little-endian token files; the rest of a file is dropped.

    skip and limit count contexts of each file. A file is read in ranges of at_once contexts by as many tasks as there are, whatever its size.
    """
    kind, width = np.dtype("<u2" if token_bytes == 2 else "<u4"), length + 1
    files = list_files(spark, path, r".*\.ds").withColumn("stop", F.floor(F.col("length") / (width * token_bytes)))
    if limit is not None:
        files = files.withColumn("stop", F.least("stop", F.lit(skip + limit)))
    first = F.explode(F.sequence(F.lit(skip).cast("bigint"), F.col("stop") - 1, F.lit(at_once).cast("bigint"))).alias("context")
    ranges = files.where(F.col("stop") > skip).select("path", first, "stop").withColumn("offset", F.col("context") * width * token_bytes)
    ranges = ranges.withColumn("size", F.least(F.lit(at_once), F.col("stop") - F.col("context")) * width * token_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, context, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                flat = np.frombuffer(raw.as_buffer(), dtype=kind).astype(np.int64)
                n = len(flat) // width
                ids = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(flat[: n * width]))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(context, context + n)), ids], names=["file", "context", "input_ids"])

    return read_ranges(ranges.select("path", "context", "offset", "size")).select("path", "context", "data").mapInArrow(run, "file string, context bigint, input_ids array<bigint>")


def read_token_folders(spark: SparkSession, folders: list[str], length: int, token_bytes: int = 2, most_tokens: int | None = None, skip_tokens: int = 0) -> DataFrame:
    """(folder, context, file, file_context, input_ids): the contexts of each folder's files in order of their names, numbered through the folder.

    skip_tokens and most_tokens leave out whole contexts at the start and beyond so many tokens of a folder, across its files. A folder without files fails.
    """
    out = []
    for k, folder in enumerate(folders):
        files = list_files(spark, folder, r".*\.ds").withColumn("contexts", F.floor(F.col("length") / ((length + 1) * token_bytes)))
        w = W.orderBy("relative").rowsBetween(W.unboundedPreceding, -1)  # a row a file
        sizes = files.select(F.col("path").alias("file"), F.coalesce(F.sum("contexts").over(w), F.lit(0)).alias("before"))
        if not sizes.limit(1).count():
            raise ValueError(f"{folder} has no token files")
        rows = read_token_stream(spark, folder, length, token_bytes).join(F.broadcast(sizes), "file")
        place = F.col("before") + F.col("context") - skip_tokens // (length + 1)
        rows = rows.select(F.lit(k).alias("folder"), place.alias("context"), "file", F.col("context").alias("file_context"), "input_ids").where(F.col("context") >= 0)
        out.append(rows if most_tokens is None else rows.where(F.col("context") < most_tokens // (length + 1)))
    return reduce(DataFrame.unionByName, out)


def index_bytes(sizes: np.ndarray, kind: str) -> bytes:
    """The index of documents of these sizes, one after the other: magic, version, type, counts, sizes, byte pointers and document boundaries."""
    ends = np.cumsum(sizes.astype(np.int64))
    pointers = (ends - sizes) * np.dtype(kind).itemsize
    head = struct.pack("<QBQQ", INDEX_VERSION, {v: k for k, v in INDEX_TYPES.items()}[kind], len(sizes), len(sizes) + 1)
    return INDEX_MAGIC + head + sizes.astype(np.int32).tobytes() + pointers.astype(np.int64).tobytes() + np.arange(len(sizes) + 1, dtype=np.int64).tobytes()


def write_indexed(prefix: str, documents: Iterable[np.ndarray], kind: str = "int32") -> None:
    """Documents, one after the other, as prefix.bin and prefix.idx; tables are written by sinks.writers.write_indexed_parts."""
    sizes = []
    system, at = filesystem(prefix)
    with system.open_output_stream(at + ".bin") as f:
        for d in documents:
            sizes.append(len(d))
            f.write(np.asarray(d, dtype=kind).tobytes())
    with system.open_output_stream(at + ".idx") as f:
        f.write(index_bytes(np.array(sizes, dtype=np.int32), kind))


def read_index(prefix: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(type, sizes, pointers, document boundaries) of prefix.idx."""
    system, at = filesystem(prefix + ".idx")
    with system.open_input_stream(at) as f:
        raw = f.read()
    if raw[:9] != INDEX_MAGIC:
        raise ValueError("no indexed token file")
    version, code, n, docs = struct.unpack_from("<QBQQ", raw, 9)
    if version != INDEX_VERSION:
        raise ValueError(f"unknown version {version}")
    at = 9 + struct.calcsize("<QBQQ")
    sizes = np.frombuffer(raw, np.int32, n, at)
    pointers = np.frombuffer(raw, np.int64, n, at + 4 * n)
    return INDEX_TYPES[code], sizes, pointers, np.frombuffer(raw, np.int64, docs, at + 12 * n)


def read_indexed(spark: SparkSession, prefix: str, per_task: int = 10_000) -> DataFrame:
    """(doc, ids) of an indexed token file on any storage; the index is read once and dealt out, tasks read their own documents' ranges."""
    kind, sizes, pointers, _ = read_index(prefix)
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = filesystem(prefix + ".bin")
        with system.open_input_file(at) as f:
            for batch in batches:
                first, last = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                out = [np.frombuffer(f.read_at(int(n) * width, int(a)), dtype=kind).astype(np.int64) for a, n in zip(first, last)]
                ends = np.concatenate([[0], np.cumsum(last)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.zeros(0, dtype=np.int64)))], names=["doc", "ids"])

    rows = spark.createDataFrame(pa.table({"doc": np.arange(len(sizes)), "pointer": pointers, "size": sizes.astype(np.int64)}))  # 24 bytes a document
    return rows.repartitionByRange(max(1, -(-len(sizes) // per_task)), "doc").mapInArrow(run, "doc bigint, ids array<bigint>")


def document_slice(prefix: str, doc: int, offset: int = 0, length: int | None = None) -> np.ndarray:
    """Tokens of one document, or a part of them, by seeking."""
    kind, sizes, pointers, _ = read_index(prefix)
    n, width = (int(sizes[doc]) - offset if length is None else length), np.dtype(kind).itemsize
    system, at = filesystem(prefix + ".bin")
    with system.open_input_file(at) as f:
        return np.frombuffer(f.read_at(n * width, int(pointers[doc]) + offset * width), dtype=kind)
