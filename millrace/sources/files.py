"""Files on any storage: listing by Spark, ranges of bytes by tasks, small files by the driver."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def filesystem(path: str) -> tuple:
    """(pyarrow file system, path in it) of a URI or a plain local path."""
    from pyarrow import fs

    if re.match(r"file:/+|/", path) or not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def exists(path: str) -> bool:
    system, at = filesystem(path)
    return system.get_file_info(at).type.name != "NotFound"


def read_text_file(path: str) -> str:
    system, at = filesystem(path)
    with system.open_input_stream(at) as f:
        return f.read().decode()


def write_text_file(path: str, text: str) -> None:
    """The file appears whole: it is written beside itself and moved."""
    system, at = filesystem(path)
    with system.open_output_stream(at + ".tmp") as f:
        f.write(text.encode())
    system.move(at + ".tmp", at)


def list_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, relative, length, modified) of all files below root whose relative path matches the pattern wholly; order by relative.

    Spark lists the folders, in parallel where there are many, on whatever storage it reads; names that begin with `_` or `.`, and empty files, are passed
    over, as Spark does. No content is read. An empty folder gives no row.
    """
    system, at = filesystem(root)
    base = re.sub(r"^[a-zA-Z0-9+.-]+:(//[^/]*)?(?=/)", "", root if "://" in root else at).rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    bare = F.regexp_replace("path", "^[a-zA-Z0-9+.-]+:(//[^/]*)?(?=/)", "")
    found = found.withColumn("relative", F.substring(bare, len(base) + 2, 1 << 30)).select("path", "relative", "length", "modified")
    return found if pattern is None else found.where(F.col("relative").rlike(f"^(?:{pattern})$"))


def read_ranges(ranges: DataFrame) -> DataFrame:
    """ranges with `data`, the bytes of (path, offset, size), each read by the task that has the row; a range beyond the end of a file is cut.

    ranges may be few rows of much data, so they are dealt over the cluster first.
    """
    kept = ranges.columns
    spark = ranges.sparkSession
    schema = ", ".join(f"`{n}` {t}" for n, t in ranges.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, handle = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                path, offset, size = (row.column(kept.index(n))[0].as_py() for n in ("path", "offset", "size"))
                if path != opened:
                    system, at = filesystem(path)
                    opened, handle = path, system.open_input_file(at)
                size = max(0, min(size, handle.size() - offset))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([handle.read_at(size, offset)], type=pa.binary())], names=[*kept, "data"])

    return ranges.repartition(4 * spark.sparkContext.defaultParallelism).sortWithinPartitions("path", "offset").mapInArrow(run, f"{schema}, data binary")


def stream_file(spark: SparkSession, root: str, pattern: str | None = None, chunk: int = 8 << 20, offset: int = 0) -> DataFrame:
    """(path, chunk, offset, size, data): the bytes of the files below root from `offset` on, in chunks; a file larger than memory is many rows."""
    files = list_files(spark, root, pattern).where(F.col("length") > offset)
    chunks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1 - offset) / chunk))).alias("chunk")
    rows = files.select("path", "length", chunks).withColumn("offset", F.col("chunk") * chunk + offset)
    return read_ranges(rows.select("path", "chunk", "offset", F.least(F.lit(chunk).cast("bigint"), F.col("length") - F.col("offset")).alias("size")))
