"""Session helpers: table reading, the shared folder, lineage cuts and input spreading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the operators are tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            found = own.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, found[len("file://") :], True)
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage is cut by files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _drop(spark: SparkSession, path: str) -> None:
    if path.startswith(("file:", "/")):
        shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        return
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


def stored_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends, on any storage while its session lives."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as a table in the shared folder and read back: cheaper to prune than a checkpoint."""
    path = stored_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows when the scan has fewer tasks than the cluster has cores (one small file);
    a scan that already has enough splits is left alone, so large inputs are never shuffled."""
    want = df.sparkSession.sparkContext.defaultParallelism
    if int(os.environ.get("MILLRACE_NO_SPREAD", "0")) or df.rdd.getNumPartitions() * 2 > want:
        return df
    return df.repartition(want)
