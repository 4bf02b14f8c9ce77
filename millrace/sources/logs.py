"""Readers of training logs and cache reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Escape sequences of coloured terminals, and the fields of a training log's line.
_ANSI = "\x1b\\[[0-9;]*[A-Za-z]"
_STEP, _LOSS = r"iteration:\s*([\d,]+)\s*/", r"lm_loss:\s*([-+0-9.eE]+)"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no) of a text file: file order is (file, offset), which increasing ids keep within and across splits."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


def losses(lines: DataFrame) -> DataFrame:
    """(step, loss): the last loss logged for each step. Lines without both fields, and null lines, are passed over."""
    plain = F.regexp_replace("value", _ANSI, "")
    step = F.expr("try_cast(s AS bigint)")
    rows = lines.select(F.regexp_replace(F.regexp_extract(plain, _STEP, 1), ",", "").alias("s"), F.regexp_extract(plain, _LOSS, 1).alias("l"), "line_no")
    rows = rows.select(step.alias("step"), F.expr("try_cast(l AS double)").alias("loss"), "line_no").where("step IS NOT NULL AND loss IS NOT NULL")
    return rows.groupBy("step").agg(F.max_by("loss", "line_no").alias("loss"))


def cached_share(lines: DataFrame) -> DataFrame:
    """(path, cached) from lines `path size B cached B`: cached bytes in percent of all, two decimals; 0 where there are none."""
    part = F.split("value", " ")
    rows = lines.select(F.get(part, F.lit(0)).alias("path"), F.get(part, F.lit(1)).cast("bigint").alias("size"), F.get(part, F.lit(3)).cast("bigint").alias("held"))
    return rows.groupBy("path").agg(F.round(F.coalesce(F.try_divide(F.sum("held") * 100.0, F.sum("size")), F.lit(0.0)), 2).alias("cached"))
