"""Running sums and ordinals without putting a group into one task.

A bucket column that ascends with the order cuts every group into pieces. Sums of the pieces, a row for each group and bucket, are run up in a
small window; the rows are then run up inside their pieces. A group that holds most rows is shared by all its buckets' tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 4096  # even ranges that a numeric order is cut into


def running_before(df: DataFrame, group: list[str], bucket: Column | str, order: list[str], amount: str, name: str = "before") -> DataFrame:
    """df with the sum of `amount` over the rows before each in its group's order (0 for the first).

    bucket must ascend with the order inside a group; the name of a numeric column stands for BUCKETS even ranges between its smallest and largest
    value, dense or not. Rows are exchanged once, by (group, bucket), for the window and the join with the pieces. Null amounts count 0; null groups are a
    group; order ties are summed in any order, so give a unique one; an empty table stays empty.
    """
    if isinstance(bucket, str):
        at = F.col(bucket).cast("double")
        ends = df.agg(F.min(at).alias("_low"), F.max(at).alias("_high"))  # one row
        placed = df.join(F.broadcast(ends)).withColumn("_b", F.floor((at - F.col("_low")) / (F.col("_high") - F.col("_low") + 1) * BUCKETS)).drop("_low", "_high")
    else:
        placed = df.withColumn("_b", bucket)
    # structs are equal where their fields are, nulls included, so one plain key serves window and join
    placed = placed.withColumn("_piece", F.struct(*group, "_b")).drop("_b")
    pieces = placed.groupBy("_piece").agg(F.sum(amount).alias("_s"))
    over = W.partitionBy(*[F.col("_piece")[g] for g in group]).orderBy(F.col("_piece")["_b"]).rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select("_piece", F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_base"))
    inside = W.partitionBy("_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = placed.withColumn("_own", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(pieces, "_piece")
    return out.withColumn(name, F.col("_base") + F.col("_own")).drop("_piece", "_own", "_base")


def hex_bucket(column: str) -> Column:
    """4,096 buckets that ascend with a hash in hexadecimal."""
    return F.substring(column, 1, 3)
