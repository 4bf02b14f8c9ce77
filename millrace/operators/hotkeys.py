"""Per-key results where a few keys hold most rows: eager aggregation through joins, and orderings by ranges.

Eager aggregation: both inputs of a join are aggregated by (join key, own groups) first, which bounds what any join key sends; the compact
states are joined, counts multiplied and sums scaled by the other side's count, and the products rolled up by the wanted groups. A group that
holds most rows is one row a join key before any shuffle by group.

Orderings: rows are range-partitioned by (key, order columns), so a hot key spreads over many tasks; ranks come from running numbers inside
the ranges plus the counts of the ranges before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import stored


def once(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Each record once by its key, with the smallest value of every column; records written again hold equal values. Records with a null key are one record; an empty table stays empty; other columns are dropped."""
    return df.groupBy(*key).agg(*(F.min(c).alias(c) for c in columns))


def eager_join_totals(left: DataFrame, right: DataFrame, on: list[str], by_left: list[str], by_right: list[str], sums_left: list[str] = [], sums_right: list[str] = [], how: str = "left") -> DataFrame:
    """SELECT by_left, by_right, count(*), sums FROM left JOIN right USING (on) GROUP BY by_left, by_right, without joining any row.

    Columns: by_left, by_right, n (joined rows), matched (joined rows with a partner), and each sum under its own name. how is
    'inner' or 'left'; with 'left', rows without a partner, null join keys among them, count once with null by_right. A null in a summed
    column adds nothing; a sum over nulls alone is null. Null groups are groups. Empty inputs give no rows (an empty right side, with 'left', gives the left's groups).
    Clashing names are no matter: columns are picked by role, and only the names in by_left, by_right and the sums come out.
    """
    l_state = left.groupBy(*[left[c].alias(f"_k{i}") for i, c in enumerate(on)], *[left[c].alias(f"_l{i}") for i, c in enumerate(by_left)]).agg(
        F.count("*").alias("_nl"), *(F.sum(left[c]).alias(f"_sl{i}") for i, c in enumerate(sums_left))
    )
    r_state = right.groupBy(*[right[c].alias(f"_q{i}") for i, c in enumerate(on)], *[right[c].alias(f"_r{i}") for i, c in enumerate(by_right)]).agg(
        F.count("*").alias("_nr"), *(F.sum(right[c]).alias(f"_sr{i}") for i, c in enumerate(sums_right))
    )
    meets = reduce(Column.__and__, (F.col(f"_k{i}") == F.col(f"_q{i}") for i in range(len(on))))
    joined = l_state.join(r_state, meets, how)
    partners = F.coalesce("_nr", F.lit(1))
    groups = [F.col(f"_l{i}").alias(c) for i, c in enumerate(by_left)] + [F.col(f"_r{i}").alias(c) for i, c in enumerate(by_right)]
    return joined.groupBy(*groups).agg(
        F.sum(F.col("_nl") * partners).alias("n"),
        F.sum(F.col("_nl") * F.coalesce("_nr", F.lit(0))).alias("matched"),
        *(F.sum(F.col(f"_sl{i}") * partners).alias(c) for i, c in enumerate(sums_left)),
        *(F.sum(F.col(f"_sr{i}") * F.col("_nl")).alias(c) for i, c in enumerate(sums_right)),
    )


def heavy_keys(totals: DataFrame, key: str, count: str = "n", percent: int = 4) -> DataFrame:
    """(key_value, n, total): keys that hold more than percent % of the records with a key; nulls are left out of both counts.

    totals has a row or more per key and is small (one row a key and partner group), so a second pass over it costs nothing.
    """
    per_key = totals.where(totals[key].isNotNull()).groupBy(totals[key].cast("bigint").alias("key_value")).agg(F.sum(count).alias("n"))
    total = per_key.agg(F.sum("n").alias("total"))
    return per_key.crossJoin(F.broadcast(total)).where(F.col("n") * 100 > F.col("total") * percent)  # total is one row


def spread_join(rows: DataFrame, other: DataFrame, on: list[str], counts: DataFrame, how: str = "inner", deal: list[str] | None = None, part: int = 2048) -> DataFrame:
    """rows JOIN other USING (on), where no key's rows meet in one task; counts has (on, n), the number of rows of each key.

    A key with more than 1 / part of all rows is spread over as many tasks as it has such parts: its rows are dealt out by a hash of the
    columns `deal` (default all), and its row or rows of other are repeated once a task, in all fewer than `part` times. What is broadcast is key and
    number of tasks of such keys, fewer than `part` rows. counts only decides the spreading, so it may be off. Null keys meet nothing, how is
    'inner' or 'left'; columns other than the key must have different names; empty tables give what the join gives.
    """
    total = counts.agg(F.sum("n").alias("_total"))  # one row
    heavy = counts.join(F.broadcast(total), F.col("n") * part > F.col("_total")).select(*on, F.ceil(F.col("n") * part / F.col("_total")).cast("int").alias("_tasks"))
    tasks = F.coalesce("_tasks", F.lit(1))
    dealt = rows.join(F.broadcast(heavy), on, "left").withColumn("_task", F.pmod(F.xxhash64(*(deal or rows.columns)), tasks).cast("int")).drop("_tasks")
    repeated = other.join(F.broadcast(heavy), on, "left").withColumn("_task", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("_tasks")
    return dealt.join(repeated, [*on, "_task"], how).drop("_task")


def ranked(df: DataFrame, key: str, order: list[str], rank: str = "position", ranges: int | None = None) -> DataFrame:
    """df with each row's position (from 1) in its key's ordering and its key's number of rows (key_rows).

    Rows are range-partitioned by (key, *order), so a key that holds a third of all rows is numbered by many tasks; what meets in one task is the
    table of counts by (range, key), a row for each key and range. Ties in order columns are broken by nothing: give a unique order
    for a defined result. Columns named like the results are replaced. Null keys form one key, null order values come first; repeated rows are numbered each; an empty table stays empty.
    """
    spark = df.sparkSession
    df = df.drop(*({rank, "key_rows", "_range"} - {key, *order}))
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # written once, so both passes see the same ranges
    placed = df.repartitionByRange(ranges, key, *order).sortWithinPartitions(key, *order).withColumn("_range", F.spark_partition_id())
    placed = stored(placed, "ranges")
    inside = W.partitionBy("_range", key).orderBy(*order)
    counts = placed.groupBy("_range", key).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("key_rows", F.sum("_n").over(W.partitionBy(key))).select(F.col("_range").alias("_r"), F.col(key).alias("_k"), "_before", "key_rows")
    numbered = placed.withColumn("_own", F.row_number().over(inside))
    out = numbered.join(before, (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k")))
    return out.withColumn(rank, F.col("_own") + F.col("_before")).drop("_own", "_before", "_r", "_k", "_range")
