import random

from pyspark.sql import functions as F

from millrace.operators.hotkeys import eager_join_totals, heavy_keys, once, ranked, spread_join
from millrace.operators.prefix import running_before


def test_eager_totals_equal_a_row_join(spark):
    rng = random.Random(3)
    left = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice(["x", "y", None]), rng.choice([1, 5, None]), "clash") for _ in range(300)]
    right = [(rng.choice([1, 1, 2, 4, None]), rng.choice(["p", "q", None]), rng.choice([2, 7, None]), "clash") for _ in range(60)]
    a = spark.createDataFrame(left, "k int, g string, v int, n string")
    b = spark.createDataFrame(right, "k int, h string, w int, n string")
    for how in ("inner", "left"):
        got = {(r.g, r.h): (r.n, r.matched, r.v, r.w) for r in eager_join_totals(a, b, ["k"], ["g"], ["h"], ["v"], ["w"], how).collect()}
        joined = a.select("k", "g", "v").join(b.select(F.col("k").alias("q"), "h", "w"), F.col("k") == F.col("q"), how)
        want = {(r.g, r.h): (r.n, r.m, r.v, r.w) for r in joined.groupBy("g", "h").agg(F.count("*").alias("n"), F.count("q").alias("m"), F.sum("v").alias("v"), F.sum("w").alias("w")).collect()}
        assert got == want
    assert eager_join_totals(a.limit(0), b, ["k"], ["g"], ["h"]).count() == 0
    assert eager_join_totals(a, b.limit(0), ["k"], ["g"], ["h"]).count() == 3


def test_heavy_keys_leave_nulls_out(spark):
    rows = spark.createDataFrame([(1, 50), (1, 45), (2, 4), (3, 1), (None, 1000)], "key int, n bigint")
    assert [(r.key_value, r.n, r.total) for r in heavy_keys(rows, "key").collect()] == [(1, 95, 100)]
    assert heavy_keys(rows.limit(0), "key").count() == 0


def test_records_written_again_count_once(spark):
    rows = spark.createDataFrame([(1, 5, "x"), (1, 5, "y"), (2, None, "z"), (None, 7, None), (None, 7, None)], "id int, v int, other string")
    assert sorted(((r.id or 0), (r.v or 0)) for r in once(rows, ["id"], ["v"]).collect()) == [(0, 7), (1, 5), (2, 0)]
    assert once(rows.limit(0), ["id"], ["v"]).count() == 0


def test_positions_of_a_hot_key_run_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([7] * 8 + [1, 2, None]), rng.random(), "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, key int, at double, key_rows string")
    got = {r.id: (r.position, r.key_rows) for r in ranked(df, "key", ["at", "id"], ranges=9).collect()}
    for key in (7, 1, 2, None):
        own = sorted((at, i) for i, k, at, _ in rows if k == key)
        assert [got[i] for _, i in own] == [(n + 1, len(own)) for n in range(len(own))]
    assert ranked(df.limit(0), "key", ["at"]).count() == 0


def test_running_sums(spark):
    rows = [(i, i % 3 or None, (i * 7) % 11 if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g int, v int")
    got = {r.id: r.before for r in running_before(df, ["g"], "id", ["id"], "v").collect()}
    sums = {}
    for i, g, v in rows:
        assert got[i] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + (v or 0)
    assert running_before(df.limit(0), ["g"], "id", ["id"], "v").count() == 0


def test_spread_join_deals_a_hot_key_over_tasks(spark):
    rows = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 7, id) AS k").unionByName(spark.sql("SELECT -1L AS id, CAST(NULL AS BIGINT) AS k"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    other = rows.where("k IS NOT NULL AND k <> 5").select("k").distinct().withColumn("v", F.col("k") * 2)
    got = spread_join(rows, other, ["k"], counts, part=64)
    assert sorted(map(tuple, got.select("id", "k", "v").collect())) == sorted(map(tuple, rows.join(other, "k").select("id", "k", "v").collect()))
    assert spread_join(rows, other, ["k"], counts, "left", ["id"], 64).count() == 3001
    none = counts.limit(0)
    assert spread_join(rows.limit(0), other, ["k"], none).count() == 0 and spread_join(rows, other.limit(0), ["k"], counts).count() == 0
    assert spread_join(rows, other, ["k"], none).count() == rows.join(other, "k").count()
    placed = got.where("k = 7").groupBy(F.spark_partition_id()).count().collect()
    assert len(placed) > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_running_sums_exchange_rows_once_and_take_hashed_keys(spark):
    df = spark.range(4000).selectExpr("xxhash64(id) AS id", "IF(id % 3 = 0, NULL, 'g') AS g", "id % 5 AS v")
    out = running_before(df, ["g"], "id", ["id"], "v")
    done, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        want[r.id] = done.get(r.g, 0)
        done[r.g] = done.get(r.g, 0) + r.v
    assert {r.id: r.before for r in out.collect()} == want
    plan = out._jdf.queryExecution().sparkPlan().toString()
    whole = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "SortMergeJoin" not in plan or whole.count("Exchange hashpartitioning(_piece") <= 3
    buckets = out.select(F.floor((F.col("id").cast("double") / 2.0**64 + 0.5) * 4096).alias("b")).distinct().count()
    assert buckets > 1000  # hashed keys fall into many buckets, and a bucket has few of them
