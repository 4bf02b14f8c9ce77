"""Queries of blending and schedules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import blending as B
from millrace.operators import schedule as S
from millrace.operators.hotkeys import once, ranked
from millrace.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_BLEND = """WITH RECURSIVE f AS (SELECT 0 AS i, [0, 0, 0, 0] AS n, CAST(NULL AS INTEGER) AS d, CAST(NULL AS INTEGER) AS s UNION ALL
    SELECT i + 1, list_transform(n, lambda x, k: CASE WHEN k = b THEN x + 1 ELSE x END), CAST(b - 1 AS INTEGER), CAST(n[b] AS INTEGER) FROM
    (SELECT i, n, list_position(e, list_max(e)) AS b FROM (SELECT i, n, list_transform(n, lambda x, k: CAST([0.1, 0.5, 0.3, 0.1][k] AS DOUBLE) * greatest(i, 1) - x) AS e FROM f WHERE i < 400)))
    SELECT CAST(i - 1 AS BIGINT) AS i, d AS dataset, CAST(s % [8, 2, 5, 5][d + 1] AS BIGINT) AS sample FROM f WHERE i > 0"""


@query(_BLEND)
def blend_index(spark: SparkSession, folder: str) -> DataFrame:
    return B.blend_index(spark, [0.1, 0.5, 0.3, 0.1], 400, [8, 2, 5, 5])


_BINS = "[0, 1, 1, 1, 1, 1, 2, 2, 2, 2]"


@query(f"SELECT i, {_BINS}[i % 10 + 1] AS dataset, ([3, 0, 1][{_BINS}[i % 10 + 1] + 1] + i // 10 * [1, 5, 4][{_BINS}[i % 10 + 1] + 1] + (i % 10 - [0, 1, 6][{_BINS}[i % 10 + 1] + 1])) % [8, 20, 15][{_BINS}[i % 10 + 1] + 1] AS sample FROM (SELECT unnest(range(0, 1000)) AS i)")
def mem_blend_index(spark: SparkSession, folder: str) -> DataFrame:
    bins = B.bins_by_weight([0.1, 0.5, 0.4], 10)
    dataset, sample = B.binned_blend(F.col("id"), bins, [1, 5, 4], [3, 0, 1], [8, 20, 15])
    return spark.range(1000).select(F.col("id").alias("i"), dataset.alias("dataset"), sample.alias("sample"))


@query(f"WITH b AS ({_BLEND}), c AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS sample, dense_rank() OVER (ORDER BY source) - 1 AS dataset FROM documents) SELECT b.i, b.dataset, b.sample, c.doc_id FROM b JOIN c ON b.dataset = c.dataset AND b.sample = c.sample")
def blended_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    names = docs.select("source").distinct().withColumn("dataset", (F.dense_rank().over(W.orderBy("source")) - 1).cast("int"))
    placed = ranked(docs, "source", ["doc_id"]).join(names, "source").select("doc_id", "dataset", (F.col("position") - 1).alias("sample"))
    return blend_index(spark, folder).join(placed, ["dataset", "sample"]).select("i", "dataset", "sample", "doc_id")


@query()
def blended_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """As many samples as there are documents, of all sources by the weights of mixture_targets, with their documents.

    blended_documents keeps the four small datasets of its SQL. Sources without a target or without documents have no sample.
    """
    docs = table(spark, folder, "documents").select("doc_id", "source")
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    rows = sizes.join(table(spark, folder, "mixture_targets").where("target_weight > 0"), "source").orderBy("source").select("source", "n", "target_weight").collect()  # one row a source
    if not rows:
        return spark.createDataFrame([], "i bigint, dataset int, source string, sample bigint, doc_id bigint")
    index = B.blend_index(spark, [r.target_weight for r in rows], docs.count(), [r.n for r in rows])
    names = spark.createDataFrame([(d, r.source) for d, r in enumerate(rows)], "dataset int, source string")
    placed = ranked(docs, "source", ["doc_id"]).select("doc_id", "source", (F.col("position") - 1).alias("sample"))
    return index.join(F.broadcast(names), "dataset").join(placed, ["source", "sample"]).select("i", "dataset", "source", "sample", "doc_id")


@query("""SELECT source, n, CAST(round_even(n * 0.949, 0) AS BIGINT) - over AS train_end, CAST(round_even(n * 0.949, 0) + round_even(n * 0.05, 0) AS BIGINT) - over AS valid_end, CAST(n AS BIGINT) AS test_end FROM
    (SELECT source, n, CAST(round_even(n * 0.949, 0) + round_even(n * 0.05, 0) + round_even(n * 0.001, 0) AS BIGINT) - n AS over FROM (SELECT source, count(*) AS n FROM documents GROUP BY source))""")
def split_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n"))
    _, a, b, c = B.split_columns(F.col("n"), (949.0, 50.0, 1.0))
    return n.select("source", "n", a.alias("train_end"), b.alias("valid_end"), c.alias("test_end"))


@query("SELECT source, CAST(ceil(100000 * target_weight * 1.005) AS BIGINT) AS samples FROM mixture_targets")
def overprovision(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "mixture_targets").select("source", B.overprovisioned(F.lit(100_000), F.col("target_weight")).alias("samples"))


@query("""WITH x AS (SELECT source, target_weight / sum(target_weight) OVER () * 1000 AS x FROM mixture_targets), f AS (SELECT source, x, floor(x) AS f FROM x),
    r AS (SELECT *, row_number() OVER (ORDER BY round(x - f, 9) DESC, source) AS r FROM f)
    SELECT source, CAST(f + CASE WHEN r <= 1000 - (SELECT sum(f) FROM f) THEN 1 ELSE 0 END AS BIGINT) AS count FROM r""")
def largest_remainder(spark: SparkSession, folder: str) -> DataFrame:
    return B.largest_remainder(table(spark, folder, "mixture_targets").select("source", "target_weight"), "target_weight", 1000, "source").select("source", "count")


@query("SELECT e AS epoch, doc_id, row_number() OVER (PARTITION BY e ORDER BY sha256('7:' || e || ':' || doc_id), doc_id) AS position FROM documents, (SELECT unnest([0, 1]) AS e)")
def epoch_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    rows = B.epoch_index(table(spark, folder, "documents"), "doc_id", 2, 7)
    return ranked(rows, "epoch", ["shuffle", "doc_id"]).select("epoch", "doc_id", "position")


@query("SELECT i, CASE WHEN i < 700 THEN 0 ELSE 1 END AS part, row_number() OVER (PARTITION BY i < 700 ORDER BY sha256('7:' || i)) + CASE WHEN i < 700 THEN 0 ELSE 700 END - 1 AS position FROM (SELECT unnest(range(0, 1000)) AS i)")
def shuffle_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.range(1000).select(F.col("id").alias("i"), F.when(F.col("id") < 700, 0).otherwise(1).alias("part"), F.sha2(F.concat(F.lit("7:"), F.col("id").cast("string")), 256).alias("h"))
    return ranked(rows, "part", ["h"]).select("i", "part", (F.col("position") + F.when(F.col("part") == 0, 0).otherwise(700) - 1).alias("position"))


@query("SELECT doc_id, e AS epoch FROM documents, (SELECT unnest([0, 1, 2]) AS e) QUALIFY row_number() OVER (ORDER BY e, sha256('11:' || doc_id), doc_id) <= 2.5 * (SELECT count(*) FROM documents)")
def repeated_epochs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.sha2(F.concat(F.lit("11:"), F.col("doc_id").cast("string")), 256).alias("h"))
    rows = docs.select("doc_id", "h", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("epoch")).withColumn("all", F.lit(0))
    return ranked(rows, "all", ["epoch", "h", "doc_id"]).where(F.col("position") * 3 <= F.col("key_rows") * 2.5).select("doc_id", "epoch")


_DEFICIT = """WITH RECURSIVE f AS (SELECT 0 AS step, CAST([0, 0, 0] AS DOUBLE[]) AS d, CAST(NULL AS INTEGER) AS t UNION ALL
    SELECT step + 1, list_transform(d, lambda x, k: CASE WHEN k = b THEN x - 1.0 ELSE x END), CAST(b - 1 AS INTEGER) FROM (SELECT step, d,
        list_sort(list_transform(list_filter([1, 2, 3], lambda k: d[k] >= list_max(d) - 1e-12), lambda k: sha256('11:' || step || ':' || (k - 1)) || k))[1][65:]::INT AS b
        FROM (SELECT step, list_transform(d, lambda x, k: x + CAST([0.7, 0.2, 0.1][k] AS DOUBLE)) AS d FROM f WHERE step < 300)))
    SELECT CAST(step - 1 AS BIGINT) AS step, t AS tokenizer_id FROM f WHERE step > 0"""


@query(_DEFICIT)
def deficit_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return S.deficit_schedule(spark, 300, S.DeficitSchedule([0.7, 0.2, 0.1], 11))


@query("SELECT DISTINCT start_training_step AS step, CAST((start_training_step + 11) % (SELECT count(*) FROM registry) AS INTEGER) AS tokenizer_id FROM data_stages WHERE start_training_step IS NOT NULL")
def round_robin_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """The tokenizer in turn at the first step of every stage."""
    steps = table(spark, folder, "data_stages").where("start_training_step IS NOT NULL").select(F.col("start_training_step").alias("step")).distinct()
    return steps.withColumn("tokenizer_id", S.round_robin(F.col("step"), table(spark, folder, "registry").count(), 11))


@query(f"""WITH s AS ({_DEFICIT}), z AS (SELECT tokenizer_id, count(DISTINCT route_id) AS rows FROM routed_documents WHERE tokenizer_id < 3 GROUP BY 1), u AS (SELECT step, tokenizer_id, row_number() OVER (PARTITION BY tokenizer_id ORDER BY step) - 1 AS turn FROM s)
    SELECT step, tokenizer_id, (turn * 8 + k) % rows AS sample FROM u JOIN z USING (tokenizer_id), (SELECT unnest(range(0, 8)) AS k)""")
def step_samples(spark: SparkSession, folder: str) -> DataFrame:
    sizes = once(table(spark, folder, "routed_documents"), ["route_id"], ["tokenizer_id"]).where("tokenizer_id < 3").groupBy("tokenizer_id").agg(F.count("*").alias("rows"))
    return S.step_context(deficit_schedule(spark, folder), sizes, 8)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i % 4 = 1 AND i // 4 >= 25")
def rank_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranked(table(spark, folder, "documents").select("doc_id").withColumn("all", F.lit(0)), "all", ["doc_id"])
    return rows.where(S.rank_rows(F.col("position") - 1, 1, 4, 100)).select("doc_id")


@query("SELECT doc_id, i // 32 AS batch, CAST(i % 32 // 8 AS INTEGER) AS rank, CAST(i % 8 AS INTEGER) AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)")
def batch_sampler(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranked(table(spark, folder, "documents").select("doc_id").withColumn("all", F.lit(0)), "all", ["doc_id"])
    a, b, c = S.batch_place(F.col("position") - 1, 8, 4)
    return rows.select("doc_id", a.alias("batch"), b.alias("rank"), c.alias("place"))


def _sql_sampler(order: str, rank: str) -> str:
    return f"""WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, (SELECT count(*) FROM documents) // 12 * 3 AS bucket FROM documents),
    r AS (SELECT doc_id, pos, bucket, CAST(pos // bucket AS INTEGER) AS rank FROM i WHERE pos < bucket * 4), p AS (SELECT doc_id, rank, row_number() OVER (PARTITION BY rank ORDER BY {order}) - 1 AS place FROM r)
    SELECT doc_id, rank, CAST(0 AS BIGINT) AS epoch, place, place // 3 AS batch FROM p WHERE place >= 15 {rank}"""


@query(_sql_sampler("pos", ""))
def cyclic_sampler(spark: SparkSession, folder: str) -> DataFrame:
    """What four ranks still read of all documents in order, micro batches of 3, after 60 samples."""
    return S.bucket_sampler(table(spark, folder, "documents"), "doc_id", "doc_id", 3, 4, 60)


@query(_sql_sampler("sha256('5:0:' || doc_id), doc_id", ""))
def resumed_sampler(spark: SparkSession, folder: str) -> DataFrame:
    """The same in an order of the epoch's own."""
    return S.bucket_sampler(table(spark, folder, "documents"), "doc_id", "doc_id", 3, 4, 60, 5)


@query("SELECT doc_id, pos // 8 AS micro_batch, CAST(pos // 8 % 4 AS INTEGER) AS rank, pos // 32 AS turn FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)")
def micro_batches(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in micro batches of 8, which go to four ranks in turn."""
    rows = ranked(table(spark, folder, "documents").select("doc_id").withColumn("all", F.lit(0)), "all", ["doc_id"])
    batch, rank, turn = S.micro_place(F.col("position") - 1, 8, 4)
    return rows.select("doc_id", batch.alias("micro_batch"), rank.alias("rank"), turn.alias("turn"))


@query("""WITH w AS (SELECT source, target_weight / sum(target_weight) OVER () * 64 AS x FROM mixture_targets WHERE target_weight > 0 AND source IN (SELECT source FROM documents)),
    r AS (SELECT source, x, greatest(round_even(x, 0), 1) AS s FROM w),
    a AS (SELECT source, s, 64 - sum(s) OVER () AS d, row_number() OVER (ORDER BY x - s DESC, source) AS up, row_number() OVER (ORDER BY CASE WHEN s > 1 THEN s - x ELSE -99 END DESC, source) AS down FROM r),
    z AS (SELECT source, CAST(s + CASE WHEN d > 0 AND up <= d THEN 1 WHEN d < 0 AND down <= -d THEN -1 ELSE 0 END AS BIGINT) AS size FROM a), f AS (SELECT source, size, CAST(sum(size) OVER (ORDER BY source) - size AS BIGINT) AS first FROM z),
    i AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('9:' || doc_id), doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL),
    p AS (SELECT doc_id, i.source, pos // size AS step, CAST(first + pos % size AS INTEGER) AS place FROM i JOIN f ON i.source = f.source WHERE pos // size < (SELECT min(n // size) FROM i JOIN f ON i.source = f.source))
    SELECT doc_id, source, step, CAST(place // 32 AS INTEGER) AS rank, CAST(place % 32 // 8 AS INTEGER) AS microbatch, place FROM p""")
def domain_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of 64 documents with the sources' target weights, for two ranks in micro batches of 8, until a source runs out."""
    docs = table(spark, folder, "documents").where("source IS NOT NULL").select("doc_id", "source")
    targets = table(spark, folder, "mixture_targets").where("target_weight > 0").join(docs.select("source").distinct(), "source", "left_semi")
    weights = {r.source: r.target_weight for r in targets.select("source", "target_weight").orderBy("source").collect()}  # a row a source
    return S.domain_samples(docs, "doc_id", "source", weights, 64, 8, 2, 9)


@query("SELECT row_number() OVER (ORDER BY e = 2, sha256('4:' || (e = 2)::INT || ':' || e || ':' || doc_id), doc_id) - 1 AS position, doc_id FROM documents, (SELECT unnest([0, 1, 2]) AS e)")
def document_index(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of three epochs, of which the last is used for less than 80 % and so shuffled on its own."""
    return B.document_index(table(spark, folder, "documents"), "doc_id", 3, B.last_epoch_separate(1000, 2300), 4)


@query("""SELECT i AS step, round(CASE WHEN i <= 100 THEN i / 100.0 WHEN i <= 300 THEN 1.0 WHEN i < 900 THEN 0.1 + 0.9 * (1 + cos((i - 300) / 600.0 * pi())) / 2 ELSE 0.1 END, 9) AS cosine,
    round(CASE WHEN i <= 100 THEN i / 100.0 WHEN i <= 300 THEN 1.0 WHEN i < 900 THEN 0.1 + 0.9 * (1 - (i - 300) / 600.0) ELSE 0.1 END, 9) AS linear,
    round(CASE WHEN i <= 100 THEN i / 100.0 WHEN i <= 300 THEN 1.0 WHEN i < 900 THEN 0.1 + 0.9 * (1 - sqrt((i - 300) / 600.0)) ELSE 0.1 END, 9) AS root FROM (SELECT unnest(range(0, 1001)) AS i)""")
def lr_schedule(spark: SparkSession, folder: str) -> DataFrame:
    rate = lambda style, name: F.round(S.learning_rate(F.col("id"), 100, 200, 600, style), 9).alias(name)
    return spark.range(1001).select(F.col("id").alias("step"), rate("cosine", "cosine"), rate("linear", "linear"), rate("1-sqrt", "root"))




@query("""SELECT s.step, arg_max(g.stage, g.start) AS stage FROM (SELECT unnest(range(0, 3001, 50)) AS step) s JOIN (SELECT name AS stage, min(start_training_step) AS start FROM data_stages GROUP BY name) g ON g.start <= s.step GROUP BY 1""")
def stage_at_step(spark: SparkSession, folder: str) -> DataFrame:
    stages = table(spark, folder, "data_stages").groupBy(F.col("name").alias("stage")).agg(F.min("start_training_step").alias("start"))
    return S.latest_stage(spark.range(0, 3001, 50).withColumnRenamed("id", "step"), stages).select("step", "stage")


_LAST = """SELECT run_name, name, start_training_step, arg_max(consumed_tokens_per_dataset_folder, (last_train_step, saved_at, checkpoint_id)) AS f, arg_max(consumed_tokens_per_tokenizer, (last_train_step, saved_at, checkpoint_id)) AS t,
    max(last_train_step) AS last_train_step FROM data_stages GROUP BY 1, 2, 3"""


@query(f"SELECT run_name, folder, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT run_name, unnest(map_keys(f)) AS folder, unnest(map_values(f)) AS tokens FROM ({_LAST})) GROUP BY 1, 2")
def folder_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return _last(spark, folder).select("run_name", F.explode("f").alias("folder", "tokens")).groupBy("run_name", "folder").agg(F.sum("tokens").alias("tokens"))


def _last(spark: SparkSession, folder: str) -> DataFrame:
    at = F.struct("last_train_step", "saved_at", "checkpoint_id")
    return table(spark, folder, "data_stages").groupBy("run_name", "name", "start_training_step").agg(F.max_by("consumed_tokens_per_dataset_folder", at).alias("f"), F.max_by("consumed_tokens_per_tokenizer", at).alias("t"), F.max("last_train_step").alias("last_train_step"))


@query(f"SELECT tokenizer, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT unnest(map_keys(t)) AS tokenizer, unnest(map_values(t)) AS tokens FROM ({_LAST})) GROUP BY 1")
def consumption_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _last(spark, folder).select(F.explode("t").alias("tokenizer", "tokens")).groupBy("tokenizer").agg(F.sum("tokens").alias("tokens"))


@query(f"SELECT dataset, count(*) AS samples FROM ({_BLEND}) WHERE i >= 100 AND i < 300 GROUP BY 1")
def consumed_samples(spark: SparkSession, folder: str) -> DataFrame:
    return blend_index(spark, folder).where("i >= 100 AND i < 300").groupBy("dataset").agg(F.count("*").alias("samples"))


@query(f"SELECT CAST(k.d AS INTEGER) AS dataset, count(b.i) AS samples FROM (SELECT unnest([0, 1, 2, 3, 4]) AS d) k LEFT JOIN ({_BLEND}) b ON b.dataset = k.d GROUP BY 1")
def dataset_counts(spark: SparkSession, folder: str) -> DataFrame:
    ids = spark.range(5).select(F.col("id").cast("int").alias("dataset"))
    return ids.join(blend_index(spark, folder), "dataset", "left").groupBy("dataset").agg(F.count("i").alias("samples"))


@query("""SELECT checkpoint_id, coalesce(list_sum(map_values(consumed_tokens_per_dataset_folder)), 0)::BIGINT AS folder_tokens, consumed_train_samples * coalesce(sequence_length, 4096) AS expected,
    coalesce(list_sum(map_values(consumed_tokens_per_dataset_folder)), 0)::BIGINT = consumed_train_samples * coalesce(sequence_length, 4096) AS consistent FROM (SELECT DISTINCT ON (checkpoint_id) * FROM data_stages ORDER BY checkpoint_id)""")
def counter_check(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "data_stages").groupBy("checkpoint_id").agg(*(F.first(c).alias(c) for c in ("consumed_tokens_per_dataset_folder", "consumed_train_samples", "sequence_length")))
    total = F.aggregate(F.coalesce(F.map_values("consumed_tokens_per_dataset_folder"), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    expected = F.col("consumed_train_samples") * F.coalesce("sequence_length", F.lit(4096))
    return d.select("checkpoint_id", total.alias("folder_tokens"), expected.alias("expected"), (total == expected).alias("consistent"))
