"""Queries of selections, candidates, samplers and formats, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import byte_length
from millrace.operators import blending as B
from millrace.operators import metrics as M
from millrace.operators import packing as P
from millrace.operators.hotkeys import once, ranked
from millrace.operators.prefix import running_before
from millrace.plans.routing import SQL as ROUTING_SQL
from millrace.plans.routing import _R, _routed, merge_proxy
from millrace.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT source, doc_id FROM documents WHERE octet_length(encode(text)) >= 128 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20")
def first_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The first 20 long enough documents of each source."""
    rows = table(spark, folder, "documents").where(byte_length("text") >= 128).select("source", "doc_id", F.lit(1).alias("one"))
    return running_before(rows, ["source"], "doc_id", ["doc_id"], "one").where("before < 20").select("source", "doc_id")


@query(f"SELECT expert_id, CAST(sum(tokens) AS DOUBLE) / greatest(sum(bytes), 1) AS priority, count(*) AS documents FROM ({_R}) GROUP BY 1 HAVING count(*) >= 40 ORDER BY priority DESC, expert_id DESC LIMIT 2")
def split_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The two experts most worth splitting: most tokens a byte first, then the higher number; those with fewer than twice 20 documents are passed over."""
    per = _routed(spark, folder).groupBy("expert_id").agg((F.sum("tokens").cast("double") / F.greatest(F.sum("bytes"), F.lit(1))).alias("priority"), F.count("*").alias("documents"))
    return per.where("documents >= 40").orderBy(F.desc("priority"), F.desc("expert_id")).limit(2)


@query(f"SELECT a, b, proxy FROM ({ROUTING_SQL['merge_proxy']}) ORDER BY proxy, a, b LIMIT 4")
def merge_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The four pairs of experts whose merge costs least."""
    return merge_proxy(spark, folder).orderBy("proxy", "a", "b").limit(4)


@query("SELECT doc_id, i // 16 AS batch FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i // 16 % 5 = 0 AND i // 16 < 50")
def sampled_inspection(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of every fifth batch of 16, ten batches."""
    rows = ranked(table(spark, folder, "documents").select("doc_id").withColumn("all", F.lit(0)), "all", ["doc_id"])
    batch = F.expr("(position - 1) div 16")
    return rows.where((batch % 5 == 0) & (batch < 50)).select("doc_id", batch.alias("batch"))


_QUOTA = """WITH x AS (SELECT source, target_weight / sum(target_weight) OVER () * 1000 AS x FROM mixture_targets), r AS (SELECT source, floor(x) AS f, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, source) AS r FROM x),
    q AS (SELECT source, CAST(f + CASE WHEN r <= 1000 - (SELECT sum(f) FROM r) THEN 1 ELSE 0 END AS BIGINT) AS n FROM r)"""


@query(_QUOTA + "SELECT row_number() OVER (ORDER BY sha256('3:' || source || ':' || k), source, k) - 1 AS i, source, k AS sample FROM (SELECT source, unnest(range(0, n)) AS k FROM q)")
def sequential_index(spark: SparkSession, folder: str) -> DataFrame:
    """A blend of 1,000 samples by largest remainders: datasets in a digest's order, each dataset's samples numbered from 0."""
    quota = B.largest_remainder(table(spark, folder, "mixture_targets").select("source", "target_weight"), "target_weight", 1000, "source").where("count > 0")
    rows = quota.select("source", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1)).alias("sample"), F.lit(0).alias("all"))
    rows = rows.withColumn("h", F.sha2(F.concat_ws(":", F.lit("3"), "source", "sample"), 256))
    return ranked(rows, "all", ["h", "source", "sample"]).select((F.col("position") - 1).alias("i"), "source", "sample")


@query("SELECT CAST(i % 4 AS INTEGER) AS rank, CAST(e AS INTEGER) AS epoch, i AS sample, row_number() OVER (PARTITION BY i % 4, e ORDER BY sha256(e || ':' || i), i) - 1 AS position FROM (SELECT unnest(range(0, 400)) AS i), (SELECT unnest([0, 1]) AS e)")
def random_sampler(spark: SparkSession, folder: str) -> DataFrame:
    """Each rank's samples in an order of their own each epoch."""
    rows = spark.range(400).select(F.col("id").alias("sample"), (F.col("id") % 4).cast("int").alias("rank"), F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch"))
    rows = rows.withColumn("h", F.sha2(F.concat_ws(":", "epoch", "sample"), 256)).withColumn("k", F.col("epoch") * 4 + F.col("rank"))
    return ranked(rows, "k", ["h", "sample"]).select("rank", "epoch", "sample", (F.col("position") - 1).alias("position"))


@query("""SELECT folder, round(avg(w), 9) AS weight FROM (SELECT unnest(map_keys(m)) AS folder, unnest(map_values(m)) / list_sum(map_values(m)) AS w FROM (SELECT checkpoint_id, any_value(consumed_tokens_per_dataset_folder) AS m FROM data_stages GROUP BY 1)) GROUP BY 1""")
def mean_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Mean share of each folder over all checkpoints that have it."""
    rows = table(spark, folder, "data_stages").groupBy("checkpoint_id").agg(F.first("consumed_tokens_per_dataset_folder").alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(total.alias("t"), F.explode("m").alias("folder", "n")).groupBy("folder").agg(F.round(F.avg(F.try_divide(F.col("n").cast("double"), F.col("t"))), 9).alias("weight"))


@query("""SELECT run_name, doc_id // 64 AS batch, sha256('[' || string_agg(doc_id || ':' || coalesce(t, -1), ',' ORDER BY doc_id) || ']') AS digest FROM (SELECT run_name, doc_id, min(predicted_tokens) AS t FROM nll_documents GROUP BY 1, 2) GROUP BY 1, 2""")
def batch_hash(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of each batch's rows in order; a batch is bounded, so its rows may meet."""
    rows = once(table(spark, folder, "nll_documents"), ["run_name", "doc_id"], ["predicted_tokens"])
    item = F.struct("doc_id", F.concat_ws(":", "doc_id", F.coalesce("predicted_tokens", F.lit(-1))).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), ",")
    return rows.groupBy("run_name", F.expr("doc_id div 64").alias("batch")).agg(F.sha2(F.concat(F.lit("["), joined, F.lit("]")), 256).alias("digest"))


@query("""WITH n AS (SELECT DISTINCT n FROM (SELECT raw_bytes AS n FROM routed_documents UNION ALL SELECT CAST(sum(raw_bytes) AS BIGINT) FROM routed_documents GROUP BY tokenizer_id) WHERE n IS NOT NULL),
    d AS (SELECT n, length(abs(n)::VARCHAR) - 1 AS most FROM n), v AS (SELECT n, CASE WHEN most >= 2 THEN round_even(n / 10.0 ** (most - 2), 0) * 10.0 ** (most - 2) ELSE n END AS v FROM d),
    u AS (SELECT n, v, CAST((length(CAST(abs(v) AS BIGINT)::VARCHAR) - 1) // 3 AS INTEGER) AS u FROM v)
    SELECT n, regexp_replace(printf('%.9f', v / 1000.0 ** u), '\\.?0+$', '') || ['', 'K', 'M', 'B', 'T', 'P', 'E'][u + 1] AS text FROM u""")
def human_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Every number of bytes of a route and of a tokenizer, as it is logged."""
    rows = table(spark, folder, "routed_documents")
    sums = rows.groupBy("tokenizer_id").agg(F.sum("raw_bytes").alias("n")).select("n")
    return rows.select(F.col("raw_bytes").alias("n")).unionByName(sums).where("n IS NOT NULL").distinct().withColumn("text", M.human_format(F.col("n")))


@query("""WITH t AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS x FROM (SELECT doc_id, list_transform(string_split(text, ' '), lambda s: length(s)) AS w FROM documents WHERE text IS NOT NULL)),
    f AS (SELECT doc_id, coalesce(min(CASE WHEN x <> 0 THEN i END), count(*)) AS lead FROM t GROUP BY 1) SELECT t.doc_id, CAST(sum(greatest(i - lead, 0)) AS BIGINT) AS positions, any_value(CAST(lead AS BIGINT)) AS padding FROM t JOIN f ON t.doc_id = f.doc_id GROUP BY 1""")
def padded_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Sum of the positions of each sequence that begins with padding (0), and the padding's length."""
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.transform(F.split("text", " ", -1), F.length).alias("ids"))
    at = P.left_padded_positions(F.col("ids"), 0)
    lead = F.coalesce(F.array_position(F.transform("ids", lambda x: x != 0), True), F.lit(0))
    sums = F.aggregate(at, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("doc_id", sums.alias("positions"), F.when(lead > 0, lead - 1).otherwise(F.size("ids")).cast("bigint").alias("padding"))


@query("""SELECT CAST(coalesce(a.k, b.k) AS INTEGER) AS tokenizer_id, a.k IS NOT NULL AS routed, b.k IS NOT NULL AS scored FROM (SELECT DISTINCT tokenizer_id AS k FROM routed_documents WHERE tokenizer_id IS NOT NULL) a FULL JOIN (SELECT DISTINCT endpoint_id AS k FROM nll_documents WHERE endpoint_id IS NOT NULL) b ON a.k = b.k""")
def id_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Ids on either side; the sets are equal if every row has both marks."""
    a = table(spark, folder, "routed_documents").where("tokenizer_id IS NOT NULL").select(F.col("tokenizer_id").alias("a")).distinct()
    b = table(spark, folder, "nll_documents").where("endpoint_id IS NOT NULL").select(F.col("endpoint_id").alias("b")).distinct()
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("tokenizer_id"), F.col("a").isNotNull().alias("routed"), F.col("b").isNotNull().alias("scored"))


@query("SELECT source, doc_id, CAST(least(raw_bytes, 2000) AS BIGINT) AS clipped, CASE WHEN raw_bytes <> b THEN true ELSE false END AS wrong FROM (SELECT doc_id, any_value(source) AS source, any_value(raw_bytes) AS raw_bytes, octet_length(encode(any_value(text))) AS b FROM evaluation_documents GROUP BY 1) WHERE raw_bytes IS NOT NULL")
def trusted_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded sizes against the texts' own."""
    rows = table(spark, folder, "evaluation_documents").groupBy("doc_id").agg(*(F.first(c).alias(c) for c in ("source", "raw_bytes", "text"))).where("raw_bytes IS NOT NULL")
    return rows.select("source", "doc_id", F.least("raw_bytes", F.lit(2000).cast("bigint")).alias("clipped"), F.coalesce(F.col("raw_bytes") != byte_length("text"), F.lit(False)).alias("wrong"))
