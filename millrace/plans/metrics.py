"""Queries of metrics, with their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.tokenizers import fingerprints
from millrace.operators import metrics as M
from millrace.operators.hotkeys import once
from millrace.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _nll(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "nll_documents"), ["run_name", "doc_id"], ["endpoint_id", "source_bytes", "predicted_tokens", "nll_sum_nats"])


_NLL = "SELECT run_name, doc_id, min(endpoint_id) AS endpoint_id, min(source_bytes) AS b, min(predicted_tokens) AS t, min(nll_sum_nats) AS x FROM nll_documents GROUP BY 1, 2"


@query(f"""SELECT run_name, endpoint_id, CAST(grouping(run_name, endpoint_id) AS BIGINT) AS level, count(*) AS documents, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(b) AS BIGINT) AS bytes, round(sum(x), 4) AS nats, round(sum(x) / sum(t), 8) AS nats_per_token,
    CASE WHEN sum(x) / sum(t) < 80 THEN round(exp(sum(x) / sum(t)), 6) END AS perplexity, round(sum(x) / sum(b), 8) AS nats_per_byte, round(sum(x) / sum(b) / ln(2), 8) AS bits_per_byte FROM ({_NLL}) WHERE x IS NOT NULL GROUP BY ROLLUP (run_name, endpoint_id)""")
def nll_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return M.likelihood(_nll(spark, folder), ["run_name", "endpoint_id"])


@query()
def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    rows = _nll(spark, folder).groupBy("doc_id").agg(F.sum("source_bytes").alias("b"), F.sum("predicted_tokens").alias("t"))
    return M.bootstrap_ratio(rows, "doc_id", "b", "t")


@query("SELECT quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high, quantile_cont(x, 0.5) AS middle FROM (SELECT CAST(source_bytes AS DOUBLE) AS x FROM nll_documents)")
def linear_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "nll_documents").select(F.col("source_bytes").cast("double").alias("x"))
    return x.agg(F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"), F.percentile("x", 0.5).alias("middle"))


_DOMAIN = f"SELECT coalesce(endpoint_id, 0) % 5 AS domain, x / t AS loss, ln(b + 1) / 3 AS ref FROM ({_NLL}) WHERE x IS NOT NULL AND t > 0"


def _losses(spark: SparkSession, folder: str) -> DataFrame:
    rows = _nll(spark, folder).where("nll_sum_nats IS NOT NULL AND predicted_tokens > 0")
    return rows.select((F.coalesce("endpoint_id", F.lit(0)) % 5).cast("int").alias("domain"), (F.col("nll_sum_nats") / F.col("predicted_tokens")).alias("l"), (F.ln(F.col("source_bytes") + 1) / 3).alias("ref"))


_EXCESS = f"""SELECT CAST(k.d AS INTEGER) AS domain, count(l.loss) AS samples, coalesce(sum(greatest(l.loss - l.ref, 0)) / nullif(count(l.loss), 0), 0) AS loss FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS d) k LEFT JOIN ({_DOMAIN}) l ON l.domain = k.d GROUP BY 1"""


def _excess(spark: SparkSession, folder: str) -> DataFrame:
    rows = _losses(spark, folder).withColumn("loss", F.greatest(F.col("l") - F.col("ref"), F.lit(0.0)))
    return M.domain_losses(rows, 6)


@query(f"SELECT domain, samples, round(loss, 8) AS loss FROM ({_EXCESS})")
def domain_loss(spark: SparkSession, folder: str) -> DataFrame:
    return _excess(spark, folder).withColumn("loss", F.round("loss", 8))


@query(f"""WITH e AS ({_EXCESS}), l AS (SELECT domain, loss, [0.3, 0.2, 0.2, 0.1, 0.1, 0.1][domain + 1] * exp(loss) AS u FROM e), w AS (SELECT domain, loss, 0.999 * u / sum(u) OVER () + 0.001 / 6 AS weight FROM l)
    SELECT domain, round(loss, 8) AS loss, round(weight, 8) AS weight, round(sum(weight * loss) OVER (), 8) AS dro FROM w""")
def domain_reweight(spark: SparkSession, folder: str) -> DataFrame:
    out = M.reweighted(_excess(spark, folder), [0.3, 0.2, 0.2, 0.1, 0.1, 0.1])
    return out.select("domain", *(F.round(c, 8).alias(c) for c in ("loss", "weight", "dro")))


@query(f"SELECT CAST(domain AS INTEGER) AS domain, round(count(*) / (SELECT count(*) FROM ({_DOMAIN})), 9) AS weight FROM ({_DOMAIN}) GROUP BY 1")
def domain_weights(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window as W

    per = _losses(spark, folder).groupBy("domain").agg(F.count("*").alias("n"))
    return per.select("domain", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 9).alias("weight"))


@query("""WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max, sum(abs(x)) AS l1, sqrt(sum(x * x)) AS l2, avg((abs(x) < 1e-10)::INT) AS zeros FROM v GROUP BY 1),
    k AS (SELECT v.label, sum(pow(x - mean, 4)) AS m4 FROM v JOIN m ON v.label = m.label GROUP BY 1)
    SELECT m.label, n, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(l1, 3) AS l1, round(l2, 4) AS l2, round(zeros, 6) AS zeros, round(m4 / n / pow(std, 4) - 3, 5) AS kurtosis FROM m JOIN k ON m.label = k.label""")
def tensor_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("label", F.explode("embedding").alias("x"))
    digits = {"mean": 6, "std": 6, "min": 6, "max": 6, "l1": 3, "l2": 4, "zeros": 6, "kurtosis": 5}
    return M.tensor_statistics(rows, "label", "x").select("label", "n", *(F.round(c, d).alias(c) for c, d in digits.items()))


@query("""WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings), m AS (SELECT vec_id, max(x) AS m FROM v GROUP BY 1), z AS (SELECT v.vec_id, any_value(m.m) + ln(sum(exp(x - m.m))) AS log_z, sum(CASE WHEN i = label THEN x END) AS t FROM v JOIN m ON v.vec_id = m.vec_id GROUP BY 1)
    SELECT vec_id, round(log_z - t, 6) AS loss, round(log_z, 6) AS log_z, round(1e-4 * pow(greatest(least(log_z, 20), -20), 2), 8) AS z_loss FROM z""")
def softmax_loss(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    out = M.cross_entropy(rows, "vec_id", "x", F.col("i") == F.col("label"))
    return out.select("vec_id", F.round("loss", 6).alias("loss"), F.round("log_z", 6).alias("log_z"), F.round("z_loss", 8).alias("z_loss"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)
    SELECT vec_id, CAST(i AS INTEGER) AS expert, round(exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id), 6) AS weight FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) <= 2""")
def top_k_routes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", F.explode(M.top_k_routing(F.col("embedding"), 2)).alias("s"))
    return rows.select("vec_id", F.col("s.expert").alias("expert"), F.round("s.weight", 6).alias("weight"))


@query("SELECT l_returnflag, CASE WHEN sum((l_linestatus = 'O')::INT) > 0 THEN round(sum(CASE WHEN l_linestatus = 'O' THEN l_discount ELSE 0 END) / sum((l_linestatus = 'O')::INT), 9) ELSE 'nan'::DOUBLE END AS mean FROM lineitem GROUP BY 1")
def masked_means(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.round(M.masked_mean(F.col("l_discount"), F.col("l_linestatus") == "O"), 9).alias("mean"))




@query("""SELECT run_name, step, loss, round(avg(loss) OVER (PARTITION BY run_name ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9) AS mean FROM
    (SELECT run_name, doc_id // 50 AS step, round(arg_max(nll_sum_nats, (doc_id, nll_sum_nats)) / 1000, 6) AS loss FROM nll_documents WHERE nll_sum_nats IS NOT NULL GROUP BY 1, 2)""")
def moving_average(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "nll_documents").where("nll_sum_nats IS NOT NULL")
    steps = rows.groupBy("run_name", F.expr("doc_id div 50").alias("step")).agg(F.round(F.max_by("nll_sum_nats", F.struct("doc_id", "nll_sum_nats")) / 1000, 6).alias("loss"))
    return steps.withColumn("mean", F.round(M.trailing_mean(F.col("loss"), "step", 10, ["run_name"]), 9))


@query("SELECT id, vocab_size, CAST(ceil(vocab_size / 24.0) * 24 AS BIGINT) AS by_lcm, CAST(ceil(vocab_size / 96.0) * 96 AS BIGINT) AS by_product, CAST(CASE WHEN vocab_size <= 65535 THEN 2 ELSE 4 END AS INTEGER) AS width FROM registry")
def vocabulary_padding(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("vocab_size")
    return table(spark, folder, "registry").select("id", "vocab_size", M.padded_vocabulary(v, 8, 12).alias("by_lcm"), M.padded_vocabulary(v, 8, 12, "product").alias("by_product"), M.storage_bytes(v).alias("width"))


@query("SELECT id, CAST(vocab_size * 256 + 12 * (4 * 256 * 256 + 3 * 256 * 704 + 2 * 256) + 256 AS BIGINT) AS parameters FROM registry")
def parameter_counts(spark: SparkSession, folder: str) -> DataFrame:
    n = M.parameter_estimate(F.lit(12), F.lit(256), F.col("vocab_size").cast("bigint"), F.lit(704))
    return table(spark, folder, "registry").select("id", n.cast("bigint").alias("parameters"))


@query("""WITH w AS (SELECT DISTINCT CAST(id AS BIGINT) AS worker FROM registry), r AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS rank FROM part),
    t AS (SELECT rank, list_reduce([CAST(1 AS BIGINT)] || list_transform(range(0, 1 + rank), lambda i: CAST(3 AS BIGINT)), lambda a, b: a * b % 4294967296) AS three FROM r)
    SELECT worker, rank, CAST((CAST(1 AS HUGEINT) << CAST(1 + worker AS INTEGER)) % 4294967296 * three % 4294967296 AS BIGINT) AS seed FROM w, t""")
def worker_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds of a worker for each tokenizer on a rank for each size of part (1 to 50), every pair."""
    workers = table(spark, folder, "registry").select(F.col("id").cast("bigint").alias("worker")).distinct()
    ranks = table(spark, folder, "part").agg(F.collect_set(F.col("p_size").cast("bigint")).alias("ranks"))  # one row of at most 50 sizes
    grid = workers.join(F.broadcast(ranks), F.lit(True)).select("worker", F.explode("ranks").alias("rank"))
    return grid.withColumn("seed", M.worker_seed(F.col("worker"), F.col("rank")))


@query("SELECT id, CAST(6 * 4096 * (12 * (256 * (2 * 256 + 2 * 2 * 32) + 2 * 4096 * 256 + 3 * 256 * 704) + 256 * CAST(vocab_size AS BIGINT)) AS BIGINT) AS flops FROM registry")
def flop_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """Operations of a training step on one sequence, for each tokenizer's vocabulary."""
    n = lambda x: F.lit(x).cast("bigint")
    return table(spark, folder, "registry").select("id", M.flops_estimate(n(12), n(256), n(8), n(2), F.col("vocab_size").cast("bigint"), n(4096), n(704)).alias("flops"))


_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@query(f"""SELECT tokenizer_name_or_path AS path, name AS revision, 'sha256:' || sha256(name || tokenizer_name_or_path) AS fingerprint FROM registry WHERE tokenizer_name_or_path IS NOT NULL
    UNION ALL SELECT filename, NULL, 'sha256:' || sha256('byte_bpe_50k.json'::BLOB || content) FROM read_blob('{_TOKENIZER}')""")
def tokenizer_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of the registry's tokenizers (no artefacts there, so of their paths) and of a vocabulary file, name standing for the revision."""
    named = table(spark, folder, "registry").select(F.col("tokenizer_name_or_path").alias("path"), F.col("name").alias("revision"))
    return fingerprints(spark, named.unionByName(spark.createDataFrame([(_TOKENIZER, None)], "path string, revision string"))).drop("artefacts")


@query("SELECT p AS prefix, coalesce((SELECT avg(p_retailprice) FROM part WHERE contains(replace(p_type, ' ', ':'), p || ':')), 0) AS average FROM (SELECT unnest(['PROMO', 'ECONOMY', 'NONE']) AS p)")
def benchmark_averages(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select(F.replace("p_type", F.lit(" "), F.lit(":")).alias("name"), "p_retailprice")
    return M.prefix_averages(rows, "name", "p_retailprice", ["PROMO", "ECONOMY", "NONE"])


@query("SELECT checkpoint_id, CASE WHEN s > 0 THEN round(tokens / s, 4) END AS tokens_per_second FROM (SELECT checkpoint_id, max(consumed_train_samples * coalesce(sequence_length, 4096)) AS tokens, max(hour(saved_at) * 3600 + minute(saved_at) * 60 + second(saved_at)) AS s FROM data_stages GROUP BY 1)")
def throughput(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "data_stages").groupBy("checkpoint_id").agg(F.max(F.col("consumed_train_samples") * F.coalesce("sequence_length", F.lit(4096))).alias("tokens"), F.max(F.expr("hour(saved_at) * 3600 + minute(saved_at) * 60 + second(saved_at)")).alias("s"))
    return d.select("checkpoint_id", F.when(F.col("s") > 0, F.round(F.col("tokens") / F.col("s"), 4)).alias("tokens_per_second"))


@query("SELECT source, CAST(sum(consumed) AS BIGINT) AS needed, any_value(available) AS available, sum(consumed) <= any_value(available) AS enough FROM (SELECT m.source AS source, floor(100000 * m.target_weight) AS consumed, coalesce(c.n, 0) AS available FROM mixture_targets m LEFT JOIN (SELECT source, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n FROM (SELECT ord, min(source) AS source, min(token_count) AS n FROM curated GROUP BY ord) GROUP BY 1) c ON m.source = c.source) GROUP BY 1")
def capacity_check(spark: SparkSession, folder: str) -> DataFrame:
    have = once(table(spark, folder, "curated"), ["ord"], ["source", "token_count"]).groupBy("source").agg(F.sum(F.coalesce("token_count", F.lit(0))).alias("n"))
    need = table(spark, folder, "mixture_targets").select("source", F.floor(F.lit(100_000) * F.col("target_weight")).alias("needed"))
    out = need.join(have, "source", "left").select("source", "needed", F.coalesce("n", F.lit(0)).alias("available"))
    return out.withColumn("enough", F.col("needed") <= F.col("available"))


@query("""SELECT coalesce(r.id, CAST(t.k AS INTEGER)) AS tokenizer_id, r.id IS NOT NULL AS registered, t.k IS NOT NULL AS present, r.tokenizer_name_or_path IS NULL AND r.id IS NOT NULL AS unresolved FROM registry r FULL OUTER JOIN (SELECT DISTINCT tokenizer_id AS k FROM routed_documents WHERE tokenizer_id IS NOT NULL) t ON r.id = t.k""")
def manifest_check(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "registry").select("id", "tokenizer_name_or_path")
    t = table(spark, folder, "routed_documents").where("tokenizer_id IS NOT NULL").select(F.col("tokenizer_id").alias("k")).distinct()
    j = r.join(t, r.id == t.k, "full")
    return j.select(F.coalesce("id", "k").alias("tokenizer_id"), F.col("id").isNotNull().alias("registered"), F.col("k").isNotNull().alias("present"), (F.col("tokenizer_name_or_path").isNull() & F.col("id").isNotNull()).alias("unresolved"))


@query("""SELECT sha256(string_agg(h, '' ORDER BY block)) AS digest, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT ord // 4096 AS block, sha256(string_agg(sha256(coalesce(text, '')), '' ORDER BY ord)) AS h, count(*) AS n FROM (SELECT ord, any_value(text) AS text FROM curated GROUP BY ord) GROUP BY 1)""")
def stream_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Three levels: digests of the texts, of each block of 4,096 of them in order, and of the blocks; a task holds a block's digests, never its texts."""
    once_ = table(spark, folder, "curated").groupBy("ord").agg(F.first("text").alias("text"))
    joined = lambda c, key, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, c))), lambda s: s[c]), sep)
    blocks = once_.select("ord", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text")).groupBy(F.expr("ord div 4096").alias("block")).agg(F.sha2(joined("text", "ord", ""), 256).alias("h"), F.count("*").alias("n"))
    return blocks.agg(F.sha2(joined("h", "block", ""), 256).alias("digest"), F.sum("n").alias("rows"))


@query("""SELECT doc_id, CAST(k AS INTEGER) AS k, sha256('5:' || doc_id || ':' || k) AS digest FROM (SELECT DISTINCT doc_id FROM evaluation_documents), (SELECT unnest([0, 1, 2]) AS k) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sha256('5:' || doc_id || ':' || k)) = 1""")
def stable_ties(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "evaluation_documents").select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    rows = rows.withColumn("digest", F.sha2(F.concat_ws(":", F.lit("5"), F.col("doc_id"), F.col("k")), 256))
    return rows.groupBy("doc_id").agg(F.min(F.struct("digest", "k")).alias("m")).select("doc_id", "m.k", "m.digest")


@query("""SELECT source, printf('%+.2f%%', (a / b - 1) * 100) AS change, replace(regexp_replace(source, '^.*/', ''), '_', ' ') AS label FROM (SELECT source, sum(octet_length(encode(text))) AS a, sum(length(text)) AS b FROM documents WHERE text IS NOT NULL GROUP BY 1)""")
def report_labels(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("text IS NOT NULL").groupBy("source").agg(F.sum(F.octet_length("text")).alias("a"), F.sum(F.char_length("text")).alias("b"))
    return d.select("source", M.format_percent(F.col("a") / F.col("b") - 1).alias("change"), F.translate(F.regexp_replace("source", "^.*/", ""), "_", " ").alias("label"))


@query("""WITH l AS (SELECT 'iteration: ' || s || ' / 9537 | lm_loss: ' || v AS line, i FROM (SELECT doc_id // 40 AS s, printf('%.4f', nll_sum_nats / 100) AS v, row_number() OVER (ORDER BY run_name, doc_id, nll_sum_nats) AS i FROM (SELECT DISTINCT run_name, doc_id, nll_sum_nats FROM nll_documents WHERE nll_sum_nats IS NOT NULL)))
    SELECT regexp_extract(line, 'iteration: (\\d+)', 1)::BIGINT AS step, arg_max(regexp_extract(line, 'lm_loss: ([0-9.]+)', 1)::DOUBLE, i) AS loss FROM l GROUP BY 1""")
def training_log(spark: SparkSession, folder: str) -> DataFrame:
    from millrace.operators.hotkeys import ranked
    from millrace.sources.logs import losses

    rows = table(spark, folder, "nll_documents").where("nll_sum_nats IS NOT NULL").select("run_name", "doc_id", "nll_sum_nats").distinct().withColumn("all", F.lit(0))
    placed = ranked(rows, "all", ["run_name", "doc_id", "nll_sum_nats"])
    line = F.format_string("\x1b[32miteration: %d / 9537 | lm_loss: %.4f\x1b[0m", F.expr("doc_id div 40"), F.col("nll_sum_nats") / 100)
    return losses(placed.select(line.alias("value"), F.col("position").alias("line_no")))


@query("SELECT source, round(sum(CASE WHEN k = 1 THEN b ELSE 0 END) * 100.0 / sum(b), 2) AS cached FROM (SELECT source, octet_length(encode(text)) AS b, doc_id % 3 = 0 AS k FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def cache_share(spark: SparkSession, folder: str) -> DataFrame:
    from millrace.sources.logs import cached_share

    rows = table(spark, folder, "documents").where("text IS NOT NULL").select(F.concat_ws(" ", F.col("source"), F.octet_length("text"), F.lit("B"), F.when(F.col("doc_id") % 3 == 0, F.octet_length("text")).otherwise(0), F.lit("B")).alias("value"))
    return cached_share(rows).select(F.col("path").alias("source"), "cached")


