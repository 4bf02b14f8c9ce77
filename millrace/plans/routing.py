"""Queries of routing and tokenizer metrics, with their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import byte_length, sql_budget_tokens
from millrace.operators import discovery as D
from millrace.operators import routing as R
from millrace.session import spread, stored, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _costs(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "documents").select("doc_id", "source", "lang", "text")).where("text IS NOT NULL")
    return rows.select("doc_id", "source", byte_length("text").cast("bigint").alias("bytes"), R.native_costs("text").alias("costs"))


def _routed(spark: SparkSession, folder: str) -> DataFrame:
    c = _costs(spark, folder).withColumn("expert_id", R.route("costs"))
    return c.withColumn("tokens", R.cost_of("costs", "expert_id"))


_C = f"""SELECT doc_id, source, octet_length(encode(text)) AS bytes, [{sql_budget_tokens('text')}, CAST(ceil(length(text) / 3.0) AS BIGINT), CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT)] AS costs FROM documents WHERE text IS NOT NULL"""
_R = f"SELECT *, CAST(list_position(costs, list_min(costs)) - 1 AS INTEGER) AS expert_id, list_min(costs) AS tokens FROM ({_C})"
_K = "(SELECT unnest([0, 1, 2]) AS expert_id)"


@query(f"SELECT doc_id, CAST(k AS INTEGER) AS expert_id, costs[k + 1] AS tokens FROM ({_C}), (SELECT unnest([0, 1, 2]) AS k)")
def expert_costs(spark: SparkSession, folder: str) -> DataFrame:
    return R.long_costs(_costs(spark, folder), "doc_id", "costs")


@query(f"SELECT doc_id, expert_id, tokens FROM ({_R})")
def oracle_route(spark: SparkSession, folder: str) -> DataFrame:
    return _routed(spark, folder).select("doc_id", "expert_id", "tokens")


@query(f"SELECT k.expert_id AS expert_id, count(r.doc_id) AS documents FROM {_K} k LEFT JOIN ({_R}) r ON r.expert_id = k.expert_id GROUP BY 1")
def route_counts(spark: SparkSession, folder: str) -> DataFrame:
    ids = spark.range(3).select(F.col("id").cast("int").alias("expert_id"))
    per = _routed(spark, folder).groupBy("expert_id").agg(F.count("*").alias("n"))
    return ids.join(per, "expert_id", "left").select("expert_id", F.coalesce("n", F.lit(0)).alias("documents"))


@query("""SELECT CAST(count(*) AS BIGINT) AS documents, CAST(count(s.doc_id) AS BIGINT) AS assigned, CAST(count(*) - count(s.doc_id) AS BIGINT) AS missing
    FROM (SELECT DISTINCT doc_id FROM evaluation_documents) e LEFT JOIN (SELECT DISTINCT doc_id FROM subject_labels) s ON e.doc_id = s.doc_id""")
def assignment_check(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "evaluation_documents").select("doc_id").distinct()
    s = table(spark, folder, "subject_labels").select(F.col("doc_id").alias("d")).distinct()
    j = e.join(s, e.doc_id == s.d, "left")
    return j.agg(F.count("*").alias("documents"), F.count("d").alias("assigned"), (F.count("*") - F.count("d")).alias("missing"))


_PRIOR = f"""SELECT expert_id, bytes, (bytes + 1) / (sum(bytes) OVER () + 3) AS prior,
    bytes / sum(bytes) OVER () >= 0.01 AS active FROM (SELECT k.expert_id AS expert_id, CAST(coalesce(sum(r.bytes), 0) AS BIGINT) AS bytes FROM {_K} k LEFT JOIN ({_R}) r ON r.expert_id = k.expert_id GROUP BY 1)"""


@query(f"SELECT expert_id, bytes, round(prior, 9) AS prior, active FROM ({_PRIOR})")
def expert_priors(spark: SparkSession, folder: str) -> DataFrame:
    return R.priors(_routed(spark, folder), 3).withColumn("prior", F.round("prior", 9))


@query(f"""WITH r AS ({_R}) SELECT CAST(sum(tokens) AS BIGINT) AS tokens, count(DISTINCT expert_id) AS experts, round(greatest(8192.0, sum(tokens) * 0.005::DOUBLE), 6)::DOUBLE AS penalty,
    round(sum(tokens) + greatest(8192.0, sum(tokens) * 0.005::DOUBLE) * count(DISTINCT expert_id), 6)::DOUBLE AS objective FROM r""")
def mdl_objective(spark: SparkSession, folder: str) -> DataFrame:
    out = _routed(spark, folder).agg(F.sum("tokens").alias("tokens"), F.count_distinct("expert_id").alias("experts"))
    penalty = F.greatest(F.lit(8192.0), F.col("tokens") * 0.005)
    return out.select("tokens", "experts", F.round(penalty, 6).alias("penalty"), F.round(F.col("tokens") + penalty * F.col("experts"), 6).alias("objective"))


_ADJ = "[c.costs[1] - 8 * ln(0.5), c.costs[2] - 8 * ln(0.3), c.costs[3] - 8 * ln(0.2)]"


@query(f"""WITH b AS (SELECT k.e, coalesce(sum(r.bytes), 0) AS b FROM (SELECT unnest([0, 1, 2]) AS e) k LEFT JOIN ({_R}) r ON r.expert_id = k.e GROUP BY 1),
    x AS (SELECT list(CASE WHEN ok THEN -8 * ln(prior) ELSE 'inf'::DOUBLE END ORDER BY e) AS extra FROM (SELECT e, (b + 1) / (sum(b) OVER () + 3) AS prior, b / sum(b) OVER () >= 0.05 AS ok FROM b))
    SELECT doc_id, CAST(list_position(a, list_min(a)) - 1 AS INTEGER) AS expert_id, round(list_min(a), 6) AS cost FROM (SELECT doc_id, list_transform([1, 2, 3], lambda i: c.costs[i] + x.extra[i]) AS a FROM ({_C}) c, x)""")
def hard_assign(spark: SparkSession, folder: str) -> DataFrame:
    """The cheapest expert of every document by costs and the experts' use; experts with less than a twentieth of the bytes are dropped."""
    usage = R.priors(_routed(spark, folder), 3, least=0.05).orderBy("expert_id").collect()  # a row an expert
    a = _costs(spark, folder).select("doc_id", R.prior_costs(F.col("costs").cast("array<double>"), [r.prior for r in usage], [r.active for r in usage]).alias("a"))
    return a.select("doc_id", R.route("a").alias("expert_id"), F.round(F.array_min("a"), 6).alias("cost"))


_SOFT = f"""SELECT doc_id, CAST(k AS INTEGER) AS expert_id, CASE WHEN r <= 2 THEN exp(l) ELSE 0 END / sum(CASE WHEN r <= 2 THEN exp(l) ELSE 0 END) OVER (PARTITION BY doc_id) AS weight FROM
    (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, k) AS r FROM
    (SELECT doc_id, k, -((costs[k + 1] - list_min(costs)) / greatest(list_min(costs), 1.0)) / 0.2 AS l FROM ({_C}), (SELECT unnest([0, 1, 2]) AS k)))"""


@query(f"SELECT doc_id, expert_id, round(weight, 9) AS weight FROM ({_SOFT})")
def soft_assign(spark: SparkSession, folder: str) -> DataFrame:
    w = _costs(spark, folder).select("doc_id", F.posexplode(R.soft_weights(F.col("costs").cast("array<double>"), 0.2)).alias("expert_id", "weight"))
    return w.withColumn("weight", F.round("weight", 9))


@query(f"""WITH r AS ({_R}), s AS ({_SOFT}), o AS (SELECT expert_id, count(*) AS documents, sum(bytes) AS bytes, sum(tokens) AS tokens FROM r GROUP BY 1),
    m AS (SELECT s.expert_id, sum(weight) AS mass, sum((weight > 0 AND s.expert_id <> r.expert_id)::INT) AS overlap FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY 1)
    SELECT k.expert_id, coalesce(documents, 0) AS documents, round(coalesce(mass, 0), 6) AS mass, CAST(coalesce(overlap, 0) AS BIGINT) AS overlap, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens,
    round(coalesce(bytes, 0) / greatest(coalesce(tokens, 0), 1), 9) AS bytes_per_token FROM {_K} k LEFT JOIN o ON o.expert_id = k.expert_id LEFT JOIN m ON m.expert_id = k.expert_id""")
def expert_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(_routed(spark, folder), "routed").withColumn("weights", R.soft_weights(F.col("costs").cast("array<double>"), 0.2))
    return R.expert_summary(rows, 3).withColumn("mass", F.round(F.col("mass").cast("double"), 6)).withColumn("bytes_per_token", F.round("bytes_per_token", 9))


_LEARN = f"""SELECT r.*, m.learned, r.costs[m.learned + 1] AS learned_tokens, r.costs[1] AS small, r.costs[3] AS large FROM ({_R}) r JOIN
    (SELECT source, arg_min(expert_id, (-n, expert_id)) AS learned FROM (SELECT source, expert_id, count(*) AS n FROM ({_R}) GROUP BY 1, 2) GROUP BY 1) m ON r.source = m.source"""


def _learned(spark: SparkSession, folder: str) -> DataFrame:
    r = stored(_routed(spark, folder), "routed")  # encoded once
    m = R.majority_router(r, "source", "expert_id")
    j = r.join(m, "source")
    return j.withColumn("learned_tokens", R.cost_of("costs", "learned")).withColumn("small", F.get("costs", F.lit(0))).withColumn("large", F.get("costs", F.lit(2)))


_METRIC = """count(*) AS documents, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(t) AS BIGINT) AS tokens, round(sum(bytes) / sum(t), 9) AS bytes_per_token, round(sum(t) * 1024 / sum(bytes), 9) AS tokens_per_kib,
    round(1 - sum(t) / sum(small), 9) AS reduction_small, round(1 - sum(t) / sum(large), 9) AS reduction_large, round(sum((t < small)::INT) / count(*), 9) AS win_rate, round(sum((t = small)::INT) / count(*), 9) AS tie_rate"""


@query(f"""WITH l AS ({_LEARN}), p AS (SELECT source, bytes, small, large, 'small' AS method, small AS t FROM l UNION ALL SELECT source, bytes, small, large, 'large', large FROM l
    UNION ALL SELECT source, bytes, small, large, 'learned', learned_tokens FROM l UNION ALL SELECT source, bytes, small, large, 'oracle', tokens FROM l)
    SELECT source, method, CAST(grouping(source) AS TINYINT) AS overall, {_METRIC} FROM p GROUP BY GROUPING SETS ((source, method), (method))""")
def method_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = _learned(spark, folder).select("source", "bytes", "small", "large", F.col("learned_tokens").alias("learned"), F.col("tokens").alias("oracle"))
    return R.method_metrics(rows, "source", "small", "large", ["small", "large", "learned", "oracle"])


@query(f"""WITH l AS ({_LEARN}), w AS (SELECT round(avg((learned = expert_id)::INT), 9) AS agreement, round(sum(learned_tokens) / greatest(sum(tokens), 1) - 1, 9) AS regret FROM l)
    SELECT k.expert_id, (SELECT count(*) FROM l WHERE learned = k.expert_id) AS learned_usage, (SELECT count(*) FROM l WHERE l.expert_id = k.expert_id) AS oracle_usage, agreement, regret FROM {_K} k, w""")
def router_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = _learned(spark, folder).select("learned", F.col("expert_id").alias("oracle"), "learned_tokens", F.col("tokens").alias("oracle_tokens"))
    return R.router_report(rows, 3)


@query(f"""WITH r AS ({_R}), p AS (SELECT * FROM (SELECT unnest([0, 0, 1]) AS a, unnest([1, 2, 2]) AS b))
    SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(sum(CASE WHEN expert_id = a THEN costs[b + 1] - costs[a + 1] ELSE costs[a + 1] - costs[b + 1] END) AS BIGINT) AS proxy
    FROM p, r WHERE r.expert_id IN (a, b) GROUP BY 1, 2 HAVING count(DISTINCT r.expert_id) = 2""")
def merge_proxy(spark: SparkSession, folder: str) -> DataFrame:
    return R.merge_proxies(_routed(spark, folder), 3)


@query(f"""WITH m AS (SELECT r.doc_id, r.expert_id, unnest(list_distinct(list_transform(regexp_extract_all(left(d.text, 20000), '[A-Za-z]{{4,}}'), lambda x: lower(x)))) AS marker FROM ({_R}) r JOIN documents d ON r.doc_id = d.doc_id),
    c AS (SELECT expert_id, marker, count(*) AS count FROM m GROUP BY 1, 2), g AS (SELECT marker, sum(count) AS g FROM c GROUP BY 1), n AS (SELECT expert_id, count(*) AS n FROM ({_R}) GROUP BY 1), t AS (SELECT sum(n) AS tn FROM n),
    s AS (SELECT c.expert_id, c.marker, c.count, round(ln(((c.count + 0.5) / (n.n + 1)) / ((g.g + 0.5) / (t.tn + 1))), 9) AS score FROM c JOIN g ON c.marker = g.marker JOIN n ON n.expert_id = c.expert_id, t WHERE c.count >= 2)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY expert_id ORDER BY score DESC, count DESC, marker DESC) AS INTEGER) AS rank FROM s) WHERE rank <= 20""")
def domain_markers(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "documents").select("doc_id", "text")).where("text IS NOT NULL")
    return R.domain_markers(rows.withColumn("expert_id", R.route(R.native_costs("text"))), "[A-Za-z]{4,}")


_W = "[A-Za-z]+"


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_W}')) AS token FROM documents WHERE text IS NOT NULL),
    v AS (SELECT doc_id, token, count(*) * greatest(ceil(length(token) / 3.0) - 1, 0.25) AS value FROM t GROUP BY 1, 2),
    k AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY value DESC, token DESC) <= 256)
    SELECT doc_id, token, value, round(value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)), 9) AS unit FROM k""")
def residual_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "documents").select("doc_id", "text")).where("text IS NOT NULL")
    tokens = rows.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_W), F.lit(0))).alias("token")).withColumn("pieces", F.ceil(F.length("token") / 3))
    return R.residual_features(tokens)


@query(f"SELECT expert_id, CAST(sum(greatest(costs[1] - costs[3], 0)) AS BIGINT) AS gap FROM ({_R}) GROUP BY 1")
def residual_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return _routed(spark, folder).groupBy("expert_id").agg(F.sum(F.greatest(F.get("costs", F.lit(0)) - F.get("costs", F.lit(2)), F.lit(0))).alias("gap"))


@query("SELECT source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS label FROM (SELECT DISTINCT source FROM documents)")
def relabel(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("source").distinct().withColumn("label", (F.dense_rank().over(W.orderBy("source")) - 1).cast("int"))


@query(f"SELECT doc_id, expert_id, list_transform(range(0, 3), lambda k: CASE WHEN k = expert_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS weights FROM ({_R})")
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    return _routed(spark, folder).select("doc_id", "expert_id", D.one_hot(3).alias("weights"))


_REPEATS = f"""WITH x AS (SELECT doc_id, expert_id, weight, CAST(round(weight * 2.0, 9) AS DECIMAL(27, 9)) AS x FROM ({_SOFT})),
    y AS (SELECT *, floor(x) AS whole, CAST(x - floor(x) AS DOUBLE) AS rest, (CAST('0x' || substr(md5('17:' || expert_id || ':' || doc_id), 1, 13) AS BIGINT) + 1) / {float(16**13 + 1)!r} AS u FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY expert_id ORDER BY CASE WHEN rest > 0 THEN -ln(u) / rest ELSE 'inf'::DOUBLE END, doc_id) AS r, round_even(CAST(sum(x) OVER (PARTITION BY expert_id) AS DOUBLE), 0) - sum(whole) OVER (PARTITION BY expert_id) AS owed FROM y),
    n AS (SELECT doc_id, expert_id, weight, CAST(whole AS BIGINT) + (r <= owed)::INT AS repeats FROM z)"""


@query(f"{_REPEATS} SELECT doc_id, expert_id, CAST(repeats AS BIGINT) AS repeats FROM n")
def fractional_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Whole repeats of every document for every expert, whose totals are the rounded sums of the weights taken twice."""
    return _repeats(spark, folder).select("doc_id", "expert_id", "repeats")


def _repeats(spark: SparkSession, folder: str) -> DataFrame:
    w = _costs(spark, folder).select("doc_id", F.posexplode(R.soft_weights(F.col("costs").cast("array<double>"), 0.2)).alias("expert_id", "weight"))
    return D.integer_repeats(w, "expert_id", "doc_id", "weight", 2.0, 17)


@query(f"""{_REPEATS}, e AS (SELECT expert_id, first(doc_id ORDER BY weight DESC, doc_id) AS doc_id FROM n GROUP BY expert_id HAVING sum(repeats) = 0)
    SELECT expert_id, doc_id, CAST(unnest(range(1, repeats + 1)) AS INTEGER) AS copy FROM n UNION ALL SELECT expert_id, doc_id, 1 FROM e""")
def weighted_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The documents each expert is fitted on, as often as they repeat."""
    return D.weighted_rows(_repeats(spark, folder), "expert_id", "doc_id", "weight", "repeats").select("expert_id", "doc_id", "copy")


@query(f"""SELECT round(avg((a.expert_id <> b.expert_id)::INT), 9) AS changed, count(*) AS documents FROM ({_R}) a JOIN
    (SELECT doc_id, CAST(list_position(a, list_min(a)) - 1 AS INTEGER) AS expert_id FROM (SELECT doc_id, {_ADJ} AS a FROM ({_C}) c)) b ON a.doc_id = b.doc_id""")
def change_rate(spark: SparkSession, folder: str) -> DataFrame:
    a = _costs(spark, folder).select(R.route("costs").alias("x"), R.route(R.prior_costs(F.col("costs").cast("array<double>"), [0.5, 0.3, 0.2], [True] * 3)).alias("y"))
    return a.agg(F.round(F.avg((F.col("x") != F.col("y")).cast("double")), 9).alias("changed"), F.count("*").alias("documents"))


@query("""SELECT CAST(tokenizer_id AS INTEGER) AS tokenizer_id, count(*) AS documents, CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(t) + count(t) AS BIGINT) // 4097 * 4097 AS usable FROM
    (SELECT route_id, min(tokenizer_id) AS tokenizer_id, min(raw_bytes) AS b, min(n_tokens) AS t FROM routed_documents GROUP BY route_id) GROUP BY 1""")
def tokenizer_totals(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "routed_documents").groupBy("route_id").agg(*(F.min(c).alias(c) for c in ("tokenizer_id", "raw_bytes", "n_tokens")))
    out = once.groupBy("tokenizer_id").agg(F.count("*").alias("documents"), F.sum("raw_bytes").alias("bytes"), F.sum("n_tokens").alias("tokens"), (F.sum("n_tokens") + F.count("n_tokens")).alias("u"))
    return out.select("tokenizer_id", "documents", "bytes", "tokens", F.expr("u div 4097 * 4097").alias("usable"))


