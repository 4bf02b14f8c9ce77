"""Queries of corpus curation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import BUDGET_TOKEN, SPACE_RUN, budget_tokens, byte_length, sql_budget_tokens, sql_strip, strip
from millrace.operators import curation as C
from millrace.operators.hotkeys import ranked
from millrace.operators.prefix import hex_bucket
from millrace.session import spread, stored, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


_T = sql_strip("text")
_ID = f"sha256('dclm-stack-v1' || chr(0) || source || chr(0) || {_T})"
_UNIT = "(('0x' || substr(document_id, 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"
_SPLIT = f"""SELECT *, CASE WHEN {_UNIT} < 0.1 THEN 'eval' ELSE 'train' END AS partition FROM
    (SELECT doc_id, source, lang, {_T} AS text, {_ID} AS document_id FROM documents WHERE octet_length(encode({_T})) >= 128 AND source IS NOT NULL)"""


@query(f"SELECT doc_id, document_id, partition FROM ({_SPLIT})")
def partition_split(spark: SparkSession, folder: str) -> DataFrame:
    return C.split_documents(_documents(spark, folder), 0.1).select("doc_id", "document_id", "partition")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def document_digest(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"SELECT doc_id, {_T} AS text FROM documents WHERE length({_T}) > 0")
def extracted_text(spark: SparkSession, folder: str) -> DataFrame:
    d = _documents(spark, folder)
    return d.select("doc_id", C.text_of(d).alias("text")).where("length(text) > 0")


@query(f"SELECT doc_id, {sql_budget_tokens('text')} AS tokens, octet_length(encode(text)) AS bytes FROM documents WHERE text IS NOT NULL")
def token_count(spark: SparkSession, folder: str) -> DataFrame:
    return spread(_documents(spark, folder).select("doc_id", "text")).where("text IS NOT NULL").select("doc_id", budget_tokens("text").alias("tokens"), byte_length("text").cast("bigint").alias("bytes"))


@query(f"""SELECT doc_id, partition, lang, document_id, CAST(least(n, 5000 - before) AS BIGINT) AS kept FROM (
    SELECT *, coalesce(sum(n) OVER (PARTITION BY partition, lang ORDER BY document_id, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT *, {sql_budget_tokens('text')} AS n FROM ({_SPLIT}))) WHERE before < 5000 AND n > 0""")
def mixture_quota(spark: SparkSession, folder: str) -> DataFrame:
    rows = C.split_documents(spread(_documents(spark, folder).select("doc_id", "source", "lang", "text")), 0.1)
    counted = rows.select("doc_id", "partition", "lang", "document_id", budget_tokens(strip("text")).alias("n"))
    counted = stored(counted, "counted")  # tokenized once; without texts
    return C.quota_cut(counted, ["partition", "lang"], "n", 5000, ["document_id", "doc_id"], hex_bucket("document_id")).select("doc_id", "partition", "lang", "document_id", "kept")


@query("""SELECT source, target_weight AS weight, CAST(CASE WHEN source = (SELECT max(source) FROM mixture_targets) THEN q + 1000000 - sum(q) OVER () ELSE q END AS BIGINT) AS quota
    FROM (SELECT source, target_weight, floor(1000000 * target_weight / sum(target_weight) OVER ()) AS q FROM mixture_targets)""")
def source_quotas(spark: SparkSession, folder: str) -> DataFrame:
    return C.source_quotas(table(spark, folder, "mixture_targets").select("source", F.col("target_weight").alias("weight")), 1_000_000)


@query("SELECT source, doc_id, n AS place, n // 4 AS turn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)")
def interleave(spark: SparkSession, folder: str) -> DataFrame:
    return C.interleaved(_documents(spark, folder).select("source", "doc_id"), "doc_id", 4).select("source", "doc_id", "place", "turn")


@query(f"SELECT doc_id, {sql_strip(f'''regexp_extract({_T}, '^(?:(?:{SPACE_RUN})?(?:{BUDGET_TOKEN})){{0,64}}')''')} AS text FROM documents WHERE text IS NOT NULL")
def truncate_budget(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).where("text IS NOT NULL").select("doc_id", C.truncate_tokens("text", 64).alias("text"))


@query("""SELECT doc_id, left(text, list_max(list_filter(range(0, 201), lambda i: octet_length(encode(left(text, i))) <= 200))::INT) AS text FROM documents WHERE text IS NOT NULL""")
def truncate_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).where("text IS NOT NULL").select("doc_id", C.truncate_utf8("text", 200).alias("text"))


@query(f"SELECT doc_id, left({sql_strip(f'''regexp_replace(text, '{SPACE_RUN}', ' ', 'g')''')}, 240) AS preview FROM documents WHERE text IS NOT NULL")
def previews(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).where("text IS NOT NULL").select("doc_id", C.preview("text").alias("preview"))


_HELD = f"""WITH r AS (SELECT doc_id, source, {_T} AS text, sha256({_T}) AS digest FROM evaluation_documents WHERE octet_length(encode({_T})) >= 128 AND source IS NOT NULL),
    f AS (SELECT source, digest, min(doc_id) AS doc_id, any_value(text) AS text FROM r WHERE digest NOT IN (SELECT sha256({_T}) FROM curated WHERE text IS NOT NULL AND partition = 'train') GROUP BY source, digest),
    b AS (SELECT *, coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
    c AS (SELECT source, doc_id, digest, CASE WHEN before + octet_length(encode(text)) <= 20000 THEN text ELSE
        left(text, list_max(list_filter(range(0, length(text) + 1), lambda i: octet_length(encode(left(text, i))) <= 20000 - before))::INT) END AS text FROM b WHERE before < 20000)
    SELECT source, doc_id, digest, text FROM c WHERE octet_length(encode(text)) >= 128"""


@query(_HELD)
def heldout_collect(spark: SparkSession, folder: str) -> DataFrame:
    return C.held_out(table(spark, folder, "evaluation_documents"), table(spark, folder, "curated").where("partition = 'train'"), 20_000)


@query(f"SELECT source, count(*) AS documents, CAST(coalesce(sum({sql_budget_tokens('text')}), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS bytes FROM documents GROUP BY source")
def source_summary(spark: SparkSession, folder: str) -> DataFrame:
    return C.source_summary(spread(_documents(spark, folder).select("source", "text")))


_CUR = "SELECT ord, any_value(token_count) AS n, any_value(source) AS source, any_value(partition) AS partition FROM curated GROUP BY ord"


@query(f"""WITH RECURSIVE c AS (SELECT ord, coalesce(n, 0) AS n, row_number() OVER (ORDER BY ord) AS i FROM ({_CUR})),
    f AS (SELECT i, ord, n, 0 AS shard, n AS held FROM c WHERE i = 1 UNION ALL
        SELECT c.i, c.ord, c.n, CASE WHEN f.held > 0 AND f.held + c.n > 20000 THEN f.shard + 1 ELSE f.shard END,
               CASE WHEN f.held > 0 AND f.held + c.n > 20000 THEN c.n ELSE f.held + c.n END FROM f JOIN c ON c.i = f.i + 1)
    SELECT ord, n AS token_count, CAST(shard AS BIGINT) AS shard FROM f""")
def shard_assign(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "curated").groupBy("ord").agg(F.first("token_count").alias("token_count"))
    return C.fill_shards(once, "ord", "token_count", 20_000)


@query(f"SELECT partition, source, count(*) AS written, CAST(coalesce(sum(n), 0) AS BIGINT) AS tokens FROM ({_CUR}) GROUP BY partition, source")
def run_metadata(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "curated").groupBy("ord").agg(*(F.first(c).alias(c) for c in ("token_count", "source", "partition")))
    return once.groupBy("partition", "source").agg(F.count("*").alias("written"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r <= floor(n * 0.25)""")
def dataset_mix(spark: SparkSession, folder: str) -> DataFrame:
    return C.first_fraction(_documents(spark, folder).select("source", "doc_id"), "source", "doc_id", 0.25).select("source", "doc_id")


@query("""SELECT source, doc_id, bytes FROM (SELECT source, doc_id, octet_length(encode(text)) AS bytes, sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents WHERE text IS NOT NULL) WHERE upto <= 30000""")
def byte_budget_prefix(spark: SparkSession, folder: str) -> DataFrame:
    rows = _documents(spark, folder).where("text IS NOT NULL").select("source", "doc_id", byte_length("text").cast("bigint").alias("bytes"))
    return C.budget_prefix(rows, ["source"], "doc_id", "bytes", 30_000).select("source", "doc_id", "bytes")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM test_items WHERE text IS NOT NULL UNION SELECT sha256(text) FROM curated WHERE text IS NOT NULL)")
def exclude_training(spark: SparkSession, folder: str) -> DataFrame:
    seen = table(spark, folder, "test_items").select("text").unionByName(table(spark, folder, "curated").select("text")).where("text IS NOT NULL").select(F.sha2("text", 256).alias("digest")).distinct()
    rows = _documents(spark, folder).where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.join(seen, "digest", "left_anti").select("doc_id")


@query("SELECT source, sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1, 2")
def dedupe_in_source(spark: SparkSession, folder: str) -> DataFrame:
    rows = _documents(spark, folder).where("text IS NOT NULL").select("source", "doc_id", F.sha2("text", 256).alias("digest"))
    return rows.groupBy("source", "digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT route_id, (row_number() OVER (ORDER BY route_id) - 1) // 512 // 2 AS shard FROM (SELECT DISTINCT route_id FROM routed_documents)")
def routed_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "routed_documents").select("route_id").distinct().withColumn("all", F.lit(0))
    return ranked(rows, "all", ["route_id"]).select("route_id", C.batch_shards(F.col("position") - 1, 512, 1000).alias("shard"))


@query("""SELECT kind, ordinal, row_number() OVER (ORDER BY kind, ordinal) AS position FROM (SELECT 'curated' AS kind, ord AS ordinal FROM curated GROUP BY ord UNION ALL SELECT 'evaluation', doc_id FROM evaluation_documents GROUP BY doc_id)""")
def union_sources(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "curated").select(F.lit("curated").alias("kind"), F.col("ord").alias("ordinal")).distinct()
    b = table(spark, folder, "evaluation_documents").select(F.lit("evaluation").alias("kind"), F.col("doc_id").alias("ordinal")).distinct()
    return ranked(a.unionByName(b).withColumn("all", F.lit(0)), "all", ["kind", "ordinal"]).select("kind", "ordinal", "position")
