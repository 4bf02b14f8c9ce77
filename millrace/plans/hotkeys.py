"""Queries on tables whose keys are very uneven, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.hotkeys import eager_join_totals, heavy_keys, once, ranked
from millrace.session import stored, table


def _routes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return once(table(spark, folder, "routed_documents"), ["route_id"], ["source_document_index", "tokenizer_id", *columns])


def _scores(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return once(table(spark, folder, "nll_documents"), ["run_name", "doc_id"], ["endpoint_id", *columns])


def _curated(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "curated").withColumnRenamed("ord", "source_document_index"), ["source_document_index"], ["partition", "token_count"])


def _evaluation(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "evaluation_documents"), ["doc_id"], ["split"])


def _totals(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    routed = eager_join_totals(_routes(spark, folder, "raw_bytes", "n_tokens"), _curated(spark, folder), ["source_document_index"], ["tokenizer_id"], ["partition"], ["raw_bytes", "n_tokens"], ["token_count"])
    scored = eager_join_totals(_scores(spark, folder, "source_bytes", "predicted_tokens"), _evaluation(spark, folder), ["doc_id"], ["endpoint_id"], ["split"], ["source_bytes", "predicted_tokens"])
    return routed, scored


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    routed = eager_join_totals(_routes(spark, folder), _curated(spark, folder), ["source_document_index"], ["tokenizer_id"], ["partition"])
    scored = eager_join_totals(_scores(spark, folder), _evaluation(spark, folder), ["doc_id"], ["endpoint_id"], ["split"])
    # each is read twice and has a row for each key and part
    routed, scored = stored(routed, "routed"), stored(scored, "scored")
    parts = [heavy_keys(t, k).select(F.lit(k).alias("key_field"), "key_value") for t, k in ((routed, "tokenizer_id"), (scored, "endpoint_id"))]
    return parts[0].unionByName(parts[1])


def p2_totals(spark: SparkSession, folder: str) -> DataFrame:
    routed, scored = _totals(spark, folder)
    a = routed.select(F.lit("tokenizer_id").alias("key_field"), F.col("tokenizer_id").cast("bigint").alias("key_value"), F.col("partition").alias("part"), F.col("n").alias("records"), "matched", F.col("raw_bytes").alias("bytes"), F.col("n_tokens").alias("tokens"), F.col("token_count").alias("partner_tokens"))
    b = scored.select(F.lit("endpoint_id").alias("key_field"), F.col("endpoint_id").cast("bigint").alias("key_value"), F.col("split").alias("part"), F.col("n").alias("records"), "matched", F.col("source_bytes").alias("bytes"), F.col("predicted_tokens").alias("tokens"), F.lit(None).cast("bigint").alias("partner_tokens"))
    return a.unionByName(b)


def p2_positions(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(_routes(spark, folder, "routed_at").where("tokenizer_id IS NOT NULL"), "routes")  # the ranges are sampled from it
    return ranked(rows, "tokenizer_id", ["routed_at", "route_id"]).select("route_id", "tokenizer_id", F.col("position").cast("bigint").alias("position"), "key_rows")


def p2_endpoint_positions(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(_scores(spark, folder, "scored_at").where("endpoint_id IS NOT NULL"), "scores")  # the ranges are sampled from it
    return ranked(rows, "endpoint_id", ["scored_at", "run_name", "doc_id"]).select("run_name", "doc_id", "endpoint_id", F.col("position").cast("bigint").alias("position"), "key_rows")


QUERIES = {"p2_found": p2_found, "p2_totals": p2_totals, "p2_positions": p2_positions, "p2_endpoint_positions": p2_endpoint_positions}

_R = "SELECT route_id, min(source_document_index) AS i, min(tokenizer_id) AS k, min(raw_bytes) AS b, min(n_tokens) AS t, min(routed_at) AS w FROM routed_documents GROUP BY route_id"
_N = "SELECT run_name, doc_id, min(endpoint_id) AS k, min(source_bytes) AS b, min(predicted_tokens) AS t FROM nll_documents GROUP BY run_name, doc_id"
SQL = {
    "p2_found": f"""
        WITH r AS ({_R}), n AS ({_N})
        SELECT 'tokenizer_id' AS key_field, CAST(k AS BIGINT) AS key_value FROM r WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 0.04 * (SELECT count(k) FROM r)
        UNION ALL
        SELECT 'endpoint_id', CAST(k AS BIGINT) FROM n WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 0.04 * (SELECT count(k) FROM n)""",
    "p2_totals": f"""
        WITH r AS ({_R}), n AS ({_N}),
        c AS (SELECT ord, min(partition) AS part, min(token_count) AS pt FROM curated GROUP BY ord),
        e AS (SELECT doc_id, min(split) AS part FROM evaluation_documents GROUP BY doc_id)
        SELECT 'tokenizer_id' AS key_field, CAST(k AS BIGINT) AS key_value, c.part AS part, count(*) AS records, count(c.ord) AS matched,
               CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(pt) AS BIGINT) AS partner_tokens
        FROM r LEFT JOIN c ON r.i = c.ord GROUP BY k, c.part
        UNION ALL
        SELECT 'endpoint_id', CAST(k AS BIGINT), e.part, count(*), count(e.doc_id), CAST(sum(b) AS BIGINT), CAST(sum(t) AS BIGINT), CAST(NULL AS BIGINT)
        FROM n LEFT JOIN e ON n.doc_id = e.doc_id GROUP BY k, e.part""",
    "p2_positions": f"""
        WITH r AS ({_R})
        SELECT route_id, k AS tokenizer_id, row_number() OVER (PARTITION BY k ORDER BY w, route_id) AS position, count(*) OVER (PARTITION BY k) AS key_rows
        FROM r WHERE k IS NOT NULL""",
    "p2_endpoint_positions": """
        SELECT run_name, doc_id, k AS endpoint_id, row_number() OVER (PARTITION BY k ORDER BY w, run_name, doc_id) AS position, count(*) OVER (PARTITION BY k) AS key_rows
        FROM (SELECT run_name, doc_id, min(endpoint_id) AS k, min(scored_at) AS w FROM nll_documents GROUP BY run_name, doc_id) WHERE k IS NOT NULL""",
}
