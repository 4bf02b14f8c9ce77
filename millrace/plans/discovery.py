"""Queries of discovery, BPE, infilling, mappings, samplers, sources, sinks and streams; those without SQL are held to invariants in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.tokenizers import bpe_costs, bpe_ids
from millrace.operators import discovery as D
from millrace.operators import infill as I
from millrace.operators.packing import packed_fragments, packed_sequences, token_offsets
from millrace.session import spread, stored, stored_path, table
from millrace.sinks import writers
from millrace.sources import readers
from millrace.streaming import routing as streams

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text").where("text IS NOT NULL")


def _bpe(spark: SparkSession, folder: str, vocabulary: int) -> str:
    """A tokenizer fitted on all texts, which stream through one task."""
    rows = _texts(spark, folder).withColumn("weights", F.array(F.lit(1.0)))
    return D.fit_experts(rows, "doc_id", "text", 1, D.Options(vocabulary=vocabulary, oversample=1.0))[0]


@query()
def bpe_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    experts = [_bpe(spark, folder, v) for v in (512, 2048)]
    costed = bpe_costs(spread(_texts(spark, folder)), "doc_id", "text", experts)
    return costed.select("doc_id", F.posexplode("costs").alias("expert_id", "tokens"))


@query()
def bpe_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Training sequences of 513 tokens per source, end marks between documents, written as a table of ids."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text").where("text IS NOT NULL")
    ids = stored(bpe_ids(spread(docs), "text", _bpe(spark, folder, 2048)).withColumn("ids", F.concat("ids", F.array(F.lit(3)))), "ids")
    offsets = token_offsets(ids.select("source", "doc_id", F.size("ids").alias("n")), ["source"], "doc_id", "n", 0)
    return packed_sequences(packed_fragments(offsets, ["source"], "doc_id", 513), ids.select("doc_id", "ids"), ["source"], "doc_id")


@query()
def char_ngram_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = D.char_ngram_features(spread(_texts(spark, folder)), "doc_id", "text", 4096)
    return rows.select("doc_id", F.size(F.filter("features", lambda x: x > 0)).alias("dimensions"), F.round(F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), 5).alias("norm"))


@query()
def discover_domains(spark: SparkSession, folder: str) -> DataFrame:
    found = D.discover_domains(_texts(spark, folder))
    return found.documents.select("doc_id", "expert_id", F.get("costs", F.col("expert_id")).alias("tokens"))


@query()
def learned_router(spark: SparkSession, folder: str) -> DataFrame:
    from millrace.operators.routing import native_costs, route

    rows = stored(spread(_texts(spark, folder)).withColumn("label", route(native_costs("text"))), "labelled")
    return D.learned_router(rows, rows, "doc_id", "text", "label", 512, 2000).join(rows.select("doc_id", F.col("label").alias("oracle")), "doc_id")


@query()
def fim_permute(spark: SparkSession, folder: str) -> DataFrame:
    ids = _texts(spark, folder).select("doc_id", F.transform(F.split("text", " ", -1), F.length).alias("ids"))
    out = I.infilled(spread(ids), "doc_id", "ids", 0, -1, -2, -3, -4)
    return out.select("doc_id", F.size("input_ids").alias("tokens"), F.size(F.filter("input_ids", lambda x: x == -1)).alias("permuted"), F.xxhash64("input_ids").alias("digest"))


@query()
def sentence_mapping(spark: SparkSession, folder: str) -> DataFrame:
    rows = _texts(spark, folder).select("doc_id", F.transform(F.split("text", r"(?<=[.!?])\s+|\n+"), lambda s: F.size(F.split(s, " "))).alias("lengths"))
    return I.sentence_spans(rows, "doc_id", "lengths", 128)


@query()
def block_mapping(spark: SparkSession, folder: str) -> DataFrame:
    rows = _texts(spark, folder).select("doc_id", F.transform(F.split("text", r"\n+"), lambda s: F.size(F.split(s, " "))).alias("lengths"))
    return I.sentence_spans(rows, "doc_id", "lengths", 256, 0.0, 1, 512, reserve=8)


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings), p AS (SELECT vec_id, i, x, exp(x - max(x) OVER (PARTITION BY vec_id)) / sum(exp(x - m)) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM v)),
    c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY x, i DESC ROWS UNBOUNDED PRECEDING) AS below FROM p), k AS (SELECT * FROM c WHERE below > 0.1 OR r = 1)
    SELECT vec_id, CAST(i AS INTEGER) AS i, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS probability FROM k""")
def nucleus_sampling(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return I.nucleus(rows, "vec_id", "i", "x").withColumn("probability", F.round("probability", 6))


@query("SELECT count(*) AS rows, count(DISTINCT doc_id) AS documents, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL")
def jsonl_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = stored_path(spark, "jsonl")
    writers.write_jsonl(_texts(spark, folder), path, "gzip")
    rows = readers.read_jsonl(spark, path, schema="doc_id bigint, text string")
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("documents"), F.sum(F.octet_length("text")).alias("bytes"))


@query()
def synthetic_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return readers.synthetic_rows(spark, 3000, 17)


@query()
def dummy_batches(spark: SparkSession, folder: str) -> DataFrame:
    return readers.dummy_batches(spark, 64, 32, 1000, 17)


@query("""SELECT to_json({'bytes': CAST(sum(b) AS BIGINT), 'documents': count(*), 'tokenizer_id': k, 'tokens': CAST(sum(t) AS BIGINT)})::VARCHAR AS manifest FROM
    (SELECT route_id, min(tokenizer_id) AS k, coalesce(min(raw_bytes), 0) AS b, coalesce(min(n_tokens), 0) AS t FROM routed_documents GROUP BY route_id) WHERE k IS NOT NULL GROUP BY k""")
def tokenizer_manifests(spark: SparkSession, folder: str) -> DataFrame:
    from millrace.operators.hotkeys import once

    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = once(table(spark, folder, "routed_documents"), ["route_id"], ["tokenizer_id", "raw_bytes", "n_tokens"]).where("tokenizer_id IS NOT NULL")
    return writers.manifest_rows(rows.groupBy("tokenizer_id").agg(F.count("*").alias("documents"), F.sum(zero("raw_bytes")).alias("bytes"), F.sum(zero("n_tokens")).alias("tokens")))


@query("""SELECT source, CAST(sum(CASE WHEN k = 0 THEN t END) AS BIGINT) AS word, CAST(sum(CASE WHEN k = 1 THEN t END) AS BIGINT) AS char, CAST(sum(CASE WHEN k = 2 THEN t END) AS BIGINT) AS byte FROM
    (SELECT source, unnest([0, 1, 2]) AS k, unnest([len(regexp_extract_all(text, '[A-Za-z]+')), length(text), octet_length(encode(text))]) AS t FROM documents WHERE text IS NOT NULL) GROUP BY 1""")
def method_columns(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("text IS NOT NULL")
    each = F.array(F.struct(F.lit("word").alias("m"), F.regexp_count("text", F.lit("[A-Za-z]+")).cast("bigint").alias("t")), F.struct(F.lit("char").alias("m"), F.char_length("text").cast("bigint").alias("t")), F.struct(F.lit("byte").alias("m"), F.octet_length("text").cast("bigint").alias("t")))
    long = rows.select("source", F.explode(each).alias("e")).select("source", "e.*").groupBy("source", "m").agg(F.sum("t").alias("t"))
    return writers.document_counts(long, "source", "m", "t", ["word", "char", "byte"])


@query("""SELECT tokenizer_id, count(*) AS documents FROM (SELECT CAST(list_position(c, list_min(c)) - 1 AS INTEGER) AS tokenizer_id FROM (SELECT [len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]')), CAST(ceil(length(text) / 3.0) AS BIGINT), CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT)] AS c FROM (SELECT any_value(text) AS text FROM curated WHERE text IS NOT NULL GROUP BY ord))) GROUP BY 1""")
def streamed_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Curated texts written as JSON-lines shards, routed by a stream that ends when all files are taken."""
    base = stored_path(spark, "stream")
    rows = table(spark, folder, "curated").where("text IS NOT NULL").groupBy(F.col("ord").alias("source_document_index")).agg(F.first("text").alias("text"))
    rows.repartition(4).write.json(f"{base}/in")
    streams.route_shards(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.json(f"{base}/out").groupBy(F.col("tokenizer_id").cast("int").alias("tokenizer_id")).agg(F.count("*").alias("documents"))


