"""Queries of packing and indices, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import budget_tokens, hashed_ids, sql_budget_tokens, sql_hashed_ids
from millrace.operators import packing as P
from millrace.operators.hotkeys import once, ranked
from millrace.session import spread, stored, stored_path, table
from millrace.sinks.writers import write_indexed_parts, write_token_files
from millrace.sources.readers import read_indexed, read_token_stream

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _routed(spark: SparkSession, folder: str, extra: int = 1) -> DataFrame:
    rows = once(table(spark, folder, "routed_documents"), ["route_id"], ["tokenizer_id", "n_tokens"]).where("tokenizer_id IS NOT NULL")
    return stored(P.token_offsets(stored(rows, "routes"), ["tokenizer_id"], "route_id", "n_tokens", extra), "offsets")  # numbers only


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    return stored(P.token_offsets(stored(once(table(spark, folder, "curated"), ["ord"], ["token_count"]), "counts"), [], "ord", "token_count", 0), "offsets")


def _sql_routed(extra: int = 1) -> str:
    return f"""SELECT tokenizer_id, route_id, n AS length, CAST(sum(n) OVER (PARTITION BY tokenizer_id ORDER BY route_id) - n AS BIGINT) AS start FROM
        (SELECT route_id, min(tokenizer_id) AS tokenizer_id, coalesce(min(n_tokens), 0) + {extra} AS n FROM routed_documents GROUP BY route_id) WHERE tokenizer_id IS NOT NULL"""


_STREAM = "SELECT ord, n AS length, CAST(sum(n) OVER (ORDER BY ord) - n AS BIGINT) AS start FROM (SELECT ord, coalesce(min(token_count), 0) AS n FROM curated GROUP BY ord)"


@query(f"SELECT tokenizer_id, route_id, start, length FROM ({_sql_routed()})")
def token_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return _routed(spark, folder).select("tokenizer_id", "route_id", "start", "length")


def _sql_packed(extra: int) -> str:
    return f"""WITH o AS ({_sql_routed(extra)}), e AS (SELECT tokenizer_id, sum(length) // 4097 AS whole FROM o GROUP BY 1),
    s AS (SELECT o.*, unnest(range(start // 4097, (start + length - 1) // 4097 + 1)) AS seq_id FROM o WHERE length > 0)
    SELECT s.tokenizer_id, seq_id, route_id, greatest(start, seq_id * 4097) - start AS doc_offset, least(start + length, (seq_id + 1) * 4097) - greatest(start, seq_id * 4097) AS length
    FROM s JOIN e ON s.tokenizer_id = e.tokenizer_id WHERE seq_id < whole"""


@query(_sql_packed(1))
def pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return P.packed_fragments(_routed(spark, folder), ["tokenizer_id"], "route_id", 4097)


@query(f"SELECT tokenizer_id, seq_id // 8 AS file, count(DISTINCT seq_id) AS sequences, CAST(sum(length) AS BIGINT) AS tokens FROM ({_sql_packed(1)}) GROUP BY 1, 2")
def packed_files(spark: SparkSession, folder: str) -> DataFrame:
    f = P.packed_fragments(_routed(spark, folder), ["tokenizer_id"], "route_id", 4097)
    return f.groupBy("tokenizer_id", F.expr("seq_id div 8").alias("file")).agg(F.count_distinct("seq_id").alias("sequences"), F.sum("length").alias("tokens"))


@query(f"SELECT tokenizer_id, count(DISTINCT seq_id) AS chunks, CAST(sum(length) AS BIGINT) AS tokens FROM ({_sql_packed(2)}) GROUP BY 1")
def lm_chunks(spark: SparkSession, folder: str) -> DataFrame:
    f = P.packed_fragments(_routed(spark, folder, 2), ["tokenizer_id"], "route_id", 4097)
    return f.groupBy("tokenizer_id").agg(F.count_distinct("seq_id").alias("chunks"), F.sum("length").alias("tokens"))


@query("""SELECT batch, CAST(sum(n) AS BIGINT) AS tokens, CASE WHEN sum(n) >= 257 THEN CAST((sum(n) - 1) // 256 AS BIGINT) ELSE 0 END AS chunks, CASE WHEN sum(n) >= 257 THEN CAST((sum(n) - 1) // 256 - 1 AS BIGINT) ELSE 0 END AS strict_chunks
    FROM (SELECT (row_number() OVER (ORDER BY ord) - 1) // 100 AS batch, n FROM (SELECT ord, coalesce(min(token_count), 0) AS n FROM curated GROUP BY ord)) GROUP BY 1""")
def clm_group_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranked(once(table(spark, folder, "curated"), ["ord"], ["token_count"]).withColumn("all", F.lit(0)), "all", ["ord"])
    t = rows.groupBy(F.expr("(position - 1) div 100").alias("batch")).agg(F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"))
    return t.select("batch", "tokens", P.grouped_chunks(F.col("tokens"), 256).cast("bigint").alias("chunks"), P.grouped_chunks(F.col("tokens"), 256, True).cast("bigint").alias("strict_chunks"))


@query("SELECT source, CAST(sum(n) AS BIGINT) AS per_epoch, CASE WHEN sum(n) > 0 THEN CAST(ceil((1000 * 256 + 1) / sum(n)) AS BIGINT) END AS epochs FROM (SELECT ord, min(source) AS source, coalesce(min(token_count), 0) AS n FROM curated GROUP BY ord) GROUP BY 1")
def epochs_needed(spark: SparkSession, folder: str) -> DataFrame:
    t = once(table(spark, folder, "curated"), ["ord"], ["source", "token_count"]).groupBy("source").agg(F.sum(F.coalesce("token_count", F.lit(0))).alias("per_epoch"))
    return t.withColumn("epochs", P.epochs_needed(F.lit(1000), 256, F.col("per_epoch")))


_TOTAL = "(SELECT sum(length) FROM o)"


@query(f"""WITH o AS ({_STREAM}), s AS (SELECT *, unnest(range(CAST(ceil(start / 256.0) AS BIGINT), (start + length - 1) // 256 + 1)) AS sample FROM o WHERE length > 0)
    SELECT sample, ord, sample * 256 - start AS offset FROM s WHERE (sample + 1) * 256 < {_TOTAL}""".replace("AS offset", 'AS "offset"'))
def sample_index(spark: SparkSession, folder: str) -> DataFrame:
    return P.sample_index(_stream(spark, folder), "ord", 256)


@query(f"""WITH o AS ({_STREAM}), n AS (SELECT unnest(range(0, CAST(({_TOTAL} - 1) // 256 AS BIGINT))) AS sample)
    SELECT sample, ord, greatest(start, sample * 256) - start AS "offset", least(start + length, sample * 256 + 257) - greatest(start, sample * 256) AS take
    FROM n JOIN o ON start < sample * 256 + 257 AND start + length > sample * 256 WHERE length > 0""")
def sample_fragments(spark: SparkSession, folder: str) -> DataFrame:
    return P.sample_fragments(_stream(spark, folder), "ord", 256)


_IDS = "list_transform(string_split(text, ' '), lambda x: length(x))"


@query(f"""WITH t AS (SELECT doc_id, unnest({_IDS}) AS id, unnest(range(0, len({_IDS}))) AS i FROM documents WHERE text IS NOT NULL),
    o AS (SELECT *, coalesce(lag(id) OVER (PARTITION BY doc_id ORDER BY i) = 0, true) AS open FROM t),
    p AS (SELECT *, i - max(CASE WHEN open THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS position FROM o),
    l AS (SELECT doc_id, i, id, position, lead(id) OVER (PARTITION BY doc_id ORDER BY i) AS label_id, lead(position) OVER (PARTITION BY doc_id ORDER BY i) <> 0 AS label_mask FROM p)
    SELECT doc_id, count(*) AS tokens, CAST(sum(position) AS BIGINT) AS positions, CAST(max(position) AS INTEGER) AS longest, CAST(sum(label_mask::INT) AS BIGINT) AS labels, CAST(sum(label_id) AS BIGINT) AS label_sum FROM l WHERE label_id IS NOT NULL GROUP BY doc_id""")
def position_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "documents").select("doc_id", "text")).where("text IS NOT NULL").select("doc_id", F.transform(F.split("text", " ", -1), F.length).alias("ids"))
    out = P.exploded_positions(rows, "doc_id", "ids", 0)
    return out.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum("position").alias("positions"), F.max("position").alias("longest"), F.sum(F.col("label_mask").cast("int")).alias("labels"), F.sum("label_id").alias("label_sum"))


@query(f"""WITH c AS (SELECT doc_id, {sql_budget_tokens("split_part(text, chr(10), 1)")} AS p, {sql_budget_tokens("text")} AS n FROM documents WHERE text IS NOT NULL),
    t AS (SELECT doc_id, p AS prompt, n - p AS completion, least(n + 1, 513) AS tokens, greatest(least(n + 1, 513) - greatest(p, 1), 0) AS labels FROM c)
    SELECT doc_id, prompt, completion, tokens, labels, 512 - (tokens - 1) AS padding FROM t WHERE labels > 0""")
def sft_examples(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "documents").select("doc_id", "text")).where("text IS NOT NULL").select("doc_id", budget_tokens(F.substring_index("text", "\n", 1)).alias("prompt"), budget_tokens("text").alias("n"))
    return P.supervised(rows.select("doc_id", "prompt", (F.col("n") - F.col("prompt")).alias("completion")), "prompt", "completion", 512)


_NLL = "SELECT run_name, doc_id, min(predicted_tokens) + 1 AS n, min(endpoint_id) AS endpoint_id FROM nll_documents GROUP BY run_name, doc_id"


@query(f"SELECT run_name, doc_id, chunk_start, least(chunk_start + 128, n) AS chunk_end FROM (SELECT run_name, doc_id, n, unnest(range(0, n - 1, 127)) AS chunk_start FROM ({_NLL}) WHERE n >= 2)")
def nll_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = once(table(spark, folder, "nll_documents"), ["run_name", "doc_id"], ["predicted_tokens"]).withColumn("n", F.col("predicted_tokens") + 1)
    return P.scored_chunks(rows, ["run_name", "doc_id"], "n", 128)


@query(f"SELECT batch, count(*) AS rows, max(n) AS width, CAST(sum(n) AS BIGINT) AS tokens, CAST(max(n) * count(*) - sum(n) AS BIGINT) AS padding FROM (SELECT doc_id // 64 AS batch, n FROM ({_NLL}) WHERE n IS NOT NULL) GROUP BY 1")
def padded_batches(spark: SparkSession, folder: str) -> DataFrame:
    rows = once(table(spark, folder, "nll_documents"), ["run_name", "doc_id"], ["predicted_tokens"]).where("predicted_tokens IS NOT NULL").withColumn("n", F.col("predicted_tokens") + 1)
    return rows.groupBy(F.expr("doc_id div 64").alias("batch")).agg(F.count("*").alias("rows"), F.max("n").alias("width"), F.sum("n").alias("tokens"), (F.max("n") * F.count("*") - F.sum("n")).alias("padding"))


@query("""WITH t AS (SELECT row_number() OVER (ORDER BY source) - 1 AS file, count(*) AS n FROM (SELECT ord, min(source) AS source FROM curated GROUP BY ord) GROUP BY source),
    f AS (SELECT file, CAST(sum(n) OVER (ORDER BY file) - n AS BIGINT) AS r_from, CAST(sum(n) OVER (ORDER BY file) AS BIGINT) AS r_to FROM t), i AS (SELECT unnest(range(0, (SELECT CAST(sum(n) AS BIGINT) FROM t))) AS item)
    SELECT item, file, item - r_from AS "offset" FROM i JOIN f ON item >= r_from AND item < r_to""")
def sample_files(spark: SparkSession, folder: str) -> DataFrame:
    f = _files(spark, folder)
    total = f.agg(F.max("r_to").alias("n"))
    items = total.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("item"))
    items = items.withColumn("l_from", F.col("item")).withColumn("l_to", F.col("item") + 1)
    return P.interval_join(items, f, 1024).select("item", "file", (F.col("item") - F.col("r_from")).alias("offset"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window as W

    per = once(table(spark, folder, "curated"), ["ord"], ["source"]).groupBy("source").agg(F.count("*").alias("n"))
    w = W.orderBy("source")  # one row a source
    return per.select((F.row_number().over(w) - 1).cast("bigint").alias("file"), (F.sum("n").over(w) - F.col("n")).alias("r_from"), F.sum("n").over(w).alias("r_to"))


@query("""WITH t AS (SELECT row_number() OVER (ORDER BY source) - 1 AS file, count(*) AS n FROM (SELECT ord, min(source) AS source FROM curated GROUP BY ord) GROUP BY source),
    f AS (SELECT file, CAST(sum(n) OVER (ORDER BY file) - n AS BIGINT) AS r_from, CAST(sum(n) OVER (ORDER BY file) AS BIGINT) AS r_to FROM t), q AS (SELECT k AS need, k * 150 AS l_from, k * 150 + 100 AS l_to FROM (SELECT unnest(range(0, 40)) AS k))
    SELECT need, file, greatest(l_from, r_from) AS start, least(l_to, r_to) AS stop FROM q JOIN f ON greatest(l_from, r_from) < least(l_to, r_to)""")
def needed_ranges(spark: SparkSession, folder: str) -> DataFrame:
    need = spark.range(40).select(F.col("id").alias("need"), (F.col("id") * 150).alias("l_from"), (F.col("id") * 150 + 100).alias("l_to"))
    return P.interval_join(need, _files(spark, folder), 256).select("need", "file", F.greatest("l_from", "r_from").alias("start"), F.least("l_to", "r_to").alias("stop"))


@query(f"SELECT ord, length AS size, start * 2 AS pointer FROM ({_STREAM})")
def index_pointers(spark: SparkSession, folder: str) -> DataFrame:
    return _stream(spark, folder).select("ord", F.col("length").alias("size"), (F.col("start") * 2).alias("pointer"))


@query(f"SELECT ord, length // 65 AS contexts, length % 65 AS dropped FROM ({_STREAM})")
def fixed_contexts(spark: SparkSession, folder: str) -> DataFrame:
    return _stream(spark, folder).select("ord", F.expr("length div 65").alias("contexts"), (F.col("length") % 65).alias("dropped"))


_BOS, _EOS, _PAD = 65536, 65537, 65538
_TOKENS = f"SELECT doc_id, source, doc_id // 100 AS batch, {sql_hashed_ids('text')} AS t FROM documents WHERE text IS NOT NULL"
_LM = f"""SELECT source, o // 65 AS seq_id, list(x ORDER BY o) AS ids FROM (SELECT source, x, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS o FROM
    (SELECT source, doc_id, unnest([{_BOS}] || t || [{_EOS}]) AS x, unnest(range(0, len(t) + 2)) AS i FROM ({_TOKENS}))) GROUP BY ALL HAVING count(*) = 65"""


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "source", "text")).where("text IS NOT NULL")
    return docs.select("doc_id", "source", F.expr("doc_id div 100").alias("batch"), hashed_ids("text").alias("ids"))


@query(f"SELECT source, seq_id, ids AS input_ids FROM ({_LM})")
def lm_chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Training sequences of 65 tokens of each source: bos, document, eos, without overlap, the rest of a source dropped."""
    rows = _tokens(spark, folder).select("doc_id", "source", F.concat(F.array(F.lit(_BOS)), "ids", F.array(F.lit(_EOS))).alias("ids"))
    rows = stored(rows, "tokens")
    offsets = stored(P.token_offsets(rows.select("doc_id", "source", F.size("ids").alias("n")), ["source"], "doc_id", "n", 0), "offsets")
    return P.packed_sequences(P.packed_fragments(offsets, ["source"], "doc_id", 65), rows.select("doc_id", "ids"), ["source"], "doc_id")


@query(f"""WITH s AS (SELECT source, seq_id, ids, list_transform(range(0, 65), lambda i: i - coalesce(list_max(list_filter(list_transform(range(0, 65), lambda k: CASE WHEN ids[k + 1] = {_EOS} THEN k + 1 END), lambda p: p <= i)), 0)) AS p FROM ({_LM}))
    SELECT source, seq_id, ids[1:64] AS input_ids, ids[2:65] AS label_ids, p[1:64] AS position_ids, list_transform(p[2:65], lambda x: x <> 0) AS label_mask FROM s""")
def collated_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The sequences of lm_chunk_rows as a collator gives them, a row a sequence, in the row."""
    return lm_chunk_rows(spark, folder).select("source", "seq_id", F.inline(F.array(P.collated(F.col("input_ids"), _EOS))))


@query(f"SELECT source, seq_id, CAST(r AS INTEGER) AS rank, ids[r * 65 // 4 + 1:(r + 1) * 65 // 4] AS input_ids FROM ({_LM}), (SELECT unnest(range(0, 4)) AS r)")
def context_slices(spark: SparkSession, folder: str) -> DataFrame:
    """The part of every sequence that each of four context-parallel ranks has."""
    rows = lm_chunk_rows(spark, folder).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.select("source", "seq_id", "rank", P.context_slice(F.col("input_ids"), F.col("rank"), 4).alias("input_ids"))


@query(f"""WITH f AS (SELECT batch, x, row_number() OVER (PARTITION BY batch ORDER BY doc_id, i) - 1 AS o, count(*) OVER (PARTITION BY batch) AS n FROM (SELECT batch, doc_id, unnest(t) AS x, unnest(range(0, len(t))) AS i FROM ({_TOKENS}))),
    c AS (SELECT batch, x, o, n, unnest([o // 64, o // 64 - CASE WHEN o % 64 = 0 THEN 1 ELSE 0 END]) AS chunk, unnest([true, o % 64 = 0]) AS use FROM f)
    SELECT batch, chunk, list(x ORDER BY o) AS input_ids FROM c WHERE use AND chunk >= 0 AND n >= 65 AND chunk < (n - 1) // 64 GROUP BY ALL""")
def clm_chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of 65 tokens with one of overlap, of the stream of every batch of documents."""
    rows = stored(_tokens(spark, folder).select("doc_id", "batch", "ids"), "tokens")
    offsets = stored(P.token_offsets(rows.select("doc_id", "batch", F.size("ids").alias("n")), ["batch"], "doc_id", "n", 0), "offsets")
    fragments = P.grouped_fragments(offsets, ["batch"], "doc_id", 64).withColumnRenamed("chunk", "seq_id")
    return P.packed_sequences(fragments, rows.select("doc_id", "ids"), ["batch"], "doc_id").withColumnRenamed("seq_id", "chunk")


@query(f"SELECT md5(source) AS stream, seq_id // 64 AS file, seq_id % 64 AS context, ids AS input_ids FROM ({_LM})")
def packed_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The sequences of lm_chunk_rows written as token files of 64 of them for each source, and read back by ranges."""
    path = stored_path(spark, "streams")
    rows = lm_chunk_rows(spark, folder).select(F.md5("source").alias("stream"), "seq_id", "input_ids")
    write_token_files(rows, path, "stream", token_bytes=4, per_file=64).write.format("noop").mode("overwrite").save()
    back = read_token_stream(spark, path, 64, 4)
    name = F.regexp_extract("file", "([0-9a-f]{32})/([0-9]+)[.]ds$", 1), F.regexp_extract("file", "([0-9a-f]{32})/([0-9]+)[.]ds$", 2).cast("bigint")
    return back.select(name[0].alias("stream"), name[1].alias("file"), "context", F.col("input_ids").cast("array<int>").alias("input_ids"))


@query(f"SELECT doc_id, t AS ids FROM ({_TOKENS})")
def indexed_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of all documents written as indexed token files and read back, in order of doc_id."""
    path = stored_path(spark, "indexed")
    rows = stored(_tokens(spark, folder).select("doc_id", "ids"), "tokens")
    written = write_indexed_parts(rows, path, "doc_id", "ids", per_file=50_000).orderBy("part").collect()  # a row a file
    before, parts = 0, []
    for r in written:
        parts.append(read_indexed(spark, f"{path}/part-{r.part:05d}").select((F.col("doc") + before + 1).alias("position"), F.col("ids").cast("array<int>").alias("ids")))
        before += r.documents
    order = ranked(rows.select("doc_id", F.lit(0).alias("all")), "all", ["doc_id"]).select("doc_id", "position")
    return reduce(DataFrame.unionByName, parts).join(order, "position").select("doc_id", "ids")


@query(f"SELECT doc_id, [{_EOS}] || t || [{_EOS}] AS with_eos, [{_BOS}] || t AS with_bos FROM ({_TOKENS})")
def encoded_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's ids as a likelihood run scores them, by a tokenizer with an eos and by one with a bos alone."""
    ids = F.col("ids")
    return _tokens(spark, folder).select("doc_id", P.encoded_document(ids, _BOS, _EOS).alias("with_eos"), P.encoded_document(ids, _BOS).alias("with_bos"))


@query(f"""WITH e AS (SELECT doc_id, batch, [{_EOS}] || t || [{_EOS}] AS x FROM ({_TOKENS})), c AS (SELECT doc_id, batch, k AS chunk_start, x[k + 1:k + 128] AS x FROM (SELECT *, unnest(range(0, len(x) - 1, 127)) AS k FROM e)),
    w AS (SELECT *, max(len(x)) OVER (PARTITION BY batch) AS w FROM c)
    SELECT doc_id, batch, chunk_start, list_resize(x, w, {_PAD}) AS input_ids, list_transform(range(0, w), lambda i: i < len(x)) AS attention_mask FROM w""")
def scored_chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of 128 tokens that are scored, padded to the longest of their batch, with masks."""
    rows = _tokens(spark, folder).select("doc_id", "batch", P.encoded_document(F.col("ids"), _BOS, _EOS).alias("ids")).withColumn("n", F.size("ids").cast("bigint"))
    chunks = P.scored_chunks(rows.select("doc_id", "batch", "ids", "n"), ["doc_id", "batch", "ids"], "n", 128)
    cut = chunks.select("doc_id", "batch", "chunk_start", F.slice("ids", (F.col("chunk_start") + 1).cast("int"), (F.col("chunk_end") - F.col("chunk_start")).cast("int")).alias("input_ids"))
    return P.padded_rows(cut, ["batch"], "input_ids", _PAD)


@query(f"""WITH e AS (SELECT doc_id, len(p) AS p, (p || c || [{_EOS}])[1:65] AS x FROM (SELECT doc_id, {sql_hashed_ids("split_part(text, chr(10), 1)")} AS p, {sql_hashed_ids("text")} AS c FROM documents WHERE text IS NOT NULL))
    SELECT doc_id, list_resize(x, 65, {_PAD}) AS input_ids, list_resize(x, 65, {_PAD}) AS label_ids, list_transform(range(0, 65), lambda i: CASE WHEN i < len(x) THEN i ELSE -1 END) AS position_ids,
    list_transform(range(0, 65), lambda i: i >= p AND i < len(x)) AS label_mask, list_transform(range(0, 65), lambda i: i < len(x)) AS attention_mask FROM e WHERE p < len(x)""")
def sft_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Supervised examples of 65 tokens: a document's first line asks for the document; those whose prompt leaves no label drop out."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text")).where("text IS NOT NULL")
    ids = docs.select("doc_id", hashed_ids(F.substring_index("text", "\n", 1)).alias("p"), hashed_ids("text").alias("c"))
    rows = ids.select("doc_id", F.inline(F.array(P.supervised_rows(F.col("p"), F.col("c"), 64, _EOS, _PAD))))
    return rows.where(F.exists("label_mask", lambda x: x))


@query(f"SELECT run_name, doc_id, n + 1 AS with_both, n AS with_bos FROM ({_NLL}) WHERE n IS NOT NULL")
def encoded_lengths(spark: SparkSession, folder: str) -> DataFrame:
    rows = once(table(spark, folder, "nll_documents"), ["run_name", "doc_id"], ["predicted_tokens"]).where("predicted_tokens IS NOT NULL")
    return rows.select("run_name", "doc_id", P.encoded_length(F.col("predicted_tokens"), False).alias("with_both"), P.encoded_length(F.col("predicted_tokens"), True).alias("with_bos"))

