"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import byte_length, sql_budget_tokens, sql_clean_lang, sql_strip, strip
from millrace.llm.bpe import encode_texts
from millrace.llm.budget import slice_shortfalls, slice_totals, tokenizer_budget
from millrace.llm.crosssplit import cross_split
from millrace.llm.leaks import leaked_items
from millrace.llm.mixture import SEATS, SHARDS, mixture, mixture_plan, mixture_shares, shard_quotas, sized_records, unfilled
from millrace.llm.neardup import similar_groups, similar_pairs
from millrace.llm.reading import reading_levels
from millrace.llm.subjects import document_subjects
from millrace.session import stored, table


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    return document_subjects(table(spark, folder, "evaluation_documents"), table(spark, folder, "subject_labels"), table(spark, folder, "subjects"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder).select("doc_id", "subject")


def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Records and bytes of each subject by split, a record counting for every subject it has."""
    records = table(spark, folder, "evaluation_documents").where("doc_id IS NOT NULL")
    once = records.groupBy("doc_id").agg(F.first("split").alias("split"), F.first(F.coalesce(byte_length(strip("text")), F.lit(0))).alias("bytes"))
    found = stored(_subjects(spark, folder), "subjects").select("doc_id", "subject")
    total = once.groupBy("split").agg(F.count("*").alias("all_records"))
    out = once.join(found, "doc_id").groupBy("split", "subject").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes")).join(total, "split")
    return out.select("split", "subject", "records", "bytes", F.round(F.col("records") / F.col("all_records"), 6).alias("share"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    totals = stored(slice_totals(table(spark, folder, "evaluation_documents")), "slices")  # read twice; a row a slice
    return slice_shortfalls(totals, table(spark, folder, "slice_budgets")).where("short").select("source", "lang", "domain")


def p3_slices(spark: SparkSession, folder: str) -> DataFrame:
    return slice_totals(table(spark, folder, "evaluation_documents"))


def p3_tokenizers(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer_budget(*(table(spark, folder, t) for t in ("evaluation_documents", "nll_documents", "data_stages", "registry")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    sized = sized_records(table(spark, folder, "evaluation_documents"))
    sizes = stored(sized.groupBy("source").agg(F.sum("bytes").alias("bytes")), "sizes")  # read twice; a row a source
    return unfilled(mixture_plan(sizes, table(spark, folder, "mixture_targets"))).select("source")


def p4_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "evaluation_documents"), table(spark, folder, "mixture_targets"))


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture_shares(table(spark, folder, "evaluation_documents"), table(spark, folder, "mixture_targets"))


def p4_quotas(spark: SparkSession, folder: str) -> DataFrame:
    return shard_quotas(table(spark, folder, "mixture_targets"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(table(spark, folder, "evaluation_documents"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return similar_groups(table(spark, folder, "evaluation_documents"))


def _cross(spark: SparkSession, folder: str) -> DataFrame:
    return cross_split(table(spark, folder, "evaluation_documents"), table(spark, folder, "curated").where("partition = 'train'"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cross(spark, folder).select("doc_id", F.col("ord").alias("train_ord"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """By split and source: records, those with a counterpart in training, those with an equal one, links, and the longest shared run of words."""
    once = table(spark, folder, "evaluation_documents").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.first("split").alias("split"), F.first("source").alias("source"))
    per_doc = _cross(spark, folder).groupBy("doc_id").agg(F.count("*").alias("links"), F.max((F.col("shared") == F.col("total")).cast("int")).alias("equal"), F.max("longest").alias("longest"))
    out = once.join(per_doc, "doc_id", "left").groupBy("split", "source")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.agg(F.count("*").alias("records"), F.count("links").alias("overlapping"), zero(F.sum("equal")).alias("equal"), zero(F.sum("links")).alias("links"), zero(F.max("longest")).alias("longest_run"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leaked_items(table(spark, folder, "documents"), table(spark, folder, "test_items"), names=False)  # a verbatim passage meets its window by the plain template
    return found.where("verbatim > 0").select("doc_id", "item_id")


def p8_reworded(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with passages of an item in other numbers, names and units, beside the verbatim ones."""
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "test_items"))


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_labels"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).select("doc_id", "level")


def p9_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and sentences of each level by source."""
    sources = table(spark, folder, "documents").select("doc_id", "source")
    return _levels(spark, folder).join(sources, "doc_id").groupBy("source", "level").agg(F.count("*").alias("documents"), F.sum("sentences").alias("sentences"), F.round(F.avg("median_grade"), 6).alias("median_grade"))


QUERIES = {f.__name__: f for f in (p1_found, p1_shares, p3_found, p3_slices, p3_tokenizers, p4_found, p4_mixture, p4_shares, p4_quotas, p5_found, p5_groups, p6_found, p6_report, p7_ids, p8_found, p8_reworded, p9_found, p9_profile)}

_E = "SELECT doc_id, any_value(text) AS text, any_value(source) AS source, any_value(split) AS split, any_value(lang) AS lang, any_value(domain) AS domain FROM evaluation_documents GROUP BY doc_id"
_SLICES = f"""SELECT source, {sql_clean_lang('lang')} AS lang, domain, count(*) AS records, count(DISTINCT md5(text)) AS distinct_texts,
    CAST(sum(CASE WHEN text IS NULL THEN 0 ELSE {sql_budget_tokens('text')} END) AS BIGINT) AS tokens FROM ({_E}) GROUP BY 1, 2, 3"""
_BYTES = f"coalesce(octet_length(encode({sql_strip('text')})), 0)"
_CAPACITY = f"""SELECT m.source, m.target_weight, m.max_repeats, coalesce(s.bytes, 0) AS bytes, t.total,
    coalesce(s.bytes, 0) * m.max_repeats < m.target_weight * t.total AS capped
    FROM mixture_targets m LEFT JOIN (SELECT source, sum({_BYTES}) AS bytes FROM ({_E}) GROUP BY source) s ON m.source = s.source,
    (SELECT sum({_BYTES}) AS total FROM ({_E})) t"""

_SEATS = f"""SELECT source, k, CAST((rank - 1) * {SHARDS} // {SEATS} AS INTEGER) AS shard FROM (SELECT source, k, row_number() OVER (ORDER BY target_weight / (2 * k + 1) DESC, source, k) AS rank
    FROM mixture_targets, (SELECT unnest(range(0, {SEATS})) AS k) WHERE target_weight > 0) WHERE rank <= {SEATS}"""
_MIXTURE = f"""WITH e AS (SELECT doc_id, source, {_BYTES} AS bytes FROM ({_E})), seats AS ({_SEATS}), q AS (SELECT source, count(*) AS quota FROM seats GROUP BY source), cap AS ({_CAPACITY}),
    plan AS (SELECT cap.*, coalesce(q.quota, 0) AS quota, CAST(coalesce(q.quota, 0) AS HUGEINT) * total // {SEATS} AS wanted FROM cap LEFT JOIN q ON cap.source = q.source),
    o AS (SELECT doc_id, source, bytes, sum(bytes) OVER (PARTITION BY source ORDER BY md5('17:' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) - bytes AS start FROM e WHERE bytes > 0),
    c AS (SELECT o.doc_id, o.source, o.bytes, o.start, p.bytes AS have, p.total, p.wanted, unnest(range(0, p.max_repeats)) AS copy FROM o JOIN plan p ON o.source = p.source),
    u AS (SELECT c.doc_id, c.source, CAST(c.bytes AS BIGINT) AS bytes, CAST(c.copy AS INTEGER) AS copy, s.shard FROM c JOIN seats s ON s.source = c.source AND s.k = (c.copy * c.have + c.start) * {SEATS} // c.total WHERE c.copy * c.have + c.start + c.bytes <= c.wanted)"""


def _words(rows: str) -> str:
    """(id, w): the words of each row of (id, text)."""
    return f"SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM ({rows}) WHERE text IS NOT NULL"


def _sets(rows: str, width: int, least: int) -> str:
    """(id, s): each row's distinct runs of words."""
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return f"SELECT DISTINCT id, {run} AS s FROM (SELECT id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM ({_words(rows)}) WHERE len(w) >= {least})"


def _ordered(rows: str, width: int, least: int) -> str:
    """(id, i, s): each row's runs of words in order."""
    return _sets(rows, width, least).replace("SELECT DISTINCT id,", "SELECT id, i,", 1)


_CROSS = f"""e AS ({_sets(f'SELECT doc_id AS id, text FROM ({_E})', 3, 30)}), t AS ({_sets("SELECT ord AS id, any_value(text) AS text FROM curated WHERE partition = 'train' GROUP BY ord", 3, 30)}),
        en AS (SELECT id, count(*) AS n FROM e GROUP BY id), tn AS (SELECT id, count(*) AS n FROM t GROUP BY id),
        p AS (SELECT e.id AS x, t.id AS y, count(*) AS c FROM e JOIN t ON e.s = t.s GROUP BY 1, 2),
        g AS (SELECT x, y, c = en.n + tn.n - c AS equal FROM p JOIN en ON en.id = x JOIN tn ON tn.id = y WHERE c * 5 >= (en.n + tn.n - c) * 3)"""

SQL = {
    "p3_found": f"""WITH s AS ({_SLICES}) SELECT b.source, b.lang, b.domain FROM slice_budgets b LEFT JOIN s ON b.source = s.source AND b.lang = s.lang AND b.domain = s.domain
        WHERE coalesce(s.tokens, 0) * 1000000 < b.requested_ppm * (SELECT sum(tokens) FROM s)""",
    "p3_slices": _SLICES,
    "p4_found": f"SELECT source FROM ({_CAPACITY}) WHERE capped",
    "p4_mixture": f"{_MIXTURE} SELECT * FROM u",
    "p4_shares": f"""{_MIXTURE} SELECT p.source, p.target_weight, p.max_repeats, p.quota, coalesce(x.n, 0) AS used_records, CAST(coalesce(x.b, 0) AS BIGINT) AS used_bytes,
        round(CAST(coalesce(x.b, 0) AS DOUBLE) / sum(x.b) OVER (), 9) AS share, NOT p.capped AS target_met FROM plan p LEFT JOIN (SELECT source, count(*) FILTER (copy = 0) AS n, sum(bytes) AS b FROM u GROUP BY source) x ON p.source = x.source""",
    "p4_quotas": f"SELECT shard, source, count(*) AS quota FROM ({_SEATS}) GROUP BY 1, 2",
    "p5_found": f"""WITH s AS ({_sets(f'SELECT doc_id AS id, text FROM ({_E})', 3, 30)}), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        p AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
        SELECT x AS doc_id_a, y AS doc_id_b FROM p JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE c * 5 >= (a.n + b.n - c) * 3""",
    "p6_found": f"WITH {_CROSS} SELECT x AS doc_id, y AS train_ord FROM g",
    "p6_report": f"""WITH {_CROSS}, w AS ({_ordered("SELECT ord AS id, any_value(text) AS text FROM curated WHERE partition = 'train' GROUP BY ord", 3, 30)}),
        h AS (SELECT g.x, g.y, w.i - row_number() OVER (PARTITION BY g.x, g.y ORDER BY w.i) AS island FROM g JOIN w ON w.id = g.y JOIN e ON e.id = g.x AND e.s = w.s),
        l AS (SELECT x, y, max(n) + 2 AS longest FROM (SELECT x, y, island, count(*) AS n FROM h GROUP BY ALL) GROUP BY 1, 2),
        d AS (SELECT g.x, count(*) AS links, max(equal::INT) AS equal, max(longest) AS longest FROM g JOIN l ON g.x = l.x AND g.y = l.y GROUP BY 1)
        SELECT split, source, count(*) AS records, count(links) AS overlapping, CAST(coalesce(sum(equal), 0) AS BIGINT) AS equal, CAST(coalesce(sum(links), 0) AS BIGINT) AS links, coalesce(max(longest), 0) AS longest_run
        FROM ({_E}) o LEFT JOIN d ON d.x = o.doc_id WHERE o.doc_id IS NOT NULL GROUP BY 1, 2""",
    "p5_groups": f"""WITH RECURSIVE e AS (SELECT doc_id AS id, md5(text) AS h, text FROM ({_E}) WHERE text IS NOT NULL AND doc_id IS NOT NULL), t AS (SELECT min(id) AS id, any_value(text) AS text, h, count(*) AS copies FROM e GROUP BY h),
        s AS ({_sets('SELECT id, text FROM t', 5, 5)}), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        p AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE c * 5 >= (a.n + b.n - c) * 4), g AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT id, id AS root FROM t UNION SELECT r.id, g.y FROM r JOIN g ON r.root = g.x)
        SELECT e.id AS doc_id, m.root AS group_id, t.copies FROM e JOIN t ON e.h = t.h JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) m ON m.id = t.id""",
    "p8_found": f"""WITH d AS ({_sets('SELECT doc_id AS id, text FROM documents', 12, 12)}), i AS ({_sets('SELECT item_id AS id, text FROM test_items', 12, 12)})
        SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM d JOIN i ON d.s = i.s""",
}
