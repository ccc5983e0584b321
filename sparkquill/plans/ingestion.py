"""Queries for contexts, citations, ingestion checks, symbols and Markdown; they join the catalogue as it is imported."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, ingestion, symbols
from .catalog import query, read

_CHUNKS = """k AS (SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS source_id, turn AS sequence_no, CASE WHEN turn >= 2 THEN conv_id * 1000 END AS parent_chunk_id,
  md5(text) AS content_hash, greatest(1, length(text) // 4) AS token_count, text AS content, role FROM conversations),
h AS (SELECT conv_id % 10 AS qid, conv_id * 1000 + turn AS chunk_id, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, turn) AS rank FROM conversations WHERE role = 'user')"""
_CONTEXT = f"""WITH RECURSIVE {_CHUNKS},
f AS (SELECT h.qid, h.rank, k.* FROM h JOIN k USING (chunk_id) WHERE rank <= 8),
a AS (SELECT qid, rank, 0 AS step, chunk_id, 'self' AS relation FROM f UNION ALL SELECT qid, rank, 1, parent_chunk_id, 'parent' FROM f WHERE parent_chunk_id IS NOT NULL
  UNION ALL SELECT qid, rank, 2, k.chunk_id, 'neighbour' FROM f JOIN k ON k.source_id = f.source_id AND k.sequence_no = f.sequence_no - 1
  UNION ALL SELECT qid, rank, 3, k.chunk_id, 'neighbour' FROM f JOIN k ON k.source_id = f.source_id AND k.sequence_no = f.sequence_no + 1),
b AS (SELECT a.*, content_hash, token_count, row_number() OVER (PARTITION BY qid, content_hash ORDER BY rank, step, a.chunk_id) AS nth FROM a JOIN k USING (chunk_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, step, chunk_id) AS place FROM b WHERE nth = 1),
r AS (SELECT qid, 0::BIGINT AS place, 0::BIGINT AS n, 0::BIGINT AS tokens, false AS truncated, NULL::BIGINT AS chunk_id, NULL::VARCHAR AS relation FROM (SELECT DISTINCT qid FROM c)
  UNION ALL SELECT c.qid, c.place, r.n + (r.n < 8 AND r.tokens + c.token_count <= 600)::INT, r.tokens + CASE WHEN r.n < 8 AND r.tokens + c.token_count <= 600 THEN c.token_count ELSE 0 END,
    r.truncated OR (r.n < 8 AND r.tokens + c.token_count > 600), CASE WHEN r.n < 8 AND r.tokens + c.token_count <= 600 THEN c.chunk_id END, c.relation
  FROM r JOIN c ON c.qid = r.qid AND c.place = r.place + 1),
o AS (SELECT qid, n::INT AS position, chunk_id, relation, bool_or(truncated) OVER (PARTITION BY qid) AS truncated FROM r)"""


def _chunks(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    id_ = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(
        id_.alias("chunk_id"), F.col("conv_id").alias("source_id"), F.col("turn").alias("sequence_no"), F.when(F.col("turn") >= 2, F.col("conv_id") * 1000).alias("parent_chunk_id"),
        F.md5(F.col("text").cast("binary")).alias("content_hash"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("token_count"), F.col("text").alias("content"), "role",
    )


def _contexts(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    asked = chunks.where("role = 'user'").select((F.col("source_id") % 10).alias("qid"), "chunk_id", F.lit(0).alias("score"))
    from ..operators.retrieval import ranked

    return context.build(ranked(asked, 8).select("qid", "chunk_id", "rank"), chunks, most_tokens=600), chunks


@query(f"{_CONTEXT} SELECT * FROM o WHERE chunk_id IS NOT NULL")
def context_build(spark, sf_dir):
    return _contexts(spark, sf_dir)[0]


@query(
    f"""{_CONTEXT} SELECT qid, 'S' || row_number() OVER (PARTITION BY qid ORDER BY position) AS label, o.chunk_id, substr(content, 1, 200) AS snippet
    FROM o JOIN k ON k.chunk_id = o.chunk_id WHERE content <> ''"""
)
def citation_rows(spark, sf_dir):
    return context.citations(*_contexts(spark, sf_dir))


@query(
    f"""{_CONTEXT}, l AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY position) AS n, content FROM o JOIN k ON k.chunk_id = o.chunk_id WHERE content <> '')
    SELECT qid, md5('Answer from the evidence alone.' || chr(10) || chr(10) || string_agg('[S' || n || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY n)) AS prompt_md5 FROM l GROUP BY qid"""
)
def prompt_assembly(spark, sf_dir):
    return context.prompts(*_contexts(spark, sf_dir)).select("qid", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


_KINDS = ["signup", "view", "click", "purchase"]


@query(
    """WITH n AS (SELECT user_id AS job, event_id AS seq, event_type AS stage, list_position(['signup', 'view', 'click', 'purchase'], event_type) AS number FROM events),
    b AS (SELECT *, coalesce(lag(coalesce(number, 0)) OVER (PARTITION BY job ORDER BY seq), 0) AS before FROM n)
    SELECT job, seq, stage, coalesce(number = 1 OR (number > 1 AND number = before + 1), false) AS valid FROM b"""
)
def stage_transitions(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"))
    return ingestion.transitions(log, _KINDS)


@query(
    """WITH RECURSIVE h AS (SELECT user_id AS key, event_id AS hit, epoch(ts) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT key, hit, i, true AS allowed, [sec] AS times FROM h WHERE i = 1
      UNION ALL SELECT h.key, h.hit, h.i, len(list_filter(times, lambda t: t > sec - 86400)) < 3,
        CASE WHEN len(list_filter(times, lambda t: t > sec - 86400)) < 3 THEN list_append(list_filter(times, lambda t: t > sec - 86400), sec) ELSE list_filter(times, lambda t: t > sec - 86400) END
      FROM r JOIN h ON h.key = r.key AND h.i = r.i + 1) SELECT key, hit, allowed FROM r"""
)
def rate_limit(spark, sf_dir):
    hits = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("hit"), "ts")
    return ingestion.allowed_hits(hits, 3, 86_400.0)


@query("SELECT source AS batch, count(*) AS n_files, sum(strlen(coalesce(text, '')))::BIGINT AS n_bytes, count(*) <= 20000 AND sum(strlen(coalesce(text, ''))) <= 1000000 AS accepted FROM documents GROUP BY source")
def upload_batches(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("batch"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    return ingestion.batch_totals(d, 20_000, 1_000_000)


@query(
    """WITH p AS (SELECT conv_id AS doc, turn AS page, length(trim(text)) >= 60 AS has FROM conversations), s AS (SELECT doc, round(avg(has::INT), 6) AS share, list_sort(coalesce(list(page) FILTER (NOT has), [])) AS empty_pages FROM p GROUP BY doc)
    SELECT doc, share, CASE WHEN share >= 0.75 THEN 'digital' WHEN share <= 0.25 THEN 'scanned' ELSE 'mixed' END AS kind, empty_pages FROM s"""
)
def page_coverage(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return ingestion.coverage(c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text"), 60)


@query(
    """SELECT l_orderkey AS doc, l_linenumber % 2 AS block, string_agg(l_shipmark, ' ' ORDER BY l_linenumber, l_shipmark) AS text, round(avg(round(l_tax * 100)), 4) AS confidence,
    min(l_suppkey) AS x0, min(l_partkey) AS y0, max(l_suppkey + l_linenumber) AS x1, max(l_partkey + l_linenumber) AS y1
    FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmark FROM lineitem) GROUP BY ALL"""
)
def ocr_blocks(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").withColumn("block", F.col("l_linenumber") % 2)  # noqa: E741
    return ingestion.recognised_blocks(
        l.select(
            F.col("l_orderkey").alias("doc"), "block", F.col("l_linenumber").alias("token"), F.concat("l_returnflag", "l_linestatus").alias("text"), F.round(F.col("l_tax") * 100).alias("confidence"),
            F.col("l_suppkey").alias("left"), F.col("l_partkey").alias("top"), F.col("l_linenumber").alias("width"), F.col("l_linenumber").alias("height"),
        )
    )


@query("SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN d.n_chars END, l.quality)::BIGINT AS value FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def backfill_update(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).alias("value"))
    return ingestion.filled(d, read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("value")), "doc_id", "value")


@query("SELECT c_custkey AS document_id, coalesce(max(o_orderkey), 0) + 1 AS version_no FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def version_numbers(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return ingestion.next_version(c.select(F.col("c_custkey").alias("document_id")), o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_no")))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def count_per_parent(spark, sf_dir):
    n = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return read(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT count(*) AS events, sum(o_orderkey)::BIGINT AS key_sum FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def versions_in_set(spark, sf_dir):
    chosen = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = read(spark, sf_dir, "orders").join(chosen, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return o.agg(F.count(F.lit(1)).alias("events"), F.sum("o_orderkey").alias("key_sum"))


@query("""SELECT event_id AS file, 'config' AS language, regexp_extract(props, '"([A-Za-z_]+)":', 1) AS name, 'key' AS kind, 1 AS line_start, 1 AS line_end FROM events""")
def config_symbols(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return symbols.symbols(e.select(F.col("event_id").alias("file"), F.lit("config").alias("language"), F.regexp_replace("props", "^[{]", "").alias("text")))


@query()
def markdown_units(spark, sf_dir):
    return symbols.markdown(read(spark, sf_dir, "documents"))
