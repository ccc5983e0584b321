"""Queries for generated answers, golden sets, languages of paths, re-indexing; they join the catalogue as it is imported."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, retrieval, snapshots
from . import written
from .catalog import query, read

# Conversations as samples of answers: turns are claims, those of the assistant cite their number.
_SAMPLES = """s AS (SELECT conv_id AS qid, list(CASE WHEN role = 'assistant' THEN 't' || turn END ORDER BY turn) AS cites, string_agg(text, ' ' ORDER BY turn) AS answer FROM conversations GROUP BY conv_id),
g AS (SELECT *, list_filter(cites, lambda c: c IS NOT NULL) AS cited, ['t1', 't3'] AS expected, ['the', 'zebra'] AS aspects FROM s)"""


def _samples(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    cite = F.when(F.col("role") == "assistant", F.concat(F.lit("t"), "turn"))
    rows = c.groupBy(F.col("conv_id").alias("qid")).agg(F.sort_array(F.collect_list(F.struct("turn", "text", cite.alias("citation")))).alias("t"))
    words = lambda *x: F.array(*map(F.lit, x))
    return rows.select(
        "qid", F.transform("t", lambda x: F.struct(x["text"].alias("text"), x["citation"].alias("citation"))).alias("claims"), F.transform("t", lambda x: x["citation"]).alias("citations"),
        words("t1", "t3").alias("expected_sources"), words("the", "zebra").alias("required_aspects"), F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("answer"),
        F.array(F.struct(F.lit("t1").alias("l"), F.lit("t3").alias("r"))).alias("contradictory_pairs"), (F.col("qid") % 2 == 0).alias("hedged"),
    )


@query(
    f"""WITH {_SAMPLES} SELECT qid, len(cited) / len(cites) AS coverage, 1 - len(cited) / len(cites) AS unsourced,
      CASE WHEN len(cited) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(cited, lambda c: list_contains(expected, c))) / len(cited) END AS accuracy,
      len(list_filter(aspects, lambda a: contains(lower(answer), a))) / 2 AS sufficiency,
      CASE WHEN list_contains(cited, 't1') AND list_contains(cited, 't3') AND qid % 2 <> 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS contradictions FROM g"""
)
def generation_metrics(spark, sf_dir):
    return evaluation.generation(_samples(spark, sf_dir))


@query(
    """WITH r AS (SELECT documents.doc_id AS record, CASE WHEN documents.doc_id % 50 <> 0 THEN 'q' || (documents.doc_id // 2) ELSE ' ' END AS id, quality = 1 AS answerable, coalesce(toxic, 0) AS n
      FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id),
    e AS (SELECT record, 'empty id' AS error FROM r WHERE trim(id) = '' UNION ALL SELECT record, 'answerable is missing' FROM r WHERE answerable IS NULL
      UNION ALL SELECT record, 'not answerable but has sources' FROM r WHERE NOT coalesce(answerable, false) AND n > 0
      UNION ALL SELECT record, 'answerable without sources' FROM r WHERE answerable AND n = 0)
    SELECT * FROM e UNION ALL SELECT min(record), 'repeated id: ' || id || ' (' || count(*) || 'x)' FROM r WHERE trim(id) <> '' GROUP BY id HAVING count(*) > 1"""
)
def golden_validation(spark, sf_dir):
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")  # noqa: E741
    id_ = F.when(F.col("doc_id") % 50 != 0, F.concat(F.lit("q"), F.floor(F.col("doc_id") / 2))).otherwise(" ")
    one = F.array(F.struct(F.lit("a.md").alias("document")))
    sources = F.when(F.coalesce("toxic", F.lit(0)) > 0, one).otherwise(F.filter(one, lambda x: F.lit(False)))
    rows = d.join(l, "doc_id", "left").select(F.col("doc_id").alias("record"), id_.alias("id"), (F.col("quality") == 1).alias("answerable"), sources.alias("expected_sources"))
    return evaluation.golden_errors(rows)


@query("WITH t(tag) AS (VALUES ('click'), ('view'), ('refund')) SELECT tag, (SELECT count(*) FROM events WHERE event_type = tag) AS n FROM t")
def category_counts(spark, sf_dir):
    return evaluation.categories(read(spark, sf_dir, "events").select(F.array("event_type").alias("tags")), ["click", "view", "refund"])


@query(
    r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages), n AS (SELECT *, lower(string_split(path, '/')[-1]) AS name FROM p)
    SELECT page_id, CASE regexp_extract(name, '[.]([^.]*)$', 1) WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'php' THEN 'php' WHEN 'md' THEN 'markdown' WHEN 'txt' THEN 'plaintext' WHEN 'json' THEN 'json' WHEN 'xml' THEN 'xml' END AS language,
      regexp_matches(name, '[.](lock|lockb|min[.]js|min[.]css)$') OR len(list_intersect(string_split(path, '/'), ['target', 'dist', 'build'])) > 0 AS generated FROM n"""
)
def path_language(spark, sf_dir):
    path = F.regexp_replace("url", "[?#].*$", "")
    return read(spark, sf_dir, "pages").select("page_id", T.language(path).alias("language"), T.is_generated(path).alias("generated"))


_SECRET = " OR ".join(f"regexp_matches(text, $p${p}$p$)" for p in (written.PEM, written.TOKEN, written.KEY_VALUE))


@query(f"SELECT doc_id, CASE WHEN {_SECRET} THEN '[REDACTED]' WHEN length(text) > 1024 THEN substr(text, 1, 1024) || '...' ELSE text END AS field FROM documents")
def log_fields(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.log_field(F.col("text")).alias("field"))


@query(
    """SELECT doc_id AS path, 0 AS chunk_index, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'made' ELSE 'copied' END AS origin,
      CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN length(text) ELSE -1 END AS size FROM documents WHERE doc_id % 11 <> 0"""
)
def incremental_reindex(spark, sf_dir):
    """A snapshot without each seventh document, then one without each eleventh in which each fifth has changed."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    hashed = lambda mark: F.md5(F.concat(F.coalesce("text", F.lit("")), mark).cast("binary")).alias("content_hash")
    before, after = d.where("path % 7 <> 0"), d.where("path % 11 <> 0")
    old = before.select("path", F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.array(F.lit(-1.0).cast("float")).alias("embedding"))
    new = after.select("path", hashed(F.when(F.col("path") % 5 == 0, "x").otherwise("")), "text")
    chunked = lambda rows: rows.select("path", F.lit(0).alias("chunk_index"), F.col("text").alias("content"))
    chunks, _ = snapshots.reindex(before.select("path", hashed(F.lit(""))), new, old, chunked, lambda text: F.array(F.length(text).cast("float")))
    return chunks.select("path", "chunk_index", "origin", F.get("embedding", F.lit(0)).cast("long").alias("size"))


@query("SELECT lang, source, doc_id FROM documents WHERE lang IN ('en', 'de') AND source = 'src0' AND doc_id BETWEEN 0 AND 299")
def filter_terms(spark, sf_dir):
    """Filters of a search as conditions on columns; empty and unknown ones don't count."""
    asked = {"document_ids": list(range(300)), "source_type": "src0", "chunk_type": ["en", "de"], "project_id": "", "version_id": None, "other": "x", "scope": "code"}
    rows = read(spark, sf_dir, "documents").withColumnsRenamed({"doc_id": "document_id", "source": "source_type", "lang": "chunk_type"})
    for condition in retrieval.filters(asked):
        rows = rows.where(condition)
    return rows.select(F.col("chunk_type").alias("lang"), F.col("source_type").alias("source"), F.col("document_id").alias("doc_id"))
