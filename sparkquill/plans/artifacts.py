"""Queries for names, keys, kinds, encodings, profiles, job states and reports; they join the catalogue as it is imported."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import code, evaluation, ingestion
from ..sources import sinks
from ..streaming import state
from .catalog import query, read

_SAFE = r"""n AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(url, ''), '^.*[/\\]', ''), '[\x00-\x1F\x7F]', '', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '._') AS c FROM pages),
s AS (SELECT page_id, CASE WHEN c = '' THEN 'file' WHEN length(c) <= 200 THEN c ELSE left(c, 200 - length(regexp_extract(c, '[.][^.]{1,19}$'))) || regexp_extract(c, '[.][^.]{1,19}$') END AS name FROM n)"""


@query(f"WITH {_SAFE} SELECT page_id, name, 'projects/p1/documents/' || page_id || '/versions/v1/original/' || name AS object_key FROM s")
def safe_names(spark, sf_dir):
    key = names.original_key(F.lit("p1"), F.col("page_id").cast("string"), F.lit("v1"), F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", names.safe_name(F.col("url")).alias("name"), key.alias("object_key"))


@query(
    """WITH p AS (SELECT event_id, ['a', '..', '', 'b', '.'][event_id % 5 + 1] || '/' || ['..', 'x', '..', 'y'][event_id % 4 + 1] || '/' || event_type AS raw, event_id % 5 AS i, event_id % 4 AS j FROM events)
    SELECT event_id, CASE WHEN i IN (1, 2) OR (i = 4 AND j IN (0, 2)) THEN NULL
      WHEN j IN (0, 2) THEN string_split(raw, '/')[3] WHEN i = 4 THEN replace(raw, './', '') ELSE raw END AS member FROM p"""
)
def member_paths(spark, sf_dir):
    """Paths made of safe, climbing and empty parts."""
    of = lambda parts: F.get(F.array(*map(F.lit, parts)), (F.col("event_id") % len(parts)).cast("int"))
    raw = F.concat_ws("/", of(["a", "..", "", "b", "."]), of(["..", "x", "..", "y"]), "event_type")
    return read(spark, sf_dir, "events").select("event_id", names.member_path(raw).alias("member"))


@query(
    """WITH f AS (SELECT p_partkey, ['a.pdf', 'b.XLSX', 'd.e/c.webp', 'plain', 'x.weird', '.hidden'][p_partkey % 6 + 1] AS name,
      ['application/pdf', ' Text/Plain; charset=x', 'image/png', 'application/x-sh', 'video/mp4'][p_partkey % 5 + 1] AS mime FROM part)
    SELECT p_partkey, CASE name WHEN 'a.pdf' THEN 'pdf' WHEN 'b.XLSX' THEN 'office' WHEN 'd.e/c.webp' THEN 'image' WHEN 'x.weird' THEN 'text' END AS by_name,
      CASE mime WHEN 'application/pdf' THEN 'pdf' WHEN 'image/png' THEN 'image' WHEN 'video/mp4' THEN NULL ELSE 'text' END AS by_mime FROM f"""
)
def upload_kinds(spark, sf_dir):
    of = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values)).cast("int"))
    name, mime = of(["a.pdf", "b.XLSX", "d.e/c.webp", "plain", "x.weird", ".hidden"]), of(["application/pdf", " Text/Plain; charset=x", "image/png", "application/x-sh", "video/mp4"])
    return read(spark, sf_dir, "part").select("p_partkey", names.kind_of_name(name).alias("by_name"), names.kind_of_mime(mime).alias("by_mime"))


@query("SELECT doc_id, text, CASE WHEN text IS NOT NULL THEN ['utf-8', 'utf-8-sig', 'utf-16-le', 'utf-16-be'][doc_id % 4 + 1] END AS encoding FROM documents")
def decoded_texts(spark, sf_dir):
    """Texts written as bytes in four encodings and read back without being told which."""
    as_ = lambda mark, charset: F.concat(F.unhex(F.lit(mark)), F.encode("text", charset))
    kind = F.col("doc_id") % 4
    raw = F.when(kind == 0, as_("", "UTF-8")).when(kind == 1, as_("EFBBBF", "UTF-8")).when(kind == 2, as_("FFFE", "UTF-16LE")).otherwise(as_("FEFF", "UTF-16BE"))
    rows = read(spark, sf_dir, "documents").select("doc_id", names.decoded(raw).alias("d"))
    return rows.select("doc_id", "d.text", F.when(F.col("d.text").isNotNull(), F.col("d.encoding")).alias("encoding"))


@query(
    """SELECT s_suppkey, sha256('provider' || chr(0) || s_name || chr(0) || 'model' || chr(0) || 'm' || chr(0) || 'dimension' || chr(0) || s_nationkey || chr(0) || 'distance_metric' || chr(0) || '<__none__>' || chr(0)
      || 'query_prefix' || chr(0) || '<__none__>' || chr(0) || 'passage_prefix' || chr(0) || '<__none__>' || chr(0) || 'profile_version' || chr(0) || '1' || chr(0)) AS profile FROM supplier"""
)
def profile_hashes(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", names.profile_hash(provider=F.col("s_name"), model=F.lit("m"), dimension=F.col("s_nationkey"), profile_version=F.lit(1)).alias("profile"))


@query(
    """WITH p AS (SELECT conv_id AS doc, avg((length(trim(text)) >= 60)::INT) AS share FROM conversations GROUP BY conv_id)
    SELECT doc, doc % 7 = 0 OR doc % 11 = 0 OR round(share, 6) < 0.75 AS needs_ocr FROM p"""
)
def ocr_routing(spark, sf_dir):
    """Each seventh document is an image; of each eleventh the share of pages with text is unknown."""
    pages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    kind, share = F.when(F.col("doc") % 7 == 0, "image").otherwise("pdf"), F.when(F.col("doc") % 11 != 0, F.col("share"))
    return ingestion.coverage(pages, 60).select("doc", names.needs_ocr(kind, share).alias("needs_ocr"))


@query("SELECT user_id AS job, max(event_id) AS seq, arg_max(event_type, event_id) AS stage, arg_max(CASE WHEN value > 10 THEN 'running' ELSE 'queued' END, event_id) AS status, count(*) FILTER (event_type = 'signup') AS attempts FROM events GROUP BY user_id")
def job_states(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.when(F.col("value") > 10, "running").otherwise("queued").alias("status"))
    return state.job_states(log, "signup")


@query(
    """SELECT l_orderkey AS service, bool_and(l_quantity > 5) AS ok, CASE WHEN bool_and(l_quantity > 5) THEN 'ok' ELSE 'degraded' END AS status,
      list_sort(coalesce(list(l_linenumber) FILTER (NOT l_quantity > 5), [])) AS down FROM lineitem GROUP BY l_orderkey"""
)
def dependency_health(spark, sf_dir):
    checks = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("service"), F.col("l_linenumber").alias("dependency"), (F.col("l_quantity") > 5).alias("up"))
    return evaluation.health(checks)


@query(
    """SELECT event_id, '{"document_id":' || user_id || ',"retrieval_stage":"' || event_type || '"' || CASE WHEN event_id % 3 = 0 THEN ',"error_code":"e"' ELSE '' END || '}' AS line FROM events"""
)
def log_lines(spark, sf_dir):
    line = names.log_line(retrieval_stage=F.col("event_type"), document_id=F.col("user_id"), error_code=F.when(F.col("event_id") % 3 == 0, "e"), password=F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", line.alias("line"))


@query(
    """SELECT '# Report' || chr(10) || chr(10) || '## Orders' || chr(10) || chr(10) || '- customers: ' || printf('%.4f', count(DISTINCT o_custkey)::DOUBLE) || chr(10) || '- urgent: ' || printf('%.4f', avg((o_orderkey % 2)::DOUBLE))
      || chr(10) || '- nothing: n/a' || chr(10) || chr(10) || '## Gate' || chr(10) || chr(10) || '- passed: true' || chr(10) || '- a' || chr(10) || '- b' || chr(10) AS value FROM orders"""
)
def metrics_report(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    row = o.agg(
        F.countDistinct("o_custkey").alias("customers"), F.avg(F.col("o_orderkey") % 2).alias("urgent"), F.lit(None).cast("double").alias("nothing"),
        F.lit(True).alias("passed"), F.array(F.lit("a"), F.lit("b")).alias("reasons"),
    )
    return sinks.report(row, "Report", {"Orders": ["customers", "urgent", "nothing"], "Gate": ["passed", "reasons"]})


@query(
    r"""WITH RECURSIVE d AS (SELECT doc_id::VARCHAR AS file, text FROM documents WHERE text IS NOT NULL),
    l AS (SELECT file, greatest(1, length(text) // 4) <= 60 AS small, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d),
    g AS (SELECT *, sum(regexp_full_match(line, '\s*')::INT) OVER (PARTITION BY file ORDER BY n) AS island FROM l),
    b AS (SELECT file, min(n) AS a, max(n) AS z, string_agg(line, chr(10) ORDER BY n) AS t FROM g WHERE NOT small AND NOT regexp_full_match(line, '\s*') GROUP BY file, island),
    k AS (SELECT *, greatest(1, length(t) // 4) AS size, row_number() OVER (PARTITION BY file ORDER BY a) AS i FROM b),
    f AS (SELECT file, i, 0 AS chunk, size AS held, a, z, t FROM k WHERE i = 1 UNION ALL
      SELECT k.file, k.i, f.chunk + (f.held + k.size > 60)::INT, CASE WHEN f.held + k.size > 60 THEN k.size ELSE f.held + k.size END, k.a, k.z, k.t FROM f JOIN k ON k.file = f.file AND k.i = f.i + 1)
    SELECT file, chunk, min(a)::INT AS line_start, max(z)::INT AS line_end, md5(string_agg(t, chr(10) ORDER BY a)) AS content_md5 FROM f GROUP BY file, chunk
    UNION ALL SELECT file, 0, 1, max(n)::INT, md5(string_agg(line, chr(10) ORDER BY n)) FROM l WHERE small GROUP BY file HAVING bool_or(NOT regexp_full_match(line, '\s*'))"""
)
def code_blocks(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.lit("other").alias("language"), "text")
    return code.code_chunks(files, 60).select("file", "chunk", "line_start", "line_end", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(
    """SELECT c_custkey::VARCHAR AS file, i AS chunk, ['PACKAGE', 'PACKAGE BODY', 'PROCEDURE'][i + 1] AS kind, ['P', 'P', 'Q' || c_custkey][i + 1] AS name, CASE WHEN i = 2 THEN 'P' END AS enclosing, [1, 3, 5][i + 1]::INT AS line_start, [2, 4, 7][i + 1]::INT AS line_end
    FROM customer, (SELECT unnest([0, 1, 2])::INT AS i)"""
)
def plsql_objects(spark, sf_dir):
    """A package for each customer, whose literals and comments hold words that begin objects."""
    lines = ["CREATE PACKAGE p AS", "END;", "create or replace package body p is", " x varchar2(9) := 'procedure no'; -- procedure no", " procedure q%d is", "begin null;", "end; end;"]
    text = F.format_string("\n".join(lines), F.col("c_custkey"))
    files = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), F.lit("plsql").alias("language"), text.alias("text"))
    return code.code_chunks(files).select("file", "chunk", "kind", "name", "enclosing", "line_start", "line_end")
