"""Queries for kinds of files, page texts, code units and places of chunks, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking
from ..sources import parsers
from .catalog import query, read


@query(
    r"""WITH p AS (SELECT doc_id // 10 AS file, doc_id AS page, regexp_replace(coalesce(text, ''), '[.] ', chr(10) || ' ' || chr(10), 'g') AS text FROM documents),
    l AS (SELECT file, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM p),
    b AS (SELECT file, page, n, trim(regexp_replace(line, '^\s+|\s+$', '', 'g')) AS line, sum(regexp_full_match(line, '\s*')::INT) OVER (PARTITION BY file, page ORDER BY n) AS island FROM l),
    g AS (SELECT file, page, min(n) AS n, string_agg(line, ' ' ORDER BY n) AS text FROM b WHERE line <> '' GROUP BY file, page, island)
    SELECT file::VARCHAR AS file, (row_number() OVER (PARTITION BY file ORDER BY page, n))::INT AS unit, 'paragraph' AS kind, md5(text) AS text_md5, page FROM g"""
)
def page_texts(spark, sf_dir):
    """Ten documents as the pages of one; sentences of a page are paragraphs, set apart by a line with a blank."""
    d = read(spark, sf_dir, "documents")
    pages = d.select(F.floor(F.col("doc_id") / 10).cast("string").alias("file"), F.col("doc_id").alias("page"), F.regexp_replace(F.coalesce("text", F.lit("")), "[.] ", "\n \n").alias("text"))
    return parsers.page_units(pages).withColumn("text_md5", F.md5(F.col("text").cast("binary"))).drop("text")


@query(
    r"""WITH f AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^?#]*', 0) AS name, CASE page_id % 6 WHEN 0 THEN 'text/plain; charset=x' WHEN 1 THEN 'image/x-own' WHEN 2 THEN 'text/x-c' WHEN 3 THEN NULL WHEN 4 THEN 'application/pdf' ELSE 'font/woff' END AS mime,
      CASE page_id % 7 WHEN 0 THEN '%PDF-1.7' WHEN 1 THEN 'PK' || chr(3) || chr(4) WHEN 2 THEN 'GIF89a' ELSE left(html, 20) END AS head FROM pages),
    e AS (SELECT *, lower(regexp_extract(regexp_extract(name, '[^/]*$', 0), '[^.].*[.]([^.]*)$', 1)) AS x FROM f),
    k AS (SELECT *, CASE WHEN x IN ('html', 'htm', 'xml', 'json') THEN 'code' WHEN x = 'pdf' THEN 'pdf' WHEN x = 'txt' THEN 'plain_text' END AS by_name,
      CASE WHEN mime LIKE 'text/plain%' THEN 'plain_text' WHEN mime LIKE 'image/%' THEN 'image' WHEN mime = 'text/x-c' THEN 'code' WHEN mime = 'application/pdf' THEN 'pdf' END AS by_mime,
      CASE WHEN head LIKE '\%PDF-%' ESCAPE '\' THEN 'pdf' WHEN head LIKE 'GIF8%' THEN 'image' END AS magic FROM e)
    SELECT page_id, CASE WHEN magic IS NULL AND by_name <> by_mime THEN NULL ELSE coalesce(magic, by_mime, by_name) END AS source_type,
      CASE WHEN magic IS NULL AND by_name <> by_mime THEN 'ambiguous' WHEN coalesce(magic, by_mime, by_name) IS NULL THEN 'unsupported' END AS error FROM k"""
)
def source_types(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    mime = F.element_at(F.array(*map(F.lit, ["text/plain; charset=x", "image/x-own", "text/x-c", None, "application/pdf", "font/woff"])), (F.col("page_id") % 6 + 1).cast("int"))
    seven = F.col("page_id") % 7
    head = F.when(seven == 0, F.lit("%PDF-1.7")).when(seven == 1, F.lit("PK\x03\x04")).when(seven == 2, F.lit("GIF89a")).otherwise(F.substring("html", 1, 20))
    return p.select("page_id", parsers.detected(F.regexp_extract("url", "^[a-z]+://[^?#]*", 0), mime, head.cast("binary")).alias("d")).select("page_id", "d.*")


@query(
    r"""WITH l AS (SELECT page_id, unnest(regexp_split_to_array(html, '\r\n|[\n\r]')) AS line, generate_subscripts(regexp_split_to_array(html, '\r\n|[\n\r]'), 1) AS n FROM pages WHERE html <> ''),
    c AS (SELECT page_id, max(n) - (arg_max(line, n) = '')::INT AS n_lines FROM l GROUP BY page_id),
    m AS (SELECT l.page_id, n, regexp_extract(line, '^<([A-Za-z_][A-Za-z0-9_.-]*)', 1) AS name, n_lines FROM l JOIN c USING (page_id) WHERE regexp_matches(line, '^<[A-Za-z_]'))
    SELECT page_id::VARCHAR AS file, name AS symbol_name, 'config_element' AS symbol_type, n::INT AS line_start, coalesce(lead(n) OVER (PARTITION BY page_id ORDER BY n) - 1, n_lines)::INT AS line_end FROM m"""
)
def code_symbols(spark, sf_dir):
    """Elements at the start of a line of each page, read as XML."""
    p = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file"), F.lit("xml").alias("language"), F.col("html").alias("text"))
    return parsers.code_units(p).where("kind = 'symbol'").select("file", "symbol_name", "symbol_type", "line_start", "line_end")


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
    b AS (SELECT *, sum(regexp_full_match(line, '\s*')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM l),
    g AS (SELECT doc_id, min(n) AS a, max(n) AS z FROM b WHERE NOT regexp_full_match(line, '\s*') GROUP BY doc_id, island),
    p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS unit, a, z FROM g),
    u AS (SELECT doc_id, unit // 3 AS chunk, unit, a, z, CASE WHEN unit % 2 = 1 THEN 'f' || doc_id || '-' || unit END AS file, CASE WHEN unit % 3 = 2 THEN unit END AS block, CASE WHEN unit % 4 <> 0 THEN unit END AS page FROM p)
    SELECT doc_id, chunk::INT AS chunk, arg_min(file, unit) FILTER (file IS NOT NULL) AS file_path, min(page)::INT AS page_start, max(page)::INT AS page_end, min(a)::INT AS line_start, max(z)::INT AS line_end,
      arg_min(block, unit) FILTER (block IS NOT NULL)::INT AS block_index FROM u GROUP BY doc_id, chunk"""
)
def locator_merge(spark, sf_dir):
    """Places of three paragraphs each, some without a file, block or page."""
    unit = F.col("paragraph")
    rows = chunking.paragraphs(read(spark, sf_dir, "documents")).select("doc_id", unit.alias("unit"), "line_start", "line_end")
    file = F.when(F.col("unit") % 2 == 1, F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("-"), F.col("unit").cast("string")))
    page = F.when(F.col("unit") % 4 != 0, F.col("unit"))
    units = parsers.located(rows.withColumns({"file": file, "page_start": page, "page_end": page, "block_index": F.when(F.col("unit") % 3 == 2, F.col("unit"))}))
    last = units.groupBy("doc_id", F.floor(F.col("unit") / 3).cast("int").alias("chunk")).agg(F.min("unit").alias("unit_first"), F.max("unit").alias("unit_last"))
    return chunking.located_chunks(last, units).select("doc_id", "chunk", "locator.*")
