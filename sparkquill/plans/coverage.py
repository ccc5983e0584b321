"""Queries for operators that had none: reranking, stages, evidence without lists, pointers, manifests, verdicts, means, tables, scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, code, context, evaluation, ingestion, retrieval, snapshots
from ..sources import files, scratch
from ..streaming import events
from .catalog import _DENSE, _FUSED, _LEXICAL, chunks, queries_, query, read, vectors
from .quality import _SAMPLES, _samples


def _fused(spark, sf_dir):
    q = queries_(spark, sf_dir)
    lists = {"dense": retrieval.dense(vectors(spark, sf_dir), q), "lexical": retrieval.lexical(chunks(spark, sf_dir), q)}
    lists = {name: scratch.saved(found, name) for name, found in lists.items()}  # shown, and fused
    ranks = [f.select("qid", "chunk_id", "rank", F.lit(name).alias("source")) for name, f in lists.items()]
    return lists | {"fused": retrieval.fuse(ranks[0].unionByName(ranks[1])).where("rank <= 20")}


_STAGES = f"""{_DENSE.strip()}, {_LEXICAL.strip()}, {_FUSED.strip()},
    st AS (SELECT 'dense' AS stage, qid, chunk_id, rank, score FROM dense UNION ALL SELECT 'lexical', qid, chunk_id, rank, score FROM lexical UNION ALL SELECT 'fused', qid, chunk_id, rank, score FROM r WHERE rank <= 20)"""


@query(f"WITH {_STAGES} SELECT * FROM st")
def search_stages(spark, sf_dir):
    return retrieval.stages(**_fused(spark, sf_dir))


@query(f"WITH {_STAGES}, n AS (SELECT qid, stage, count(*) AS n, arg_min(chunk_id, rank) AS first FROM st GROUP BY ALL) SELECT qid, stage, n, first, '60' AS rrf_k FROM n")
def debug_payloads(spark, sf_dir):
    """What a payload says of each stage: how many candidates, and the first."""
    payload = retrieval.debug_payload(retrieval.stages(**_fused(spark, sf_dir)), {"rrf_k": 60})
    parsed = F.from_json("payload", "config map<string,string>, stages map<string,array<struct<chunk_id:long,label:string,rank:int,score:double,source:string>>>")
    rows = payload.select("qid", parsed.alias("p")).select("qid", "p.config", F.explode("p.stages").alias("stage", "c"))
    return rows.select("qid", "stage", F.size("c").cast("long").alias("n"), F.get("c", F.lit(0))["chunk_id"].alias("first"), F.col("config")["rrf_k"].alias("rrf_k"))


@query(
    f"""WITH {_DENSE.strip()}, c AS (SELECT d.qid, d.chunk_id, d.rank, CASE d.chunk_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE e.label::VARCHAR END AS rerank FROM dense d JOIN embeddings e ON e.vec_id = d.chunk_id WHERE rank <= 20),
    s AS (SELECT *, coalesce(TRY_CAST(rerank AS DOUBLE), 0) AS score FROM c WHERE chunk_id % 4 <> 3)
    SELECT qid, chunk_id, score, rank FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, chunk_id) AS rank FROM s) WHERE rank <= 8"""
)
def rerank(spark, sf_dir):
    """Scores by label; some chunks are left out, some have no number."""
    found = retrieval.dense(vectors(spark, sf_dir), queries_(spark, sf_dir)).where("rank <= 20")
    label = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("label"))
    four = F.col("chunk_id") % 4
    scores = found.select("qid", "chunk_id").join(label, "chunk_id").where(four != 3).select("qid", "chunk_id", F.when(four == 1, F.lit("x")).when(four == 2, F.col("label")).alias("rerank"))
    return retrieval.kept_by_reranker(found, scores).select("qid", "chunk_id", "score", "rank")


@query(
    f"""WITH {_DENSE.strip()}, c AS (SELECT qid, chunk_id, rank, score, CASE chunk_id % 3 WHEN 0 THEN 'dense' WHEN 1 THEN 'lexical' ELSE 'identifier' END AS source FROM dense WHERE rank <= 5)
    SELECT qid, chunk_id, rank, CASE WHEN source = 'dense' THEN score END AS dense, CASE WHEN source = 'lexical' THEN score END AS lexical, source = 'identifier' AS identifier, source = 'identifier' AND score >= 0.9 AS exact_identifier, false AS presence FROM c"""
)
def fallback_signals(spark, sf_dir):
    found = retrieval.dense(vectors(spark, sf_dir), queries_(spark, sf_dir), 5)
    source = F.element_at(F.array(F.lit("dense"), F.lit("lexical"), F.lit("identifier")), (F.col("chunk_id") % 3 + 1).cast("int"))
    return retrieval.fallback_evidence(found.withColumn("source", source))


@query(
    f"""WITH {_DENSE.strip()}, l AS (SELECT qid, chunk_id, chunk_id % 3 AS list, CASE chunk_id % 3 WHEN 0 THEN 'dense' WHEN 1 THEN 'lexical' ELSE 'dense' END AS source FROM dense UNION ALL
      SELECT qid, chunk_id, 1, 'lexical' FROM dense WHERE rank % 2 = 0),
    u AS (SELECT qid, chunk_id, source, min(list) AS list FROM l GROUP BY ALL)
    SELECT qid, chunk_id, arg_min(source, list) AS source, list(source ORDER BY list) AS sources FROM u GROUP BY qid, chunk_id"""
)
def fused_sources(spark, sf_dir):
    found = retrieval.dense(vectors(spark, sf_dir), queries_(spark, sf_dir))
    of = (F.col("chunk_id") % 3).cast("int")
    every = found.select("qid", "chunk_id", of.alias("list"), F.when(of == 1, "lexical").otherwise("dense").alias("source"))
    return retrieval.fused_sources(every.unionByName(found.where("rank % 2 = 0").select("qid", "chunk_id", F.lit(1).alias("list"), F.lit("lexical").alias("source"))))


@query(
    """SELECT o_orderkey AS chunk_id, c_mktsegment AS project_id, n_name AS source_type, CASE WHEN c_custkey % 3 <> 0 THEN 'file ' || c_custkey END AS path FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    WHERE c_mktsegment = 'BUILDING' AND n_name IN ('FRANCE', 'KENYA', 'PERU') AND o_custkey % 5 = 0"""
)
def scoped_chunks(spark, sf_dir):
    """Orders as chunks of customers; segments are projects, nations are types of sources."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    held = o.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"), F.col("o_custkey").alias("source_file_id"), (F.col("o_custkey") % 5).alias("chunk_type"))
    documents = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("document_id"), F.col("c_mktsegment").alias("project_id"), F.col("n_name").alias("source_type"))
    paths = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("source_file_id"), F.concat(F.lit("file "), F.col("c_custkey").cast("string")).alias("path"))
    asked = {"project_id": "BUILDING", "source_type": ["FRANCE", "KENYA", "PERU"], "chunk_type": 0, "symbol_name": None}
    return retrieval.searchable(held, documents, paths, asked).select("chunk_id", "project_id", "source_type", "path")


@query(
    """WITH p AS (SELECT c_custkey AS document_id, c_custkey * 10 AS version_id FROM customer WHERE c_custkey % 3 = 0),
    v AS (SELECT o_custkey AS document_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS new FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1)
    SELECT coalesce(p.document_id, v.document_id) AS document_id, coalesce(new, version_id) AS version_id FROM p FULL JOIN v ON p.document_id = v.document_id"""
)
def active_versions(spark, sf_dir):
    pointers = read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("document_id"), (F.col("c_custkey") * 10).alias("version_id"))
    o = read(spark, sf_dir, "orders")
    return snapshots.activate(pointers, o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("version_no"), (F.col("o_orderkey") % 4 != 0).alias("complete")))


@query("SELECT user_id, arg_max(event_type, (ts, event_type)) AS event_type, arg_max(value, (ts, value)) AS value, max(ts) AS ts FROM events GROUP BY user_id")
def latest_rows(spark, sf_dir):
    return snapshots.latest(read(spark, sf_dir, "events"), "user_id", "ts", ["event_type", "value"])


@query("SELECT sha256(string_agg(path || ':' || h, chr(10) ORDER BY path || ':' || h)) AS revision FROM (SELECT url AS path, sha256(coalesce(html, '')) AS h FROM pages)")
def manifest_revision(spark, sf_dir):
    return files.manifest_hash(read(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("content_hash")))


@query(
    """WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'text' ELSE 'office' END AS claimed,
      CASE page_id % 7 WHEN 0 THEN '%PDF-1.7' WHEN 1 THEN 'PK' || chr(3) || chr(4) WHEN 2 THEN 'GIF89a' WHEN 3 THEN '' ELSE html END AS content FROM pages),
    k AS (SELECT *, CASE WHEN starts_with(content, '%PDF') THEN 'pdf' WHEN starts_with(content, 'PK' || chr(3) || chr(4)) THEN 'office' WHEN starts_with(content, 'GIF8') THEN 'image' END AS found FROM f)
    SELECT page_id, CASE WHEN content = '' THEN 'empty' WHEN strlen(content) > 3000 THEN 'too_large' WHEN found <> claimed THEN 'mismatch' WHEN found IS NULL AND claimed <> 'text' THEN 'no_signature' ELSE 'ok' END AS verdict FROM k"""
)
def upload_verdicts(spark, sf_dir):
    p, four, seven = read(spark, sf_dir, "pages"), F.col("page_id") % 4, F.col("page_id") % 7
    claimed = F.when(four == 0, "pdf").when(four == 1, "image").when(four == 2, "text").otherwise("office")
    content = F.when(seven == 0, F.lit("%PDF-1.7")).when(seven == 1, F.lit("PK\x03\x04")).when(seven == 2, F.lit("GIF89a")).when(seven == 3, F.lit("")).otherwise(F.col("html"))
    return p.select("page_id", ingestion.upload_verdict(claimed, content.cast("binary"), 3000).alias("verdict"))


@query(
    r"""WITH f AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a/x.PNG' WHEN 1 THEN 'x.tar.gz' WHEN 2 THEN 'noext' ELSE url END AS path, CASE page_id % 7 WHEN 0 THEN '%PDF-1' WHEN 1 THEN 'PK' || chr(3) || chr(4) WHEN 2 THEN '' ELSE html END AS content FROM pages)
    SELECT page_id, content <> '' AND (regexp_matches(lower(path), '[.](png|jpg|jpeg|gif|pdf|gz|zip|exe|bin)$') OR starts_with(content, '%PDF-') OR starts_with(content, 'PK' || chr(3) || chr(4)) OR starts_with(content, 'BM') OR starts_with(content, 'MZ')) AS is_binary FROM f"""
)
def binary_files(spark, sf_dir):
    p, five, seven = read(spark, sf_dir, "pages"), F.col("page_id") % 5, F.col("page_id") % 7
    path = F.when(five == 0, F.lit("a/x.PNG")).when(five == 1, F.lit("x.tar.gz")).when(five == 2, F.lit("noext")).otherwise(F.col("url"))
    content = F.when(seven == 0, F.lit("%PDF-1")).when(seven == 1, F.lit("PK\x03\x04")).when(seven == 2, F.lit("")).otherwise(F.col("html"))
    return p.select("page_id", files.is_binary_file(path, content.cast("binary")).alias("is_binary"))


@query(
    f"""WITH {_SAMPLES}, m AS (SELECT len(cited) / len(cites) AS coverage, CASE WHEN len(cited) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(cited, lambda c: list_contains(expected, c))) / len(cited) END AS accuracy,
      len(list_filter(aspects, lambda a: contains(lower(answer), a))) / 2 AS sufficiency, CASE WHEN list_contains(cited, 't1') AND list_contains(cited, 't3') AND qid % 2 <> 0 THEN 0.0::DOUBLE ELSE 1.0 END AS contradictions FROM g)
    SELECT round(avg(coverage), 6) AS coverage, round(avg(1 - coverage), 6) AS unsourced, round(avg(accuracy), 6) AS accuracy, round(avg(sufficiency), 6) AS sufficiency, round(avg(contradictions), 6) AS contradictions FROM m"""
)
def generation_means(spark, sf_dir):
    return evaluation.generation_summary(evaluation.generation(_samples(spark, sf_dir)))


@query(
    """WITH b AS (SELECT l_orderkey AS doc, length(l_shipmode_) AS n, CASE WHEN l_linenumber <> 3 THEN l_discount * 10 END AS c FROM (SELECT *, l_returnflag || l_linestatus || l_linenumber AS l_shipmode_ FROM lineitem)),
    s AS (SELECT doc, round(sum(c * n) FILTER (c IS NOT NULL) / nullif(sum(n) FILTER (c IS NOT NULL), 0), 4) AS confidence FROM b GROUP BY doc) SELECT doc, confidence, coalesce(confidence < 0.6, true) AS review FROM s"""
)
def confidence_by_document(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    text = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    return ingestion.weighted_confidence(l.select(F.col("l_orderkey").alias("doc"), text.alias("text"), F.when(F.col("l_linenumber") != 3, F.col("l_discount").cast("double") * 10).alias("confidence")))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 20 WHEN 1 THEN 60 WHEN 2 THEN 100 ELSE 0 END AS progress FROM events")
def job_progress(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ["queued", "running", "completed", "failed", "other", None])), (F.col("event_id") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", ingestion.progress(status).alias("progress"))


@query("SELECT * FROM events")
def deduplicated_events(spark, sf_dir):
    """Events of which a third were delivered twice."""
    e = read(spark, sf_dir, "events")
    return events.deduplicated(e.unionByName(e.where("event_id % 3 = 0")))


@query(
    """WITH RECURSIVE k AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, '| ' || turn || ' | ' || role || ' | ' || length(text) || ' |' AS line FROM conversations),
    z AS (SELECT *, greatest(1, length(line) // 4) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM k),
    f AS (SELECT conv_id, i, line, 0 AS chunk, 11 + n AS held FROM z WHERE i = 1
      UNION ALL SELECT z.conv_id, z.i, z.line, f.chunk + (f.held + n > 24)::INT, CASE WHEN f.held + n > 24 THEN 11 + n ELSE f.held + n END FROM f JOIN z ON z.conv_id = f.conv_id AND z.i = f.i + 1)
    SELECT conv_id AS table_id, chunk, '| turn | role | length |' || chr(10) || '| --- | --- | ----- |' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS content FROM f GROUP BY conv_id, chunk"""
)
def table_groups(spark, sf_dir):
    """A table for each conversation, in groups of at most 24 tokens."""
    c = read(spark, sf_dir, "conversations")
    row = F.concat(F.lit("| "), F.col("turn").cast("string"), F.lit(" | "), "role", F.lit(" | "), F.length("text").cast("string"), F.lit(" |"))
    rows = c.groupBy(F.col("conv_id").alias("table")).agg(F.sort_array(F.collect_list(F.struct("turn", row.alias("row")))).alias("r"))
    text = F.concat(F.lit("| turn | role | length |\n| --- | --- | ----- |\n"), F.array_join(F.transform("r", lambda x: x["row"]), "\n"))
    return chunking.table_groups(rows.select("table", text.alias("text")), 24).withColumnRenamed("table", "table_id")


@query(
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '[S1]' || chr(10) || 'Repository: ' || CASE WHEN page_id % 3 = 0 THEN '?' ELSE 'repo' END || chr(10) || 'Dosya: ' || url || CASE WHEN page_id % 5 = 0 THEN '' ELSE chr(10) || 'Satırlar: 3-' || CASE WHEN page_id % 7 = 0 THEN '?' ELSE page_id::VARCHAR END END
      ELSE '[S1]' || CASE WHEN page_id % 3 = 0 THEN '' ELSE chr(10) || 'Belge: name' END || chr(10) || 'Bölüm: A > B' || CASE WHEN page_id % 5 = 0 THEN '' ELSE chr(10) || 'Sayfa: 3' || CASE WHEN page_id % 7 = 0 THEN '' ELSE '-' || page_id END END END
      || chr(10) || 'İçerik: ' || coalesce(left(html, 50), '') AS block FROM pages"""
)
def evidence_blocks(spark, sf_dir):
    n, on = F.col("page_id"), lambda k, v: F.when(F.col("page_id") % k != 0, v)
    row = F.struct(
        (n % 2 == 0).alias("is_code"), on(3, F.lit("repo")).alias("repository"), F.when((n % 2 != 0) & (n % 3 != 0), F.lit("name")).alias("document_name"), F.col("url").alias("file_path"), F.lit("").alias("symbol_name"),
        on(5, F.lit(3)).alias("line_start"), on(5, on(7, n)).alias("line_end"), F.array(F.lit("A"), F.lit(None), F.lit("B")).alias("heading_path"),
        on(5, F.lit(3)).alias("page_start"), on(5, on(7, n)).alias("page_end"), F.substring("html", 1, 50).alias("content"),
    )
    return read(spark, sf_dir, "pages").select("page_id", context.evidence_block(F.lit("S1"), row).alias("block"))


@query(
    """WITH p AS (SELECT DISTINCT l_orderkey AS file, l_linenumber AS chunk, l_linenumber * 10 AS a, l_linenumber * 10 + 14 AS z FROM lineitem),
    s AS (SELECT DISTINCT l_orderkey AS file, 's' || l_partkey AS name, l_linenumber * 10 + 5 AS a, l_linenumber * 10 + 9 AS z FROM lineitem)
    SELECT p.file::VARCHAR AS file, p.chunk::INT AS chunk, coalesce(list(s.name ORDER BY s.a, s.name) FILTER (s.name IS NOT NULL), []) AS symbols FROM p LEFT JOIN s ON s.file = p.file AND s.a <= p.z AND s.z >= p.a GROUP BY ALL"""
)
def chunk_symbols(spark, sf_dir):
    """Lines of an order as chunks, and as symbols in the middle of each."""
    l, ten = read(spark, sf_dir, "lineitem"), (F.col("l_linenumber") * 10).cast("int")  # noqa: E741
    file = F.col("l_orderkey").cast("string").alias("file")
    pieces = l.select(file, F.col("l_linenumber").cast("int").alias("chunk"), F.lit(0).alias("part"), ten.alias("line_start"), (ten + 14).alias("line_end"))
    found = l.select(file, F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("name"), (ten + 5).alias("line_start"), (ten + 9).alias("line_end"))
    return code.with_symbols(pieces.distinct(), found).select("file", "chunk", "symbols")


@query("SELECT tag, coalesce(n, 0) AS n FROM (SELECT unnest(['signup', 'view', 'refund']) AS tag) LEFT JOIN (SELECT event_type AS tag, count(*) AS n FROM events GROUP BY 1) USING (tag)")
def wanted_tags(spark, sf_dir):
    return evaluation.categories(read(spark, sf_dir, "events").select(F.array("event_type").alias("tags")), ["signup", "view", "refund"])
