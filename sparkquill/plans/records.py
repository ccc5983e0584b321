"""Queries for records that are found or made, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records
from ..sources import scratch
from ..sources.keyed import KeyedTable
from .catalog import query, read


def _id(*parts: str) -> str:
    framed = " || ".join(f"CASE WHEN {p} IS NULL THEN chr(0) ELSE chr(1) || strlen({p}::VARCHAR) || ':' || ({p}::VARCHAR) END" for p in parts)
    h = f"sha256({framed})"
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


_WANTED = """w AS (SELECT doc_id, lang AS project_id, source AS source_type, CASE WHEN doc_id % 23 <> 0 THEN md5(coalesce(text, '')) END AS origin_uri, 'document ' || doc_id AS name FROM documents)"""


@query(
    f"""WITH {_WANTED}, o AS (SELECT project_id, source_type, origin_uri, arg_min(name, name) AS name FROM w WHERE doc_id % 3 = 0 GROUP BY ALL),
    a AS (SELECT project_id, source_type, origin_uri, min(name) AS name FROM w GROUP BY ALL)
    SELECT {_id("a.project_id", "a.source_type", "a.origin_uri")} AS document_id, a.project_id, a.source_type, a.origin_uri, coalesce(o.name, a.name) AS name, o.name IS NULL AS created
    FROM a LEFT JOIN o ON a.project_id = o.project_id AND a.source_type = o.source_type AND a.origin_uri IS NOT DISTINCT FROM o.origin_uri"""
)
def get_or_create(spark, sf_dir):
    """Source documents of a first scan that saw a third of them, then of one that saw all."""
    d = read(spark, sf_dir, "documents")
    origin = F.when(F.col("doc_id") % 23 != 0, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    wanted = d.select("doc_id", F.col("lang").alias("project_id"), F.col("source").alias("source_type"), origin.alias("origin_uri"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("name"))
    table = KeyedTable(spark, scratch.new_folder(spark, "documents"), records.DOCUMENTS, records.DOCUMENT_KEY)
    records.source_documents(table, wanted.where("doc_id % 3 = 0"))
    return records.source_documents(table, wanted).drop("status")


_REQUESTS = """c AS (SELECT 'c' || event_id AS conversation_id, user_id::VARCHAR AS project_id, ts AS updated_at, to_timestamp(0) AS created_at FROM events WHERE event_type = 'signup'),
    r AS (SELECT event_id AS request, CASE WHEN event_id % 10 <> 0 THEN user_id::VARCHAR END AS project_id, CASE WHEN event_id % 7 = 0 THEN 'given' || event_id END AS conversation_id FROM events WHERE event_type = 'click'),
    l AS (SELECT project_id, arg_max(conversation_id, (updated_at, conversation_id)) AS last FROM c GROUP BY project_id)"""


@query(
    f"""WITH {_REQUESTS} SELECT request, r.project_id, coalesce(conversation_id, last, CASE WHEN r.project_id IS NOT NULL THEN {_id("'conversation'", "r.project_id")} END) AS conversation_id,
      conversation_id IS NULL AND last IS NULL AND r.project_id IS NOT NULL AS created FROM r LEFT JOIN l ON r.project_id = l.project_id"""
)
def conversation_resolve(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("project_id", F.col("user_id").cast("string"))
    ts = F.col("ts").cast("timestamp")
    held = e.where("event_type = 'signup'").select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("conversation_id"), "project_id", ts.alias("updated_at"), F.timestamp_seconds(F.lit(0)).alias("created_at"))
    given = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("given"), F.col("event_id").cast("string")))
    asked = e.where("event_type = 'click'").select(F.col("event_id").alias("request"), F.when(F.col("event_id") % 10 != 0, F.col("project_id")).alias("project_id"), given.alias("conversation_id"))
    return records.resolved_conversations(asked, held)


@query(
    f"""WITH d AS (SELECT c_custkey AS document_id, CASE WHEN c_custkey % 6 = 0 THEN 'given' || c_custkey END AS active FROM customer),
    v AS (SELECT 'old' || c_custkey AS version_id, c_custkey AS document_id, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 2 END AS version_no, CASE WHEN c_custkey % 8 = 0 THEN 'legacy-v0' ELSE 'p' END AS parser_profile FROM customer WHERE c_custkey % 3 = 0),
    n AS (SELECT {_id("'version'", "d.document_id", "1")} AS version_id, document_id FROM d WHERE document_id NOT IN (SELECT document_id FROM v)),
    l AS (SELECT version_id, document_id FROM n UNION ALL SELECT version_id, document_id FROM v WHERE version_no = 1 AND parser_profile = 'legacy-v0')
    SELECT o_orderkey AS chunk_id, CASE WHEN o_orderkey % 5 = 0 THEN 'v' || o_orderkey ELSE l.version_id END AS version_id, coalesce(d.active, l.version_id) AS active_version_id,
      o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 AS has_vector FROM orders JOIN d ON d.document_id = o_custkey LEFT JOIN l ON l.document_id = o_custkey"""
)
def backfill_steps(spark, sf_dir):
    """Customers as documents, orders as chunks; some have versions and vectors already. The second pass finds nothing to do."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    key = F.col("c_custkey")
    name = lambda prefix, k: F.concat(F.lit(prefix), k.cast("string"))
    documents = c.select(key.alias("document_id"), F.when(key % 6 == 0, name("given", key)).alias("active_version_id"))
    versions = c.where("c_custkey % 3 = 0").select(name("old", key).alias("version_id"), key.alias("document_id"), F.when(key % 4 == 0, 1).otherwise(2).alias("version_no"), F.lit("completed").alias("status"), F.when(key % 8 == 0, "legacy-v0").otherwise("p").alias("parser_profile"))
    order = F.col("o_orderkey")
    chunks = o.select(order.alias("chunk_id"), F.col("o_custkey").alias("document_id"), F.when(order % 5 == 0, name("v", order)).alias("version_id"), F.when(order % 2 == 0, F.array(F.lit(1.0))).alias("embedding"))
    profiles = spark.createDataFrame([], "profile_id string, provider string, model string, dimension int, distance_metric string, profile_version int")
    vectors = o.where("o_orderkey % 3 = 0").select(order.alias("chunk_id"), F.lit("other").alias("profile_id"), F.array(F.lit(2.0)).alias("embedding"))
    done = records.backfill(profiles, documents, versions, chunks, vectors, "m", 1)
    done = records.backfill(*(done[t] for t in ("profiles", "documents", "versions", "chunks", "vectors")), "m", 1)
    rows = done["chunks"].join(done["documents"], "document_id")
    has = done["vectors"].select("chunk_id").distinct().withColumn("has", F.lit(True))
    return rows.join(has, "chunk_id", "left").select("chunk_id", "version_id", "active_version_id", F.coalesce("has", F.lit(False)).alias("has_vector"))


@query(
    """SELECT c_custkey AS document_id, CASE c_custkey % 4 WHEN 0 THEN 'repository' WHEN 1 THEN 'archive' ELSE 'directory' END AS scanner, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 = 0 THEN c_mktsegment END AS relative_path,
      CASE WHEN c_custkey % 5 = 0 THEN 'no active version' WHEN c_custkey % 4 = 1 AND c_custkey % 7 <> 0 THEN 'original missing' END AS error FROM customer"""
)
def refresh_plans(spark, sf_dir):
    c, key = read(spark, sf_dir, "customer"), F.col("c_custkey")
    four = key % 4
    kind = F.when(four == 0, "repository").when(four == 1, "archive").when(four == 2, "directory")
    documents = c.select(key.alias("document_id"), kind.alias("source_type"), F.lit("origin").alias("origin_uri"), F.when(key % 5 != 0, key.cast("string")).alias("active_version_id"))
    settings = F.create_map(F.lit("relative_path"), F.col("c_mktsegment"))
    kept = records.scan_artifacts(c.where("c_custkey % 3 = 0").select(key.cast("string").alias("version_id"), settings.alias("settings")))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    originals = c.where("c_custkey % 7 = 0").select(F.lit("a").alias("artifact_id"), key.cast("string").alias("version_id"), F.lit("original").alias("artifact_type"), F.lit("k").alias("storage_key"), F.lit(1).cast("long").alias("size_bytes"), none.alias("metadata"))
    return records.refresh_plans(documents, kept.unionByName(originals)).select("document_id", "scanner", F.try_element_at("settings", F.lit("relative_path")).alias("relative_path"), "error")
