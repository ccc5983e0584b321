"""Records that are found or made: source documents, embedding profiles, conversations with their messages and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.keyed import KeyedTable, content_id

DOCUMENTS = "document_id string, project_id string, source_type string, origin_uri string, name string, status string"
DOCUMENT_KEY = ["project_id", "source_type", "origin_uri"]
PROFILES = "profile_id string, provider string, model string, dimension int, distance_metric string, profile_version int, is_active boolean, created_at timestamp"
MESSAGES = "message_id string, conversation_id string, role string, content string, model string, answerable boolean"
CITATIONS = "message_id string, rank int, chunk_id long, document_id string, version_id string, page_start int, page_end int, line_start int, line_end int, retrieval_score double, reranker_score double, label string"
# What a profile is made with, and the title of a conversation that is made.
PROVIDER, METRIC, TITLE = "openai-compatible", "cosine", "Varsayılan Sohbet"


def source_documents(table: KeyedTable, wanted: DataFrame) -> DataFrame:
    """The document of each (project_id, source_type, origin_uri) in ``wanted`` (with a name), found in ``table`` or made, and ``created``."""
    made = wanted.select(content_id(*DOCUMENT_KEY).alias("document_id"), *DOCUMENT_KEY, "name", F.lit("processing").alias("status"))
    return table.get_or_create(made)


def active_profile(profiles: DataFrame, model: str, dimension: int, now) -> DataFrame:
    """One row: the active profile that was made last, as it is even if the model differs; without any, a new one and ``created``."""
    kind = dict(profiles.dtypes)
    last = profiles.where("is_active").orderBy(F.col("created_at").desc(), "profile_id").limit(1).withColumn("created", F.lit(False))
    fields = {"provider": PROVIDER, "model": model, "dimension": dimension, "distance_metric": METRIC, "profile_version": 1}
    made = profiles.sparkSession.range(1).select(*[F.lit(v).alias(c) for c, v in fields.items()])
    made = made.select(content_id(*fields).alias("profile_id"), *fields, F.lit(True).alias("is_active"), F.lit(now).alias("created_at"))
    made = made.select(*[F.col(c).cast(kind[c]).alias(c) for c in profiles.columns], F.lit(True).alias("created"))
    return last.unionByName(made.join(last.select("profile_id").withColumnRenamed("profile_id", "_there"), F.lit(True), "left_anti"))


def resolved_conversations(requests: DataFrame, conversations: DataFrame) -> DataFrame:
    """request, conversation_id, created for requests (request, project_id, conversation_id).

    A conversation that is named is taken as it is; else the project's that was last updated, then last made; a project
    without any gets one, whatever the number of its requests; without a project there is none.
    """
    order = F.struct("updated_at", "created_at", "conversation_id")
    last = conversations.where("project_id is not null").groupBy("project_id").agg(F.max_by("conversation_id", order).alias("last"))
    rows = requests.join(last, "project_id", "left")
    fresh = F.when(F.col("project_id").isNotNull(), content_id(F.lit("conversation"), F.col("project_id")))
    created = F.col("conversation_id").isNull() & F.col("last").isNull() & F.col("project_id").isNotNull()
    return rows.select("request", "project_id", F.coalesce("conversation_id", "last", fresh).alias("conversation_id"), created.alias("created"))


def new_conversations(resolved: DataFrame, now) -> DataFrame:
    """The rows to add to the conversations: one for each that was made."""
    made = resolved.where("created").select("conversation_id", "project_id").distinct()
    return made.select("conversation_id", "project_id", F.lit(TITLE).alias("title"), F.lit(now).cast("timestamp").alias("created_at"), F.lit(now).cast("timestamp").alias("updated_at"))


def persist_answers(messages: KeyedTable, citations: KeyedTable, answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds the message of each answer and the citations of its evidence; gives request, message_id.

    answers (request, conversation_id, content, model, answerable), evidence (request, rank, chunk_id, ...) as ``CITATIONS``
    has it. Messages are named by conversation and request, so an answer that comes again is there already. Answers
    without a conversation are not kept.
    """
    named = answers.where("conversation_id is not null").withColumn("message_id", content_id(F.lit("message"), F.col("conversation_id"), F.col("request")))
    messages.get_or_create(named.select("message_id", "conversation_id", F.lit("assistant").alias("role"), "content", "model", "answerable"))
    columns = [c.split()[0] for c in CITATIONS.split(", ")]
    held = evidence.join(named.select("request", "message_id"), "request")
    missing = [F.lit(None).alias(c) for c in columns if c not in held.columns and c != "label"]
    label = [] if "label" in held.columns else [F.concat(F.lit("S"), F.col("rank").cast("string")).alias("label")]
    citations.get_or_create(held.select("*", *missing, *label).select(*[F.col(c).cast(k.split()[1]).alias(c) for c, k in zip(columns, CITATIONS.split(", "))]))
    return named.select("request", "message_id")


# What rows from before versions are marked with.
LEGACY = "legacy-v0"


def backfill(profiles: DataFrame, documents: DataFrame, versions: DataFrame, chunks: DataFrame, vectors: DataFrame, model: str, dimension: int) -> dict[str, DataFrame]:
    """Brings rows from before there were versions into the versioned tables, in five steps; done again, it changes nothing.

    profiles (profile_id, provider, model, dimension, distance_metric, profile_version), documents (document_id,
    active_version_id, ...), versions (version_id, document_id, version_no, status, parser_profile), chunks (chunk_id, document_id,
    version_id, embedding, ...), vectors (chunk_id, profile_id, embedding). The profile that old vectors were made with is
    registered; a document without any version gets version 1; documents and chunks that name none are given it; and
    vectors that stand on chunks alone are copied under the profile. What is named already is never touched.
    """
    fields = {"provider": PROVIDER, "model": model, "dimension": dimension, "distance_metric": METRIC, "profile_version": 1}
    made = profiles.sparkSession.range(1).select(*[F.lit(v).alias(c) for c, v in fields.items()]).select(content_id(*fields).alias("profile_id"), *fields)
    key = ["provider", "model", "profile_version"]
    profiles = profiles.unionByName(made.join(profiles.select(*key), key, "left_anti"))
    profile = profiles.where((F.col("provider") == PROVIDER) & (F.col("model") == model) & (F.col("profile_version") == 1)).agg(F.min("profile_id").alias("_profile"))

    bare = documents.select("document_id").join(versions.select("document_id"), "document_id", "left_anti")
    first = bare.select(content_id(F.lit("version"), F.col("document_id"), F.lit(1)).alias("version_id"), "document_id", F.lit(1).alias("version_no"), F.lit("completed").alias("status"), F.lit(LEGACY).alias("parser_profile"))
    versions = versions.unionByName(first)
    legacy = versions.where((F.col("version_no") == 1) & (F.col("parser_profile") == LEGACY)).select("document_id", F.col("version_id").alias("_version"))
    filled = lambda rows, column: rows.join(legacy, "document_id", "left").withColumn(column, F.coalesce(column, "_version")).drop("_version").select(*rows.columns)
    stamped = filled(chunks, "version_id")
    # one profile: one row
    old = chunks.where("embedding is not null").select("chunk_id", "embedding").crossJoin(F.broadcast(profile)).withColumnRenamed("_profile", "profile_id")
    missing = old.join(vectors.select("chunk_id", "profile_id"), ["chunk_id", "profile_id"], "left_anti").select("chunk_id", "profile_id", "embedding")
    return {"profiles": profiles, "documents": filled(documents, "active_version_id"), "versions": versions, "chunks": stamped, "vectors": vectors.unionByName(missing)}


SCAN_CONFIG = "scan_config"


def scan_artifacts(versions: DataFrame, settings: str = "settings") -> DataFrame:
    """The artifact in which each version keeps how it was scanned: (version_id, settings map) as artifact_id, version_id, artifact_type, storage_key, size_bytes, metadata."""
    named = content_id(F.lit(SCAN_CONFIG), F.col("version_id"))
    return versions.select(named.alias("artifact_id"), "version_id", F.lit(SCAN_CONFIG).alias("artifact_type"), F.lit("inline:scan_config").alias("storage_key"), F.lit(0).cast("long").alias("size_bytes"), F.col(settings).alias("metadata"))


def refresh_plans(documents: DataFrame, artifacts: DataFrame) -> DataFrame:
    """document_id, scanner, settings, error: how to scan each document (document_id, source_type, origin_uri, active_version_id) again.

    Settings are those of the active version, none where it kept none. A document without an active version can't be scanned
    again, nor an archive whose original is not kept. Repositories go by their origin, directories by alias and path.
    """
    kept = artifacts.where(F.col("artifact_type") == SCAN_CONFIG).groupBy("version_id").agg(F.min_by("metadata", "artifact_id").alias("settings"))
    originals = artifacts.where("artifact_type = 'original'").select("version_id").distinct().withColumn("_original", F.lit(True))
    rows = documents.join(kept, F.col("active_version_id") == F.col("version_id"), "left").drop("version_id").join(originals, F.col("active_version_id") == F.col("version_id"), "left")
    kind = F.when(F.col("source_type").isin("repository", "archive"), F.col("source_type")).otherwise("directory")
    error = F.when(F.col("active_version_id").isNull(), "no active version").when((kind == "archive") & F.col("_original").isNull(), "original missing")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return rows.select("document_id", kind.alias("scanner"), F.coalesce("settings", none).alias("settings"), error.alias("error"))
