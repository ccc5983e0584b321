"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

Normalised texts are cut where their content says so, chunks become verified identifiers, and documents
are compared as ordered lists of identifiers: a long text moves once, as chunks, to verify identifiers, and
never again; what the grouping moves is 8 bytes a chunk. Recipes are written once and read from there. Identifiers
that name two contents are next to none: where their table is as small as MOST_SHARED it goes to every task, and
only beyond that are recipes' identifiers moved to meet it, each once a text.

Defined results: a null text is an empty one, and all texts without visible characters are equal; a null
doc_id takes part, and loses ties against any doc_id; rows that repeat the kept row's doc_id with an equal
text of the same length are all kept (nothing tells them apart); an empty table gives an empty result;
further columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, text_key

SPACE = "[\\x20\\x09-\\x0D]+"
#: A chunk ends after this pattern, once it has LEAST characters, and at MOST in any case.
#: Identifiers of several contents up to which their table is broadcast (16 bytes each).
MOST_SHARED = 1_000_000
BOUNDARY, LEAST, MOST = "[aeiou.,][^aeiou][aeiou][^aeiou][^aeiou]", 1024, 8192


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The text cut at content-defined places; joined again they are the text."""
    pattern = f"(?s).{{{least},{most}}}?{BOUNDARY}|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, identify=F.xxhash64, least: int = LEAST, most: int = MOST) -> DataFrame:
    """doc_id, key, n_code_points, recipe (ordered chunk identifiers), text_sha256, unverified.

    ``unverified`` holds the text's SHA-256 for documents with a chunk whose identifier two different
    chunks share, else null: identifiers alone decide only where they are proven to name one content.
    """
    norm = docs.select("doc_id", text_key().alias("key"), F.col("text").alias("_text"), normalised(F.col("text")).alias("_norm"))
    rows = norm.select(
        "doc_id",
        "key",
        F.length(F.coalesce("_text", F.lit(""))).alias("n_code_points"),
        F.transform(chunks(F.col("_norm"), least, most), lambda c: identify(c)).alias("recipe"),
        F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
    )
    rows = materialize(rows, "recipes")
    # Each identifier's contents, combined in the scanning tasks first: a chunk that a third of the
    # documents have reaches the reducer once a task.
    content = docs.select(F.explode(chunks(normalised(F.col("text")), least, most)).alias("chunk"))
    dictionary = content.select(identify("chunk").alias("id"), "chunk").distinct()
    shared = materialize(dictionary.groupBy("id").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("id"), "shared")
    used = rows.select("text_sha256", F.explode("recipe").alias("id"))
    if bounded(shared, MOST_SHARED):
        doubtful = used.join(F.broadcast(shared), "id", "left_semi")
    else:
        doubtful = used.distinct().join(shared, "id", "left_semi")
    doubtful = materialize(doubtful.select(F.col("text_sha256").alias("unverified")).distinct(), "doubtful")
    if not bounded(doubtful, 0):
        return rows.join(doubtful, rows.text_sha256 == doubtful.unverified, "left")
    return rows.withColumn("unverified", F.lit(None).cast("string"))


def exact_dedup(docs: DataFrame, identify=F.xxhash64, least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, key (tells rows of one doc_id apart).

    Of equal texts the row with the most code points in the original stays, then the smallest doc_id.
    """
    rows = recipes(docs, identify, least, most).withColumn("recipe_hash", F.xxhash64("recipe"))
    best = F.min(F.struct((-F.col("n_code_points")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id"))
    groups = rows.groupBy("recipe_hash", "recipe", "unverified").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    g = groups.select(
        F.col("recipe_hash").alias("g_hash"),
        F.col("recipe").alias("g_recipe"),
        F.col("unverified").alias("g_unverified"),
        "group_size",
        F.col("best.doc_id").alias("keep_id"),
        (-F.col("best.less")).alias("keep_points"),
    )
    same = (rows.recipe_hash == g.g_hash) & (rows.recipe == g.g_recipe) & rows.unverified.eqNullSafe(g.g_unverified)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_code_points") == F.col("keep_points"))
    return rows.join(g, same).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "key")


ORACLE = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x FROM documents),
r AS (SELECT *, count(*) OVER (PARTITION BY x) AS group_size, first_value(doc_id) OVER (PARTITION BY x ORDER BY length(t) DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM r
"""
