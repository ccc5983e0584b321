"""Snapshot differences, backfills and cache probes as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change from (path, content_hash): new, changed, unchanged or deleted; every path once."""
    b = before.select("path", F.col("content_hash").alias("old"), F.lit(True).alias("was"))
    a = after.select("path", F.col("content_hash").alias("new"), F.lit(True).alias("is"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return b.join(a, "path", "full_outer").select("path", change.alias("change"))


def misses(needed: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Each key that is needed and not cached, once."""
    return needed.select(key).distinct().join(cache, key, "left_anti")


def latest(rows: DataFrame, group: str, order: str, values: list[str]) -> DataFrame:
    """The last row of each group, by map-side aggregation rather than a window."""
    return rows.groupBy(group).agg(*[F.max_by(v, F.struct(order, v)).alias(v) for v in values], F.max(order).alias(order))


def reindex(before: DataFrame, after: DataFrame, old_chunks: DataFrame, chunked, embed) -> tuple[DataFrame, DataFrame]:
    """Chunks of the new snapshot and the change of each path: what is unchanged is copied with its vectors, the rest is made anew.

    before (path, content_hash), after (path, content_hash, text), old_chunks (path, chunk_index, content, embedding);
    ``chunked`` turns (path, text) into (path, chunk_index, content), ``embed`` a content column into a vector column.
    Unchanged files never reach either; deleted ones are in neither part.
    """
    changes = diff(before, after)
    same = changes.where("change = 'unchanged'").select("path")
    fresh = after.join(changes.where("change in ('new', 'changed')").select("path"), "path", "left_semi")
    copied = old_chunks.join(same, "path", "left_semi").select("path", "chunk_index", "content", "embedding", F.lit("copied").alias("origin"))
    made = chunked(fresh.select("path", "text")).select("path", "chunk_index", "content", embed(F.col("content")).alias("embedding"), F.lit("made").alias("origin"))
    return copied.unionByName(made), changes


def reindex_summary(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """n_processed and n_copied (chunks), deleted (paths in order)."""
    of = lambda o: F.count_if(F.col("origin") == o)
    gone = changes.where("change = 'deleted'").agg(F.sort_array(F.collect_list("path")).alias("deleted"))
    return chunks.agg(of("made").alias("n_processed"), of("copied").alias("n_copied")).join(gone)


def activate(pointers: DataFrame, versions: DataFrame) -> DataFrame:
    """document_id, version_id: pointers after ``versions`` (document_id, version_id, version_no, complete) came in.

    The last complete version of a document is its active one; a document without any keeps its pointer.
    """
    new = versions.where("complete").groupBy("document_id").agg(F.max_by("version_id", F.struct("version_no", "version_id")).alias("new"))
    return pointers.join(new, "document_id", "full_outer").select("document_id", F.coalesce("new", "version_id").alias("version_id"))
