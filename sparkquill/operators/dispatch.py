"""Units of a source to chunks: each family of units by its own chunker, one numbering, and the profile that made them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunking, code

#: The profile that chunks carry unless they are given another.
PROFILE = {"name": "sparkquill-chunker", "version": "1", "token_counter_method": "fallback"}


def profile_of(fields: dict[str, str]) -> Column:
    return F.struct(*[F.lit(fields[k]).alias(k) for k in PROFILE])


def chunked(units: DataFrame, most: int = chunking.MOST_TOKENS, profile: dict[str, str] = PROFILE) -> DataFrame:
    """doc_id, sequence_no, family, kind, unit_first, unit_last, heading_path, content, embedding_text, content_hash, tokens, profile.

    units (doc_id, unit, kind, text, markdown, heading_path, language): texts in a row are chunked together, every table by
    its rows under its header, every piece of code by its blocks; headings, images and page breaks give context only. Chunks are
    numbered from 1 in the order of their families.
    """
    placed = chunking.families(units)
    lone = placed.where(F.col("kind").isin(chunking.ALONE)).select("doc_id", "family")
    texts = chunking.document_chunks(units, most).join(lone, ["doc_id", "family"], "left_anti").select("doc_id", "family", "chunk", F.lit("text").alias("kind"), "unit_first", "unit_last", "heading_path", "content")
    alone = placed.where(F.col("kind").isin(chunking.ALONE)).withColumn("named", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("family").cast("string")))
    of = alone.select("named", "doc_id", "family", "kind", F.col("unit").alias("unit_first"), F.col("unit").alias("unit_last"), "heading_path")
    tables = chunking.table_groups(alone.where("kind = 'table'").select(F.col("named").alias("table"), F.coalesce("markdown", "text").alias("text")), most).withColumnRenamed("table", "named")
    blocks = code.code_chunks(alone.where("kind = 'code'").select(F.col("named").alias("file"), "language", "text"), most).select(F.col("file").alias("named"), (F.col("chunk") * 10_000 + F.col("part")).alias("chunk"), "content")
    cut = tables.unionByName(blocks).join(of, "named").select(*texts.columns)
    rows = texts.unionByName(cut)
    order = Window.partitionBy("doc_id").orderBy("family", "chunk")
    return rows.select(
        "doc_id", F.row_number().over(order).alias("sequence_no"), "family", "kind", "unit_first", "unit_last", "heading_path", "content",
        T.embedding_text(F.col("heading_path"), F.col("content")).alias("embedding_text"), F.sha2("content", 256).alias("content_hash"), T.naive_tokens(F.col("content")).alias("tokens"), profile_of(profile).alias("profile"),
    )
