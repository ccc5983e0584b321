"""Searches over a kept index, each with the SQL of the search that reads the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import postings
from .catalog import ORACLES, chunks, queries_, query


def _index(spark: SparkSession, sf_dir: str) -> postings.PostingsIndex:
    """An index of an earlier state of the documents, some of which were missing or read otherwise, brought up to their present state."""
    now = chunks(spark, sf_dir).select("chunk_id", "text")
    before = now.where("chunk_id % 11 <> 3").withColumn("text", F.when(F.col("chunk_id") % 5 == 0, F.concat(F.lit("the "), "text")).otherwise(F.col("text")))
    before = before.unionByName(now.select((-1 - F.col("chunk_id")).alias("chunk_id"), "text").where("chunk_id % 13 = 0"))
    index = postings.PostingsIndex(spark)
    index.add(before)
    index.reindex(before, now)
    return index


@query(ORACLES["lexical_search"])
def indexed_search(spark, sf_dir) -> DataFrame:
    return _index(spark, sf_dir).search(queries_(spark, sf_dir))


@query(ORACLES["lexical_ranked"])
def indexed_ranked(spark, sf_dir) -> DataFrame:
    """Two words of each item, from an index that was compacted."""
    index = _index(spark, sf_dir)
    index.compact()
    two = queries_(spark, sf_dir).select("qid", F.array_join(F.slice(F.sort_array(T.query_terms(F.col("text"))), 1, 2), " ").alias("text"))
    return index.search(two)
