"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.

Stages keep all columns, whatever their names, and tell rows of one doc_id apart by their texts; of rows alike in both, the
dedup stages keep one. Null and empty texts are documents without words: they are scored like others, equal each other, have
no near copies and hold no test item. Rows without a doc_id are documents of their own. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from sparkquill.llm.common import bounded, materialize, table, text_key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go; what is scored is kept beside its row."""
    model, score = toxicity.fit(docs, table(spark, sf_dir, "labels")), "toxicity"
    while score in map(str.lower, docs.columns):
        score += "_"
    return model.score(docs, score).where(f"{score} < 0.5").drop(score)


def _named(docs: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``names`` (kept_id, kept_key, n) names by doc_id and text; of n rows alike in both, one."""
    names = materialize(names, "kept")
    same = docs.doc_id.eqNullSafe(names.kept_id) & (text_key() == names.kept_key)
    if bounded(names.where("n > 1"), 0):
        return docs.join(names, same, "left_semi").select(*docs.columns)
    once = docs.join(names.where("n = 1"), same, "left_semi").select(*docs.columns)
    alike = docs.join(names.where("n > 1"), same, "left_semi").select(*docs.columns)
    return once.unionByName(alike.dropDuplicates(["doc_id", "text"]))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays; a null doc_id is a document like others."""
    kept = exact_dedup.exact_dedup(docs.select("doc_id", "text")).where("kept")
    alike = kept.groupBy("text_sha256", "doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    first = alike.groupBy("text_sha256").agg(F.min(F.struct("key", "doc_id", "n")).alias("k"))
    return _named(docs, first.select(F.col("k.doc_id").alias("kept_id"), F.col("k.key").alias("kept_key"), "k.n"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 the smallest row stays; those with a null doc_id stay too."""
    first = near_dedup.near_dedup(docs.select("doc_id", "text"), 80).where("first")
    n = F.when(F.col("doc_id").isNull(), 1).otherwise(F.count(F.lit(1)))
    return _named(docs, first.groupBy("doc_id", "key").agg(n.alias("n")).select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"), "n"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a test item go."""
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    leaks = materialize(found.where("contaminated").select("doc_id", F.col("key").alias("leak")), "leaks")
    same = docs.doc_id.eqNullSafe(leaks.doc_id) & (text_key() == leaks.leak)
    return docs.join(leaks, same, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and place in it."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: Trees and alignments are beyond SQL; tests compare each stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
