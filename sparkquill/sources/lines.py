"""JSON lines with the number of the line that each record, or each error, stands on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of text files: blocks of a file are read apart, and counted on from the blocks before."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    inside = Window.partitionBy("file", "block").orderBy("at")
    placed = rows.withColumn("nth", F.row_number().over(inside))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, ["file", "block"]).select("file", (F.col("start") + F.col("nth")).alias("line"), "value")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """file, line, record (``schema``) and error of JSON lines; blank lines are left out.

    ``strict``: the first line that is no JSON object of the schema ends the reading with its place; else it is a row with an error.
    """
    lines = numbered_lines(spark, path).where(r"value rlike '\\S'")
    parsed = F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.select("file", "line", parsed.alias("record"), "value")
    error = F.when(F.col("record").isNull() | F.col("record._broken").isNotNull(), F.concat(F.lit("no record: "), F.substring("value", 1, 80)))
    rows = rows.select("file", "line", F.when(error.isNull(), F.col("record").dropFields("_broken")).alias("record"), error.alias("error"))
    if strict and (first := rows.where("error is not null").orderBy("file", "line").first()):
        raise ValueError(f"{first.file}:{first.line}: {first.error}")
    return rows
