"""Checks and bookkeeping of ingestion: stages, hit limits, uploads, page coverage, recognised blocks, backfills."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The order of stages and the progress that a status stands for.
STAGES = ["validating", "storing", "parsing", "chunking", "embedding", "indexing", "activating"]
PROGRESS = {"queued": 20, "running": 60, "completed": 100, "failed": 0}


def transitions(log: DataFrame, stages: list[str] = STAGES) -> DataFrame:
    """job, seq, stage, valid: each event must be the first stage again, or the successor of the one before."""
    number = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage"))
    order = Window.partitionBy("job").orderBy("seq")
    before = F.coalesce(F.lag("number").over(order), F.lit(0))
    rows = log.withColumn("number", number).withColumn("before", before)
    return rows.select("job", "seq", "stage", ((F.col("number") == 1) | ((F.col("number") > 1) & (F.col("number") == F.col("before") + 1))).alias("valid"))


def progress(status: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in PROGRESS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, status), F.lit(0))


def allowed_hits(hits: DataFrame, limit: int, seconds: float) -> DataFrame:
    """key, hit, allowed: a hit is allowed while under ``limit`` allowed ones lie in the seconds before it.

    Denied hits don't count, so each verdict depends on the ones before: a key's hits are walked in order of
    (ts, hit). Keys are sorted into partitions and streamed; what is held is the last ``limit`` allowed times of
    the key at hand, even where a key holds a third of all hits.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, times = None, []
        for frame in frames:
            verdicts = []
            for key, at in zip(frame["key"], frame["at"]):
                if key != now:
                    now, times = key, []
                times = [t for t in times if t > at - seconds]
                verdicts.append(len(times) < limit)
                if verdicts[-1]:
                    times.append(at)
            yield pd.DataFrame({"key": frame["key"], "hit": frame["hit"], "allowed": verdicts})

    rows = hits.select("key", "hit", F.col("ts").cast("timestamp").cast("double").alias("at"))
    dealt = rows.repartition("key").sortWithinPartitions("key", "at", "hit")
    return dealt.mapInPandas(walk, "key long, hit long, allowed boolean")


def batch_totals(files: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """batch, n_files, n_bytes, accepted from (batch, size)."""
    totals = files.groupBy("batch").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))
    return totals.withColumn("accepted", (F.col("n_files") <= most_files) & (F.col("n_bytes") <= most_bytes))


def signature(content: Column) -> Column:
    """The kind that the first bytes of a file name; null where none does."""
    first = F.hex(F.substring(content, 1, 12))
    starts = lambda *hexes: F.lit(False) if not hexes else first.rlike("^(?:" + "|".join(hexes) + ")")
    return (
        F.when(starts("25504446"), "pdf")
        .when(starts("504B0304", "504B0506", "D0CF11E0"), "office")
        .when(starts("89504E47", "FFD8FF", "47494638", "424D", "49492A00", "4D4D002A") | (starts("52494646") & (F.substring(first, 17, 8) == "57454250")), "image")
    )


def upload_verdict(claimed: Column, content: Column, most_bytes: int) -> Column:
    """ok, or why not: signatures are the truth, and what claims to be binary must have one."""
    found, size = signature(content), F.octet_length(content)
    return (
        F.when(size == 0, "empty")
        .when(size > most_bytes, "too_large")
        .when(found.isNotNull() & (found != claimed), "mismatch")
        .when(found.isNull() & claimed.isin("pdf", "office", "image"), "no_signature")
        .otherwise("ok")
    )


def coverage(pages: DataFrame, least: int = 20) -> DataFrame:
    """doc, share, kind, empty_pages from (doc, page, text): digital, scanned or mixed by the share of pages with text."""
    has = F.length(F.trim(F.coalesce("text", F.lit("")))) >= least
    share = F.avg(has.cast("int"))
    rows = pages.groupBy("doc").agg(F.round(share, 6).alias("share"), F.sort_array(F.collect_list(F.when(~has, F.col("page")))).alias("empty_pages"))
    kind = F.when(F.col("share") >= 0.75, "digital").when(F.col("share") <= 0.25, "scanned").otherwise("mixed")
    return rows.select("doc", "share", kind.alias("kind"), "empty_pages")


def recognised_blocks(tokens: DataFrame) -> DataFrame:
    """doc, block, text, confidence and the corners x0, y0, x1, y1 from one row for each recognised token."""
    ordered = F.sort_array(F.collect_list(F.struct("token", "text")))
    rows = tokens.groupBy("doc", "block").agg(
        F.array_join(F.transform(ordered, lambda t: t["text"]), " ").alias("text"),
        F.round(F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))), 4).alias("confidence"),
        F.min("left").alias("x0"), F.min("top").alias("y0"),
        F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"),
    )
    return rows


def weighted_confidence(blocks: DataFrame, least: float = 0.6) -> DataFrame:
    """doc, confidence (weighted by the length of the text), review."""
    known = F.col("confidence").isNotNull()
    size = F.length("text")
    mean = F.round(F.try_divide(F.sum(F.when(known, F.col("confidence") * size)), F.sum(F.when(known, size))), 4)
    return blocks.groupBy("doc").agg(mean.alias("confidence")).withColumn("review", F.coalesce(F.col("confidence") < least, F.lit(True)))


def filled(rows: DataFrame, source: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` whose ``value``, where it is null, comes from ``source`` (key, value); values that stand are not touched."""
    new = source.select(F.col(key).alias("_key"), F.col(value).alias("_new"))
    return rows.join(new, F.col(key) == F.col("_key"), "left").withColumn(value, F.coalesce(value, "_new")).drop("_key", "_new")


def next_version(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """document_id, version_no: one more than the last version, 1 for documents without any."""
    last = versions.groupBy("document_id").agg(F.max("version_no").alias("last"))
    return documents.join(last, "document_id", "left").select("document_id", (F.coalesce("last", F.lit(0)) + 1).alias("version_no"))
