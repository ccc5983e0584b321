"""Ingestion of jobs, a batch at a time, from a stream or from a table: bytes to text to chunks to vectors to active versions.

A job (job_id, document_id, version_id, version_no, name, content) takes one version of a document in. Each batch leaves
three tables in folders of its own number: ``jobs`` (how each ended), ``events`` (the stages each went through) and
``chunks``; then the lexical index is brought up to date, and last a commit is written under the batch's number. Readers see
committed batches alone. So a batch that was cut off is simply done again over its own folders, and one that is
delivered again after its commit is left out: a stopped and restarted stream leaves what one run leaves.

A job that an earlier batch completed is left out too, and a job that stands twice in a batch is done once. Failed jobs may come
again and count their attempts. Secrets are masked before a chunk's text is embedded, hashed or written. A version that comes
in again under another job replaces its chunks. Of a document's completed versions the one of the last batch is active,
there the one with the highest number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import names
from ..functions import text as T
from ..operators import chunking, postings
from ..operators.ingestion import STAGES
from ..sources import scratch

JOBS = "job_id long, document_id long, version_id long, version_no int, status string, error string, stage string, n_chunks long, attempt int, batch long"
CHUNKS = "chunk_id long, job_id long, document_id long, version_id long, chunk_index int, content string, content_hash string, identifiers array<string>, embedding array<float>, batch long"
EVENTS = "job_id long, seq int, stage string, status string, batch long"
#: How many bits of a chunk_id number the rows of a batch's file, and its files; the rest numbers batches.
ROW_BITS, FILE_BITS = 30, 14
# Why a job can't go on, by the stage where it shows.
NO_VERSION, NO_CONTENT, NO_TEXT, NO_CHUNKS = "version_not_found", "original_missing", "no_text", "no_chunks"


def no_vectors(content: Column) -> Column:
    return F.lit(None).cast("array<float>")


def outcomes(jobs: DataFrame, chunked: Callable[[DataFrame], DataFrame] = chunking.char_chunks, embed: Callable[[Column], Column] = no_vectors) -> tuple[DataFrame, DataFrame]:
    """Each job with status, error and the last stage it reached; and the chunks of the jobs that have any.

    ``chunked`` turns (doc_id, text) into (doc_id, chunk_index, content), ``embed`` a masked content into its vector.
    """
    read = jobs.select("job_id", "document_id", "version_id", "version_no", F.col("content").isNull().alias("missing"), names.decoded(F.col("content"))["text"].alias("text"))
    early = (
        F.when(F.col("document_id").isNull() | F.col("version_id").isNull(), F.struct(F.lit("validating").alias("stage"), F.lit(NO_VERSION).alias("error")))
        .when(F.col("missing"), F.struct(F.lit("validating").alias("stage"), F.lit(NO_CONTENT).alias("error")))
        .when(~F.col("text").rlike(r"\S"), F.struct(F.lit("parsing").alias("stage"), F.lit(NO_TEXT).alias("error")))
    )
    read = scratch.saved(read.withColumn("early", early), "texts")
    named = read.where("early is null").select("job_id", "document_id", "version_id")
    cut = chunked(read.where("early is null").select(F.col("job_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("job_id"), "chunk_index", T.redact(F.col("content")).alias("content"))
    chunks = cut.join(named, "job_id").select(
        "job_id", "document_id", "version_id", "chunk_index", "content", F.sha2("content", 256).alias("content_hash"), T.index_identifiers(F.col("content")).alias("identifiers"), embed(F.col("content")).alias("embedding")
    )
    return read.select("job_id", "document_id", "version_id", "version_no", "early"), chunks


def judged(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """job_id, document_id, version_id, version_no, status, error, stage, n_chunks from what ``outcomes`` gave."""
    counted = chunks.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    rows = jobs.join(counted, "job_id", "left").withColumn("n_chunks", F.coalesce("n", F.lit(0)))
    none = F.col("early").isNull() & (F.col("n_chunks") == 0)
    error = F.coalesce("early.error", F.when(none, NO_CHUNKS))
    stage = F.coalesce("early.stage", F.when(none, "chunking"), F.lit(STAGES[-1]))
    return rows.select("job_id", "document_id", "version_id", "version_no", F.when(error.isNull(), "completed").otherwise("failed").alias("status"), error.alias("error"), stage.alias("stage"), "n_chunks")


def stage_events(jobs: DataFrame) -> DataFrame:
    """job_id, seq, stage, status: every stage a job began, and at the last how it ended."""
    order = F.array(*map(F.lit, STAGES))
    reached = F.slice(order, F.lit(1), F.array_position(order, F.col("stage")).cast("int"))
    begun = F.transform(reached, lambda s: F.struct(s.alias("stage"), F.lit("started").alias("status")))
    ended = F.array(F.struct(F.col("stage").alias("stage"), F.col("status").alias("status")))
    rows = jobs.select("job_id", F.posexplode(F.concat(begun, ended)).alias("seq", "e"))
    return rows.select("job_id", "seq", "e.stage", "e.status")


class Ingestion:
    """The tables of one ingestion under a folder of the shared file system."""

    def __init__(self, spark: SparkSession, folder: str, chunked: Callable[[DataFrame], DataFrame] = chunking.char_chunks, embed: Callable[[Column], Column] = no_vectors):
        self.spark, self.folder, self.chunked, self.embed = spark, folder.rstrip("/"), chunked, embed

    def _path(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch-{batch}"

    def committed(self) -> list[int]:
        return sorted(int(name.split("-")[1]) for name in scratch.names_in(self.spark, f"{self.folder}/commits"))

    def _read(self, table: str, schema: str) -> DataFrame:
        batches = self.committed()
        reader = self.spark.read.schema(schema)
        return reader.parquet(*[self._path(table, b) for b in batches]) if batches else self.spark.createDataFrame([], schema)

    def jobs(self) -> DataFrame:
        return self._read("jobs", JOBS)

    def events(self) -> DataFrame:
        return self._read("events", EVENTS)

    def _versions(self) -> DataFrame:
        """version_id, batch, job_id: where the chunks of each version lie."""
        done = self.jobs().where("status = 'completed'")
        return done.groupBy("version_id").agg(F.max_by(F.struct("batch", "job_id"), F.struct("batch", "job_id")).alias("last")).select("version_id", "last.*")

    def chunks(self) -> DataFrame:
        """The chunks of every version, as it came in last."""
        return self._read("chunks", CHUNKS).join(self._versions(), ["version_id", "batch", "job_id"], "left_semi")

    def active(self) -> DataFrame:
        """document_id, version_id: the active version of each document."""
        done = self.jobs().where("status = 'completed'")
        return done.groupBy("document_id").agg(F.max_by("version_id", F.struct("batch", "version_no", "version_id")).alias("version_id"))

    def index(self) -> postings.PostingsIndex:
        return postings.PostingsIndex(self.spark, f"{self.folder}/postings")

    def _commit(self, batch: int) -> None:
        self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("overwrite").parquet(self._path("commits", batch))

    def take(self, jobs: DataFrame, batch: int) -> bool:
        """Takes a batch in; False if it was committed before."""
        if batch in self.committed():
            return False
        history = self.jobs().groupBy("job_id").agg(F.max("attempt").alias("before"), F.bool_or(F.col("status") == "completed").alias("done"))
        once = jobs.dropDuplicates(["job_id"])
        once = scratch.saved(once.join(history.where("done").select("job_id"), "job_id", "left_anti"), "batch")
        begun, made = outcomes(once, self.chunked, self.embed)

        place = F.monotonically_increasing_id()
        number = F.shiftleft(F.lit(batch).cast("long"), ROW_BITS + FILE_BITS) + F.shiftleft(F.shiftright(place, 33), ROW_BITS) + place.bitwiseAND((1 << ROW_BITS) - 1)
        made.select(number.alias("chunk_id"), *made.columns, F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(self._path("chunks", batch))
        chunks = self.spark.read.schema(CHUNKS).parquet(self._path("chunks", batch))
        rows = judged(begun, chunks).join(history.select("job_id", "before"), "job_id", "left")
        rows = rows.select(*[c.split()[0] for c in JOBS.split(", ")[:-2]], (F.coalesce("before", F.lit(0)) + 1).alias("attempt"), F.lit(batch).cast("long").alias("batch"))
        rows.write.mode("overwrite").parquet(self._path("jobs", batch))
        rows = self.spark.read.schema(JOBS).parquet(self._path("jobs", batch))
        stage_events(rows).withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(self._path("events", batch))

        done = rows.where("status = 'completed'")
        replaced = self.chunks().join(done.select("version_id"), "version_id", "left_semi").select("chunk_id")
        last = Window.partitionBy("version_id").orderBy(F.col("job_id").desc())
        kept = done.withColumn("nth", F.row_number().over(last)).where("nth = 1").select("job_id")
        self.index().add(chunks.join(kept, "job_id", "left_semi").select("chunk_id", F.col("content").alias("text")), replaced, key=batch)
        self._commit(batch)
        return True

    def stream(self, jobs: DataFrame, checkpoint: str) -> StreamingQuery:
        """Takes a stream of jobs in, until what it holds now is done."""
        writer = jobs.writeStream.foreachBatch(lambda rows, batch: self.take(rows, batch) and None)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
