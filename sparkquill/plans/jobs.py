"""Ingestion of a whole table as one batch of jobs, with SQL; the stream of the same jobs is compared with it in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import ingest
from . import written
from .catalog import CHAR_CHUNKS, query, read

_JOBS = rf"""{CHAR_CHUNKS},
    j AS (SELECT doc_id AS job_id, CASE WHEN doc_id % 17 = 5 THEN 'version_not_found' WHEN doc_id % 19 = 7 THEN 'original_missing' WHEN NOT regexp_matches(coalesce(text, ''), '\S') THEN 'no_text' END AS early FROM documents),
    r AS (SELECT doc_id AS job_id, chunk_index, regexp_replace(regexp_replace(regexp_replace(content, $p${written.PEM}$p$, '[REDACTED]', 'g'), $p${written.TOKEN}$p$, '[REDACTED]', 'g'), $p${written.KEY_VALUE}$p$, '\1[REDACTED]', 'g') AS content FROM cc),
    n AS (SELECT job_id, count(*) AS n, sha256(string_agg(content, chr(10) ORDER BY chunk_index)) AS h FROM r GROUP BY job_id),
    o AS (SELECT j.job_id, CASE WHEN coalesce(early, CASE WHEN n IS NULL THEN 'no_chunks' END) IS NULL THEN 'completed' ELSE 'failed' END AS status, coalesce(early, CASE WHEN n IS NULL THEN 'no_chunks' END) AS error,
        CASE WHEN early IN ('version_not_found', 'original_missing') THEN 'validating' WHEN early = 'no_text' THEN 'parsing' WHEN n IS NULL THEN 'chunking' ELSE 'activating' END AS stage,
        CASE WHEN early IS NULL THEN coalesce(n, 0) ELSE 0 END AS n_chunks, CASE WHEN early IS NULL THEN h END AS content_sha256 FROM j LEFT JOIN n USING (job_id))"""


def job_table(spark, sf_dir) -> DataFrame:
    """A job for each document; some name no document, some have lost their bytes."""
    d = read(spark, sf_dir, "documents")
    id_ = F.col("doc_id")
    return d.select(
        id_.alias("job_id"), F.when(id_ % 17 != 5, id_).alias("document_id"), id_.alias("version_id"), F.lit(1).alias("version_no"),
        F.concat("source", F.lit(".txt")).alias("name"), F.when(id_ % 19 != 7, F.coalesce("text", F.lit("")).cast("binary")).alias("content"),
    )


@query(f"WITH RECURSIVE {_JOBS} SELECT * FROM o")
def ingest_jobs(spark, sf_dir):
    jobs, chunks = ingest.outcomes(job_table(spark, sf_dir))
    whole = chunks.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))
    digest = F.sha2(F.array_join(F.transform("c", lambda x: x["content"]), "\n"), 256)
    return ingest.judged(jobs, chunks).join(whole, "job_id", "left").select("job_id", "status", "error", "stage", "n_chunks", digest.alias("content_sha256"))


@query(
    f"""WITH RECURSIVE {_JOBS}, st AS (SELECT * FROM (VALUES (1, 'validating'), (2, 'storing'), (3, 'parsing'), (4, 'chunking'), (5, 'embedding'), (6, 'indexing'), (7, 'activating')) AS v(k, name)),
    e AS (SELECT job_id, st.k - 1 AS seq, st.name AS stage, 'started' AS status FROM o JOIN st AS z ON z.name = o.stage JOIN st ON st.k <= z.k
      UNION ALL SELECT job_id, z.k, o.stage, o.status FROM o JOIN st AS z ON z.name = o.stage) SELECT job_id, seq::INT AS seq, stage, status FROM e"""
)
def ingest_events(spark, sf_dir):
    return ingest.stage_events(ingest.judged(*ingest.outcomes(job_table(spark, sf_dir))))
