"""Queries for operational metrics and for relevance, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation
from ..operators.observed import Metrics
from ..sources import scratch
from ..streaming import events
from .catalog import _TERMS, queries_, query, read

_KINDS = ["signup", "view", "click", "purchase"]


@query(
    """SELECT 'events.' || event_type AS name, 'counter' AS kind, count(*) AS count, NULL::DOUBLE AS total_ms, NULL::DOUBLE AS mean_ms FROM events WHERE event_type IN ('signup', 'view', 'click', 'purchase') GROUP BY event_type
    UNION ALL SELECT 'large.' || event_type, 'counter', count(*) FILTER (value > 50), NULL, NULL FROM events WHERE event_type IN ('signup', 'view', 'click', 'purchase') GROUP BY event_type"""
)
def stage_metrics(spark, sf_dir):
    """Counters of events by type, taken while the durations of stages are computed from them."""
    metrics, kind = Metrics(spark), F.col("event_type")
    counters = {f"events__{k}": F.count_if(kind == k) for k in _KINDS} | {f"large__{k}": F.count_if((kind == k) & (F.col("value") > 50)) for k in _KINDS}
    scratch.saved(events.stage_durations(metrics.counting(read(spark, sf_dir, "events"), **counters)), "durations")
    return metrics.report()


@query(
    f"""WITH {_TERMS.strip()}, e AS (SELECT qid, 'src' || (qid % 5) AS document, CASE WHEN qid % 7 = 0 THEN [] ELSE list_sort(terms)[1:2] END AS must FROM q),
    h AS (SELECT doc_id % 40 AS qid, doc_id, ' ' || source AS document, lower(coalesce(text, '')) AS content, source FROM documents)
    SELECT h.qid, doc_id, h.document, coalesce(bool_or(e.qid IS NOT NULL AND (len(must) = 0 OR len(list_filter(must, lambda t: contains(content, t))) > 0)), false) AS relevant
    FROM h LEFT JOIN e ON e.qid = h.qid AND e.document = source GROUP BY ALL"""
)
def relevance_labels(spark, sf_dir):
    """Documents as hits of the items; expected sources have blanks around their names and terms in capitals."""
    d = read(spark, sf_dir, "documents")
    hits = d.select((F.col("doc_id") % 40).alias("qid"), "doc_id", F.concat(F.lit(" "), "source").alias("document"), F.col("text").alias("content"))
    terms = F.slice(F.sort_array(T.query_terms(F.col("text"))), 1, 2)
    must = F.when(F.col("qid") % 7 == 0, F.array().cast("array<string>")).otherwise(F.transform(terms, F.upper))
    expected = queries_(spark, sf_dir).select("qid", F.concat(F.lit("src"), (F.col("qid") % 5).cast("string"), F.lit("\t ")).alias("document"), must.alias("must_contain"))
    return evaluation.relevant(hits, expected)
