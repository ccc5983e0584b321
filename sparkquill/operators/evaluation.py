"""Retrieval-quality metrics over ranked results and relevance labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(ranks: DataFrame, k: int = 10) -> DataFrame:
    """qid, hit_1, hit_3, hit_5, rr, ndcg from qid, rank, relevant, n_relevant (ideal gain is not cut at k)."""
    hit = lambda n: F.max(((F.col("rank") <= n) & F.col("relevant")).cast("int")).alias(f"hit_{n}")
    first = F.min(F.when(F.col("relevant") & (F.col("rank") <= k), F.col("rank")))
    gain = F.sum(F.when(F.col("relevant") & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.max("n_relevant").cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    rows = ranks.groupBy("qid").agg(hit(1), hit(3), hit(5), F.coalesce(1 / first, F.lit(0.0)).alias("rr"), gain.alias("gain"), F.max("n_relevant").alias("n_relevant"), ideal.alias("ideal"))
    return rows.withColumn("ndcg", F.when(F.col("n_relevant") > 0, F.col("gain") / F.col("ideal")).otherwise(0.0)).drop("gain", "ideal")


def summary(rows: DataFrame) -> DataFrame:
    cut = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return rows.agg(cut("hit_1", "recall_1"), cut("hit_3", "recall_3"), cut("hit_5", "recall_5"), cut("rr", "mrr_10"), cut("ndcg", "ndcg_10"))


def with_all(queries: DataFrame, rows: DataFrame, n_relevant: DataFrame) -> DataFrame:
    """``rows`` (qid, rank, relevant) with a row for each query of ``queries`` (qid), so that one without hits counts as missed."""
    counted = queries.select("qid").distinct().join(n_relevant.select("qid", "n_relevant"), "qid", "left")
    found = counted.join(rows.select("qid", "rank", "relevant"), "qid", "left")
    return found.select("qid", F.coalesce("rank", F.lit(1 << 30)).alias("rank"), F.coalesce("relevant", F.lit(False)).alias("relevant"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"))


def relevant(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """``hits`` (qid, document, content, ...) and relevant: some expected (qid, document, must_contain) has its document and a term of it, or none to hold.

    Documents are compared without white space at their ends, terms in any case; null terms are held by nothing.
    """
    edges = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    wanted = expected.select(F.col("qid").alias("_qid"), edges(F.col("document")).alias("_document"), F.coalesce("must_contain", F.array().cast("array<string>")).alias("_terms"))
    content = F.lower(F.coalesce(F.col("content"), F.lit("")))
    holds = (F.size("_terms") == 0) | F.coalesce(F.exists("_terms", lambda t: F.coalesce(F.contains(content, F.lower(t)), F.lit(False))), F.lit(False))
    keys = [c for c in hits.columns if c != "content"]
    rows = hits.join(wanted, (hits.qid == wanted._qid) & (edges(hits.document) == wanted._document), "left")
    return rows.withColumn("relevant", F.col("_qid").isNotNull() & holds).groupBy(*keys).agg(F.bool_or("relevant").alias("relevant"))


def gate(metrics: DataFrame, recall: float = 0.85, mrr: float = 0.75) -> DataFrame:
    """passed and reasons: a missing recall fails, a missing MRR does not."""
    low = F.coalesce("recall_5", F.lit(0.0)) < recall, F.coalesce("mrr_10", F.lit(mrr)) < mrr
    said = [F.format_string(f"{name} %.3f < %.2f", F.coalesce(c, F.lit(0.0)), F.lit(least)) for name, c, least in (("recall_5", "recall_5", recall), ("mrr_10", "mrr_10", mrr))]
    reasons = F.array_compact(F.array(*[F.when(x, text) for x, text in zip(low, said)]))
    return metrics.withColumn("passed", ~low[0] & ~low[1]).withColumn("reasons", reasons)


def generation(samples: DataFrame) -> DataFrame:
    """qid, coverage, unsourced, accuracy, sufficiency, contradictions from the samples of generated answers.

    samples: qid, claims (array of text, citation), citations, expected_sources, required_aspects (arrays), answer,
    contradictory_pairs (array of l, r), hedged. Nulls in ``citations`` are no citations.
    """
    some = lambda c: F.coalesce(c, F.array())
    claims, cited = some("claims"), F.array_compact(F.coalesce("citations", F.array().cast("array<string>")))
    sourced = F.size(F.filter(claims, lambda c: c["citation"].isNotNull()))
    coverage = F.when(F.size(claims) == 0, 0.0).otherwise(sourced / F.size(claims))
    expected = F.coalesce("expected_sources", F.array().cast("array<string>"))
    right = F.size(F.filter(cited, lambda c: F.array_contains(expected, c)))
    accuracy = F.when(F.size(cited) == 0, F.when(F.size(expected) == 0, 1.0).otherwise(0.0)).otherwise(right / F.size(cited))
    aspects, answer = F.coalesce("required_aspects", F.array().cast("array<string>")), F.lower(F.coalesce("answer", F.lit("")))
    met = F.size(F.filter(aspects, lambda x: F.contains(answer, F.lower(F.coalesce(x, F.lit(""))))))
    sufficiency = F.when(F.size(aspects) == 0, 1.0).otherwise(met / F.size(aspects))
    clash = F.exists(some("contradictory_pairs"), lambda p: F.array_contains(cited, p["l"]) & F.array_contains(cited, p["r"]))
    handled = F.when(F.coalesce(clash, F.lit(False)) & ~F.coalesce("hedged", F.lit(False)), 0.0).otherwise(1.0)
    return samples.select("qid", coverage.alias("coverage"), (1 - coverage).alias("unsourced"), accuracy.alias("accuracy"), sufficiency.alias("sufficiency"), handled.alias("contradictions"))


def generation_summary(rows: DataFrame) -> DataFrame:
    """The mean of each metric; null where no sample has it."""
    return rows.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("coverage", "unsourced", "accuracy", "sufficiency", "contradictions")])


# The categories that a golden set must cover.
CATEGORIES = [
    "docx-heading", "docx-table", "pdf-page", "ocr", "identifier", "paraphrase", "multi-doc", "code", "plsql", "no-answer", "smalltalk",
    "prompt-injection", "contradictory-version",
]


def golden_errors(records: DataFrame) -> DataFrame:
    """record, error: what is wrong with a golden set (record, id, answerable, expected_sources); one row for each error.

    Ids that repeat are counted over the whole set by a grouping; the other rules look at one record.
    """
    sources = F.coalesce("expected_sources", F.array().cast("array<struct<document:string>>"))
    rules = {
        "empty id": F.coalesce(F.trim("id"), F.lit("")) == "",
        "answerable is missing": F.col("answerable").isNull(),
        "not answerable but has sources": ~F.coalesce("answerable", F.lit(False)) & (F.size(sources) > 0),
        "answerable without sources": F.coalesce("answerable", F.lit(False)) & (F.size(sources) == 0),
        "source without document": F.exists(sources, lambda s: s.isNull() | s["document"].isNull()),
    }
    found = records.select("record", F.explode(F.array_compact(F.array(*[F.when(x, F.lit(name)) for name, x in rules.items()]))).alias("error"))
    named = records.where(F.coalesce(F.trim("id"), F.lit("")) != "")
    again = named.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("record").alias("record")).where("n > 1")
    return found.unionByName(again.select("record", F.concat(F.lit("repeated id: "), "id", F.lit(" ("), "n", F.lit("x)")).alias("error")))


def categories(records: DataFrame, wanted: list[str] = CATEGORIES) -> DataFrame:
    """tag, n for each wanted category, 0 where no record has it."""
    counts = records.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    every = records.sparkSession.createDataFrame([(t,) for t in wanted], "tag string")
    return every.join(counts, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"))


def no_answer(rows: DataFrame) -> DataFrame:
    """Confusion of answerable (golden) and predicted."""
    fp = F.count_if(~F.col("answerable") & F.col("predicted"))
    fn = F.count_if(F.col("answerable") & ~F.col("predicted"))
    negatives, positives = F.count_if(~F.col("answerable")), F.count_if(F.col("answerable"))
    return rows.agg(
        fp.alias("false_positives"), fn.alias("false_negatives"), F.round(F.try_divide(fp, negatives), 6).alias("fp_rate"),
        F.round(F.try_divide(fn, positives), 6).alias("fn_rate"), F.round(F.try_divide(fp + fn, F.count(F.lit(1))), 6).alias("error_rate"),
    )


def health(checks: DataFrame) -> DataFrame:
    """service, ok, status, down from checks (service, dependency, up): one that is down or unknown degrades its service."""
    up = F.coalesce("up", F.lit(False))
    rows = checks.groupBy("service").agg(F.bool_and(up).alias("ok"), F.sort_array(F.collect_list(F.when(~up, F.col("dependency")))).alias("down"))
    return rows.select("service", "ok", F.when(F.col("ok"), "ok").otherwise("degraded").alias("status"), "down")
