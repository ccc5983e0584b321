"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of passages.

Every 4-word gram of a test item is a seed, whatever its count in the corpus, so any copy that keeps one gram
is aligned. Where seeds stand in a text, a passage around them is cut, as wide as an alignment of ``least`` of
the full score can reach. Passages are joined to items through their seeds, and each pair's words are aligned:
edited or paraphrased copies keep most of an item's score. A document is contaminated if an item reaches
``least`` of its full score. A copy that keeps no four words in a row is not found.

Test items are processed in blocks of about MOST_GRAMS grams (an item is never cut), so the seeds that are broadcast
are bounded however large the benchmark is; each block meets all documents. Items' texts are joined by their id, as
Spark sees fit by their size. A seed that many items share pairs each passage with all of them, as each may be the source.

Defined results: null or empty texts aren't contaminated; items under four words can't be sought and match
nothing; item ids may repeat (each text is sought); of equal scores the smallest item_id is named; rows that
repeat a doc_id are judged by their own texts; an empty corpus or benchmark gives no contamination; further
columns of the inputs are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import materialize, text_key

SEED = 4
MOST_GRAMS = 1_000_000
#: Of an item's full score, this share makes a copy.
LEAST = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in W.slices(batch):
            w = W.split(texts, lower=True)
            at = np.flatnonzero(w.whole(SEED))
            doc = w.doc[at]
            sizes = np.diff(w.bounds)
            before = at - w.bounds[doc]
            take = pa.array(doc)
            yield pa.record_batch(
                [part.column("item").take(take), pa.array(W.signed(w.rolling(SEED)[at])), pa.array(before.astype(np.int32)), pa.array((sizes[doc] - before).astype(np.int32))],
                ["item", "h", "before", "after"],
            )


def item_grams(items: DataFrame) -> DataFrame:
    """item, h, before, after: each gram of each item, and the words before and from it."""
    return items.mapInArrow(_gram_rows, "item long, h long, before int, after int")


def _found(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in ``ordered``, and whether it does."""
    if not len(ordered):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return place, ordered[place] == values


def _passage_rows(seeds: np.ndarray, before: np.ndarray, after: np.ndarray):
    """``before`` and ``after``: how far a passage reaches from the first word of each seed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in W.slices(batch):
                w = W.split(texts, lower=True)
                at = np.flatnonzero(w.whole(SEED))
                place, hit = _found(W.signed(w.rolling(SEED)[at]), seeds)
                at, place = at[hit], place[hit]
                doc = w.doc[at]
                low = np.maximum(w.bounds[doc], at - before[place])
                high = np.minimum(w.bounds[doc + 1], at + after[place])
                out: list[tuple] = []
                i = 0
                while i < len(at):
                    j, end = i + 1, high[i]
                    while j < len(at) and doc[j] == doc[i] and low[j] <= end:
                        end, j = max(end, high[j]), j + 1
                    start = int(low[i:j].min())
                    out.append((int(doc[i]), start - int(w.bounds[doc[i]]), b" ".join(w.span(start, int(end))), np.unique(seeds[place[i:j]])))
                    i = j
                take = pa.array([x[0] for x in out], pa.int64())
                offsets = np.concatenate(([0], np.cumsum([len(x[3]) for x in out]))).astype(np.int64)
                flat = np.concatenate([x[3] for x in out]) if out else np.zeros(0, np.int64)
                yield pa.record_batch(
                    [part.column("doc_id").take(take), part.column("key").take(take), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()).cast(pa.string()), W.lists(flat, offsets, pa.int64())],
                    ["doc_id", "key", "first_word", "passage", "hs"],
                )

    return rows


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score of two word sequences, and where it ends in b (words before it)."""
    row = np.zeros(len(b) + 1, np.int64)
    slope = -GAP * np.arange(len(b) + 1)
    best, end = 0, 0
    for x in a:
        new = np.maximum(row + GAP, 0)
        np.maximum(new[1:], row[:-1] + np.where(b == x, MATCH, MISMATCH), out=new[1:])
        row = np.maximum.accumulate(new + slope) - slope  # gaps along b
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def _score_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores, ends = [], []
        for item, passage in zip(batch.column("item_text").to_pylist(), batch.column("passage").to_pylist()):
            numbers: dict[bytes, int] = {}
            both = []
            for text in (item, passage):
                w = W.split([text.encode()], lower=True)
                both.append(np.array([numbers.setdefault(x, len(numbers)) for x in w.span(0, len(w.hash))], np.int64))
            score, end = align(*both)
            scores.append(score / (MATCH * max(1, len(both[0]))))
            ends.append(end)
        kept = [batch.column(c) for c in ("doc_id", "key", "item_id", "first_word")]
        yield pa.record_batch([*kept, pa.array(scores, pa.float64()), pa.array(ends, pa.int64())], ["doc_id", "key", "item_id", "first_word", "score", "end"])


def passages_scored(docs: DataFrame, benchmark: DataFrame, most_grams: int = MOST_GRAMS, least: float = LEAST) -> DataFrame:
    """doc_id, key, item_id, score, end_word: every passage that shares a seed with an item, aligned with it."""
    texts = docs.select("doc_id", text_key().alias("key"), "text")
    items = materialize(benchmark.select("item_id", "text").withColumn("item", F.xxhash64("item_id", "text")), "items")
    grams = materialize(item_grams(items.select("item", "text")), "grams")
    blocks = -(-grams.count() // most_grams)
    # An item is never cut: blocks hold whole items, dealt by their hash.
    items = items.join(grams.select("item").distinct(), "item", "left_semi")
    scored = None
    for block in range(max(1, blocks)):
        here = F.pmod("item", F.lit(max(1, blocks))) == block
        g = grams.where(here)
        # An alignment of ``least`` of the full score holds at most so many words more than the item has.
        more = F.ceil((F.col("before") + F.col("after")) * (MATCH * (1 - least) / -GAP))
        wide = g.select("item", "h", (F.col("before") + more).alias("before"), (F.col("after") + more).alias("after"))
        seeds = materialize(wide.groupBy("item", "h").agg(F.max("before").alias("before"), F.max("after").alias("after")), "seeds")
        reach = sorted((r.h, r.b, r.a) for r in seeds.groupBy("h").agg(F.max("before").alias("b"), F.max("after").alias("a")).toLocalIterator())
        hs, before, after = (np.array([r[i] for r in reach], np.int64) for i in range(3))
        found = texts.mapInArrow(_passage_rows(hs, before, after), "doc_id long, key long, first_word long, passage string, hs array<long>")
        pairs = (
            found.withColumn("h", F.explode("hs"))
            .join(F.broadcast(seeds.select("h", "item")), "h")
            .groupBy("doc_id", "key", "first_word", "item")
            .agg(F.first("passage").alias("passage"))
            .join(items.where(here).select("item", "item_id", F.col("text").alias("item_text")), "item")
        )
        part = pairs.mapInArrow(_score_rows, "doc_id long, key long, item_id long, first_word long, score double, end long")
        scored = part if scored is None else scored.unionByName(part)
    return scored.select("doc_id", "key", "item_id", "score", (F.col("first_word") + F.col("end")).alias("end_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, key, contaminated, item_id, score, end_word (of the best item), n_items."""
    best = F.min(F.struct((-F.col("score")).alias("less"), F.col("item_id").isNull().alias("unnamed"), "item_id", "end_word")).alias("best")
    hits = passages_scored(docs, benchmark, least=least).groupBy("doc_id", "key").agg(best, F.count_distinct(F.when(F.col("score") >= least, F.col("item_id"))).alias("n_items"))
    hits = hits.select(F.col("doc_id").alias("h_id"), F.col("key").alias("h_key"), "best", "n_items")
    rows, score = docs.select("doc_id", text_key().alias("key")), -F.col("best.less")
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key")), "left").select(
        "doc_id",
        "key",
        F.coalesce(score >= least, F.lit(False)).alias("contaminated"),
        F.when(score >= least, F.col("best.item_id")).alias("item_id"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
        F.when(score >= least, F.col("best.end_word")).alias("end_word"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
    )
