"""Packing by optimal length buckets.

A histogram of lengths over all documents goes to the driver (its classes are bounded, see ``length_class``);
dynamic programming over it chooses the bucket boundaries with the least padding. A bucket is as long as the longest
document in it. Boundaries between lengths of over 1024 lie between classes, so there the padding may exceed the
optimum by up to 1/512 of a document's length. Inside a bucket documents
are numbered without gaps and dealt to batches that hold as many padded sequences as the token budget allows.

Defined results: null or empty texts have 0 tokens and are padded like others; a document longer than the
budget is a batch of its own; with fewer length classes than buckets each class is a bucket; rows that
repeat take places of their own; a null doc_id is packed too; an empty table gives an empty result; further
columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, text_key

BUCKETS, BUDGET = 16, 65_536
WORD = "[^\\x20\\x09-\\x0D]+"


def tokens(text: Column) -> Column:
    """Words of the text; where a tokenizer's counts exist, they can be given instead."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def length_class(n: Column) -> Column:
    """``n`` up to 1024, then rounded up in steps of at most 1/512 of it: under 30 000 classes for any long."""
    step = F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(1)))) - 9)).cast("long")
    return F.when(n <= 1024, F.greatest(n, F.lit(1))).otherwise(F.ceil(n / step) * step).cast("long")


def boundaries(histogram: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """The at most ``buckets`` lengths that pad least, from (longest in class, documents, tokens) in order.

    With prefix counts C and tokens S, a bucket over classes i+1..j pads L[j] * (C[j] - C[i]) - (S[j] - S[i]):
    lines in L[j] with falling slopes, so a monotone hull of lines gives each layer in linear time.
    """
    n = len(histogram)
    length, count, total = [0], [0], [0]
    for size, docs, held in histogram:
        length.append(size)
        count.append(count[-1] + docs)
        total.append(total[-1] + held)
    cost = [0, *[length[j] * count[j] - total[j] for j in range(1, n + 1)]]
    back = [[0] * (n + 1)]
    for _ in range(1, min(buckets, n)):
        new, origin = cost[:], list(range(n + 1))
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        at = 0
        for j in range(1, n + 1):
            m, b, i = -count[j - 1], cost[j - 1] + total[j - 1], j - 1
            while len(hull) - at >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m) >= (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]):
                hull.pop()
            hull.append((m, b, i))
            x = length[j]
            while len(hull) - at >= 2 and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            value = hull[at][0] * x + hull[at][1] + x * count[j] - total[j]
            origin[j] = hull[at][2]
            new[j] = value
        back.append(origin)
        cost = new
    out, j, layer = [], n, len(back) - 1
    while j > 0:
        out.append(length[j])
        j, layer = back[layer][j], layer - 1
        if layer < 0 and j > 0:
            raise AssertionError("a path leads to class 0")
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, batch, slot, padding: one row per document."""
    rows = docs.select("doc_id", text_key().alias("key"), tokens(F.col("text")).alias("n_tokens"))
    rows = materialize(rows.withColumn("class", length_class(F.col("n_tokens"))), "lengths")
    counted = rows.groupBy("class").agg(F.max("n_tokens").alias("longest"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).toLocalIterator()
    histogram = sorted((r.longest, r.n, r.t) for r in counted)
    tops = boundaries(histogram, buckets)
    if not tops:
        return rows.select("doc_id", "n_tokens", *[F.lit(0).cast("long").alias(c) for c in ("bucket", "bucket_tokens", "batch", "slot", "padding")])
    plan, first, low = [], 0, -1
    for bucket, top in enumerate(tops):
        held = sum(n for size, n, _ in histogram if low < size <= top)
        capacity = max(1, budget // max(1, top))
        plan.append((bucket, low, top, capacity, first))
        first += -(-held // capacity)
        low = top
    level = lambda i, c: _step(c, [(p[2], p[i]) for p in plan])
    placed = numbered(rows.withColumn("bucket", level(0, F.col("n_tokens"))), ["bucket"], ["doc_id", "key"], "at", sum(n for _, n, _ in histogram))
    capacity = level(3, F.col("n_tokens"))
    return placed.select(
        "doc_id",
        "n_tokens",
        F.col("bucket").cast("long").alias("bucket"),
        level(2, F.col("n_tokens")).cast("long").alias("bucket_tokens"),
        (level(4, F.col("n_tokens")) + F.floor(F.col("at") / capacity)).cast("long").alias("batch"),
        (F.col("at") % capacity).cast("long").alias("slot"),
        (level(2, F.col("n_tokens")) - F.col("n_tokens")).cast("long").alias("padding"),
    )


def _step(x: Column, steps: list[tuple[int, int]]) -> Column:
    """The value of the first step whose bound is not under x."""
    out = F.when(x <= steps[0][0], F.lit(steps[0][1]))
    for bound, value in steps[1:]:
        out = out.when(x <= bound, F.lit(value))
    return out
