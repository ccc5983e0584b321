"""Many strings sought in many texts at once: one automaton over the strings, one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

#: Strings of one automaton, some 100 bytes a letter; a larger set is sought in several passes.
MOST_STRINGS = 100_000
#: Groups whose texts are counted inside the scanning task, a bit for each in each string's mask.
MOST_GROUPS = 4096


def _passes(strings: DataFrame, most: int) -> list[list[str]]:
    """The strings in blocks; each block is held by the driver and sent to the tasks alone."""
    n = strings.limit(most + 1).count()
    blocks = 1 if n <= most else -(-strings.count() * 5 // (most * 4))
    dealt = strings.withColumn("_block", F.pmod(F.xxhash64("string"), F.lit(blocks)))
    return [found for b in range(blocks) if (found := [r.string for r in dealt.where(F.col("_block") == b).collect()])]


def _hits(strings: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, s in enumerate(strings):
            automaton.add_word(s, i)
        automaton.make_automaton()
        for batch in batches:
            place, found = [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                here = {i for _, i in automaton.iter(text or "")}
                place += [at] * len(here)
                found += [strings[i] for i in here]
            yield pa.record_batch([batch.column("id").take(pa.array(place, pa.int64())), pa.array(found, pa.string())], ["id", "string"])

    return rows


def held_strings(texts: DataFrame, strings: DataFrame, most: int = MOST_STRINGS) -> DataFrame:
    """id, string from texts (id, text) and strings (string): each string that stands anywhere in a text, once a text.

    Strings and texts are compared as they are; null and empty strings are held by nothing, a null text is an empty one.
    """
    wanted = strings.select("string").where("string <> ''").distinct()
    rows, kind = None, texts.schema["id"].dataType.simpleString()
    for block in _passes(wanted, most):
        one = texts.select("id", "text").mapInArrow(_hits(block), f"id {kind}, string string")
        rows = one if rows is None else rows.unionByName(one)
    return rows if rows is not None else texts.sparkSession.createDataFrame([], f"id {kind}, string string")


def _counts(masks: dict[str, int], groups: list[int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, size = ahocorasick.Automaton(), -(-len(groups) // 8)
        for s, mask in masks.items():
            automaton.add_word(s, mask)
        automaton.make_automaton()
        total = np.zeros(size * 8, np.int64)
        for batch in batches:
            column = batch.column("text")
            for begin in range(0, len(column), 256):
                texts, bits = column.slice(begin, 256).to_pylist(), []
                for text in texts:
                    held = 0
                    for mask in {m for _, m in automaton.iter(text or "")}:
                        held |= mask
                    bits.append(held.to_bytes(size, "little"))
                total += np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(texts), size), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        yield pa.record_batch([pa.array(groups, pa.int64()), pa.array(total[: len(groups)])], ["qid", "n"])

    return rows


def counted_texts(texts: DataFrame, wanted: DataFrame, most: int = MOST_STRINGS) -> DataFrame:
    """qid, n_docs from texts (id, text) and wanted (qid, string): how many ids have a text that holds one of a query's strings.

    Texts are counted in the scanning task, which gives a row for each query. Where an id has several texts, and where there are too many
    strings or queries for that, (query, id) are made distinct by a shuffle.
    """
    wanted = wanted.where("string <> ''").distinct()
    pairs = wanted.limit(most + 1).collect()
    groups = sorted({r.qid for r in pairs if r.qid is not None})

    def distinct(some: DataFrame) -> DataFrame:
        found = held_strings(some, wanted, most).join(wanted, "string")
        return found.select("qid", "id").distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("n"))

    if len(pairs) > most or len(groups) > MOST_GROUPS or any(r.qid is None for r in pairs):
        rows = distinct(texts)
    else:
        masks, place = {}, {g: i for i, g in enumerate(groups)}
        for r in pairs:
            masks[r.string] = masks.get(r.string, 0) | 1 << place[r.qid]
        again = scratch.saved(texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").select("id"), "repeated")
        several = not again.isEmpty()
        met = again.withColumnRenamed("id", "other")
        same = F.col("id").eqNullSafe(F.col("other"))
        once = texts.join(met, same, "left_anti") if several else texts
        rows = once.select("text").mapInArrow(_counts(masks, groups), "qid long, n long").where("n > 0")
        if several:
            rows = rows.unionByName(distinct(texts.join(met, same, "left_semi")))
    return rows.groupBy("qid").agg(F.sum("n").alias("n_docs"))
