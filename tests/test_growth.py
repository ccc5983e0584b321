"""What may not grow faster than the input: rows and bytes between tasks, what a task or its Python holds."""

import pyarrow as pa
import pytest
from oracle import same
from pyspark.sql import functions as F

from sparkquill.functions import text as T
from sparkquill.operators import chunking, patterns, postings, retrieval
from sparkquill.plans.catalog import ORACLES, QUERIES


def shuffled(spark, run) -> int:
    """Bytes that tasks wrote for others while ``run`` ran."""
    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(x.totalShuffleWrite() for x in [spark.sparkContext._jsc.sc().statusStore().executorSummary("driver")])

    before = total()
    run()
    return total() - before


def test_lexical_search_shuffles_no_texts(spark, sf):
    """Before, a chunk's places were gathered by chunk, and then went with each of its words."""
    assert "hashpartitioning(chunk_id" not in QUERIES["lexical_search"](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [500_000, 0])
def test_lexical_search_of_few_and_many_terms(spark, monkeypatch, most):
    monkeypatch.setattr(retrieval, "MOST_BROADCAST", most)
    for name in ("lexical_search", "lexical_ranked"):
        same(QUERIES[name](spark, "/root/testdata/sf0.001"), ORACLES[name], "/root/testdata/sf0.001")



def test_searches_run_once_for_evidence(spark, sf):
    """Where evidence is drawn from lists, these are read as they were written, not searched again."""
    assert "MapInArrow" not in QUERIES["evidence_signals"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_identifiers_cost_no_pairs_of_queries_and_chunks(spark):
    """Every query names what every chunk holds: k rows of it meet each query, not all chunks."""
    chunks = spark.range(5000).select(F.col("id").alias("chunk_id"), F.lit("see load_all").alias("text"), F.lit("load_all").alias("symbol"), F.lit("src/load_all.py").alias("path"))
    asked = spark.range(300).select(F.col("id").alias("qid"), F.lit("where is load_all").alias("text"))
    found = retrieval.by_identifier(chunks, asked).collect()
    assert len(found) == 6000 and all(r.chunk_id == r["rank"] - 1 and r.score == 1.0 for r in found)
    assert shuffled(spark, lambda: retrieval.by_identifier(chunks, asked).collect()) < 2_000_000


def test_symbol_overlap_sorts_once(spark, tmp_path):
    rows = [(1, 1), (1, 1), (1, 3), (None, 1), (2, None), (2, 7), (2, 6)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["symbol_overlap"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 15), (1, 3, 35), (2, 6, 65), (2, 7, 75)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # before, both sides of a join and two hash tables stood in one task
    same(QUERIES["symbol_overlap"](spark, "/root/testdata/sf0.01"), ORACLES["symbol_overlap"], "/root/testdata/sf0.01")


def test_frames_given_back_are_bounded():
    """Before, one frame held all that a batch of 10 000 documents was cut into."""
    rows = [(1, i, "x" * 10) for i in range(4500)] + [(2, i, "y" * 1_500_000) for i in range(3)] + [(3, 0, None)]
    frames = list(chunking.in_pieces(iter(rows), ["doc_id", "n", "text"]))
    assert [tuple(r) for f in frames for r in f.itertuples(index=False)] == rows
    assert all(len(f) <= 2000 and f["text"].fillna("").str.len().sum() <= 3_500_000 for f in frames) and not list(chunking.in_pieces(iter([]), ["text"]))


def test_presence_is_counted_where_texts_are_read(spark, sf, monkeypatch):
    """Before, a row for each string of each text was joined to all queries that ask for it."""
    assert "Join" not in QUERIES["term_presence_all"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    texts = spark.createDataFrame([(1, "ab c"), (1, "abc"), (2, None), (3, "cab"), (None, "ab"), (4, "")], "id long, text string")
    wanted = spark.createDataFrame([(q, s) for q in range(20) for s in ("ab", "c", "zz")[q % 3 :]] + [(7, ""), (8, None)], "qid long, string string")
    want = sorted((q, n) for q in range(20) if (n := len({i for i, t in texts.collect() if any(s in (t or "") for s in ("ab", "c", "zz")[q % 3 :])})))
    for most in (4096, 3):
        monkeypatch.setattr(patterns, "MOST_GROUPS", most)
        assert sorted(map(tuple, patterns.counted_texts(texts, wanted).collect())) == want


def test_postings_of_a_word_are_shuffled_as_one_row(spark, monkeypatch):
    """Before, each posting was a row that was written, shuffled and sorted, and the texts that stay were joined by chunk to compact."""
    texts = spark.range(4000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("one two three one "), F.col("id") % 10).alias("text")).coalesce(2)
    asked = spark.createDataFrame([(1, "one two"), (2, "three 7"), (3, "four")], "qid long, text string")
    wrong = texts.where("chunk_id % 4 <> 1").withColumn("text", F.when(F.col("chunk_id") % 8 == 0, "one").otherwise(F.col("text")))
    want = sorted(map(tuple, retrieval.lexical(texts, asked).select("qid", "chunk_id", "score", "rank").collect()))
    for most, tokens, wide in ((2_000_000, 4_000_000, 8192), (0, 4_000_000, 8192), (2_000_000, 7, 3)):
        for name, value in (("MOST_GONE", most), ("MOST_TOKENS", tokens), ("WIDE", wide)):
            monkeypatch.setattr(postings, name, value)
        index = postings.PostingsIndex(spark, buckets=4)
        index.add(wrong)
        index.reindex(wrong, texts)
        held = lambda: spark.read.parquet(*[f"{index.folder}/{run['name']}" for run in index.held["runs"]])
        assert tokens == 7 or held().count() < 100
        assert sorted(map(tuple, index.search(asked).collect())) == want
        index.compact()
        assert held().agg(F.sum("n")).first()[0] == 16_000 and sorted(map(tuple, index.search(asked).collect())) == want


def test_ascii_words_are_those_of_the_pattern(spark):
    """Before, the pattern cut all texts; those that are ASCII in lower case are cut by arrays of bytes."""
    words, n = postings._lexemes(pa.array(["a-b", "", "b c_1"]).slice(1)), postings._lexemes(pa.array([], pa.string()))
    assert words[0].tolist() == [0, 2] and words[1].to_pylist() == ["b", "c_1"] and len(n[0]) == len(n[1]) == 0
    texts = ["", "a", " a", "a ", "A_b9\x00c\x7fd", "  ", "\u212a k K", "\u0130x \u00e9t\u00e9 x", "x-y.z\nx\tY", "no", "", "9_9 9_9", None, "end"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, text string").coalesce(1)
    want = sorted((i, w, [k for k, x in enumerate(ws) if x == w]) for i, ws in rows.select("chunk_id", T.lexemes(F.col("text"))).collect() for w in set(ws))
    assert sorted((r.chunk_id, r.word, r.places) for r in postings.postings(rows).collect()) == want
