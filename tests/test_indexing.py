"""The kept index against the search that reads the texts; automata against plain containment."""

import glob
import os

import numpy as np
import pytest
from oracle import same

from sparkquill.operators import patterns, postings, retrieval
from sparkquill.plans.catalog import ORACLES, QUERIES
from sparkquill.sources import scratch

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog"), (2, "a lazy brown dog, and a quick QUICK fox"), (3, ""), (4, None), (5, "fox fox fox dog"), (6, "şifre ÉTÉ fox_trot dog"),
    (7, "nothing to see"), (8, " ".join(["dog"] * 500 + ["fox"])), (9, "Dog! fox?"),
]
ASKED = [(1, "quick brown fox"), (2, "the dog"), (3, ""), (4, None), (5, "unheard words"), (6, "Şifre été"), (7, "fox dog"), (8, "the")]


def frame(spark, rows, name="chunk_id"):
    return spark.createDataFrame(rows, f"{name} long, text string")


def rows(df):
    return sorted(tuple(r) for r in df.select("qid", "chunk_id", "score", "rank").collect())


@pytest.mark.parametrize("hot,named", [(1_000_000, 20_000), (2, 20_000), (2, 1)])
def test_index_finds_what_the_texts_hold(spark, monkeypatch, hot, named):
    monkeypatch.setattr(postings, "HOT_ROWS", hot)
    monkeypatch.setattr(postings, "MOST_NAMED", named)
    chunks, asked = frame(spark, TEXTS), frame(spark, ASKED, "qid")
    index = postings.PostingsIndex(spark)
    index.add(chunks)
    want = rows(retrieval.lexical(chunks, asked))
    assert want and rows(index.search(asked)) == want
    assert rows(postings.PostingsIndex(spark, index.folder).search(asked)) == want


def test_only_what_changed_is_posted(spark):
    asked, index = frame(spark, ASKED, "qid"), postings.PostingsIndex(spark)
    first = frame(spark, TEXTS)
    index.add(first)
    second = frame(spark, [(1, "the dog alone"), *TEXTS[2:], (10, "quick brown fox again")])
    changes = {r.path: r.change for r in index.reindex(first, second).collect()}
    assert changes == {1: "changed", 2: "deleted", 10: "new"}
    posted = spark.read.parquet(f"{index.folder}/{index.held['runs'][-1]['name']}")
    assert {r.chunk_id for r in posted.collect()} == {1, 10}
    want = rows(retrieval.lexical(second, asked))
    assert rows(index.search(asked)) == want
    index.compact()
    assert rows(index.search(asked)) == want and len(index.held["runs"]) == 1 and not index.held["gone"]
    held = scratch.names_in(spark, index.folder)
    assert sum(not n.startswith("manifest-") for n in held) == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sparkquill_")]


def test_a_search_reads_the_buckets_of_its_words_alone(spark):
    index = postings.PostingsIndex(spark, buckets=16)
    index.add(frame(spark, TEXTS))
    asked = frame(spark, [(1, "fox dog")], "qid")
    want = rows(index.search(asked))
    folder = f"{index.folder}/{index.held['runs'][0]['name']}"
    used = {r.f for r in spark.read.parquet(folder).where("word in ('fox', 'dog')").selectExpr("input_file_name() f").collect()}
    every = glob.glob(folder.removeprefix("file:") + "/*.parquet")
    others = [f for f in every if not any(u.endswith(os.path.basename(f)) for u in used)]
    assert len(used) <= 2 < len(others)
    for f in others:
        with open(f, "wb") as out:
            out.write(b"not a table")
    assert rows(index.search(asked)) == want
    with index._tables() as tables:
        table = tables.table(index.held["runs"][0]["name"])
        assert "PushedFilters: [In(slot" in table.where(table.slot.isin("fox", "dog"))._jdf.queryExecution().executedPlan().toString()


def test_an_empty_index(spark):
    index = postings.PostingsIndex(spark)
    assert index.search(frame(spark, ASKED, "qid")).count() == 0
    index.add(frame(spark, []))
    assert index.search(frame(spark, ASKED, "qid")).count() == 0


def test_postings_have_all_places(spark):
    found = {(r.chunk_id, r.word): r.places for r in postings.postings(frame(spark, TEXTS)).collect()}
    assert found[5, "fox"] == [0, 1, 2] and found[8, "dog"] == list(range(500)) and found[6, "fox_trot"] == [2] and (3, "") not in found


def test_strings_in_texts(spark):
    rng = np.random.default_rng(4)
    texts = [(i, "".join(rng.choice(list("ab c"), 30))) for i in range(60)] + [(60, None), (61, "")]
    strings = sorted({"".join(rng.choice(list("ab c"), int(rng.integers(1, 5)))) for _ in range(80)})
    want = sorted((i, s) for i, t in texts for s in strings if t and s in t)
    held = spark.createDataFrame([(s,) for s in strings] * 2 + [(None,), ("",)], "string string")
    for most in (100_000, 9):
        got = patterns.held_strings(frame(spark, texts, "id"), held, most)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert patterns.held_strings(frame(spark, texts, "id"), held.limit(0)).count() == 0


def test_identifiers_within_names_keep_their_wildcards(spark):
    chunks = spark.createDataFrame([(1, "", "load_all", "src/a.py"), (2, "", "loadXall", None), (3, "", None, "lib/LOAD-ALL/x"), (4, "", "other", "z")], "chunk_id long, text string, symbol string, path string")
    asked = frame(spark, [(1, "where is load_all used"), (2, "_._ here")], "qid")
    got = sorted(tuple(r) for r in retrieval.by_identifier(chunks, asked).select("qid", "chunk_id", "score").collect())
    assert got == [(1, 1, 0.9), (1, 2, 0.6), (1, 3, 0.6), (2, 1, 0.6)]
    assert retrieval.by_identifier(chunks, frame(spark, [(1, "nothing of that kind")], "qid")).count() == 0


def test_no_nested_loop_is_planned(spark, sf):
    for name in ("term_presence", "term_presence_all", "identifier_search"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ["indexed_search", "indexed_ranked", "term_presence_all"])
def test_on_more_rows(spark, name):
    same(QUERIES[name](spark, "/root/testdata/sf0.01"), ORACLES[name], "/root/testdata/sf0.01")
