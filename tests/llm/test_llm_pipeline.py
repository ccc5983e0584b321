"""Each stage keeps the documents' columns and drops what it should."""

import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sparkquill.llm import common, decontaminate, near_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def shingles(words, k):
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_copies(rows):
    best = {}
    for i, t in rows.items():
        k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[k] = min(best.get(k, (1, 0)), (-len(t or ""), i))
    return {i for _, i in best.values()}


def plain_near_copies(rows):
    sets = {i: shingles(plain_words(t), 5) for i, t in rows.items()}
    top = {i: i for i in rows}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(sorted(rows), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((root(a), root(b)))
            top[high] = low
    return {i for i in rows if root(i) == i}


def plain_clean(rows, items):
    """Every pair with a 4-gram in common is aligned whole, without seeds or passages."""
    words = {i: plain_words(t) for i, t in rows.items()}
    grams = {i: shingles(w, 4) if len(w) > 3 else set() for i, w in words.items()}
    bad = set()
    for text in items:
        item = plain_words(text)
        wanted = shingles(item, 4) if len(item) > 3 else set()
        for i, w in words.items():
            if i not in bad and wanted & grams[i]:
                number = {x: n for n, x in enumerate({*item, *w})}
                score, _ = decontaminate.align(np.array([number[x] for x in item]), np.array([number[x] for x in w]))
                if score >= decontaminate.LEAST * decontaminate.MATCH * len(item):
                    bad.add(i)
    return set(rows) - bad


def test_stages_match_plain_versions(spark, sf):
    docs = common.table(spark, sf, "documents")
    near = docs.where("size(split(text, ' ')) between 100 and 400").orderBy("doc_id").limit(5)
    docs = common.materialize(docs.unionByName(near.selectExpr("doc_id + 10000 as doc_id", "concat(text, ' more') as text", "lang", "source", "n_chars")), "planted")
    predicted = toxicity.toxicity(docs, common.table(spark, sf, "labels")).where("predicted = 1")
    toxic = {r.doc_id for r in predicted.collect()}
    items = [r.text for r in common.table(spark, sf, "benchmark").collect()]
    plain = [lambda rows: set(rows) - toxic, plain_copies, plain_near_copies, lambda rows: plain_clean(rows, items)]
    for (name, stage), want in zip(corpus_pipeline.STAGES, plain):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = common.materialize(stage(spark, docs, sf), "test")
        after = {r.doc_id for r in docs.collect()}
        assert after == want(before), name
        assert len(after) < len(before), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(r.doc_id for r in packed) == sorted(after)


def test_near_dedup_at_80_percent(spark):
    def changed(tag, n, places):
        return " ".join(f"x{tag}{k}" if k in places else f"{tag}{k}" for k in range(n))

    texts = [changed("a", 8, ()), changed("a", 9, ()), changed("b", 7, ()), changed("b", 8, ())]
    for tag in (f"c{i}" for i in range(12)):  # 0.81, 0.83, 0.78 and 0.66 to the first
        texts += [changed(tag, 100, p) for p in ((), (20, 50), (99, 0, 40, 42), (20, 21, 50, 51), (10, 30, 60, 80))]
    rows = {i: t for i, t in enumerate(texts)}
    sets = {i: shingles(plain_words(t), 5) for i, t in rows.items()}
    top = dict.fromkeys(rows)
    for i in rows:
        top[i] = i
    for _ in rows:
        for a, b in combinations(rows, 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                top[a] = top[b] = min(top[a], top[b])
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    kept = {r.doc_id for r in near_dedup.near_dedup(docs, 80).where("kept").collect()}
    assert kept == {i for i in rows if top[i] == i}
    assert 1 not in kept and 3 in kept and 5 not in kept and 8 in kept


def test_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    before = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf), "test")
        assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert before is None or ids <= before, name
        before = ids
    assert len(before) > 100
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == before


def test_dedup_stages_keep_rows_without_ids(spark, sf):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(1, "a b  c"), (2, "a b c"), (None, "a b c"), (None, "other words"), (4, None), (5, ""), (1, "second text of an id"), (7, near), (8, near + " more"), (None, near + " x")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, key string")
    exact = corpus_pipeline.drop_copies(spark, docs, sf)
    assert exact.columns == docs.columns
    assert sorted((r[:2] for r in exact.collect()), key=str) == sorted([(1, "a b  c"), (None, "other words"), (4, None), (1, "second text of an id"), (7, near), (8, near + " more"), (None, near + " x")], key=str)
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, exact, sf).collect()}
    assert kept == {(1, "a b  c"), (None, "other words"), (4, None), (1, "second text of an id"), (7, near), (None, near + " x")}


def test_near_dedup_stage_keeps_unlike_rows_of_one_id(spark, sf):
    a, b = (" ".join(f"{tag}{k}" for k in range(40)) for tag in "ab")
    rows = [(1, a + " q"), (9, a), (9, b), (9, b + " z"), (9, b), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()), key=str)
    assert len(kept) in (3, 4) and (1, a + " q") in kept and (None, a) in kept and {t for i, t in kept if i == 9} in ({b}, {b + " z"})


def test_stages_on_clashing_names_and_empty_tables(spark, sf):
    docs = common.table(spark, sf, "documents")
    names = ["_features", "toxicity", "Toxicity_", "node", "key", "kept_key", "leak", "first", "component", "score", "in0"]
    wide = docs.select("*", *[F.lit(n).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = sorted(r.doc_id for r in stage(spark, docs, sf).select("doc_id").collect())
        got = stage(spark, wide, sf)
        assert got.columns == wide.columns and sorted(r.doc_id for r in got.where("_features = '_features'").collect()) == want, name
        none = stage(spark, wide.limit(0), sf)
        assert none.columns == wide.columns and none.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, wide.limit(0), sf).count() == 0


def test_stages_on_nulls(spark, sf):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, None), (3, "one"), (3, None), (4, "x " * 30_000)], "doc_id long, text string")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.materialize(stage(spark, kept, sf), "test")
    assert sorted(map(str, (tuple(r)[:1] for r in kept.collect()))) == sorted(map(str, [(1,), (3,), (4,)]))
    assert corpus_pipeline.STAGES[-1][1](spark, kept, sf).count() == 3


def test_dedup_stages_leave_one_of_identical_rows(spark, sf):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text)] * 3 + [(2, text), (2, text.replace("word0 ", "word0\t"))] + [(5, "another text of a few words only")] * 2 + [(6, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in corpus_pipeline.drop_copies(spark, docs, sf).collect()) == [(1, text), (5, "another text of a few words only"), (6, "x")]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs.where("doc_id <> 2"), sf).collect()) == [1, 5, 6]
