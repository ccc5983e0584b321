"""Records found or made: twice the same, only touched files written, profiles, conversations and citations."""

import datetime
import glob

import pytest
from oracle import same

from sparkquill.operators import records
from sparkquill.plans.catalog import ORACLES, QUERIES
from sparkquill.sources.keyed import KeyedTable

NOW = datetime.datetime(2024, 5, 1, 12)


def table(spark, folder, **kw):
    return KeyedTable(spark, f"file://{folder}", "k string, v int", ["k"], **kw)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(folder):
    return set(glob.glob(f"{folder}/**/*.parquet", recursive=True))


def test_made_once_and_found_again(spark, tmp_path):
    t = table(spark, tmp_path)
    wanted = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 4), (None, 5)], "k string, v int")
    assert rows(t.get_or_create(wanted)) == [("a", 1, True), ("b", 3, True), (None, 4, True)]
    before = files(tmp_path)
    assert rows(t.get_or_create(wanted)) == [("a", 1, False), ("b", 3, False), (None, 4, False)]
    assert files(tmp_path) == before
    again = table(spark, tmp_path)
    assert rows(again.get_or_create(spark.createDataFrame([("b", 9), ("c", 7)], "k string, v int"))) == [("b", 3, False), ("c", 7, True)]
    assert rows(again.rows()) == [("a", 1), ("b", 3), ("c", 7), (None, 4)]


def test_untouched_slots_keep_their_files(spark, tmp_path):
    t = table(spark, tmp_path, slots=16)
    t.get_or_create(spark.range(400).selectExpr("cast(id as string) k", "cast(id as int) v"))
    before, places = files(tmp_path), dict(t.places)
    t.get_or_create(spark.createDataFrame([("new", 1)], "k string, v int"))
    assert sum(t.places[s] != places[s] for s in t.places) == 1 and before <= files(tmp_path)
    t.upsert(spark.createDataFrame([("7", 700)], "k string, v int"))
    assert sum(t.places[s] != places[s] for s in t.places) <= 2
    found = dict(rows(t.rows()))
    assert found["7"] == 700 and found["8"] == 8 and found["new"] == 1 and len(found) == 401


def test_a_profile_is_made_once(spark):
    none = spark.createDataFrame([], records.PROFILES)
    made = records.active_profile(none, "m1", 1024, NOW)
    first = made.first()
    assert first.created and (first.provider, first.model, first.dimension, first.is_active) == ("openai-compatible", "m1", 1024, True)
    held = made.drop("created").unionByName(spark.createDataFrame([("old", "p", "m0", 3, "cosine", 1, True, NOW - datetime.timedelta(1)), ("off", "p", "m0", 3, "cosine", 2, False, NOW + datetime.timedelta(1))], records.PROFILES))
    got = records.active_profile(held, "m2", 8, NOW).collect()
    assert [(r.profile_id, r.model, r.created) for r in got] == [(first.profile_id, "m1", False)]


def test_conversations(spark):
    day = datetime.timedelta(1)
    held = spark.createDataFrame([("c1", "p", NOW, NOW), ("c2", "p", NOW + day, NOW - day), ("c3", "p", NOW + day, NOW), ("c4", None, NOW, NOW)], "conversation_id string, project_id string, updated_at timestamp, created_at timestamp")
    asked = spark.createDataFrame([(1, "p", None), (2, "p", "mine"), (3, "q", None), (4, "q", None), (5, None, None), (6, None, "given")], "request long, project_id string, conversation_id string")
    got = {r.request: (r.conversation_id, r.created) for r in records.resolved_conversations(asked, held).collect()}
    assert got[1] == ("c3", False) and got[2] == ("mine", False) and got[3] == got[4] and got[3][1] and got[5] == (None, False) and got[6] == ("given", False)
    assert [(r.project_id, r.title) for r in records.new_conversations(records.resolved_conversations(asked, held), NOW).collect()] == [("q", records.TITLE)]


def test_answers_are_kept_once(spark, tmp_path):
    messages = KeyedTable(spark, f"file://{tmp_path}/m", records.MESSAGES, ["message_id"])
    citations = KeyedTable(spark, f"file://{tmp_path}/c", records.CITATIONS, ["message_id", "rank"])
    answers = spark.createDataFrame([(1, "c1", "yes", "m", True), (2, None, "unkept", "m", True), (3, "c1", "", None, False)], "request long, conversation_id string, content string, model string, answerable boolean")
    evidence = spark.createDataFrame([(1, 1, 10, 0.5), (1, 2, 11, 0.25), (2, 1, 12, 0.1)], "request long, rank int, chunk_id long, retrieval_score double")
    for _ in range(2):
        named = {r.request: r.message_id for r in records.persist_answers(messages, citations, answers, evidence).collect()}
        assert set(named) == {1, 3}
        assert {(r.message_id, r.role, r.content) for r in messages.rows().collect()} == {(named[1], "assistant", "yes"), (named[3], "assistant", "")}
        assert sorted((r.message_id, r.rank, r.chunk_id, r.label, r.page_start) for r in citations.rows().collect()) == [(named[1], 1, 10, "S1", None), (named[1], 2, 11, "S2", None)]


@pytest.mark.parametrize("name", ["get_or_create", "conversation_resolve"])
def test_on_more_rows(spark, name):
    same(QUERIES[name](spark, "/root/testdata/sf0.01"), ORACLES[name], "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", ["backfill_steps", "refresh_plans"])
def test_backfills_on_more_rows(spark, name):
    same(QUERIES[name](spark, "/root/testdata/sf0.01"), ORACLES[name], "/root/testdata/sf0.01")


def test_a_backfill_is_done_once(spark):
    profiles = spark.createDataFrame([("p0", "openai-compatible", "m", 3, "cosine", 1)], "profile_id string, provider string, model string, dimension int, distance_metric string, profile_version int")
    documents = spark.createDataFrame([(1, None), (2, "v")], "document_id long, active_version_id string")
    versions = spark.createDataFrame([], "version_id string, document_id long, version_no int, status string, parser_profile string")
    chunks = spark.createDataFrame([(10, 1, None, [1.0]), (11, 2, "w", None)], "chunk_id long, document_id long, version_id string, embedding array<double>")
    vectors = spark.createDataFrame([], "chunk_id long, profile_id string, embedding array<double>")
    once = records.backfill(profiles, documents, versions, chunks, vectors, "m", 3)
    twice = records.backfill(*(once[t] for t in ("profiles", "documents", "versions", "chunks", "vectors")), "m", 3)
    for name in once:
        assert rows(once[name]) == rows(twice[name]), name
    assert rows(once["profiles"]) == rows(profiles) and rows(once["vectors"]) == [(10, "p0", [1.0])] and {r.document_id: r.active_version_id for r in once["documents"].collect()}[2] == "v"
