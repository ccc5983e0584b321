"""Streams of jobs and of stage events: stopped, cut off, delivered again, out of order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquill.operators import ingestion, retrieval
from sparkquill.plans.jobs import job_table
from sparkquill.streaming import ingest, state

FILES = 4


@pytest.fixture(scope="module")
def jobs(spark, sf, tmp_path_factory):
    """Four files of jobs: the second repeats jobs of the first, the third brings documents in again as new versions."""
    folder, table = str(tmp_path_factory.mktemp("jobs")), job_table(spark, sf).where("job_id < 60")
    again = table.where("job_id < 10").withColumns({"job_id": F.col("job_id") + 1000, "version_id": F.col("version_id") + 1000, "version_no": F.lit(2), "content": F.lit("Second version. password=hunter2secret").cast("binary")})
    replaced = table.where("job_id between 30 and 34").withColumns({"job_id": F.col("job_id") + 2000, "content": F.lit("The same version anew").cast("binary")})
    parts = [table.where("job_id < 20").unionByName(table.where("job_id = 3")), table.where("job_id between 10 and 39"), again.unionByName(table.where("job_id = 50")), table.where("job_id >= 40").unionByName(replaced)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


def source(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def state_of(done):
    rows = lambda df, *drop: sorted(map(str, (r.asDict() for r in df.drop("batch", "chunk_id", *drop).collect())))
    return rows(done.jobs()), rows(done.events()), rows(done.chunks()), rows(done.active()), done.committed()


def run(spark, done, jobs, checkpoint):
    query = done.stream(source(spark, jobs), checkpoint)
    query.awaitTermination(300)
    return query


@pytest.fixture(scope="module")
def whole(spark, jobs, tmp_path_factory):
    done = ingest.Ingestion(spark, f"file://{tmp_path_factory.mktemp('whole')}")
    run(spark, done, jobs, str(tmp_path_factory.mktemp("whole-checkpoint")))
    return done


def test_a_run(spark, whole):
    found = {r.job_id: r for r in whole.jobs().collect()}
    assert whole.committed() == list(range(FILES)) and len(found) == whole.jobs().count()  # repeated jobs were done once
    assert found[5].error == ingest.NO_VERSION and found[7].error == ingest.NO_CONTENT and found[0].status == "completed"
    assert {r.version_id for r in whole.active().where("document_id in (0, 11)").collect()} == {1000, 11}
    chunks = whole.chunks().collect()
    assert len({c.chunk_id for c in chunks}) == len(chunks)
    assert {c.content for c in chunks if c.version_id == 1000} == {"Second version. password=[REDACTED]"}
    assert {c.content for c in chunks if c.version_id == 31} == {"The same version anew"}
    log = whole.events().select(F.col("job_id").alias("job"), "seq", "stage").where("status = 'started'")
    assert ingestion.transitions(log).where("not valid").count() == 0


def test_the_index_holds_what_the_chunks_hold(spark, whole):
    asked = spark.createDataFrame([(1, "second version"), (2, "same version anew"), (3, "the"), (4, "hunter2secret")], "qid long, text string")
    rows = lambda df: sorted(tuple(r) for r in df.select("qid", "chunk_id", "score", "rank").collect())
    want = rows(retrieval.lexical(whole.chunks().select("chunk_id", F.col("content").alias("text")), asked))
    assert rows(whole.index().search(asked)) == want and {q for q, *_ in want} >= {1, 2}


def test_a_batch_that_is_delivered_again_changes_nothing(spark, whole, jobs):
    before = state_of(whole)
    assert whole.take(spark.read.parquet(jobs), 0) is False
    assert whole.take(spark.read.parquet(jobs).where("job_id < 5"), FILES) is True  # done jobs under a new number
    after = state_of(whole)
    assert after[:4] == before[:4] and after[4] == list(range(FILES + 1))


@pytest.mark.parametrize("cut", ["_commit", "index"])
def test_a_stream_that_is_cut_off_goes_on(spark, whole, jobs, tmp_path, monkeypatch, cut):
    done, calls = ingest.Ingestion(spark, f"file://{tmp_path}/tables"), []
    real = getattr(done, cut)

    def once(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("cut off")
        return real(*args)

    monkeypatch.setattr(done, cut, once)
    query = done.stream(source(spark, jobs), str(tmp_path / "checkpoint"))
    with pytest.raises(Exception, match="cut off"):
        query.awaitTermination(300)
    assert done.committed() == [0]
    run(spark, done, jobs, str(tmp_path / "checkpoint"))
    again = ingest.Ingestion(spark, f"file://{tmp_path}/once")
    run(spark, again, jobs, str(tmp_path / "checkpoint-once"))
    assert state_of(done) == state_of(again)
    assert sum(r.n for r in done.index().found(spark.createDataFrame([("version",)], "word string")).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).collect()) == again.index().found(spark.createDataFrame([("version",)], "word string")).count()


def test_stages_as_a_stream_are_the_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    stages = [*ingestion.STAGES, "unknown"]
    rows = [(j, s, stages[int(rng.integers(8))] if rng.random() < 0.3 else stages[s % 7]) for j in range(40) for s in range(int(rng.integers(1, 25)))]
    log = spark.createDataFrame(rows, "job long, seq long, stage string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 60))
    want = sorted(tuple(r) for r in ingestion.transitions(log).collect())
    at = {(j, s): float(s + rng.uniform(-4, 4)) for j, s, _ in rows}  # arrives up to four minutes early or late
    arrival = spark.createDataFrame([(j, s, at[j, s]) for j, s, _ in rows] + [(j, s, at[j, s] + 1) for j, s, _ in rows[::3]], "job long, seq long, at double")
    folder = str(tmp_path / "events")
    for low in range(-4, 32, 4):
        log.join(arrival.where((F.col("at") >= low) & (F.col("at") < low + 4)), ["job", "seq"]).select(*log.columns).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(-1, 0, "validating")], log.select("job", "seq", "stage").schema).withColumn("ts", F.timestamp_seconds(F.lit(1_700_100_000))).coalesce(1).write.mode("append").parquet(folder)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = state.checked_stages(source(spark, folder)).writeStream.format("memory").queryName("checked").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    finally:
        spark.conf.set(name, before)
    assert sorted(tuple(r) for r in spark.table("checked").where("job >= 0").collect()) == want
