import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkquill.functions import names
from sparkquill.operators import ingestion
from sparkquill.sources import archives, sinks
from sparkquill.streaming import state


def one(spark, column, values, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").repartition(2)
    return [r.v for r in frame.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_safe_name(spark):
    cases = {
        "a b.pdf": "a_b.pdf", "../../etc/passwd": "passwd", "C:\\tmp\\x.doc": "x.doc", "": "file", None: "file", "..": "file", "___": "file", "nul\0l.txt": "null.txt",
        "ﬁle①.txt": "file1.txt", "çok güzel.md": "ok_g_zel.md", "dir/": "file", "x" * 300 + ".tar": "x" * 196 + ".tar", "y" * 300: "y" * 200, "z" * 190 + "." + "e" * 30: "z" * 190 + "." + "e" * 9,
    }
    assert one(spark, names.safe_name, list(cases)) == list(cases.values())
    key = lambda x: names.original_key(x, F.lit("d"), F.lit("v"), F.lit("n.txt"))
    assert one(spark, key, ["p", "a/b", "..", "", None]) == ["projects/p/documents/d/versions/v/original/n.txt", None, None, None, None]


def test_member_path(spark):
    cases = {"a/b.txt": "a/b.txt", "./a//b": "a/b", "a\\b": "a/b", "/a": None, "\\a": None, "c:x": None, "../a": None, "a/../b": "b", "a/../../b": None, "a/..": None, "": None, ".": None, None: None}
    assert one(spark, names.member_path, list(cases)) == list(cases.values())


def test_decoded(spark):
    cases = [
        (b"plain", "plain", "utf-8"), ("şöyle".encode(), "şöyle", "utf-8"), (b"\xef\xbb\xbfx", "x", "utf-8-sig"), ("ş€".encode("cp1254"), "ş€", "cp1254"), (b"\x8e\xe9", "Žé", "cp1252"),
        (b"\x81\xe9", "\x81é", "latin-1"), (b"\xff\xfeh\0", "h", "utf-16-le"), (b"\xfe\xff\0h", "h", "utf-16-be"), (b"\xff\xfe\0\0h\0\0\0", "h", "utf-32-le"), (b"\0\0\xfe\xff\0\0\0h", "h", "utf-32-be"), (b"", "", "utf-8"),
    ]
    got = one(spark, names.decoded, [bytearray(c[0]) for c in cases], "binary")
    assert [(g.text, g.encoding) for g in got] == [c[1:] for c in cases]
    assert one(spark, names.decoded, [None], "binary")[0].text is None


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return bytearray(out.getvalue())


def tarred(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in members:
            m = tarfile.TarInfo(name)
            if data is None:
                m.type, m.linkname = tarfile.SYMTYPE, "/etc/passwd"
            else:
                m.size = len(data)
            t.addfile(m, io.BytesIO(data or b""))
    return bytearray(out.getvalue())


def test_archives(spark):
    rows = [
        ("ok.zip", zipped([("d/", b""), ("d/a.txt", b"one"), ("../out", b"x"), ("big", b"b" * 50)])), ("ok.tgz", tarred([("a", b"1"), ("link", None), ("/abs", b"2"), ("e", b"")])),
        ("many.zip", zipped([(f"f{i}", b"") for i in range(6)])), ("large.zip", zipped([(f"f{i}", b"x" * 30) for i in range(4)])), ("bad", bytearray(b"no archive")), ("cut.zip", zipped([("a", b"one")])[:-30]), ("null", None),
    ]
    frame = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    got = sorted((r.path, r.entry or "", bytes(r.content) if r.content is not None else None, r.problem) for r in archives.expand(frame, 5, 100, 40).collect())
    assert got == sorted([
        ("ok.zip", "d/a.txt", b"one", None), ("ok.zip", "../out", None, "outside"), ("ok.zip", "big", None, "oversized"),
        ("ok.tgz", "a", b"1", None), ("ok.tgz", "link", None, "link"), ("ok.tgz", "/abs", None, "outside"), ("ok.tgz", "e", b"", None),
        ("many.zip", "", None, "too_many_entries"), ("large.zip", "", None, "too_large"), ("bad", "", None, "unreadable"), ("cut.zip", "", None, "unreadable"),
    ])
    assert archives.expand(frame.where("false")).count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("q", 1, "c")], "project string, version int, x string")
    table = str(tmp_path / "table")
    sinks.write_table(rows, table, "project", "version")
    sinks.write_table(spark.createDataFrame([("p", 2, "new")], rows.schema), table, "project", "version")
    assert sorted(r.x for r in spark.read.parquet(table).collect()) == ["a", "c", "new"]
    sinks.write_report(spark.createDataFrame([(0.5, None)], "recall double, mrr double"), str(tmp_path / "r"), "T", {"S": ["recall", "mrr"]})
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "r" / "markdown")).collect()).splitlines()[-2:] == ["- recall: 0.5000", "- mrr: n/a"]
    assert spark.read.json(str(tmp_path / "r" / "json")).first().recall == 0.5


@pytest.fixture
def folder(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    low, high = events.agg(F.percentile(F.col("ts").cast("timestamp").cast("double"), F.array(F.lit(0.3), F.lit(0.7)))).first()[0]
    at = F.col("ts").cast("timestamp").cast("double")
    for part in (at < low, (at >= low) & (at < high), at >= high):  # one after the other: a stream takes files by their age
        events.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    return str(tmp_path)


def streamed(spark, frame, folder, name, mode):
    run = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    assert run.awaitTermination(180)
    return spark.table(name)


def source(spark, folder):
    path = os.path.join(folder, "events")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_job_states_as_stream(spark, sf, folder):
    log = lambda e: e.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.lit("running").alias("status"))
    got = streamed(spark, state.job_states(log(source(spark, folder)), "signup"), folder, "states", "complete")
    want = state.job_states(log(spark.read.parquet(f"{sf}/events.parquet")), "signup")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_limited_stream_is_the_batch_limit(spark, sf, folder):
    hits = lambda e: e.select(F.col("user_id").alias("key"), F.col("event_id").alias("hit"), "ts")
    got = streamed(spark, state.limited(hits(source(spark, folder)), 3, 86_400.0), folder, "limited", "append")
    want = ingestion.allowed_hits(hits(spark.read.parquet(f"{sf}/events.parquet")), 3, 86_400.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
