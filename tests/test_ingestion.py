from collections import defaultdict

from pyspark.sql import functions as F

from sparkquill.operators import context, ingestion, symbols
from sparkquill.plans.catalog import QUERIES


def chunk_rows(spark):
    rows = [("a1", "a", 1, None, "h1", 5, "one"), ("a2", "a", 2, "a1", "h2", 5, "two"), ("a3", "a", 3, "a1", "h3", 50, "three"), ("b1", "b", 1, None, "h2", 5, "two"), ("c1", "c", 1, None, "h4", 5, "")]
    return spark.createDataFrame(rows, "chunk_id string, source_id string, sequence_no int, parent_chunk_id string, content_hash string, token_count int, content string")


def test_context(spark):
    hits = spark.createDataFrame([(1, "a2", 1), (1, "b1", 2), (1, "c1", 3), (2, "gone", 1)], "qid int, chunk_id string, rank int")
    built = context.build(hits, chunk_rows(spark), most_tokens=20)
    rows = [tuple(r) for r in built.orderBy("qid", "position").collect()]
    # the parent is also a neighbour and stands once; a3 doesn't fit; b1 repeats a2
    assert rows == [(1, 1, "a2", "self", True), (1, 2, "a1", "parent", True), (1, 3, "c1", "self", True)]
    assert [r[2] for r in context.build(hits, chunk_rows(spark), most_chunks=1).collect()] == ["a2"]
    cited = [(r.label, r.chunk_id) for r in context.citations(built, chunk_rows(spark)).orderBy("label").collect()]
    assert cited == [("S1", "a2"), ("S2", "a1")]
    assert context.prompts(built, chunk_rows(spark), "Q").first().prompt == "Q\n\n[S1]\ntwo\n\n[S2]\none"


def test_stage_order(spark):
    log = [("j", i, s) for i, s in enumerate(["validating", "storing", "chunking", "validating", "unknown", "storing"])]
    got = ingestion.transitions(spark.createDataFrame(log, "job string, seq int, stage string")).orderBy("seq").collect()
    assert [bool(r.valid) for r in got] == [True, True, False, True, False, False]
    assert [r.p for r in spark.createDataFrame([("running",), ("other",), (None,)], "s string").select(ingestion.progress(F.col("s")).alias("p")).collect()] == [60, 0, 0]


def test_hit_limit_known_values(spark):
    hits = spark.createDataFrame([(1, i, float(10 * i)) for i in range(8)], "key long, hit long, at double").select("key", "hit", F.col("at").cast("timestamp").alias("ts"))
    got = [r.allowed for r in ingestion.allowed_hits(hits, 3, 60).orderBy("hit").collect()]
    assert got == [True, True, True, False, False, False, True, True]


def test_hit_limit_by_brute_force(spark, sf):
    kept, want = defaultdict(list), {}
    for e in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("at")).orderBy("at", "event_id").collect():
        want[e.event_id] = sum(t > e["at"] - 86_400 for t in kept[e.user_id]) < 3
        if want[e.event_id]:
            kept[e.user_id].append(e["at"])
    assert {r.hit: r.allowed for r in QUERIES["rate_limit"](spark, sf).collect()} == want


def test_uploads(spark):
    rows = [("pdf", b"%PDF-1.7 x", "ok"), ("pdf", b"plain", "no_signature"), ("text", b"plain", "ok"), ("text", b"\x89PNG....", "mismatch"), ("image", b"RIFF0000WEBP", "ok"), ("image", b"RIFF0000WAVE", "no_signature"), ("text", b"", "empty"), ("text", b"x" * 101, "too_large")]
    frame = spark.createDataFrame([(a, bytearray(b), c) for a, b, c in rows], "claimed string, content binary, want string")
    for r in frame.select("want", ingestion.upload_verdict(F.col("claimed"), F.col("content"), 100).alias("got")).collect():
        assert r.got == r.want


def test_confidence(spark):
    blocks = spark.createDataFrame([(1, "aaaa", 0.9), (1, "b", 0.4), (1, "zz", None), (2, "c", None)], "doc int, text string, confidence double")
    assert [tuple(r) for r in ingestion.weighted_confidence(blocks).orderBy("doc").collect()] == [(1, 0.8, False), (2, None, True)]


def test_symbols(spark):
    files = [("a.py", "python", "import x\nclass A:\n    def f(self):\n        pass\nasync def g():\n    pass"), ("b.sql", "sql", "CREATE OR REPLACE VIEW v AS\nselect 1"), ("c.yml", "config", "name: x\n'k.z': 1\n"), ("d", "other", "def x"), ("e.py", "python", None)]
    got = sorted(tuple(r) for r in symbols.symbols(spark.createDataFrame(files, "file string, language string, text string")).collect())
    assert got == [
        ("a.py", "python", "A", "class", 2, 2), ("a.py", "python", "f", "def", 3, 4), ("a.py", "python", "g", "def", 5, 6),
        ("b.sql", "sql", "v", "view", 1, 2), ("c.yml", "config", "k.z", "key", 2, 3), ("c.yml", "config", "name", "key", 1, 1),
    ]


def test_markdown(spark):
    text = "# A\nintro\nmore\n\n## B\n- one\n- two\n```py\n# no heading\n```\n| x | y |\n|---|---|\n| 1 | 2 |\n# C\n~~~\nopen"
    got = [tuple(r)[2:] for r in symbols.markdown(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("unit").collect()]
    assert got == [
        ("heading", ["A"], 1, 1, "A"), ("paragraph", ["A"], 2, 3, "intro\nmore"), ("heading", ["A", "B"], 5, 5, "B"), ("list_item", ["A", "B"], 6, 6, "one"), ("list_item", ["A", "B"], 7, 7, "two"),
        ("code", ["A", "B"], 8, 10, "# no heading"), ("table", ["A", "B"], 11, 13, "| x | y |\n|---|---|\n| 1 | 2 |"), ("heading", ["C"], 14, 14, "C"), ("code", ["C"], 15, 16, "open"),
    ]


def test_table_chunks(spark):
    text = "\n".join(["|h|", "|-|", *[f"|{i}|" for i in range(5)]])
    got = [r.content for r in symbols.table_chunks(spark.createDataFrame([(1, text), (2, "|h|\n|-|")], "table int, text string"), 2).orderBy("table", "chunk").collect()]
    assert got == ["|h|\n|-|\n|0|\n|1|", "|h|\n|-|\n|2|\n|3|", "|h|\n|-|\n|4|", "|h|\n|-|"]
