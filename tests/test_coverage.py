"""Units, chunks by family, JSON lines, reranking that fails; and queries on more rows."""

import pytest
from oracle import same
from pyspark.sql import functions as F

from sparkquill.operators import dispatch, retrieval
from sparkquill.plans import coverage
from sparkquill.plans.catalog import ORACLES, QUERIES
from sparkquill.sources import lines, parsers

MARKDOWN = """# Top
#Close

one
two
- item a
  1. item b
| a | b |
|---|:-:|
| 1 | 2 |
text on
#######  seven
## Sub ##
```sql x
select 1
~~~
```
| no | table |
###
~~~
open"""


def test_markdown_units(spark):
    got = [tuple(r)[2:] for r in parsers.markdown_units(spark.createDataFrame([("f", MARKDOWN), ("n", None)], "file string, text string")).orderBy("unit").collect()]
    assert [(k, t, a, z, p) for k, t, _, _, _, p, _, a, z in got] == [
        ("heading", "Top", 1, 1, None), ("heading", "Close", 2, 2, None), ("paragraph", "one\ntwo", 4, 5, 2), ("list_item", "- item a", 6, 6, 2), ("list_item", "1. item b", 7, 7, 2),
        ("table", "| a | b |\n|---|:-:|\n| 1 | 2 |\ntext on\n#######  seven", 8, 12, 2), ("heading", "Sub ##", 13, 13, None), ("code", "select 1\n~~~", 14, 17, 7),
        ("paragraph", "| no | table |\n###", 18, 19, 7), ("code", "open", 20, 22, 7),
    ]
    assert got[7][2] == "```sql x\nselect 1\n~~~\n```" and got[7][6] == "sql x" and got[7][3] == ["Close", "Sub ##"] and got[4][2] == "  1. item b"


def test_chunks_of_a_mixed_document(spark):
    text = "# T\n" + "\n\n".join(f"paragraph number {i} of some length" for i in range(8)) + "\n\n| a | b |\n|---|---|\n" + "\n".join(f"| row {i} | value |" for i in range(20)) + "\n\n```py\nx = 1\n\n" + "\n\n".join(f"def f{i}():\n    return {i}" for i in range(30)) + "\n```\nend"
    units = parsers.markdown_units(spark.createDataFrame([("1", text)], "file string, text string")).withColumn("doc_id", F.col("file").cast("long"))
    rows = dispatch.chunked(units, 40).orderBy("sequence_no").collect()
    assert [r.sequence_no for r in rows] == list(range(1, len(rows) + 1)) and [k for i, k in enumerate(r.kind for r in rows) if i == 0 or rows[i - 1].kind != k] == ["text", "table", "code", "text"]
    tables = [r for r in rows if r.kind == "table"]
    assert len(tables) > 1 and all(r.content.startswith("| a | b |\n|---|---|\n| row") for r in tables) and sum(r.content.count("| row") for r in tables) == 20
    assert sum(r.content.count("def f") for r in rows if r.kind == "code") == 30 and len([r for r in rows if r.kind == "code"]) > 1
    assert all(r.embedding_text == f"# T\n\n{r.content}" for r in rows) and rows[0].profile.asDict() == dispatch.PROFILE


def test_image_units(spark):
    kind = "file string, error string, full_text string, confidence double, blocks array<struct<text:string,page:int,confidence:double,bbox:array<double>>>"
    rows = [("a", None, "all", 0.5, [("x", None, 0.9, [1.0, 2.0, 3.0, 4.0]), (" ", 1, None, None), ("y", 2, None, [0.0, 5.0, 1.0, 9.0]), ("", 1, None, [2.0, 2.0, 1.0, 1.0])]), ("b", "no engine", None, None, None), ("c", None, "t", None, None), ("d", None, "", 0.9, [])]
    got = [tuple(r) for r in parsers.image_units(spark.createDataFrame(rows, kind)).orderBy("file", "unit").collect()]
    of = lambda f: [g[1:] for g in got if g[0] == f]
    assert [g[1:7] for g in of("a")] == [("file_header", "a", None, None, None, None), ("ocr_text", "all", 0, 0.5, None, [0.0, 2.0, 4.0, 12.0]), ("ocr_text", "x", 0, 0.9, 1, [1.0, 2.0, 3.0, 4.0]), ("ocr_text", "y", 2, None, 3, [0.0, 5.0, 1.0, 9.0]), ("ocr_text", "", 1, None, 4, [2.0, 2.0, 1.0, 1.0])]
    assert of("a")[0][7:] == (True, "low OCR confidence") and [g[1] for g in of("b")] == ["file_header", "image"] and of("b")[0][8] == "OCR unavailable: no engine"
    assert of("c")[1][6:] == (None, True, "missing OCR confidence") and len(of("c")) == 2 and of("d")[0][7:] == (False, None)


def test_json_lines(spark, tmp_path):
    body = ['{"id": "a", "n": 1}', "", "  ", '{"id": "b"}', "{broken", '{"id": "c", "n": "x"}'] + ['{"id": "z", "n": 2}'] * 3000
    (tmp_path / "a.jsonl").write_text("\n".join(body))
    (tmp_path / "b.jsonl").write_text('{"id": "q", "n": 5}\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        rows = lines.json_lines(spark, str(tmp_path), "id string, n int", strict=False).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    a = {r.line: r for r in rows if r.file.endswith("a.jsonl")}
    assert set(a) == {1, 4, *range(5, 3007)} and (a[1].record.id, a[1].record.n, a[4].record.n) == ("a", 1, None)
    assert {n for n, r in a.items() if r.error} == {5, 6} and a[5].record is None and a[3006].record.id == "z" and [r.line for r in rows if r.file.endswith("b.jsonl")] == [1]
    with pytest.raises(ValueError, match="a.jsonl:5"):
        lines.json_lines(spark, str(tmp_path / "a.jsonl"), "id string, n int")


def test_a_reranker_that_fails_changes_nothing(spark):
    fused = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.8), (1, 12, 3, 0.7)], "qid long, chunk_id long, rank int, score double")
    rows, worked = retrieval.reranked(fused, lambda f: 1 / 0, 2)
    assert not worked and [(r.chunk_id, r["rank"]) for r in rows.orderBy("rank").collect()] == [(10, 1), (11, 2)]
    rows, worked = retrieval.reranked(fused, lambda f: f.select("qid", "chunk_id", F.col("chunk_id").alias("rerank")), 2)
    assert worked and [r.chunk_id for r in rows.orderBy("rank").collect()] == [12, 11]


@pytest.mark.parametrize("name", sorted(n for n, f in QUERIES.items() if f.__module__ == coverage.__name__) + ["rate_limit", "path_ignored"])
def test_on_more_rows(spark, name):
    same(QUERIES[name](spark, "/root/testdata/sf0.01"), ORACLES[name], "/root/testdata/sf0.01")


def test_dense_search_in_several_blocks_of_queries(spark, sf, monkeypatch):
    from sparkquill.plans import catalog

    rows = lambda: sorted(tuple(r) for r in retrieval.dense(catalog.vectors(spark, sf), catalog.queries_(spark, sf), 7).select("qid", "chunk_id", "score", "rank").collect())
    want = rows()
    monkeypatch.setattr(retrieval, "MATRIX", 500)
    assert rows() == want and len(want) > 100


def test_headers_and_signatures_stand_before_their_chunks(spark):
    from sparkquill.operators import context

    kind = "chunk_id long, source_id long, sequence_no int, parent_chunk_id long, content_hash string, token_count long, content string, row_group_header string, signature string"
    chunks = spark.createDataFrame([(1, 1, 1, None, "h1", 5, "| 1 |", "| a |", None), (2, 1, 2, None, "h2", 5, "| a |\n| 2 |", "| a | ", ""), (3, 2, 1, None, "h3", 5, "body", None, "def f()"), (4, 2, 2, None, "h4", 5, "more", "| a |", "def f()")], kind)
    hits = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4)], "qid long, chunk_id long, rank int")
    got = [(r.chunk_id, r.relation) for r in context.build(hits, chunks, width=0).orderBy("position").collect()]
    assert got == [(1, "row_group_header"), (1, "self"), (2, "self"), (3, "signature"), (3, "self"), (4, "self")]
    assert [r.relation for r in context.build(hits, chunks, most_chunks=2, width=0).orderBy("position").collect()] == ["row_group_header", "self"]
