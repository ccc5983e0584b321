"""What must hold for large groups and trees: percentiles, folds, pruned walks, counters without a pass of their own."""

import os

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from sparkquill.operators import chunking, evaluation, quantiles
from sparkquill.operators.observed import Metrics
from sparkquill.plans.catalog import ORACLES, QUERIES
from sparkquill.sources import files, walk


@pytest.mark.parametrize("few,bins,left_out", [(10_000, 4096, ()), (3, 512, ("log",)), (1, 8, ("log", "wide", "normal"))])
def test_percentiles(spark, few, bins, left_out):
    rng = np.random.default_rng(2)
    groups = {"normal": rng.normal(0, 1, 700), "ties": np.repeat([1.0, 2.0, 2.0, 9.0], 150), "wide": np.concatenate((rng.random(500), [1e300, -1e300])), "one": np.full(800, 4.25), "few": rng.random(30), "log": 10.0 ** rng.uniform(-200, 200, 600)}
    groups = {g: vs for g, vs in groups.items() if g not in left_out}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", None), (None, 1.0), (None, 3.0), ("few", float("nan"))]
    shares = [0.0, 0.5, 0.95, 1.0, 1.5, -1.0, 0.333]
    got = {r[0]: r[1:] for r in quantiles.percentiles(spark.createDataFrame(rows, "k string, x double"), "k", "x", shares, small=100, few=few, bins=bins).collect()}
    assert set(got) == {*groups, None} and got[None][1] == 2.0
    for g, vs in groups.items():
        assert np.allclose(got[g], np.quantile(vs, np.clip(shares, 0, 1)), rtol=1e-12, atol=0), g


def plain_parents(rows, most):
    out, at = [], None
    for doc, seq, path, tokens in sorted(rows, key=lambda r: r[:2]):
        if at is None or doc != at[0]:
            parent, held, key = 0, 0, None
        if path != key or held + tokens > most:
            parent, held = parent + 1, 0
        key, held, at = path, held + tokens, (doc,)
        out.append((doc, seq, parent))
    return out


def test_parents(spark):
    rng = np.random.default_rng(3)
    rows = [(d, s, [f"h{rng.integers(2)}"] if rng.random() < 0.9 else [], int(rng.integers(1, 50))) for d in range(30) for s in range(int(rng.integers(1, 40)))]
    frame = spark.createDataFrame(rows, "doc_id long, seq int, heading_path array<string>, tokens int")
    assert sorted(tuple(r) for r in chunking.parents(frame, 100).collect()) == plain_parents(rows, 100)
    found = [r.asDict() for r in chunking.sequenced(frame, 100).collect()]
    for d in range(30):
        mine = sorted((r for r in found if r["doc_id"] == d), key=lambda r: r["sequence_no"])
        assert [r["sequence_no"] for r in mine] == list(range(1, len(mine) + 1))
        above = {r["sequence_no"]: r["parent"] for r in mine if r["kind"] == "parent"}
        assert all(above[r["parent_sequence_no"]] == r["parent"] for r in mine if r["kind"] == "chunk")


def test_parents_of_a_very_long_document(spark):
    frame = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("seq"), F.array((F.col("id") / 1000).cast("int").cast("string")).alias("heading_path"), F.lit(7).alias("tokens"))
    assert chunking.parents(frame, 70).agg(F.max("parent")).first()[0] == 10_000


def test_relevance(spark):
    hits = spark.createDataFrame([(1, " A.md ", "The Answer is here", 1), (1, "A.md", None, 2), (1, "B.md", "x", 3), (2, "A.md", "the answer", 4), (1, None, "y", 5), (1, "C", "z", 6)], "qid long, document string, content string, n int")
    expected = spark.createDataFrame([(1, "A.md", ["ANSWER", None]), (1, "B.md ", []), (1, "", ["y"]), (1, "C", [None]), (3, "A.md", None)], "qid long, document string, must_contain array<string>")
    got = {r.n: r.relevant for r in evaluation.relevant(hits, expected).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for path, size in [("a.py", 5), ("src/b.py", 7), ("src/deep/er/c.js", 9), ("src/deep/x.min.js", 3), ("node_modules/m/i.js", 4), ("logs/x.log", 2), ("logs/keep.log", 2), ("big.txt", 5000), (".env", 1), ("my_secret.txt", 1), ("src/bin.dat", 3)]:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(b"\0" * size if path.endswith(".dat") else b"x" * size)
    os.symlink(root / "a.py", root / "link.py")
    os.symlink(tmp_path, root / "up")
    return root


LAYERS = (["logs/*", "!logs/keep.log"],)


@pytest.mark.parametrize("tasks", [1, 3, 50])
def test_walk(spark, tree, tasks):
    got = {r.path: r for r in walk.walk(spark, str(tree), *LAYERS, tasks=tasks, most_file=1000).collect()}
    assert list(got) == sorted(got) and set(got) == {"a.py", "src/b.py", "src/deep/er/c.js", "logs/keep.log", "big.txt", "src/bin.dat"}
    assert got["big.txt"].error == "file_too_large" and got["big.txt"].content_hash is None and got["src/bin.dat"].is_binary and got["a.py"].language == "python"
    every = {r.path: r.content_hash for r in files.discover(spark, str(tree), 1000, *LAYERS).collect() if r.path != "link.py" and not r.path.startswith("up/")}
    assert {p: r.content_hash for p, r in got.items() if r.content_hash} == every


def test_what_is_left_out_is_neither_listed_nor_opened(tree, monkeypatch):
    reader = walk._Reader({"path": str(tree), "layers": '[["logs/*"]]', "tasks": "1"})
    listed, opened, scandir, open_ = [], [], os.scandir, open
    monkeypatch.setattr(walk.os, "scandir", lambda p: listed.append(os.path.relpath(p, tree)) or scandir(p))
    monkeypatch.setattr("builtins.open", lambda p, *a, **k: opened.append(str(p)) or open_(p, *a, **k))
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    monkeypatch.undo()
    assert sorted(set(listed)) == [".", "logs", "src", "src/deep", "src/deep/er"] and len(opened) == len(rows) == 5
    late = walk._Reader({"path": str(tree), "most_seconds": "-1", "tasks": "1"})
    assert [r[4] for part in late.partitions() for r in late.read(part)] == ["scan_timeout"] or not late.partitions()[0].folders


def test_allowed_roots(spark, tree):
    root = str(tree)
    assert walk.is_allowed(root, [root]) and walk.is_allowed(f"{root}/src", ["/nowhere", root])
    assert not walk.is_allowed(f"{root}/up", [root]) and not walk.is_allowed(f"{root}/../x", [root]) and not walk.is_allowed("src", [root]) and not walk.is_allowed(root + "2", [root]) and not walk.is_allowed("", [root])
    assert [r.path for r in walk.scan(spark, {"r": root}, "r", "src/deep").collect()] == ["er/c.js"]
    for error, alias, relative in ((ValueError, "q", ""), (ValueError, "r", "/etc"), (PermissionError, "r", "up"), (PermissionError, "r", ".."), (FileNotFoundError, "r", "none")):
        with pytest.raises(error):
            walk.scan(spark, {"r": root}, alias, relative)


def test_limits_of_a_tree(spark):
    found = spark.createDataFrame([(f"p{i:03}", 10 if i else None) for i in range(100)], "path string, size long")
    assert {(r.path, r.truncated) for r in walk.within(found, 3, 10**9).collect()} == {(f"p{i:03}", True) for i in range(3)}
    assert walk.within(found, 1000, 95).count() == 10 and not walk.within(found).first().truncated and walk.within(found).count() == 100


def test_counters_ride_along(spark):
    metrics = Metrics(spark)
    rows = metrics.counting(spark.range(100), rows=F.count(F.lit(1)), even__ones=F.count_if(F.col("id") % 2 == 0))
    with metrics.timed("write"):
        assert rows.where("id < 10").count() <= 100
    metrics.took("parse", 0.25)
    metrics.took("parse", 0.75)
    metrics.add("calls", 2)
    metrics.add("calls")
    got = {(r.name, r.kind): (r["count"], r.total_ms, r.mean_ms) for r in metrics.report().collect()}
    assert got["calls", "counter"][0] == 3 and got["parse", "duration"] == (2, 1000.0, 500.0) and got["rows", "counter"][0] == 100 and got["even.ones", "counter"][0] == 50 and ("write", "duration") in got


@pytest.mark.parametrize("name", ["stage_metrics", "relevance_labels", "chunk_sequence", "parent_chunks", "latency_percentiles"])
def test_on_more_rows(spark, name):
    same(QUERIES[name](spark, "/root/testdata/sf0.01"), ORACLES[name], "/root/testdata/sf0.01")


def test_the_plainest_walk(spark, tree):
    (tree / "x.min.js").write_text("y")
    (tree / ".env.local").write_text("y")
    (tree / "sub_id_rsa").write_text("y")
    got = {r.path: r.language for r in walk.walk_plain(spark, str(tree), 1000).collect()}
    assert got == {"a.py": "python", "logs/keep.log": None, "logs/x.log": None, "my_secret.txt": None, "src/b.py": "python", "src/deep/er/c.js": "javascript", "src/deep/x.min.js": "javascript", "x.min.js": "javascript"}
