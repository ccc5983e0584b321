"""Line dedup against brute force: batches, levels, hot lines, repeated and missing ids."""

import hashlib
from collections import defaultdict

import pytest
from test_llm_operators import docs

from sparkquill.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_brute_force(rows, before=()):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    held = defaultdict(list)
    for i, text in [*before, *rows]:
        for k in {key(line) for line in (text or "").split("\n")}:
            held[k].append(-(2**70) if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        at = -(2**70) if i is None else i
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == at]
        out.append((i is None, i or 0, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def have(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


FOOT, HEAD, SHORT = "all rights are reserved by the writers", "  Read This Page In Your Own Language \r", "of 19 characters, x"
ROWS = [
    (1, f"{HEAD}\nfirst text of its own, long enough\n{FOOT}"),
    (2, f"{FOOT}\n{FOOT}\n{SHORT}\nread this page in your own language"),
    (3, f"{SHORT}\n\n{FOOT.upper()}\n"),
    (4, f"{SHORT}\n{HEAD}{HEAD}"),
    (5, f"{SHORT}\n{FOOT} \nÀ line with Ä and ä, over twenty"),
    (6, "à line with Ä and ä, over twenty\nÀ line with ä and ä, over twenty"),
    (7, f"{HEAD}\n{HEAD}\nends here"),
    (8, f"a line that two documents hold\n{FOOT}\nlast"),
    (9, "a line that two documents hold"),
    (9, f"{FOOT}\nrepeats its doc_id"),
    (None, f"{HEAD}\nno id\na line that rows without ids hold"),
    (None, "a line that rows without ids hold\nx"),
    (None, "a line that rows without ids hold"),
    (13, None),
    (14, ""),
    (15, "\n\n"),
    (2**63 - 1, f"x\n{FOOT}"),
    (-(2**63), f"y\n{FOOT}\n{FOOT}\ny"),
]


@pytest.mark.parametrize("batches,fanout", [(1, 4), (3, 2), (6, 2)])
def test_line_dedup(spark, batches, fanout):
    index = line_dedup.LineIndex(spark, fanout=fanout)
    assert have(line_dedup.line_dedup(docs(spark, ROWS), batches, index)) == by_brute_force(ROWS)
    assert all(sum(r["level"] == level for r in index.runs) < fanout for level in {r["level"] for r in index.runs})
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lines_")]


def test_frequent_keys_beyond_the_bound_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_FREQUENT", 0)
    assert have(line_dedup.line_dedup(docs(spark, ROWS))) == by_brute_force(ROWS)


def test_an_index_is_opened_again(spark):
    index = line_dedup.LineIndex(spark, fanout=2)
    line_dedup.line_dedup(docs(spark, ROWS[:9]), 3, index).count()
    again = line_dedup.LineIndex(spark, index.folder, fanout=2)
    assert again.runs == index.runs and again.buckets == index.buckets
    later = [(i + 100 if i and 0 < i < 100 else i, t) for i, t in ROWS[9:]]
    assert have(line_dedup.line_dedup(docs(spark, later), 1, again)) == by_brute_force(later, ROWS[:9])


def test_runs_share_no_key_and_history_is_not_shuffled(spark, monkeypatch):
    index = line_dedup.LineIndex(spark, fanout=9)
    for i in range(0, len(ROWS), 6):
        index.append(docs(spark, ROWS[i : i + 6]))
    rows = [tuple(r) for run in index.runs for r in spark.read.schema("h long, c int").parquet(f"{index.folder}/{run['name']}").collect()]
    assert len(rows) == len(set(rows)) > 5
    with index._bucketed() as (table, _):
        a, b = (table(r["name"]) for r in index.runs[:2])
        plan = a.join(b.select("h", "c").hint("merge"), ["h", "c"], "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_one_line_in_every_document(spark):
    rows = [(i, f"{FOOT}\nunlike {i}") for i in range(3000)]
    assert have(line_dedup.line_dedup(docs(spark, rows), 2)) == by_brute_force(rows)


def test_a_text_of_very_many_lines(spark):
    lines = [f"line number {i % 5000} of a long text" for i in range(60_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[::-1])), (3, "\n".join(lines[:100]))]
    assert have(line_dedup.line_dedup(docs(spark, rows), 1)) == by_brute_force(rows)
