"""Each operator against brute force or its SQL, and on nulls, empty and long texts, repeats, empty tables and extra columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from sparkquill.llm import catalog, common, decontaminate, exact_dedup, license_scan, near_dedup, packing, sharding, substring_dedup, token_files, toxicity, url_filter, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, key string, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", 0.5) for i, t in rows], SCHEMA)


def phrase(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("w" + "".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    long = phrase(9, 30_000)
    base = phrase(1, 60)
    return [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, base), (6, base), (7, base + " more words"), (8, long), (9, phrase(2, 20) + " " + base), (9, phrase(2, 20) + " " + base), (None, base), (11, "Ünïcode İ ſ x" * 3)]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, sf, name):
    same(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf)


def removed_by_brute_force(rows):
    w = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), x in zip(rows, w):
        for k in range(len(x) - 12):
            g = tuple(x[k : k + 13])
            first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), x in zip(rows, w):
        gone = {j for k in range(len(x) - 12) if first[tuple(x[k : k + 13])] < i for j in range(k, k + 13)}
        out.append((i, len(x), len(gone), hashlib.sha256(" ".join(v for j, v in enumerate(x) if j not in gone).encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup_edge_ids(spark):
    rows = [(i, phrase(5, 30)) for i in (2**63 - 1, -(2**63), 0, 7)]
    for hot_rows in (5, 1):
        index = substring_dedup.FingerprintIndex(spark, hot_rows=hot_rows)
        windows = substring_dedup.repeated_windows(docs(spark, rows), index.append(docs(spark, rows)), hot_rows)
        assert sorted(tuple(r) for r in substring_dedup.remove_repeats(docs(spark, rows), windows).collect()) == removed_by_brute_force(rows)


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(spark, odd, batches):
    rows = [r for r in odd if r[0] is not None]
    found = substring_dedup.substring_dedup(docs(spark, odd), batches, substring_dedup.FingerprintIndex(spark, most_runs=1))
    got = [tuple(r) for r in found.collect()]
    assert sorted(r for r in got if r[0] is not None) == removed_by_brute_force(rows)
    assert [r[2] for r in got if r[0] is None] == [0]


def test_substring_dedup_calls_on_one_index(spark):
    shared = [phrase(s, 20) for s in (1, 2, 3)]
    old = [(1, phrase(10, 30) + " " + shared[0]), (3, shared[1] + " " + phrase(11, 30)), (9, phrase(12, 15) + " " + shared[2])]
    new = [(5, phrase(13, 5) + " " + shared[0] + " " + phrase(14, 20)), (6, shared[1] + " " + shared[0]), (7, shared[2] + " " + phrase(15, 9)), (11, shared[2])]
    index = substring_dedup.FingerprintIndex(spark, most_runs=1)
    first = substring_dedup.substring_dedup(docs(spark, old), 1, index)
    assert sorted(tuple(r) for r in first.collect()) == removed_by_brute_force(old)
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(docs(spark, new), 1, index)
    second = substring_dedup.substring_dedup(docs(spark, new), 1, index, docs(spark, old))
    want = [r for r in removed_by_brute_force(old + new) if r[0] in {i for i, _ in new}]
    assert sorted(tuple(r) for r in second.collect()) == want and sum(r[2] for r in want) == 80


def test_substring_dedup_index_is_opened_again(spark):
    rows = [(i, phrase(200 + i, 20) + " " + phrase(300 + i % 3, 15) + " " + phrase(400 + i % 2, 15)) for i in range(24)]
    folder, got = common.new_folder(spark, "again"), []
    for at in range(0, 24, 4):  # six calls, each on an index opened from the folder; hot fingerprints and merged runs
        index = substring_dedup.FingerprintIndex(spark, folder, most_runs=2, hot_rows=1)
        assert len(index.runs) <= 3 and bool(index.runs) == bool(at)
        found = substring_dedup.substring_dedup(docs(spark, rows[at : at + 4]), 1, index, docs(spark, rows[:at]))
        got += [tuple(r) for r in found.collect()]
    assert sorted(got) == removed_by_brute_force(rows)
    assert len(common.files_in(spark, folder)) < 30 and any(r["hot"] for r in index.runs)


def test_substring_dedup_does_not_shuffle_history(spark, monkeypatch):
    index, plans = substring_dedup.FingerprintIndex(spark), []
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    write, save = substring_dedup.materialize, index._save
    monkeypatch.setattr(substring_dedup, "materialize", lambda df, name, *path: (name == "candidates" and seen(df)) or write(df, name, *path))
    monkeypatch.setattr(index, "_save", lambda df, path: ("repeated" in path and seen(df)) or save(df, path))
    for at in (0, 10):
        index.append(docs(spark, [(at + i, phrase(at + i, 30) + " " + phrase(7, 20)) for i in range(10)]))
    matched, candidates = plans[2:]  # those of the second batch
    for plan, joins in ((matched, 1), (candidates, 2)):
        assert plan.count("SortMergeJoin") >= joins and "Exchange" not in plan and "Bucketed: true" in plan


def test_substring_dedup_hot_windows(spark):
    rows = [(i, phrase(100 + i, 15) + " " + phrase(1, 20)) for i in range(40)]
    frame = docs(spark, rows)
    found = substring_dedup.FingerprintIndex(spark, hot_rows=5).append(frame)
    windows = substring_dedup.repeated_windows(frame, found, hot_rows=3)
    assert sorted(tuple(r) for r in substring_dedup.remove_repeats(frame, windows).collect()) == removed_by_brute_force(rows)


def test_sharding(spark, odd):
    got = sharding.shard(docs(spark, odd), 3).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in odd)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_sharding_balances(spark, sf):
    sizes = [r.b for r in catalog.op2_sharding(spark, sf).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 24 and max(sizes) < 1.35 * sum(sizes) / 24  # 200 texts, one of them 4 % of all bytes


def test_sharding_keeps_groups_of_up_to_half_a_shard(spark):
    rows = [(i, phrase(500 + i, 20)) for i in range(120)] + [(200 + i, phrase(7, 20)) for i in range(12)] + [(300 + i, phrase(8, 20)) for i in range(60)]
    got = {r.doc_id: r.shard for r in sharding.shard(docs(spark, rows), 4).collect()}
    assert len({got[200 + i] for i in range(12)}) == 1 and len({got[300 + i] for i in range(60)}) > 1


FOUR = ["doc_id", "n_shingles", "component_id", "kept"]


def linked_by_brute_force(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
    return sorted((i, len(sets[i]), top[i], top[i] == i) for i in sets)


def test_near_dedup(spark):
    rng = np.random.default_rng(3)
    rows = [(1, None), (2, ""), (3, "one two"), (4, "one two")]
    for group in range(4):
        base = phrase(50 + group, 80 + 40 * group).split()
        for _ in range(14):
            copy = list(base)
            for k in rng.choice(len(base), rng.integers(0, 8), replace=False):
                copy[k] = f"edit{rng.integers(3)}" if rng.random() < 0.5 else phrase(int(rng.integers(1e9)), 1)
            rows.append((len(rows) + 1, " ".join(copy)))
    got = sorted(tuple(r) for r in near_dedup.near_dedup(docs(spark, rows), 85).select(FOUR).collect())
    assert got == linked_by_brute_force(rows)


def test_near_dedup_odd_rows(spark, odd):
    got = [tuple(r) for r in near_dedup.near_dedup(docs(spark, odd), 85).select(FOUR).collect()]
    assert len(got) == len(odd) and [r[2:] for r in got if r[0] is None] == [(None, True)]


def test_near_dedup_of_a_repeated_id_with_unlike_texts(spark):
    a, b = phrase(60, 60), phrase(61, 60)
    rows = [(1, a + " more"), (9, a), (9, b), (12, b + " more"), (12, b + " more")]
    got = sorted(tuple(r) for r in near_dedup.near_dedup(docs(spark, rows), 85).select("doc_id", "component_id", "kept", "first").collect())
    assert got == [(1, 1, True, True), (9, 1, False, False), (9, 9, True, True), (12, 9, False, False), (12, 9, False, False)]
    rows = [(9, a), (9, a + " more"), (3, b), (None, a)]
    got = sorted((tuple(r) for r in near_dedup.near_dedup(docs(spark, rows), 85).select("doc_id", "component_id", "kept", "first").collect()), key=str)
    # two linked texts of one id: both have the id's component, one is the first
    assert sorted(r[:3] for r in got if r[0] == 9) == [(9, 9, True)] * 2 and sorted(r[3] for r in got if r[0] == 9) == [False, True]
    assert (3, 3, True, True) in got and (None, None, True, True) in got


def test_near_dedup_where_buckets_hold_many_unlinked_texts(spark, monkeypatch):
    # With buckets of two rows all of these meet; most share rare words with others they aren't linked to.
    monkeypatch.setattr(near_dedup, "band_rows", lambda percent: 2)
    monkeypatch.setattr(near_dedup, "LEAVES", 3)
    rng = np.random.default_rng(21)
    base = phrase(70, 60).split()
    rows = []
    for i in range(60):
        copy = list(base)
        for k in rng.choice(12, rng.integers(1, 5), replace=False):
            copy[5 * k] = f"edit{k}v{rng.integers(3)}"
        rows.append((i, " ".join(copy)))
    assert len({r[2] for r in linked_by_brute_force(rows)}) > 4
    got = sorted(tuple(r) for r in near_dedup.near_dedup(docs(spark, rows), 85).select(FOUR).collect())
    assert got == linked_by_brute_force(rows)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup_where_large_buckets_are_cut_into_parts(spark, monkeypatch, percent):
    # Texts of several lengths share passages with many others; buckets of more than three nodes are cut.
    monkeypatch.setattr(near_dedup, "band_rows", lambda percent: 2)
    monkeypatch.setattr(near_dedup, "PART", 3)
    rng = np.random.default_rng(31)
    base = phrase(71, 90).split()
    rows = [(1000, ""), (1001, None), (1002, "two words")]
    for i in range(90):
        copy = base[: 45 + 5 * int(rng.integers(0, 10))]
        for k in rng.choice(9, rng.integers(0, 5), replace=False):
            copy[5 * k] = f"edit{k}v{rng.integers(3)}" if i % 3 else f"own{i}v{k}"
        rows.append((i, " ".join(copy)))
    wanted = linked_by_brute_force(rows, percent)
    assert 4 < len({r[2] for r in wanted}) < 90
    assert sorted(tuple(r) for r in near_dedup.near_dedup(docs(spark, rows), percent).select(FOUR).collect()) == wanted


def test_parts_that_sizes_hold_apart_do_not_meet(spark):
    schema = "bucket long, node long, n int, u int, component long, top long"
    alike = [(1, i, 110, 18, i, -1) for i in range(3000)]
    assert not near_dedup._parts_met(spark.createDataFrame(alike, schema), 80)[1].count()
    # one node without shingles of its own may meet each of them: one part against the others, not all against all
    rows, met = near_dedup._parts_met(spark.createDataFrame([*alike, (1, 5000, 100, 0, 5000, -1)], schema), 80)
    parts = rows.where("node < 3000").select("part").distinct().count()
    assert met.count() == parts + 1 and rows.groupBy("part").count().agg({"count": "max"}).first()[0] < 2 * near_dedup.PART


def test_signatures_estimate_similarity():
    a, b = phrase(1, 400), " ".join(phrase(1, 400).split()[:360] + phrase(2, 40).split())
    doc, hashes = near_dedup.shingle_sets([a.encode(), b.encode()])
    s = near_dedup.signatures(doc, hashes, 2, 6144)
    x, y = (set(hashes[doc == d].tolist()) for d in (0, 1))
    assert abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.05


def test_toxicity(spark, sf):
    labels = common.table(spark, sf, "labels")
    got = toxicity.toxicity(common.table(spark, sf, "documents"), labels, trees=3)
    rows = {r.doc_id: r for r in got.collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.values())


def test_toxicity_holds_on_rows_it_never_learned_from(spark):
    folder = "/root/testdata/sf0.1"
    labels = common.table(spark, folder, "labels")
    got = toxicity.toxicity(common.table(spark, folder, "documents"), labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    rank = got.score.rank()[got.toxic == 1].sum()
    assert len(toxic) > 50 and (got.predicted == got.toxic).mean() > 0.97
    assert (toxic.predicted == 1).mean() > 0.85 and (clean.predicted == 1).mean() < 0.01
    assert (rank - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * len(clean)) > 0.93


def test_toxicity_features():
    of = lambda text, words={}, begins={}: dict(zip(toxicity.FEATURES, toxicity.features(text, words, begins, frozenset(b[:4] for b in begins))))
    assert [toxicity.kind_of(w) for w in ("idiots", "pathetically", "killer", "kill", "idea", "trashcan")] == ["mind", "worth", None, "threat", None, "worth"]
    got = of("You are an IDIOT! What a nice day it is here, and no more of it than that, scum")
    assert got["mind_density"] == got["worth_density"] == 1 / 19 and got["lexicon_density"] == 2 / 19 and got["lexicon_window"] == 2 / toxicity.WINDOW
    assert got["lexicon_within_2"] == 0 and got["lexicon_within_5"] == got["lexicon_within_10"] == 1 / 19
    assert got["capital_hits"] == got["marked_hits"] == got["capital_words"] == 1 / 19 and got["obfuscated"] == 0
    got = of("such an 1d10t, id!ot and m0r0n here on the 2nd of th3m")
    assert got["obfuscated_lexicon"] == got["mind_density"] == 3 / 13 and got["obfuscated"] == 4 / 13  # th3m is th and m
    # what a fixed lexicon holds is not counted as learned too; the strongest of word and beginnings counts
    got = of("idiot blergh blerghen plain", {"idiot": 3.0, "blergh": 2.5}, {"blerg": 4.0})
    assert got["learned_density"] == 2 / 4 and got["learned_weight"] == 8 / 4 and got["lexicon_density"] == 1 / 4
    assert set(of("").values()) == {0.0}
    at, you = np.sort(np.random.default_rng(2).choice(500, 40, replace=False)), np.sort(np.random.default_rng(3).choice(500, 9, replace=False))
    assert toxicity._distances(at, you).tolist() == [int(np.abs(you - i).min()) for i in at]
    assert toxicity._densest(at) == max(sum(i <= j < i + toxicity.WINDOW for j in at) for i in at)


def test_toxicity_learns_what_the_fixed_lexicons_miss(spark):
    rows = [(1, f"idiots moron blergh{i % 3} plain{i}") for i in range(20)] + [(0, f"plain words {i}") for i in range(20)]
    words, begins = toxicity._terms(spark.createDataFrame(rows, "toxic int, text string"))
    assert set(words) <= {"blergh"} and set(begins) == {"blerg", "bler"}


def test_toxicity_does_not_rest_on_one_feature(spark):
    folder = "/root/testdata/sf0.1"
    model = toxicity.fit(common.table(spark, folder, "documents"), common.table(spark, folder, "labels"))
    importance = dict(zip(toxicity.FEATURES, model.trees.featureImportances.toArray()))
    assert max(importance.values()) < 0.5 and sum(v for k, v in importance.items() if not k.startswith("learned")) > 0.4


def test_toxicity_of_rows_without_ids_and_with_clashing_names(spark, sf):
    source = common.table(spark, sf, "documents")
    clash = source.select("doc_id", "text", *[F.lit("mine").alias(c) for c in ("_features", "_vector", "_margin", "_calibrated", "_raw", "_score", "score", "in0")])
    labels = common.table(spark, sf, "labels")
    model = toxicity.fit(source, labels, trees=2)
    assert sorted(map(tuple, model.score(clash, "own").select("doc_id", "own").collect())) == sorted(map(tuple, model.score(source, "own").select("doc_id", "own").collect()))
    assert model.score(clash, "own").columns == [*clash.columns, "own"]
    assert toxicity.Model({}, {}).score(clash, "own").select("_features").distinct().collect() == [("mine",)]
    rows = toxicity.toxicity(spark.createDataFrame([(None, "x"), (3, "x")], "doc_id long, text string"), labels).collect()
    assert {r.doc_id: r.held_out for r in rows} == {None: False, 3: zlib.crc32(b"3") % 5 == 0}


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1, None), (6, None, 1), (None, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs(spark, odd), labels).count() == len(odd)


def padding(histogram, tops):
    return sum(min(t for t in tops if t >= size) * n - held for size, n, held in histogram)


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(4)
    for _ in range(30):
        sizes = sorted(rng.choice(200, 9, replace=False).tolist())
        h = [(s + 1, int(n), int(n) * (s + 1)) for s, n in zip(sizes, rng.integers(1, 50, 9))]
        best = min(padding(h, [*c, h[-1][0]]) for c in combinations([s for s, _, _ in h[:-1]], 3))
        assert padding(h, packing.boundaries(h, 4)) == best


def test_packing(spark, odd):
    got = packing.pack(docs(spark, odd), 4, 100).collect()
    assert len(got) == len(odd) and all(r.n_tokens <= r.bucket_tokens for r in got)
    assert len({(r.batch, r.slot) for r in got}) == len(got)
    for b in {r.batch for r in got}:
        of = [r for r in got if r.batch == b]
        assert len(of) == 1 or len(of) * of[0].bucket_tokens <= 100
    assert packing.pack(docs(spark, []), 4, 100).count() == 0


def test_packing_by_brute_force(spark):
    """The query on a whole table: sizes by plain counting, least padding by a plain dynamic program, batches without gaps."""
    folder = "/root/testdata/sf0.01"
    rows = catalog.op5_packing(spark, folder).collect()
    texts = {r.doc_id: r.text for r in common.table(spark, folder, "documents").collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(WORD.findall(t or "")) for i, t in texts.items()} and len(rows) == len(texts)
    sizes = sorted(r.n_tokens for r in rows)
    distinct = sorted(set(sizes))
    before = [0] + [sum(1 for s in sizes if s <= d) for d in distinct]
    total = [0] + [sum(s for s in sizes if s <= d) for d in distinct]
    cost = {0: 0}
    for _ in range(packing.BUCKETS):
        cost = {j: min(c + distinct[j - 1] * (before[j] - before[i]) - (total[j] - total[i]) for i, c in cost.items() if i < j) for j in range(1, len(distinct) + 1)} | {0: 0}
    best = cost[len(distinct)]
    assert best <= sum(r.padding for r in rows) <= best + sum(s for s in sizes if s > 1024) / 512
    for b in {r.bucket for r in rows}:
        of = [r for r in rows if r.bucket == b]
        top, capacity = max(r.n_tokens for r in of), max(1, packing.BUDGET // max(1, max(r.n_tokens for r in of)))
        assert {r.bucket_tokens for r in of} == {top} and all(r.padding == top - r.n_tokens for r in of)
        at = sorted((r.batch, r.slot) for r in of)
        assert at == [(at[0][0] + i // capacity, i % capacity) for i in range(len(of))]


def test_sharding_balances_all_sizes(spark):
    folder = "/root/testdata/sf0.1"
    rows = catalog.op2_sharding(spark, folder).collect()
    words = {r.doc_id: r.n for r in common.table(spark, folder, "documents").select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(sharding.WORD)).alias("n")).collect()}
    assert sorted(r.doc_id for r in rows) == sorted(words) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    for share, of in ((0.002, lambda r: r.size), (0.01, lambda r: words[r.doc_id]), (0.02, lambda r: 1)):
        loads = np.bincount([r.shard for r in rows], weights=[of(r) for r in rows], minlength=24)
        assert len(loads) == 24 and np.abs(loads / loads.mean() - 1).max() < share
    for s in range(24):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_code_lengths():
    rng = np.random.default_rng(5)
    counts = {i: int(n) for i, n in enumerate(rng.zipf(1.3, 300) % 10_000 + 1)}
    limited, free = token_files.code_lengths(counts, 16), token_files.huffman_lengths(counts)
    assert sum(2.0**-n for n in limited.values()) <= 1 and max(limited.values()) <= 16
    if max(free.values()) <= 16:
        assert sum(counts[i] * n for i, n in limited.items()) == sum(counts[i] * n for i, n in free.items())
    assert max(token_files.code_lengths({i: 2**i for i in range(12)}, 5).values()) == 5


def test_blocks_round_trip():
    rng = np.random.default_rng(6)
    for n in (0, 1, 63, 64, 65, 5000):
        ids = (rng.zipf(1.2, n) % 3000).astype(np.int64)
        kept, size, codes = token_files.canonical(token_files.code_lengths({i: int(c) for i, c in zip(*np.unique(np.append(ids, [1, 2]), return_counts=True))}))
        code, length = np.zeros(3001, np.uint64), np.zeros(3001, np.int64)
        code[kept], length[kept] = codes, size
        bits, marks = token_files.encode_block(ids, code, length)
        assert (token_files.decode_block(bits, marks, n, token_files.decode_table(kept, size)) == ids).all()


def test_token_files(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    rows = [r for r in odd if r[0] is not None] + [(20, "Don't you'RE <|endoftext|> a_b ½ 3x\x1c"), (21, "éà ÀÉ##'s \u0085 ﬁ Σας")]
    plain = Tokenizer.from_file(path)
    folder = token_files.write_tokens(docs(spark, rows), path, block_ids=500)
    got = sorted(token_files.token_digests(spark, folder).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda r: r[0])):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(rows)


def plain_digests(path, rows):
    """doc_id, start, n_tokens, ids_crc32 by the tokenizer alone."""
    from tokenizers import Tokenizer

    plain, at, out = Tokenizer.from_file(path), 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_of_a_whole_table(spark):
    import public_tokenizers

    got = catalog.op6_token_files(spark, "/root/testdata/sf0.01").select("doc_id", "start", "n_tokens", "ids_crc32")
    rows = [(r.doc_id, r.text) for r in common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect())) == plain_digests(str(public_tokenizers.path("word_bpe_49k.json")), rows)


def test_token_files_of_another_tokenizer(spark, sf, odd):
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    frame = common.table(spark, sf, "documents").select("doc_id", "text")
    got = token_files.token_digests(spark, token_files.write_tokens(frame, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == plain_digests(path, [tuple(r) for r in frame.collect()])


def test_tokenising_in_arrays():
    import public_tokenizers

    rng = np.random.default_rng(12)
    signs = list("abcXYZ019 \t\n.,#'<|>-_éÀÿß÷×½ªµ²İıſŸŁ日本Σς\u0301\u00a0\u2003\x1c\x85") + ["'s", "'LL", "<|endoftext|>", "don't", " the ", "\U0001f600"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 30))).encode() for _ in range(3000)]
    coder = token_files.Coder(str(public_tokenizers.path("word_bpe_49k.json")))
    for some in (texts, texts[:5], [b""], [b"", b" "]):
        ids, sizes = coder.encode(some)
        want = [e.ids for e in coder.tokenizer.encode_batch([t.decode() for t in some], add_special_tokens=False)]
        assert coder.by_word and sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_rows_of_keys():
    rng = np.random.default_rng(13)
    rows, held = token_files.Rows(4), {}
    for _ in range(20):
        a, b = rng.integers(0, 40, 30).astype(np.uint64) << np.uint64(59), rng.integers(0, 40, 30).astype(np.uint64)
        keys = list(zip(a.tolist(), b.tolist()))
        assert rows.find(a, b).tolist() == [held.get(k, -1) for k in keys]
        new = [k for k in dict.fromkeys(keys) if k not in held]
        held |= {k: len(held) + i for i, k in enumerate(new)}
        rows.add(*np.array(new, np.uint64).reshape(-1, 2).T, np.array([held[k] for k in new], np.int64))


def test_exact_dedup_with_colliding_identifiers(spark, odd):
    rows = odd + [(30, phrase(1, 60).replace(" ", "\n")), (31, "x" * 9000)]
    frame = docs(spark, rows)
    fine = sorted(map(tuple, exact_dedup.exact_dedup(frame).collect()), key=str)
    coarse = exact_dedup.exact_dedup(frame, identify=lambda c: F.pmod(F.xxhash64(c), F.lit(2)), least=16, most=64)
    assert sorted(map(tuple, coarse.collect()), key=str) == fine
    sizes = {}
    for _, t in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        sizes[k] = sizes.get(k, 0) + 1
    assert sorted(r[2] for r in fine) == sorted(n for n in sizes.values() for _ in range(n))


def test_exact_dedup_ties_and_edge_ids(spark, monkeypatch):
    rows = [(-(2**63), "a b"), (5, "a  b"), (5, "a  b"), (None, "ab  "), (2, "x"), (None, "x"), (7, None), (3, " ")]
    want = sorted([(-(2**63), 5, 4, False), (5, 5, 4, True), (5, 5, 4, True), (None, 5, 4, False), (2, 2, 2, True), (None, 2, 2, False), (7, 3, 2, False), (3, 3, 2, True)], key=str)
    for most in (1_000_000, 0):
        monkeypatch.setattr(exact_dedup, "MOST_SHARED", most)
        for how in ({}, {"identify": lambda c: F.pmod(F.xxhash64(c), F.lit(2)), "least": 1, "most": 4}):
            got = exact_dedup.exact_dedup(docs(spark, rows), **how).select("doc_id", "keep_id", "group_size", "kept").collect()
            assert sorted(map(tuple, got), key=str) == want


def test_chunks_join_to_the_text(spark):
    row = spark.createDataFrame([(phrase(3, 5000),)], "t string").select("t", exact_dedup.chunks(F.col("t")).alias("c")).first()
    assert "".join(row.c) == row.t and len(row.c) > 10


def test_url_filter_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM", "http://x.Example.com/en/7?q", "ftp://b.com/en/x#y", "http://example.net/de/81", "http://net/de/1", "http://a.org/es/", "http://notexample.com/en/7", "http://a.org/es/"]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark), ranges=7).collect()}
    assert len(got) == len(urls)
    assert got[0] == got[2] == ("", "", None, "allow") and got[4] == ("a.com", "", None, "allow")
    assert got[5] == ("x.example.com", "/en/7", "example.com/en/7", "allow") and got[6] == ("b.com", "/en/x", "com/en/", "block")
    assert got[7][2:] == ("example.net/de/8", "block") and got[8][2:] == ("net/de/", "allow") and got[10][2:] == ("com/en/", "block")


def judged_by_brute_force(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    name = re.match("[^/?#]*", rest)[0].translate({c: c + 32 for c in range(65, 91)})
    tail = re.match("[^/?#]*([^?#]*)", rest)[1]
    best = None
    for rule, action in rules:
        h, slash, q = (rule or "").partition("/")
        if h and name and (name == h.lower() or name.endswith("." + h.lower())) and tail.startswith(slash + q):
            best = max(best or (), (len(rule), len(h), rule, action or "block"))
    return (name, tail, best[2], best[3]) if best else (name, tail, None, default)


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_url_filter_by_brute_force(spark, ranges):
    rng = np.random.default_rng(14)
    hosts = ["com", "net", "a.com", "b.a.com", "c.b.a.com", "A.Com", "xa.com", "com.net", "acom", "a-b.com", ""]
    paths = ["", "/", "/x", "/x/", "/x/y", "/x/y/z", "/xy", "/X", "?q=/x", "#/x", "/x?y", "/\u00e9/\x02"]
    urls = [None, "", "a.com/x"] + ["http://" + h + p for h in hosts for p in paths] * 2
    rules = [("com/x/", "block"), ("com/x/", "allow"), ("com", "allow"), ("a.com/", "block"), ("a.com/x/y", "allow"), ("B.A.com/x", "block"), ("net/x", None), (None, "block"), ("/x", "block"), ("", "block"), ("a-b.com/x/y/z", "allow")]
    pages = spark.createDataFrame([(int(i), u, "h") for i, u in zip(rng.permutation(len(urls)), urls)], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge_urls(pages, spark.createDataFrame(rules, "rule string, action string"), ranges=ranges).collect()}
    assert got == {r.page_id: judged_by_brute_force(r.url, rules) for r in pages.collect()}
    none = url_filter.judge_urls(pages, spark.createDataFrame([], "rule string, action string"), "block", ranges).collect()
    assert len(none) == len(urls) and {(r.rule, r.verdict) for r in none} == {(None, "block")}


def test_decontamination_ties_repeats_and_missing_ids(spark):
    item = phrase(77, 30)
    rows = [(3, item), (3, item), (None, item), (-(2**63), item + " x"), (4, phrase(2, 30))]
    items = spark.createDataFrame([(8, item), (7, item), (None, item), (-(2**63), " ".join(item.split()[:9])), (9, "a b"), (10, None)], "item_id long, text string")
    got = sorted(((r.doc_id, r.contaminated, r.item_id, r.score) for r in decontaminate.decontaminate(docs(spark, rows), items).collect()), key=str)
    low = -(2**63)  # part of the item, found whole: as good a score, and the smallest id
    assert got == sorted([(3, True, low, 1.0), (3, True, low, 1.0), (None, True, low, 1.0), (low, True, low, 1.0), (4, False, None, 0.0)], key=str)


def test_decontamination(spark):
    item = phrase(77, 40)
    edited = item.split()
    for k in (5, 14, 23, 32):
        edited[k] = "other"
    rows = [(1, None), (2, ""), (3, phrase(1, 300)), (4, phrase(2, 100) + " " + item + " " + phrase(3, 100)), (5, " ".join(edited)), (6, " ".join(item.split()[:8]) + " " + phrase(4, 50))]
    items = spark.createDataFrame([(1, item, "x"), (2, "too short", "x"), (3, None, "x")], "item_id long, text string, doc_id string")
    got = {r.doc_id: (r.contaminated, r.item_id) for r in decontaminate.decontaminate(docs(spark, rows), items).collect()}
    assert got == {1: (False, None), 2: (False, None), 3: (False, None), 4: (True, 1), 5: (True, 1), 6: (False, None)}
    blocks = decontaminate.passages_scored(docs(spark, rows), items, most_grams=10)
    assert {r.doc_id for r in blocks.where("score >= 0.6").collect()} == {4, 5}


@pytest.mark.parametrize("beside", [False, True])
def test_decontamination_finds_every_copy_that_keeps_a_gram(spark, beside):
    item = phrase(77, 48)
    sixth = item.split()
    for k in range(3, 48, 6):
        sixth[k] = "other"
    # one gram stays, and two further words stand after it and after each third word
    longer = item.split()[:4] + [x for k in range(4, 48, 3) for x in ("x", "y", *item.split()[k : k + 3])]
    rows = [(1, phrase(1, 60) + " " + " ".join(sixth) + " " + phrase(2, 60)), (2, " ".join(longer)), (3, phrase(3, 200))] + [(9, item)] * beside
    items = spark.createDataFrame([(5, item, "x")], "item_id long, text string, doc_id string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs(spark, rows), items).collect()}
    number = {w: n for n, w in enumerate({w for _, t in rows for w in t.split()})}
    for i, text in rows:
        score, _ = decontaminate.align(*(np.array([number.get(w, -1) for w in t.split()]) for t in (item, text)))
        assert got[i].contaminated == (score >= 0.6 * 2 * 48) == (i != 3)
        assert i == 3 or got[i].score == score / 96


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(8)
    for _ in range(40):
        a, b = rng.integers(0, 4, 12), rng.integers(0, 4, 15)
        h = np.zeros((13, 16), int)
        for i in range(1, 13):
            for j in range(1, 16):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def test_license_scan(spark):
    mit = license_scan.TEMPLATES[0][1]
    broken = mit.replace("any person", "any good person").title()
    rows = [(1, None), (2, ""), (3, "Under the MIT-License, under THE mit license!"), (4, broken), (5, "see apache license, version 2 and CC BY-NC"), (5, "cc"), (6, "cc by and nc")]
    got = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in license_scan.license_scan(docs(spark, rows)).collect())
    assert got == sorted([
        (1, 0, 0, None, None, "", ""), (2, 0, 0, None, None, "", ""), (3, 8, 2, 0, 4, "mit", "mit"), (4, len(broken.split()), 0, None, None, "", "mit"),
        (5, 9, 2, 1, 6, "apache-2,cc-by-nc", "apache-2,cc-by-nc"), (5, 1, 0, None, None, "", ""), (6, 4, 0, None, None, "", ""),
    ])


def test_base_places_by_brute_force(spark, sf):
    rows = {r.doc_id: r for r in catalog.op10_license_scan(spark, sf).collect()}
    for d in common.table(spark, sf, "documents").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in d.text or ""))
        at = [i for _, p in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = rows[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))


def colliding(n):
    """Two words of 2^n letters that every polynomial hash modulo 2^64 takes for one."""
    w = "a"
    for _ in range(n):
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_long_words_do_not_collide(spark):
    x, y = colliding(11)
    rows = [(1, " ".join([x] + [f"w{i}" for i in range(12)])), (2, " ".join([y] + [f"w{i}" for i in range(12)]))]
    assert sorted(tuple(r) for r in substring_dedup.substring_dedup(docs(spark, rows)).collect()) == removed_by_brute_force(rows)
    rows = [(1, " ".join([x, y] * 20)), (2, " ".join([y, y] * 20)), (3, " ".join([y, x] * 20))]
    assert sorted(tuple(r) for r in near_dedup.near_dedup(docs(spark, rows), 85).select(FOUR).collect()) == linked_by_brute_force(rows)


def test_words_and_hashes():
    texts = [b"", b"  a\tb  c ", b"a b c", "é\x0bü".encode()]
    w = words.split(texts)
    assert [w.span(a, b) for a, b in zip(w.bounds, w.bounds[1:])] == [[], [b"a", b"b", b"c"], [b"a", b"b", b"c"], ["é".encode(), "ü".encode()]]
    assert w.rolling(3)[0] == w.rolling(3)[3] and w.whole(3).tolist() == [True, False, False, True, False, False]


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op2_sharding", "op3_near_dedup", "op4_toxicity", "op5_packing", "op6_token_files", "op7_exact_dedup", "op8_url_filter", "op9_decontaminate", "op10_license_scan", "op11_line_dedup", "op12_token_alignment", "op13_conversation_repair"])
def test_empty_tables(spark, sf, tmp_path, name):
    for table in ("documents", "labels", "benchmark", "pages", "conversations"):
        common.table(spark, sf, table).limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_numbering_has_no_gaps(spark):
    frame = spark.range(1000).withColumn("g", F.col("id") % 3)
    got = common.numbered(frame, ["g"], ["id"], "at", 8 * common.SLICE_ROWS).collect()
    assert sorted((r.g, r["at"]) for r in got) == sorted((g, i) for g in range(3) for i in range(334 if g == 0 else 333))


def test_numbering_of_rows_that_repeat(spark):
    frame = spark.createDataFrame([(g, i, "x") for g in (0, 1) for i in [None] * 50 + [7] * 30 + list(range(20))], "g int, id long, t string")
    for most in (10**9, 5):
        got = common.numbered(frame, ["g"], ["id"], "at", 200, most).collect()
        assert sorted((r.g, r["at"]) for r in got) == [(g, i) for g in (0, 1) for i in range(100)]
        assert sorted((r.g, r.id is None, r.id or 0) for r in got) == sorted((r.g, r.id is None, r.id or 0) for r in frame.collect())


@pytest.mark.parametrize("id_", [None, 7])
def test_sharding_of_rows_that_repeat(spark, id_):
    rows = sharding.shard(docs(spark, [(id_, "one text, again and again")] * 400 + [(i, phrase(i, 3)) for i in range(80)])).collect()
    load = [sum(r["size"] for r in rows if r.shard == s) for s in range(24)]
    assert len(rows) == 480 and max(load) - min(load) <= 2 * max(r["size"] for r in rows)
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_url_filter_of_a_host_with_very_many_labels(spark):
    long = ".".join(["a"] * 100_000)
    pages = spark.createDataFrame([(1, f"http://{long}.example.com/en/7x"), (2, f"http://{long}/de/"), (3, f"http://{long}.net/de/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark)).collect()}
    assert got == {1: ("example.com/en/7", "allow"), 2: (None, "allow"), 3: ("net/de/", "allow")}
