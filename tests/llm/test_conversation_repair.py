"""Conversation repair against the least (cost, audit) over all states, found row by row without layers."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sparkquill.llm import catalog, conversation_repair as C

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost double"


def best_edits(rows):
    """rows: (initial, must go, extra) -> the least (cost, audit, outputs) from state 0; two rows at most are put in at a place."""
    after = {0: (0, "", ()), 3: (0, "", ())}

    def with_inserts(found):
        for _ in range(3):
            for (q, role), t in NEXT.items():
                if role != "s" and t in found:
                    cost, audit, out = found[t]
                    new = (cost + 2, "I" + audit, (("I", role), *out))
                    found[q] = min(found.get(q, new), new)
        return found

    after = with_inserts(after)
    for initial, gone, extra in reversed(rows):
        here = {}
        for q in range(4):
            ways = [(after[q][0] + 3, "D" + after[q][1], (("D", ""), *after[q][2]))] if q in after else []
            for (p, role), t in NEXT.items():
                if p == q and t in after and not gone:
                    cost, audit, out = after[t]
                    if role == initial:
                        ways.append((cost + extra, "K" + audit, (("K", role), *out)))
                    if role != "s":
                        ways.append((cost + 2 + extra, "R" + audit, (("R", role), *out)))
            if ways:
                here[q] = min(ways)
        after = with_inserts(here)
    return after[0]


def by_brute_force(turns):
    every, left = {t[0] for t in turns}, defaultdict(list)
    for conv, turn, role, text in turns:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        left[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv in every:
        rows = sorted(left[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, kinds = set(), []
        for _, role, text in rows:
            visible = text.strip(" \t\n\x0b\x0c\r")
            kinds.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
            seen.add((role, text))
        steps = [(r[1][:1], k in ("blank", "duplicate"), int(k == "truncated")) for r, k in zip(rows, kinds)]
        cost, audit, edits = best_edits(steps)
        said, lines = iter(rows), []
        for edit, role in edits:
            row = None if edit == "I" else next(said)
            if edit != "D":
                lines.append((row[1] if edit == "K" else {"u": "user", "a": "assistant"}[role]) + ":" + (row[2] if row else ""))
        known = [r[0] for r in rows if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def have(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, turns):
    return spark.createDataFrame([(*t, "clash", 0.5) for t in turns], SCHEMA)


def made(seed, conversations, most):
    rng = np.random.default_rng(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "u", " user", "Assistant"]
    texts = ["Yes.", "No!", "cut off", "", " \n", "Why?", "ok", None, "trail. \t", "ünï…", "a:b\nc.", "Same.", "Same. "]
    out = []
    for c in range(conversations):
        for t in range(int(rng.integers(0, most))):
            turn = None if rng.random() < 0.05 else int(rng.integers(0, most)) if rng.random() < 0.3 else t
            out.append((None if c == 3 else c, turn, roles[int(rng.choice(len(roles), p=[0.08, 0.3, 0.3, 0.1, 0.1, *[0.02] * 6]))], texts[int(rng.integers(len(texts)))] if rng.random() < 0.6 else f"text {t}."))
    return out + out[:20]


def test_repair_of_the_table(spark, sf):
    for folder in (sf, "/root/testdata/sf0.01"):
        turns = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert have(catalog.QUERIES["op13_conversation_repair"](spark, folder)) == by_brute_force(turns)


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_of_made_rows(spark, seed):
    turns = made(seed, 250, 16)
    assert have(C.repair(frame(spark, turns))) == by_brute_force(turns)


def test_a_conversation_in_many_pieces(spark):
    turns = made(5, 6, 30) + [(99, t % 900 if t % 7 else t, ["user", "assistant", "user", "tool", "system"][t * t % 5], ["Same.", f"x{t}", f"t{t}."][t % 3]) for t in range(3000)]
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert have(C.repair(frame(spark, turns))) == by_brute_force(turns)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_pieces_join_to_the_whole():
    rng = np.random.default_rng(8)
    for _ in range(400):
        steps = [("suax"[int(rng.integers(4))], bool(rng.random() < 0.2), int(rng.random() < 0.3), 1) for _ in range(int(rng.integers(1, 14)))]
        cost, audit, _ = best_edits([s[:3] for s in steps])
        assert C._cost(C._all_layers(steps, C.END)[0], 0) == cost
        cut = int(rng.integers(0, len(steps)))
        one, two = steps[:cut], steps[cut:]
        m = C.matrix(two)
        after = [min(c + C.END[t] for t, c in enumerate(m[4 * s : 4 * s + 4]) if c >= 0) for s in range(4)]
        first, state = C.walk(one, 0, after, False)
        second, _ = C.walk(two, state, C.END, True)
        assert "".join(e for e, _ in first + second) == audit


def test_states_are_never_further_apart_than_a_word_is_deep():
    rng = np.random.default_rng(9)
    for _ in range(300):
        steps = [("suax"[int(rng.integers(4))], bool(rng.random() < 0.3), int(rng.random() < 0.5), 1) for _ in range(40)]
        for end in (C.END, *[[0 if q == t else None for q in range(4)] for t in range(4)]):
            for word, _ in C._all_layers(steps, end):
                assert word >> 4 * (C.DEPTH - 1) == word >> 4 * (C.DEPTH - 5) & 15


def test_very_many_copies_of_one_row(spark):
    turns = [(1, 0, "user", "Hi there.")] * 5000 + [(1, 1, "assistant", "Yes.")]
    assert have(C.repair(frame(spark, turns))) == by_brute_force(turns)
