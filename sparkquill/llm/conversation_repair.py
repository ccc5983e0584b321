"""Repair of damaged conversations at the least cost, by layers of reachable grammar states.

The roles of a repaired conversation are (s?(ua)+)?: nothing, or user and assistant in turn after a system message or none.
A row is kept (K, cost 0), gets another role (R, 2) or goes (D, 3); rows may be put in anywhere (I, 2); blank and
duplicate rows must go, a truncated row that stays costs 1 more. States of the grammar: 0 nothing yet, 1 after s, 2 after
u, 3 after a. For each row one word holds, layer by layer of increasing cost, the set of states from which the rest can be
repaired at no more than that cost: four bits a layer, so one shift and mask moves all layers over an edit, as in
approximate matching by bit vectors. States lie at most DEPTH - 1 apart in cost, so words slide over the costs and the
work is linear in the rows. The first layer that accepts from state 0 gives the cost; following the words forward, at
each row the first edit of D, I, K, R that stays within what is left, gives the least audit.

Rows are sorted by ranges of (conv_id, turn, role, text), so a conversation of very many rows lies in several pieces. Pieces
are first reduced to matrices of costs from state to state, in any number of tasks; these few give the costs behind each
piece, and then a conversation streams through one task, a piece at a time, as the digest of its text demands. Its audit,
one character an edit, is held whole; so is one piece.

Defined results: null roles and texts are one blank, and so is a null in the text that damage is drawn from; null turns come
first and leave no gaps; rows of one turn stand in the order of role, then text, by bytes, and rows that are alike in all stand
side by side; a role counts by its first letter, one without s, u or a there must change or go; rows without a conv_id
are one conversation; a conversation that loses all its rows has zeros, an empty audit and the digest of the empty text; an empty
table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE, VISIBLE = " \t\n\x0b\x0c\r", r"[^\x20\x09-\x0D]"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Layers of a word, and bits of all of them and of a few more that a step may need.
DEPTH, SPARE = 16, 4
_WORD, _WIDE = (1 << 4 * DEPTH) - 1, (1 << 4 * (DEPTH + SPARE)) - 1
_ONES = _WIDE // 15
#: Costs of what is left after the last row, from each state.
END = [0, 2 * INSERT, INSERT, 0]
#: The next state by role, where there is one.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: what is left of ``turns`` after damage drawn from crc32(conv_id:turn); rows alike in all are one."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault``: blank, duplicate (all copies of a row whose role and text an earlier turn has), truncated or null."""
    place = F.struct(F.col("turn").isNotNull().alias("named"), "turn")
    said = ["conv_id", "role", "text"]
    first = rows.groupBy(*said).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.toDF(*[f"_{c}" for c in said], "first", "n")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in said]
    joined = rows.join(first, same[0] & same[1] & same[2], "left").select(*rows.columns, "first")
    ends = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = F.when(~F.col("text").rlike(VISIBLE), "blank").when(F.col("first") < place, "duplicate").when(~ends.isin(".", "!", "?"), "truncated")
    return joined.withColumn("fault", fault).drop("first")


def _behind_user(f: int) -> int:
    """All layers at once: the states from which a user's row leads into one of ``f``."""
    x = f >> 2 & _ONES
    return x | x << 1 | x << 3


def _behind_assistant(f: int) -> int:
    return (f >> 3 & _ONES) << 2


def _behind_system(f: int) -> int:
    return f >> 1 & _ONES


_BEHIND = {"s": _behind_system, "u": _behind_user, "a": _behind_assistant}


def _before(word: int, base: int, step: tuple[str, bool, int, int]) -> tuple[int, int]:
    """The layers before a step (initial, whether it must go, extra cost if it stays, how many of them) from those after it."""
    initial, gone, extra, times = step
    f = word | (word >> 4 * (DEPTH - 1)) * (0x1111 << 4 * DEPTH)
    g = f << 4 * DELETE
    if not gone:
        g |= (_behind_user(f) | _behind_assistant(f)) << 4 * (REROLE + extra)
        if initial in _BEHIND:
            g |= _BEHIND[initial](f) << 4 * extra
    g &= _WIDE
    for _ in range(2):  # at most two rows are worth putting in at one place
        g |= (_behind_user(g) | _behind_assistant(g)) << 4 * INSERT & _WIDE
    while not g & 15:
        g >>= 4
        base += 1
    return g & _WORD, base + DELETE * (times - 1)


def _layers(costs: list[int | None]) -> tuple[int, int]:
    """A word and its least cost from the cost of each state."""
    base = min(c for c in costs if c is not None)
    return sum(sum(1 << q for q, c in enumerate(costs) if c is not None and c <= base + k) << 4 * k for k in range(DEPTH)), base


def _cost(layers: tuple[int, int], state: int) -> int | None:
    found = layers[0] >> state & _ONES
    return layers[1] + ((found & -found).bit_length() - 1) // 4 if found else None


def _steps(rows: list[dict]) -> list[tuple[str, bool, int, int]]:
    """Each row, then further copies of it, which must go; copies of a row that must go are one step."""
    out = []
    for r in rows:
        initial = r["role"][:1]
        if r["fault"] in ("blank", "duplicate"):
            out.append((initial, True, 0, r["copies"]))
            continue
        out.append((initial, False, TRUNCATED if r["fault"] else 0, 1))
        if r["copies"] > 1:
            out.append((initial, True, 0, r["copies"] - 1))
    return out


def _all_layers(steps: list, after: list[int | None]) -> list[tuple[int, int]]:
    layers = [_layers(after)]
    for step in reversed(steps):
        layers.append(_before(*layers[-1], step))
    return layers[::-1]


def matrix(steps: list) -> list[int | None]:
    """The least cost over a piece from each state into each state (-1: none), row by row."""
    into = [_all_layers(steps, [0 if q == t else None for q in range(4)])[0] for t in range(4)]
    return [c if (c := _cost(into[t], s)) is not None else -1 for s in range(4) for t in range(4)]


def walk(steps: list, state: int, after: list[int], last: bool) -> tuple[list[tuple[str, str]], int]:
    """The edits of a piece, the least first, each with the role it gives or an empty one; and the state behind it."""
    layers, edits = _all_layers(steps, after), []
    left = _cost(layers[0], state)
    for i, (initial, gone, extra, times) in enumerate(steps):
        while True:
            role = "a" if state == 2 else "u"
            then = NEXT[role][state]
            if _cost(layers[i + 1], state) == left - DELETE * times:
                edits += [("D", "")] * times
                left -= DELETE * times
            elif _cost(layers[i], then) == left - INSERT:
                edits.append(("I", role))
                state, left = then, left - INSERT
                continue
            elif not gone and state in NEXT.get(initial, {}) and _cost(layers[i + 1], NEXT[initial][state]) == left - extra:
                edits.append(("K", initial))
                state, left = NEXT[initial][state], left - extra
            else:
                edits.append(("R", role))
                state, left = then, left - REROLE - extra
            break
    while last and left:
        role = "a" if state == 2 else "u"
        edits.append(("I", role))
        state, left = NEXT[role][state], left - INSERT
    return edits, state


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, list[dict]]]:
    """Rows of one conversation and segment, which lie side by side."""
    key, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and key != (r["conv_id"], r["segment"]):
                yield *key, rows
                rows = []
            key = r["conv_id"], r["segment"]
            rows.append(r)
    if rows:
        yield *key, rows


def _matrix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for conv, segment, rows in _pieces(batches):
        yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([segment], pa.int32()), pa.array([matrix(_steps(rows))], pa.list_(pa.int64()))], ["conv_id", "segment", "costs"])


def _after_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's pieces in order -> the costs behind each but the last."""
    for batch in batches:
        for r in batch.to_pylist():
            after, found = END, []
            for piece, before in zip(r["pieces"][:0:-1], r["pieces"][-2::-1]):
                ways = [[(c, after[t]) for t, c in enumerate(piece["costs"][4 * s : 4 * s + 4]) if c >= 0] for s in range(4)]
                after = [min(c + a for c, a in w) for w in ways]
                found.append((before["segment"], after))
            yield pa.record_batch([pa.array([r["conv_id"]] * len(found), pa.int64()), pa.array([s for s, _ in found], pa.int32()), pa.array([a for _, a in found], pa.list_(pa.int64()))], ["conv_id", "segment", "after"])


REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """One conversation as it streams by."""

    def __init__(self):
        self.state, self.cost, self.audit, self.digest, self.begun = 0, 0, [], hashlib.sha256(), False
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.initial, self.turns, self.low, self.high = 0, None, 0, None, None

    def add(self, rows: list[dict], after: list[int] | None) -> None:
        steps = _steps(rows)
        edits, self.state = walk(steps, self.state, END if after is None else after, after is None)
        self.audit.append("".join(e for e, _ in edits))
        said = iter([r for r in rows for _ in range(r["copies"])])
        for edit, role in edits:
            row = None if edit == "I" else next(said)
            if edit != "D":
                text = f"{row['role'] if edit == 'K' else ROLES[role]}:{row['text'] if row else ''}"
                self.digest.update(f"\n{text}".encode() if self.begun else text.encode())
                self.begun = True
            stays = row is not None and edit != "D"
            self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if stays and row["fault"] == "truncated" else 0)
        for r in rows:
            n, initial = r["copies"], r["role"][:1]
            if r["fault"] in ("blank", "duplicate"):
                self.counts[r["fault"]] += n
            else:
                self.counts["truncated"] += r["fault"] == "truncated"
                self.counts["duplicate"] += n - 1
            self.illegal += (n - 1) + (self.initial is not None and self.initial + initial not in LEGAL)
            self.initial = initial
            if r["turn"] is not None and r["turn"] != self.high:
                self.low, self.high, self.turns = r["turn"] if self.low is None else self.low, r["turn"], self.turns + 1

    def row(self, conv: int | None) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return conv, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def _repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    kinds = [pa.string() if "string" in c else pa.int64() for c in REPAIRED.split(", ")]
    batch = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    at, conversation, done = None, None, []
    for conv, _, rows in _pieces(batches):
        if conversation is not None and conv != at:
            done.append(conversation.row(at))
            conversation = None
            if len(done) == 1000:
                yield batch(done)
                done = []
        at, conversation = conv, conversation or _Conversation()
        conversation.add(rows, rows[0]["after"])
    if conversation is not None:
        yield batch([*done, conversation.row(at)])


def _within(rows: DataFrame, few: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Joins a table of a few rows a range (see ``repair``) by columns that may be null."""
    other = few.toDF(*[f"_{c}" if c in columns else c for c in few.columns])
    same: Column = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(F.broadcast(other), same, how).drop(*[f"_{c}" for c in columns])


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text), damaged and repaired: the columns of REPAIRED."""
    order = ["conv_id", "turn", "role", "text"]
    rows = faults(damaged(turns)).repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions(*order)
    rows = materialize(rows.select("*", F.spark_partition_id().alias("segment"), F.monotonically_increasing_id().alias("at")), "turns")
    # A border between ranges lies in at most one conversation, so these are fewer than ranges, and their pieces fewer than twice as many.
    spans = rows.groupBy("conv_id").agg(F.min("segment").alias("low"), F.max("segment").alias("high")).where("low < high").select("conv_id")
    long = _within(rows, spans, ["conv_id"], "left_semi").select("conv_id", "segment", "at", "role", "fault", "copies")
    dealt = long.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "at")
    pieces = dealt.mapInArrow(_matrix_rows, "conv_id long, segment int, costs array<long>")
    folded = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "costs"))).alias("pieces"))
    after = materialize(folded.mapInArrow(_after_rows, "conv_id long, segment int, after array<long>"), "after")
    whole = _within(rows, after, ["conv_id", "segment"], "left").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    found = whole.mapInArrow(_repaired_rows, REPAIRED)
    every = turns.select(F.col("conv_id").alias("asked")).distinct()
    joined = every.join(found, F.col("asked").eqNullSafe(F.col("conv_id")), "left")
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    filled = [F.coalesce(c, F.lit(nothing[c]) if c in nothing else F.lit(0).cast("long")).alias(c) for c in found.columns[1:]]
    return joined.select(F.col("asked").alias("conv_id"), *filled)
