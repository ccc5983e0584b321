"""Alignment of two tokenizers' tokens over the same bytes, scored by corpus-wide counts of linked ids.

A text is encoded by a byte-level file (side A) and a piece model (side B), both over space + text. Byte offsets where
tokens of both sides end cut them into groups; the tokens that end there together are linked. Per document the
ids linked and how often are written to the shared folder, as one sorted array.

Counts are dense matrices, striped by the id of side B: tasks add up what they hold, the sums are dealt by stripe, and
``np.add.at`` adds them into the block of STRIPE rows x all ids of side A. Row maxima give the highest count of each B
id. Links are dealt by the same stripes, in batches of documents, and scored beside their block. A stripe of more than
HOT_LINKS links has several parts, each with a copy of the block. A task holds one block and one batch at a time.

Neither side's tokens cross from a visible character to a blank, tab or line end after it, where the vocabularies have no
such piece (this is looked up); so texts are cut there, and each distinct part is encoded and aligned once a worker as long as
it is remembered. Texts with other white space, or any text under other vocabularies, are one part each.

Defined results: null and empty texts, and texts whose tokens don't give back their bytes (a piece model reads U+2581 as a
blank), have no tokens, zeros and an empty ``groups_sha256``; each row counts as a document, rows that repeat a
doc_id or have none too; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import materialize

#: Ids of side B in one block (with 50 000 ids of side A, 100 MB).
STRIPE = 256
#: Links of a stripe that one part scores.
HOT_LINKS = 1_000_000
#: Parts, and characters of parts, that a worker remembers; beyond, it starts anew. Bytes of text aligned at once.
REMEMBERED, REMEMBERED_CHARS, AT_ONCE = 250_000, 1 << 24, 1 << 20
#: Characters of parts that are encoded as one text.
CHUNK = 1 << 14
#: Sums that a task gathers before it hands them on; and documents (2 to this) whose sums it hands on as one row.
GATHERED, TOGETHER = 1 << 20, 12
SPACE_MARK = "▁"
_PART = re.compile(r"[ \t\n]*[^ \t\n]+|[ \t\n]+")
#: White space at which texts are not cut.
_OTHER_SPACE = re.compile("[%s]" % "".join(map(chr, [*range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])))
#: What side A's file must have for texts to be cut (fixed values of that format).
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and the parts that a worker has aligned."""

    def __init__(self, byte_file: str, piece_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        letters = _bytes_of_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.size_a, self.size_b = 1 + max(self.a.get_vocab().values()), self.b.get_piece_size()
        self.bytes_a = [b""] * self.size_a
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        if not all(self.bytes_a[i] for i in vocabulary.values()) or not all(pieces):
            raise ValueError("a vocabulary with empty tokens can't be aligned by bytes")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id(SPACE_MARK)
        self.length_a, self.length_b = (np.array([len(x) for x in of]) for of in (self.bytes_a, self.bytes_b))
        # ids as they are written: within a group, and as the last of their side
        self.names = [f"{i}{after}" for n, last in ((self.size_a, "|"), (self.size_b, ";")) for i in range(n) for after in (",", last)]
        self.name_lengths = np.array(list(map(len, self.names)))
        with open(byte_file, encoding="utf-8") as f:
            layout = json.load(f)
        crossing = re.compile(rf"[^\s{SPACE_MARK}][{SPACE_MARK} \t\n]|{SPACE_MARK}[\t\n]")
        self.cut = layout["normalizer"] is None and layout["pre_tokenizer"] == _BYTE_LEVEL and not any(map(crossing.search, pieces))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str | None] = []
        self.n_a = self.n_b = self.n_groups = self.links = np.zeros(0, np.int64)

    def parts(self, text: str) -> list[str]:
        """Space + text, cut where neither side's tokens cross."""
        whole = " " + text
        return _PART.findall(whole) if self.cut and not _OTHER_SPACE.search(whole) else [whole]

    def _piece_ids(self, parts: list[str]) -> list[list[int]]:
        """Side B's ids; the model puts a blank of its own before what it is given."""
        found = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        return [([self.mark] if p == " " else ids) if p[0] == " " else ids[1:] if ids[:1] == [self.mark] else [] for p, ids in zip(parts, found)]

    def _chunks(self, parts: list[str]) -> list[list[str]]:
        """Parts that can be encoded as one text, as they would be cut out of it again; others alone."""
        closed, out, size = [p for p in parts if p[-1] not in " \t\n"], [[]], 0
        for p in closed:
            if size > CHUNK:
                out.append([])
                size = 0
            out[-1].append(p)
            size += len(p)
        out = [c for chunk in out for c in ([chunk] if self.cut and not _OTHER_SPACE.search("".join(chunk)) else [[p] for p in chunk])]
        return [*filter(None, out), *[[p] for p in parts if p[-1] in " \t\n"]]

    def learn(self, parts: list[str]) -> None:
        """Encodes and aligns parts that are not known yet."""
        chunks = self._chunks(parts)
        while chunks:
            texts = ["".join(c) for c in chunks]
            ids_a, ids_b = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self._piece_ids(texts)
            raw = [t.encode() for t in texts]
            good = [b"".join(map(self.bytes_a.__getitem__, a)) == r == b"".join(map(self.bytes_b.__getitem__, b)) for a, b, r in zip(ids_a, ids_b, raw)]
            of = lambda each: [x for x, g in zip(each, good) if g]  # noqa: B023, E731
            self._take_in(list(chain.from_iterable(of(chunks))), *(np.fromiter(chain.from_iterable(of(ids)), np.int64) for ids in (ids_a, ids_b)))
            bad = [c for c, g in zip(chunks, good) if not g]
            self._take_in([c[0] for c in bad if len(c) == 1])
            chunks = [[p] for c in bad if len(c) > 1 for p in c]

    def _take_in(self, parts: list[str], a: np.ndarray | None = None, b: np.ndarray | None = None) -> None:
        """Parts and the ids of all of them, one after another; without ids, parts that have none."""
        n = len(parts)
        self.known.update(zip(parts, range(len(self.groups), len(self.groups) + n)))
        self.chars += sum(map(len, parts))
        if a is None:
            counts, links = [np.zeros(n, np.int64)] * 3, np.zeros(0, np.int64)
            self.groups += [None] * n
        else:
            ends_a, ends_b, ends = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]), np.cumsum([len(p.encode()) for p in parts])
            beside = np.searchsorted(ends_b, ends_a)
            last_a = ends_b[beside] == ends_a  # a token of side B ends where this one does
            last_b = np.zeros(len(b), bool)
            last_b[beside[last_a]] = True
            links = b[beside[last_a]] * self.size_a + a[last_a]
            upto = [np.searchsorted(e, ends, "right") for e in (ends_a, ends_b, ends_a[last_a])]
            counts = [np.diff(u, prepend=0) for u in upto]
            # groups as they are written: side A's ids of a group, then side B's
            names = np.empty(len(a) + len(b), np.int64)
            group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
            names[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = 2 * a + last_a
            names[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * (self.size_a + b) + last_b
            text = "".join(map(self.names.__getitem__, names.tolist()))
            cuts = np.concatenate(([0], np.cumsum(self.name_lengths[names])))[np.concatenate(([0], upto[0] + upto[1]))].tolist()
            self.groups += [text[i : j - 1] for i, j in zip(cuts, cuts[1:])]
        self.n_a, self.n_b, self.n_groups, self.links = (np.concatenate((x, y)) for x, y in zip((self.n_a, self.n_b, self.n_groups, self.links), (*counts, links)))


def aligner(files: tuple[str, str]) -> Aligner:
    if files not in _ALIGNERS:
        _ALIGNERS[files] = Aligner(*files)
    return _ALIGNERS[files]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), then the same of the next."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _decoded(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return ""


ALIGNED = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"


def _aligned_rows(files: tuple[str, str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, row = aligner(files), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, raw in W.slices(batch, most=AT_ONCE):
                if len(al.known) > REMEMBERED or al.chars > REMEMBERED_CHARS:
                    al.forget()
                texts = [_decoded(t) for t in raw]
                parts = [al.parts(t) if t else [] for t in texts]
                new = list(set(chain.from_iterable(parts)).difference(al.known))
                if new:
                    al.learn(new)
                at = [list(map(al.known.__getitem__, ps)) for ps in parts]
                digests = []
                for d, a in enumerate(at):
                    groups = list(map(al.groups.__getitem__, a))
                    if None in groups:
                        at[d], groups = [], []
                    digests.append(hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
                of = np.repeat(np.arange(len(at)), [len(a) for a in at])
                flat = np.fromiter(chain.from_iterable(at), np.int64, len(of))
                n_a, n_b, n_groups = (np.bincount(of, x[flat], len(at)).astype(np.int64) for x in (al.n_a, al.n_b, al.n_groups))
                n_links = n_groups  # one of each side ends where a group does, as no token is empty
                # each document's links by id pair, in ascending order: one number for both, sorted
                size = al.n_groups[flat]
                code = al.links[_ranges((np.cumsum(al.n_groups) - al.n_groups)[flat], size)]
                both = np.sort(np.repeat(of * (al.size_a * al.size_b), size) + code)
                first = np.flatnonzero(np.diff(both, prepend=-1))
                times = np.diff(first, append=len(both)).astype(np.uint32)
                doc, code = np.divmod(both[first], al.size_a * al.size_b)
                cuts = np.searchsorted(doc, np.arange(len(at) + 1))
                code = code.astype(np.uint32 if al.size_a * al.size_b < 1 << 32 else np.uint64)
                each = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())  # noqa: B023, E731
                numbers = pa.array(np.arange(row, row + len(at)))
                row += len(at)
                columns = [part.column("doc_id"), numbers, *map(pa.array, (n_a, n_b, n_groups, n_links)), pa.array(digests, pa.string()), each(code), each(times)]
                yield pa.record_batch(columns, [c.split()[0] for c in ALIGNED.split(", ")])

    return rows


def _codes(batch: pa.RecordBatch, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id pairs, how often, and the place of their document in the batch."""
    codes = [np.frombuffer(x, kind) for x in batch.column("codes").to_pylist()]
    times = [np.frombuffer(x, np.uint32) for x in batch.column("times").to_pylist()]
    doc = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    return np.concatenate(codes).astype(np.int64), np.concatenate(times).astype(np.int64), doc


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(code):
        return code, n
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(n, first)


PART_COUNTS = "stripe int, codes binary, times binary"


def _counted_rows(stripe_size: int, kind: type):
    """Sums of a task's id pairs, a row for each stripe."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def out() -> pa.RecordBatch:
            stripe = held[0] // stripe_size
            first = np.flatnonzero(np.diff(stripe, prepend=-1))
            parts = list(zip(first, [*first[1:], len(stripe)]))
            return pa.record_batch(
                [pa.array(stripe[first].astype(np.int32)), pa.array([held[0][i:j].tobytes() for i, j in parts], pa.binary()), pa.array([held[1][i:j].tobytes() for i, j in parts], pa.binary())],
                ["stripe", "codes", "times"],
            )

        for batch in batches:
            if batch.num_rows:
                code, n, _ = _codes(batch, kind)
                code, n = _summed(code, n)
                held = _summed(np.concatenate((held[0], code)), np.concatenate((held[1], n)))
                if len(held[0]) > GATHERED:
                    yield out()
                    held = (held[0][:0], held[1][:0])
        if len(held[0]):
            yield out()

    return rows


class _Block:
    """The counts of one stripe: ``height`` ids of side B x all ids of side A."""

    def __init__(self, stripe: int, height: int, size_a: int):
        self.stripe, self.size_a, self.first, self.counts = stripe, size_a, stripe * height * size_a, np.zeros((height, size_a), np.int64)

    def add(self, codes: bytes, n: bytes) -> None:
        np.add.at(self.counts, np.divmod(np.frombuffer(codes, np.int64) - self.first, self.size_a), np.frombuffer(n, np.int64))

    def best(self) -> np.ndarray:
        return self.counts.max(axis=1)


STRIPES = "stripe int, codes binary, times binary, links long"


def _stripe_rows(height: int, size_a: int):
    """All sums of a stripe, which lie side by side, as one row: its counted pairs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None

        def out() -> pa.RecordBatch:
            b, a = np.nonzero(block.counts)
            n = block.counts[b, a]
            codes = block.first + b * size_a + a
            return pa.record_batch(
                [pa.array([block.stripe], pa.int32()), pa.array([codes.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([int(n.sum())])], ["stripe", "codes", "times", "links"]
            )

        for batch in batches:
            for r in batch.to_pylist():
                if block is None or block.stripe != r["stripe"]:
                    if block is not None:
                        yield out()
                    block = None  # one block at a time
                    block = _Block(r["stripe"], height, size_a)
                block.add(r["codes"], r["times"])
        if block is not None:
            yield out()

    return rows


DEALT = "stripe int, codes binary, times binary, rows binary, sizes binary"


def _dealt_rows(stripe_size: int, kind: type):
    """A batch's links, a row for each stripe: id pairs and how often, by document; the documents' rows and their numbers of pairs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code, n, doc = _codes(batch, kind)
            number = batch.column("row").to_numpy()
            stripe = code // stripe_size
            order = np.argsort(stripe, kind="stable")
            stripe, code, n, doc = stripe[order], code[order], n[order].astype(np.uint32), doc[order]
            first = np.flatnonzero(np.diff(stripe, prepend=-1))
            out: list[list] = [[], [], [], [], []]
            for i, j in zip(first, [*first[1:], len(stripe)]):
                begin = i + np.flatnonzero(np.diff(doc[i:j], prepend=-1))
                sizes = np.diff(begin, append=j).astype(np.uint32)
                within = (code[i:j] - stripe[i] * stripe_size).astype(np.uint32)
                for column, value in zip(out, (int(stripe[i]), within.tobytes(), n[i:j].tobytes(), number[doc[begin]].tobytes(), sizes.tobytes())):
                    column.append(value)
            yield pa.record_batch([pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]], [c.split()[0] for c in DEALT.split(", ")])

    return rows


def _added(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' rows once each, ascending, with the sums of what is held of them."""
    row, best, sum_ = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(row, kind="stable")
    row, best, sum_ = row[order], best[order], sum_[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    return row[first], np.add.reduceat(best, first), np.add.reduceat(sum_, first)


SCORED = "docs long, rows binary, best binary, sums binary"


def _scored_rows(height: int, size_a: int):
    """Rows of a stripe's part: first its counted pairs, then links of documents. Gives sums of documents, as far as a task holds them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, held = None, None, []

        def out() -> pa.RecordBatch:
            sums = _added(held)
            docs = sums[0] >> TOGETHER
            first = np.flatnonzero(np.diff(docs, prepend=-1))
            parts = list(zip(first, [*first[1:], len(docs)]))
            return pa.record_batch([pa.array(docs[first]), *[pa.array([x[i:j].tobytes() for i, j in parts], pa.binary()) for x in sums]], [c.split()[0] for c in SCORED.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                if r["rows"] is None:
                    if block is None or block.stripe != r["stripe"]:
                        block = None
                        block = _Block(r["stripe"], height, size_a)
                        block.add(r["codes"], r["times"])
                        best = block.best()
                    continue
                b, a = np.divmod(np.frombuffer(r["codes"], np.uint32).astype(np.int64), size_a)
                n, sizes = np.frombuffer(r["times"], np.uint32).astype(np.int64), np.frombuffer(r["sizes"], np.uint32)
                count = block.counts[b, a]
                first = np.cumsum(sizes, dtype=np.int64) - sizes
                held.append((np.frombuffer(r["rows"], np.int64), np.add.reduceat(np.where(count == best[b], n, 0), first), np.add.reduceat(n * count, first)))
                if sum(len(h[0]) for h in held) > GATHERED:
                    yield out()
                    held = []
        if held:
            yield out()

    return rows


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All sums of some documents, which lie side by side, as a row for each document."""
    docs, held = None, []

    def out() -> pa.RecordBatch:
        return pa.record_batch(list(map(pa.array, _added(held))), ["row", "n_best", "count_sum"])

    for batch in batches:
        for r in batch.to_pylist():
            if held and docs != r["docs"]:
                yield out()
                held = []
            docs = r["docs"]
            held.append(tuple(np.frombuffer(r[c], np.int64) for c in ("rows", "best", "sums")))
            if sum(len(h[0]) for h in held) > GATHERED:
                held = [_added(held)]
    if held:
        yield out()


def align(docs: DataFrame, byte_file: str, piece_file: str, height: int = STRIPE) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The files are read by every worker from the paths given, as tokenizers are installed on each machine. ``height``: ids of side B in a block.
    """
    files = (byte_file, piece_file)
    al = aligner(files)
    size_a, kind = al.size_a, np.uint32 if al.size_a * al.size_b < 1 << 32 else np.uint64
    aligned = materialize(docs.select("doc_id", "text").mapInArrow(_aligned_rows(files), ALIGNED), "aligned")
    linked = aligned.where("n_links > 0")
    sums = linked.select("codes", "times").mapInArrow(_counted_rows(height * size_a, kind), PART_COUNTS)
    counts = materialize(sums.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(_stripe_rows(height, size_a), STRIPES), "stripes")
    # as many stripes as side B has ids over STRIPE: their parts are a small table whatever the corpus
    parts = counts.select("stripe", F.greatest(F.lit(1), F.ceil(F.col("links") / HOT_LINKS)).cast("int").alias("parts"))
    dealt = linked.select("row", "codes", "times").mapInArrow(_dealt_rows(height * size_a, kind), DEALT).join(F.broadcast(parts), "stripe")
    dealt = dealt.select("stripe", F.pmod(F.xxhash64("rows"), F.col("parts")).cast("int").alias("part"), "codes", "times", "rows", "sizes")
    blocks = counts.join(F.broadcast(parts), "stripe").select("stripe", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "codes", "times")
    blocks = blocks.select("*", F.lit(None).cast("binary").alias("rows"), F.lit(None).cast("binary").alias("sizes"))
    beside = dealt.unionByName(blocks).repartition("stripe", "part").sortWithinPartitions("stripe", "part", F.col("rows").isNotNull())
    scored = beside.mapInArrow(_scored_rows(height, size_a), SCORED).repartition("docs").sortWithinPartitions("docs")
    sums_of = scored.mapInArrow(_document_rows, "row long, n_best long, count_sum long")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return aligned.drop("codes", "times").join(sums_of, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
