"""Token ids in files of Huffman-coded blocks.

A token folder holds two tables. ``codes`` has the length of each id's code; codes are canonical, so lengths
are all a reader needs, and no code is longer than LONGEST bits. ``blocks`` has one row for each block of
whole documents in ascending doc_id order: the documents' ids and lengths, the coded ids, and the bit offset
of every STRIDE-th id. Blocks are read independently, and inside a block all strides are decoded side by
side: each step looks the next LONGEST bits up in a table of (id, length).

Writing takes two steps, as codes need the counts of the whole corpus: documents are dealt to ranges of
doc_id, tokenised and cut into blocks of plain ids in the shared folder; then ids are counted and each block
is coded. Spark's writers commit both, so lost tasks are simply run again.

A tokenizer file whose parts are those of WORD_PARTS never looks across white space, and cuts words into runs of
letters, single digits and runs of other characters, each tokenised for itself: texts are cut in arrays, and a worker
looks the pieces up (by 128 bits of hash) among those it has tokenised. With any other file whole texts go through
the tokenizer. A corpus may use at most 65 536 different ids (codes have at most LONGEST bits).

Defined results: null or empty texts have the end id alone; rows that repeat a doc_id stand side by side,
in the order of a hash of their texts, and may stand in different files; a null doc_id comes first; an empty table
gives empty tables; further columns of the input are not looked at.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import materialize, new_folder, remove_folder, shuffles_dropped

END, BLOCK, STRIDE, LONGEST = 2, 1 << 16, 64, 16
#: Words whose ids a Python worker remembers; beyond, it starts anew. And bytes of text that are tokenised at once.
REMEMBERED, AT_ONCE = 600_000, 1 << 20
#: The parts of a tokenizer file that make words independent of each other (fixed values of that format).
WORD_PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: Kinds of bytes: white space, letters, digits, others; and those that leave a word to the tokenizer: apostrophes
#: (which join letters), angle brackets and bars (special tokens), control characters, all beyond Latin-1's letters.
_SPACE, _LETTER, _DIGIT, _OTHER, _RARE = range(5)
_KIND = np.full(256, _RARE, np.uint8)
_KIND[0x21:0x7F] = _OTHER
for _range, _kind in ((b"\t\n\v\f\r ", _SPACE), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", _LETTER), (b"0123456789", _DIGIT), (b"'<>|", _RARE)):
    _KIND[list(_range)] = _kind
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODERS: dict[str, Coder] = {}


def _byte_letters() -> list[str]:
    """The printable character for each byte in byte-level vocabularies: itself, or the next one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


_BYTE = dict(enumerate(_byte_letters()))


def pieces(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of each piece, whether it is a rare word (not lower-cased), and where each text's pieces begin."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n" * 8, np.uint8)
    kind = _KIND[raw]
    low = _LOWER[raw]
    # À-ÿ but × and ÷: two bytes, the second from 0x80; capitals have their small letters 0x20 further
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    second = raw[lead + 1]
    lead = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    low[lead + 1] += ((raw[lead + 1] <= 0x9E) * 32).astype(np.uint8)
    # a word with a rare byte is one piece of that kind, as it stands
    space = kind == _SPACE
    first, last = (np.flatnonzero(x) + 1 for x in (~space[1:] & space[:-1], space[1:] & ~space[:-1]))
    first = first if space[0] else np.insert(first, 0, 0)
    words = np.unique(np.searchsorted(last, np.flatnonzero(kind == _RARE), side="right"))
    for a, b in zip(first[words].tolist(), last[words].tolist()):
        kind[a:b], low[a:b] = _RARE, raw[a:b]
    new = kind == _DIGIT
    new[1:] |= kind[1:] != kind[:-1]
    new[0] = True
    after = np.flatnonzero(new)  # where a piece or white space begins
    kept = np.flatnonzero(~space[after])
    start, end = after[kept], after[kept + 1]
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return low.tobytes(), start, end, kind[start] == _RARE, np.searchsorted(start, starts)


class Rows:
    """Row numbers by 128-bit keys, looked up many at once (open addressing)."""

    def __init__(self, bits: int = 20):
        self.bits, self.held = bits, 0
        self.key, self.row = np.zeros((2, 1 << bits), np.uint64), np.full(1 << bits, -1, np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The row of each key; -1 if there is none."""
        slot, out, todo = (a >> np.uint64(64 - self.bits)).astype(np.int64), np.full(len(a), -1), np.arange(len(a))
        while len(todo):
            row = self.row[slot]
            hit = (self.key[0][slot] == a[todo]) & (self.key[1][slot] == b[todo]) & (row >= 0)
            out[todo[hit]] = row[hit]
            on = ~hit & (row >= 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, a: np.ndarray, b: np.ndarray, row: np.ndarray) -> None:
        """Takes in keys that it does not hold, each once."""
        if 2 * (self.held + len(a)) > 1 << self.bits:
            kept = self.row >= 0
            old = self.key[0][kept], self.key[1][kept], self.row[kept]
            self.__init__(max(self.bits + 1, (4 * (self.held + len(a))).bit_length()))
            self.add(*old)
        self.held += len(a)
        slot, todo = (a >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(a))
        while len(todo):
            places, first = np.unique(slot, return_index=True)
            first = first[self.row[places] < 0]
            at, which = slot[first], todo[first]
            self.key[0][at], self.key[1][at], self.row[at] = a[which], b[which], row[which]
            on = np.ones(len(todo), bool)
            on[first] = False
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)


class Coder:
    """Ids of many whole texts at once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.by_word = all(parts.get(k) == v for k, v in WORD_PARTS.items()) and all(re.fullmatch(r"<\|\w+\|>", t["content"]) and not (t["normalized"] or t["lstrip"] or t["rstrip"]) for t in parts["added_tokens"])
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self._forget()

    def _forget(self) -> None:
        self.known = Rows()
        self.ids, self.first, self.size = array("I"), array("q"), array("q")

    def _learn(self, pieces_: list[bytes], rare: list[bool]) -> None:
        for piece, whole in zip(pieces_, rare):
            if whole:
                ids = self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids
            else:
                ids = [t.id for t in self.tokenize(piece.decode() if piece.isascii() else piece.decode("latin-1").translate(_BYTE))]
            self.first.append(len(self.ids))
            self.size.append(len(ids))
            self.ids.extend(ids)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        if not self.by_word:
            found = [e.ids for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)
        if self.known.held > REMEMBERED:
            self._forget()
        data, start, end, rare, bounds = pieces(texts)
        a, b = (W.byte_hashes(data, start, end, half) for half in (0, 1))
        row = self.known.find(a, b)
        while len(new := np.flatnonzero(row < 0)):
            new = new[np.unique(a[new], return_index=True)[1]]
            at = np.arange(len(self.first), len(self.first) + len(new))
            self._learn([data[i:j] for i, j in zip(start[new].tolist(), end[new].tolist())], rare[new].tolist())
            self.known.add(a[new], b[new], at)
            todo = np.flatnonzero(row < 0)
            row[todo] = self.known.find(a[todo], b[todo])
        size, first = np.frombuffer(self.size, np.int64)[row], np.frombuffer(self.first, np.int64)[row]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = np.frombuffer(self.ids, np.uint32)[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
        return ids, np.diff(ends[bounds])


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


BLOCK_SCHEMA = "file int, block int, doc_ids array<long>, lengths array<long>, ids binary"


def _plain_blocks(path: str, end: int, block_ids: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, block = TaskContext.get().partitionId(), 0
        docs: list = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            small = ids.astype("<u2") if ids.max() < 1 << 16 else ids.astype("<u4")
            out = pa.record_batch(
                [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([bytes([small.itemsize]) + small.tobytes()], pa.binary())],
                ["file", "block", "doc_ids", "lengths", "ids"],
            )
            docs.clear(), lengths.clear(), parts.clear()
            return out

        held, of = 0, coder(path)
        for batch in batches:
            for part, texts in W.slices(batch, most=AT_ONCE):
                ids, sizes = of.encode(texts)
                ids, sizes = np.insert(ids, np.cumsum(sizes), end), sizes + 1
                done = 0  # ids before the document at hand; those of the block begin at ``begun``
                begun = 0
                for doc_id, size in zip(part.column("doc_id").to_pylist(), sizes.tolist()):
                    docs.append(doc_id)
                    lengths.append(size)
                    done, held = done + size, held + size
                    if held >= block_ids:
                        parts.append(ids[begun:done])
                        yield flush()
                        block, held, begun = block + 1, 0, done
                if begun < done:
                    parts.append(ids[begun:done])
        if docs:
            yield flush()

    return rows


def _plain(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, f"<u{ids[0]}", offset=1)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for ids in batch.column("ids").to_pylist():
            n = np.bincount(_plain(ids))
            if len(n) > len(total):
                total = np.concatenate((total, np.zeros(len(n) - len(total), np.int64)))
            total[: len(n)] += n
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used.astype(np.int64)), pa.array(total[used])], ["id", "n"])


def code_lengths(counts: dict[int, int], longest: int = LONGEST) -> dict[int, int]:
    """Optimal code lengths of at most ``longest`` bits (package-merge over the sorted counts)."""
    ids = sorted(counts, key=lambda i: (counts[i], i))
    if len(ids) <= 1:
        return {i: 1 for i in ids}
    if len(ids) > 1 << longest:
        raise ValueError(f"{len(ids)} ids need codes of over {longest} bits")
    weights = np.array([counts[i] for i in ids], np.int64)
    # Each level keeps the sorted list of leaves and packages; a leaf's length is how many levels take it.
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(longest):
        merged = np.concatenate((weights, packages))
        order = np.argsort(merged, kind="stable")
        levels.append(order < len(ids))
        merged = merged[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, length = 2 * len(ids) - 2, np.zeros(len(ids), np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    return dict(zip(ids, length.tolist()))


def huffman_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Unlimited Huffman code lengths, which tests compare with."""
    heap = [(n, i, (i,)) for i, n in counts.items()]
    out = dict.fromkeys(counts, 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            out[s] += 1
        heapq.heappush(heap, (a + b, i, x + y))
    return out


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, lengths and codes, ordered by (length, id)."""
    order = sorted(lengths, key=lambda i: (lengths[i], i))
    size = np.array([lengths[i] for i in order], np.int64)
    codes, code, last = [], 0, 0
    for n in size.tolist():
        code <<= n - last
        codes.append(code)
        code, last = code + 1, n
    return np.array(order, np.int64), size, np.array(codes, np.uint64)


def encode_block(ids: np.ndarray, code: np.ndarray, length: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
    """The coded bits (four bytes of zeros after them) and the bit offset of every stride-th id."""
    size = length[ids]
    at = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    words = np.zeros((int(at[-1]) + 63) // 64 + 2, np.uint64)
    word, bit = at[:-1] >> 6, at[:-1] & 63
    shift = 64 - bit - size
    left = np.where(shift >= 0, code[ids] << np.maximum(shift, 0).astype(np.uint64), code[ids] >> np.maximum(-shift, 0).astype(np.uint64))
    over = np.flatnonzero(shift < 0)
    if len(ids):
        # codes of one 64-bit word follow each other, and their bits don't meet: sums are unions
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[first]] = np.add.reduceat(left, first)
        words[word[over] + 1] += code[ids[over]] << (64 + shift[over]).astype(np.uint64)
    data = words.astype(">u8").tobytes()[: (int(at[-1]) + 7) // 8] + bytes(4)
    return data, at[:-1:stride]


def decode_table(ids: np.ndarray, size: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """id and length by the next ``longest`` bits."""
    spans = np.left_shift(1, longest - size)
    fill = (1 << longest) - int(spans.sum())
    return np.repeat(np.append(ids, 0), np.append(spans, fill)), np.repeat(np.append(size, 1), np.append(spans, fill))


def decode_block(data: bytes, starts: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], stride: int = STRIDE, longest: int = LONGEST) -> np.ndarray:
    """The n ids of a block; each stride begins at its checkpoint and all advance together."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    by_bits, sizes = table
    out = np.zeros((len(starts), stride), np.uint32)
    at = starts.astype(np.int64).copy()
    last = len(window) - 1
    for step in range(stride):
        bits = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - longest)
        out[:, step] = by_bits[bits]
        at += sizes[bits]
    return out.ravel()[:n]


CODED_SCHEMA = "file int, block int, doc_ids array<long>, lengths array<long>, n_ids long, checkpoints binary, bits binary"


def _coded_rows(ids: np.ndarray, size: np.ndarray, codes: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = int(ids.max()) + 1 if len(ids) else 1
        code, length = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        code[ids], length[ids] = codes, size
        for batch in batches:
            for i, raw in enumerate(batch.column("ids")):
                plain = _plain(raw.as_py()).astype(np.int64)
                bits, marks = encode_block(plain, code, length)
                kept = [batch.column(c).slice(i, 1) for c in ("file", "block", "doc_ids", "lengths")]
                yield pa.record_batch([*kept, pa.array([len(plain)], pa.int64()), pa.array([marks.astype("<u4").tobytes()]), pa.array([bits])], ["file", "block", "doc_ids", "lengths", "n_ids", "checkpoints", "bits"])

    return rows


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = END, files: int | None = None, block_ids: int = BLOCK) -> str:
    """Writes the ids of all texts, each followed by ``end``, in ascending doc_id order; gives the folder."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ranges may end between texts of one doc_id, so one id of very many rows is no hot key.
    rows = docs.select("doc_id", F.xxhash64("text").alias("of"), "text")
    ordered = rows.repartitionByRange(files, "doc_id", "of").sortWithinPartitions("doc_id", "of").select("doc_id", "text")
    scratch = new_folder(spark, "plain")
    plain = materialize(ordered.mapInArrow(_plain_blocks(tokenizer, end, block_ids), BLOCK_SCHEMA), "plain", f"{scratch}/blocks")
    counted = plain.select("ids").mapInArrow(_count_rows, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    lengths = code_lengths({r.id: r.n for r in counted.toLocalIterator()})  # one entry for each id of the vocabulary
    ids, size, codes = canonical(lengths)
    table = [(int(i), int(n)) for i, n in zip(ids, size)]
    spark.createDataFrame(table, "id long, bits int").coalesce(1).write.parquet(f"{folder}/codes")
    coded = plain.mapInArrow(_coded_rows(ids, size, codes), CODED_SCHEMA)
    with shuffles_dropped(spark):
        coded.write.parquet(f"{folder}/blocks")
    remove_folder(spark, scratch)
    return folder


def _decoded(ids: np.ndarray, size: np.ndarray):
    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        table = decode_table(ids, size)
        for i, (bits, marks, n) in enumerate(zip(batch.column("bits"), batch.column("checkpoints"), batch.column("n_ids").to_pylist())):
            yield i, decode_block(bits.as_py(), np.frombuffer(marks.as_py(), "<u4"), n, table)

    return blocks


def _codes(spark: SparkSession, folder: str) -> tuple[np.ndarray, np.ndarray]:
    ids, size, _ = canonical({r.id: r.bits for r in spark.read.parquet(f"{folder}/codes").collect()})
    return ids, size


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids (array of int): the documents of a token folder."""
    blocks = _decoded(*_codes(spark, folder))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ids in blocks(batch):
                offsets = np.concatenate(([0], np.cumsum(batch.column("lengths")[i].values.to_numpy())))
                column = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([batch.column("doc_ids")[i].values, column], ["doc_id", "ids"])

    return spark.read.parquet(f"{folder}/blocks").mapInArrow(rows, "doc_id long, ids array<int>")


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    blocks = _decoded(*_codes(spark, folder))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ids in blocks(batch):
                lengths = batch.column("lengths")[i].values.to_numpy()
                ends = np.cumsum(lengths)
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                same = [pa.array(np.full(len(lengths), batch.column(c)[i].as_py(), np.int32)) for c in ("file", "block")]
                yield pa.record_batch(
                    [*same, batch.column("doc_ids")[i].values, pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["file", "block", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    table = spark.read.parquet(f"{folder}/blocks")
    docs = table.mapInArrow(rows, "file int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # Where a block begins: inside its file by a window over the file's blocks, and the files (as many as
    # write_tokens was told to make) by one over their totals.
    sizes = table.select("file", "block", "n_ids")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = sizes.groupBy("file").agg(F.sum("n_ids").alias("held"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("file_start"))
    starts = sizes.withColumn("block_start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).join(files, "file").drop("n_ids")
    start = (F.col("file_start") + F.col("block_start") + F.col("inside")).alias("start")
    return docs.join(starts, ["file", "block"]).select("doc_id", start, "n_tokens", "ids_crc32")
