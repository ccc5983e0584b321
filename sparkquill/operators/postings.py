"""A positional inverted index of chunks, kept in the shared file system and brought up to date by what changed.

A posting is a word, a chunk and the word's places in it. The postings that a task gathers for a word stand in one row, a
block of little-endian integers, so that words, shuffles and sorts are paid by the block. Blocks lie in runs, one for each time chunks came in, bucketed
by word and sorted by word and first chunk, so that a search reads the buckets of its words alone, and in them the row
groups that hold these words. A word of more than HOT_ROWS postings in a run is dealt over several slots, which lie in
different buckets. A manifest names the runs, the lists of chunks that left, and the slots of frequent words; it is written
last, so an index is always whole, and opens again from its folder. A list of chunks that left hides their postings
in all earlier runs until ``compact`` writes one run without them.

Chunks are matched by a query's rarest word, whose postings are the candidates; of these the other words are looked up.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import scratch
from .retrieval import LEXICAL_K, cover_density, ranked
from .snapshots import diff

#: Postings of one word that lie in one bucket; and words of a batch of queries that are named in the scan's filter.
HOT_ROWS, MOST_NAMED = 1_000_000, 20_000
#: Words of texts, or postings of blocks, that a task handles at once, if there are several texts or blocks; and chunks that left which are broadcast.
MOST_TOKENS, MOST_GONE = 4_000_000, 2_000_000
#: Groups of words that are counted before words are, so that these are counted in large groups alone.
GROUPS = 65_536
#: Postings from which blocks of a word that stand side by side are no longer joined.
WIDE = 8192
#: Bytes of ASCII that belong to lexemes, in lower case.
_OF_WORDS = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789_"))
#: A word, the first chunk of the block, its postings; their chunks (64 bits), how many places each has and all places (32 bits).
BLOCK = "word STRING, chunk_id BIGINT, n INT, chunks BINARY, counts BINARY, places BINARY"
COLUMNS, KEY, LAYOUT = f"slot STRING, {BLOCK}", ["slot", "chunk_id"], 2


def _slot(word: Column, part: Column) -> Column:
    return F.when(part == 0, word).otherwise(F.concat(word, F.lit("\x01"), part.cast("string")))


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where one of the keys differs from the one before; 0 among them."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(lengths, dtype=np.int64))


def _pieces(lengths: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold ``most`` (MOST_TOKENS) together at most, or are one row."""
    ends, begin = _ends(lengths), 0
    while begin < len(lengths):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + (most or MOST_TOKENS), "right")) - 1)
        yield begin, end
        begin = end


def _in_bytes(values: np.ndarray, kind: str, ends: np.ndarray) -> pa.Array:
    held = np.ascontiguousarray(values, kind)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * held.itemsize).astype(np.int32)), pa.py_buffer(held)])


def _numbers(column: pa.Array, kind: str) -> np.ndarray:
    """All numbers of a column of _in_bytes, row after row."""
    _, at, held = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(memoryview(held)[at[0] : at[-1]], kind)


def _block(words: pa.Array, starts: np.ndarray, chunk: np.ndarray, counts: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """One row for each of ``words``, whose postings (chunk, count of places) begin at ``starts``."""
    ends = np.append(starts, len(chunk))
    lists = [_in_bytes(chunk, "<i8", ends), _in_bytes(counts, "<i4", ends), _in_bytes(places, "<i4", _ends(counts)[ends])]
    return pa.record_batch([words, pa.array(chunk[starts], pa.int64()), pa.array(np.diff(ends), pa.int32()), *lists], ["word", "chunk_id", "n", "chunks", "counts", "places"])


def _lexemes(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of lexemes of each lower-case ASCII text, and all of them."""
    _, at, held = texts.buffers()
    at = np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data, edges = np.frombuffer(held or b"", np.uint8)[at[0] : at[-1]], at - at[0]
    inner = _OF_WORDS[data]
    # whether the byte before and the one behind belong to the same word
    before, behind = np.zeros_like(inner), np.zeros_like(inner)
    before[1:], behind[:-1] = inner[:-1], inner[1:]
    before[edges[edges < len(data)]], behind[edges[edges > 0] - 1] = False, False
    first, last = np.flatnonzero(inner & ~before), np.flatnonzero(inner & ~behind)
    ends = _ends(last - first + 1).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data[inner])])
    return np.diff(np.searchsorted(first, edges)), words


def _gathered(ids: np.ndarray, lengths: np.ndarray, flat: pa.Array) -> Iterator[pa.RecordBatch]:
    """Blocks of chunks whose words stand in ``flat``, one chunk after the other."""
    ends = _ends(lengths)
    for begin, end in _pieces(lengths):
        low, n = int(ends[begin]), int(ends[end] - ends[begin])
        if not n:
            continue
        coded, bits = flat.slice(low, n).dictionary_encode(), n.bit_length()
        # by word, then as they stand
        key = coded.indices.to_numpy().astype(np.int64)
        key <<= bits
        key |= np.arange(n)
        key.sort()
        word, at = (key >> bits).astype(np.int32), (key & ((1 << bits) - 1)).astype(np.int32)
        row = np.repeat(np.arange(begin, end, dtype=np.int32), lengths[begin:end])[at]
        place = at - (ends[:-1] - low).astype(np.int32)[row]
        first = _changes(word, row)
        yield _block(coded.dictionary, _changes(word[first]), ids[row[first]], np.diff(first, append=n), place)


def blocks(chunks: DataFrame) -> DataFrame:
    """The postings of each word in some MOST_TOKENS words of chunks (chunk_id, a key, and text) as blocks.

    Places ascend. Gathered inside the scanning task, so no word is shuffled by chunk. Texts that are ASCII in lower case are cut
    into words by arrays of bytes, others by the pattern.
    """

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pc.is_valid(batch.column("every")))
            yield from _gathered(some.column("chunk_id").to_numpy(), pc.list_value_length(some.column("every")).to_numpy(), some.column("every").flatten())
            some = batch.filter(pc.is_valid(batch.column("plain")))
            for begin, end in _pieces(pc.binary_length(some.column("plain")).to_numpy(), 6 * MOST_TOKENS):
                piece = some.slice(begin, end - begin)
                yield from _gathered(piece.column("chunk_id").to_numpy(), *_lexemes(piece.column("plain")))

    lower = F.lower(F.coalesce("text", F.lit("")))
    plain = F.octet_length(lower) == F.length(lower)
    rows = chunks.where("chunk_id is not null").select("chunk_id", F.when(plain, lower).alias("plain"), F.when(~plain, T.lexemes(F.col("text"))).alias("every"))
    return rows.mapInArrow(gathered, BLOCK)


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of postings (word, chunk_id, places) that stand near each other."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                coded = batch.column("word").dictionary_encode()
                word = coded.indices.to_numpy()
                order = np.argsort(word, kind="stable")
                places = batch.column("places").take(pa.array(order))
                counts = pc.list_value_length(places).to_numpy()
                yield _block(coded.dictionary, _changes(word[order]), batch.column("chunk_id").to_numpy()[order], counts, places.flatten().to_numpy())

    return rows.select("word", "chunk_id", "places").mapInArrow(gathered, BLOCK)


def unpacked(rows: DataFrame) -> DataFrame:
    """word, chunk_id, places: the postings of blocks."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            for begin, end in _pieces(n):
                piece = batch.slice(begin, end - begin)
                words = piece.column("word").take(pa.array(np.repeat(np.arange(end - begin), n[begin:end])))
                ends = pa.array(_ends(_numbers(piece.column("counts"), "<i4")), pa.int32())
                places = pa.ListArray.from_arrays(ends, pa.array(_numbers(piece.column("places"), "<i4")))
                yield pa.record_batch([words, pa.array(_numbers(piece.column("chunks"), "<i8")), places], ["word", "chunk_id", "places"])

    return rows.select("word", "n", "chunks", "counts", "places").mapInArrow(spread, "word string, chunk_id long, places array<int>")


def _without(rows: DataFrame, gone: np.ndarray) -> DataFrame:
    """Blocks without the postings of chunks that left (ascending); those of a word that stand side by side become one."""
    sent = rows.sparkSession.sparkContext.broadcast(gone)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = sent.value
        for batch in batches:
            n = batch.column("n").to_numpy()
            for begin, end in _pieces(n):
                piece = batch.slice(begin, end - begin)
                coded = piece.column("word").dictionary_encode()
                chunk, counts, places = (_numbers(piece.column(c), kind) for c, kind in (("chunks", "<i8"), ("counts", "<i4"), ("places", "<i4")))
                # a new block where the word changes, and where WIDE postings are passed
                of = lambda values: np.repeat(values, n[begin:end])
                word, wide = of(coded.indices.to_numpy()), of(_ends(n[begin:end])[:-1] // WIDE)
                if len(left):
                    stays = left[np.minimum(np.searchsorted(left, chunk), len(left) - 1)] != chunk
                    places = places[np.repeat(stays, counts)]
                    chunk, counts, word, wide = chunk[stays], counts[stays], word[stays], wide[stays]
                if len(chunk):
                    starts = _changes(word, wide)
                    yield _block(coded.dictionary.take(pa.array(word[starts])), starts, chunk, counts, places)

    return rows.select("word", "chunk_id", "n", "chunks", "counts", "places").mapInArrow(kept, BLOCK)


def postings(chunks: DataFrame) -> DataFrame:
    """word, chunk_id, places (ascending) of chunks (chunk_id, text)."""
    return unpacked(blocks(chunks))


class PostingsIndex:
    """Runs of postings under one folder of the shared file system."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None):
        self.spark, self.folder = spark, folder or scratch.new_folder(spark, "postings")
        self.held: dict = {"layout": LAYOUT, "runs": [], "gone": [], "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))}
        self.version = 0
        known = [name for name in scratch.names_in(spark, self.folder) if name.startswith("manifest-")]
        if known:
            latest = max(known, key=lambda name: int(name.split("-")[1]))
            self.version = int(latest.split("-")[1])
            self.held = json.loads(spark.read.text(f"{self.folder}/{latest}", wholetext=True).first().value)
            if self.held.get("layout") != LAYOUT:
                raise ValueError(f"{self.folder} holds an index of another layout")

    def _tables(self):
        return scratch.bucketed(self.spark, self.folder, COLUMNS, KEY, self.held["buckets"])

    def _commit(self, **change) -> None:
        self.version += 1
        held = self.held | change
        self.spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.text(f"{self.folder}/manifest-{self.version}")
        of = lambda h: {x["name"] for x in [*h["runs"], *h["gone"]]}
        gone, self.held = of(self.held) - of(held), held
        for name in gone:
            scratch.remove(self.spark, f"{self.folder}/{name}")

    def _hot(self, counted: DataFrame) -> dict[str, int]:
        """Slots of words of over HOT_ROWS postings in ``counted`` (word, n): there are postings / HOT_ROWS such words at most, so they can be named."""
        group, many = F.pmod(F.xxhash64("word"), F.lit(GROUPS)), F.sum("n") > HOT_ROWS
        large = [r.g for r in counted.groupBy(group.alias("g")).agg(many.alias("many")).where("many").collect()]
        if not large:
            return {}
        return {r.word: -(-r.n // HOT_ROWS) for r in counted.where(group.isin(large)).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > HOT_ROWS).collect()}

    def _run(self, rows: DataFrame, counted: DataFrame | None = None) -> dict:
        """``rows`` (blocks) as a run. ``counted`` (word, n) has no fewer postings of any word; without it ``rows`` are written to be counted."""
        name, path = f"run-{uuid.uuid4().hex[:12]}", None
        if counted is None:
            path = scratch.new_folder(self.spark, "postings")
            rows = counted = scratch.saved(rows, "rows", path)
        hot = self._hot(counted)
        named = self.spark.createDataFrame(list(hot.items()), "word string, parts int")
        part = F.coalesce(F.pmod(F.xxhash64("chunk_id"), F.col("parts")), F.lit(0))
        dealt = rows.join(F.broadcast(named), "word", "left").select(_slot(F.col("word"), part).alias("slot"), "word", "chunk_id", "n", "chunks", "counts", "places")
        with self._tables() as tables:
            tables.save(dealt, name)
        if path:
            scratch.remove(self.spark, path)
        return {"name": name, "at": self.version + 1, "hot": hot}

    def add(self, chunks: DataFrame, gone: DataFrame | None = None, key: int | None = None) -> None:
        """Posts ``chunks`` (chunk_id, text); ``gone`` (chunk_id): chunks that left or that ``chunks`` replace.

        Calls with ascending ``key`` (the number of a batch) may be repeated: what was posted under a key is not posted again.
        """
        if key is not None and key <= self.held.get("key", -1):
            return
        run = self._run(blocks(chunks))
        lists = list(self.held["gone"])
        if gone is not None and self.held["runs"]:
            name = f"gone-{uuid.uuid4().hex[:12]}"
            left = scratch.saved(gone.select("chunk_id").distinct(), name, f"{self.folder}/{name}")
            lists.append({"name": name, "at": run["at"], "n": left.count()})
        self._commit(runs=[*self.held["runs"], run], gone=lists, **({} if key is None else {"key": key}))

    def reindex(self, before: DataFrame, after: DataFrame) -> DataFrame:
        """From one snapshot (chunk_id, text) to the next: only new and changed chunks are posted. Gives path, change."""
        hashed = lambda rows: rows.select(F.col("chunk_id").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
        changes = scratch.saved(diff(hashed(before), hashed(after)).where("change <> 'unchanged'"), "changes")
        of = lambda *kinds: changes.where(F.col("change").isin(*kinds)).select(F.col("path").alias("chunk_id"))
        self.add(after.join(of("new", "changed"), "chunk_id", "left_semi"), of("changed", "deleted"))
        return changes

    def _left(self, at: int) -> tuple[DataFrame | None, bool]:
        """chunk_id of chunks that left after the run was written, if there are such lists; whether they may be broadcast."""
        lists = [g for g in self.held["gone"] if g["at"] > at]
        rows = self.spark.read.schema("chunk_id long").parquet(*[f"{self.folder}/{g['name']}" for g in lists]).distinct() if lists else None
        return rows, sum(g["n"] for g in lists) <= MOST_GONE

    def _live(self, rows: DataFrame, at: int) -> DataFrame:
        """Blocks without the postings of chunks that left after the run was written; more than MOST_GONE are joined by a shuffle."""
        left, few = self._left(at)
        if not few:
            return packed(unpacked(rows).join(left, "chunk_id", "left_anti").repartition("word").sortWithinPartitions("word", "chunk_id"))
        gone = [] if left is None else [r.chunk_id for r in left.where("chunk_id is not null").collect()]
        return _without(rows, np.sort(np.array(gone, np.int64)))

    def compact(self) -> None:
        """One run without the chunks that left."""
        with self._tables() as tables:
            rows = counted = None
            for run in self.held["runs"]:
                table = tables.table(run["name"])
                one, count = self._live(table, run["at"]), table.select("word", "n")
                rows, counted = (one, count) if rows is None else (rows.unionByName(one), counted.unionByName(count))
            if rows is not None:
                self._commit(runs=[self._run(rows, counted)], gone=[])

    def found(self, words: DataFrame) -> DataFrame:
        """word, chunk_id, places of ``words`` (word, each once), written to the shared folder.

        Up to MOST_NAMED words are named in the scan's filter, which prunes buckets and row groups; more are joined bucket by bucket.
        """
        named = [r.word for r in words.limit(MOST_NAMED + 1).collect()]
        rows = None
        with self._tables() as tables:
            for run in self.held["runs"]:
                table, parts = tables.table(run["name"]), run["hot"]
                if len(named) <= MOST_NAMED:
                    slots = [w if not i else f"{w}\x01{i}" for w in named for i in range(parts.get(w, 1))]
                    one = table.where(F.col("slot").isin(slots))
                else:
                    hot = self.spark.createDataFrame(list(parts.items()), "word string, parts int")
                    dealt = words.join(F.broadcast(hot), "word", "left").select("word", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
                    one = table.join(dealt.select(_slot(F.col("word"), F.col("part")).alias("slot")).hint("merge"), "slot", "left_semi")
                one = unpacked(self._live(one, run["at"]))
                rows = one if rows is None else rows.unionByName(one)
            if rows is None:
                return self.spark.createDataFrame([], "word string, chunk_id long, places array<int>")
            return scratch.saved(rows, "found")

    def search(self, queries: DataFrame, k: int = LEXICAL_K) -> DataFrame:
        """qid, chunk_id, score, rank for queries (qid, text): what ``retrieval.lexical`` gives, without reading a text."""
        asked = queries.select("qid", T.query_terms(F.col("text")).alias("words")).where(F.size("words") > 0)
        each = asked.select("qid", F.size("words").alias("n"), F.posexplode("words").alias("term", "word"))
        held = self.found(each.select("word").distinct())
        often = held.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        rarest = each.join(often, "word", "left").groupBy("qid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("least"))
        rarest = rarest.where("least.df > 0").select("qid", F.col("least.word").alias("word"))
        candidates = rarest.join(held.select("word", "chunk_id"), "word").select("qid", "chunk_id")
        wanted = candidates.join(each, "qid").join(held, ["word", "chunk_id"])
        places = F.transform("places", lambda at: F.struct(at.alias("at"), F.col("term").alias("term")))
        whole = wanted.groupBy("qid", "chunk_id", "n").agg(F.collect_list(places).alias("hits"), F.count(F.lit(1)).alias("m")).where("m = n")
        hits = F.sort_array(F.flatten("hits"))
        scored = whole.select("qid", "chunk_id", hits.alias("hits"), "n")
        return ranked(scored.select("qid", "chunk_id", F.round(cover_density(F.col("hits"), F.col("n")), 6).alias("score")), k)
