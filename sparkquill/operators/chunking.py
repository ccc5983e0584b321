"""Texts to paragraphs, chunks and parents of chunks."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import scratch

#: Tokens of a chunk, share of it that the next one repeats, tokens of a parent.
MOST_TOKENS, OVERLAP, PARENT_TOKENS = 900, 0.12, 2400
TEXT_KINDS, ALONE = ["paragraph", "list_item", "text", "formula", "image_caption", "ocr_text", "file_header", "symbol", "configuration"], ["table", "code"]


#: Rows of a frame that a function gives back at once, and letters of their texts.
PIECE_ROWS, PIECE_LETTERS = 2000, 2_000_000


def in_pieces(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """``rows`` as frames of a bounded size, whatever a batch of documents is cut into; the last column is the text."""
    held, letters = [], 0
    for row in rows:
        held.append(row)
        letters += len(row[-1] or "")
        if len(held) >= PIECE_ROWS or letters >= PIECE_LETTERS:
            yield pd.DataFrame(held, columns=columns)
            held, letters = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def _runs(text: str) -> Iterator[tuple[int, int, str]]:
    """First line, last line (from 1) and text of each maximal run of lines that aren't blank."""
    lines, begin = text.split("\n"), None
    for at, line in enumerate([*lines, ""]):
        blank = not line.strip(" \t\n\x0b\f\r")
        if blank and begin is not None:
            yield begin + 1, at, "\n".join(lines[begin:at])
        begin = None if blank else at if begin is None else begin


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, line_start, line_end, text: maximal runs of lines that aren't blank.

    One pass over each document's lines, inside its task: nothing is shuffled, and a document costs what it is long.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = ((d, i, *r) for d, t in zip(frame["doc_id"], frame["text"]) for i, r in enumerate(_runs(t or "")))
            yield from in_pieces(rows, ["doc_id", "paragraph", "line_start", "line_end", "text"])

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, paragraph int, line_start int, line_end int, text string")


def _windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows of ``size`` characters; the next begins ``overlap`` before the end of the one before.

    A window that the text goes on after ends behind its last full stop or line end, if that is in its second half,
    else before its last space, if it has one. Places are looked up in sorted lists; each window begins later than the last.
    """
    stops, spaces = ([m.start() for m in re.finditer(p, text)] for p in ("[.\n]", " "))
    before = lambda places, end: places[i - 1] if (i := bisect_left(places, end)) else -1
    out, begin = [], 0
    while begin < len(text):
        end = begin + size
        if end < len(text):
            stop, space = before(stops, end), before(spaces, end)
            if 2 * (stop - begin) > size:
                end = stop + 1
            elif space > begin:
                end = space
        out.append(text[begin:end].strip())
        begin = max(end - overlap, begin + 1)
    return [x for x in out if x]


def char_chunks(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """doc_id, chunk_index, content: the window's place depends on the one before, so a document is cut in one go."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = ((d, i, c) for d, t in zip(frame["doc_id"], frame["text"]) for i, c in enumerate(_windows(t or "", size, overlap)))
            yield from in_pieces(rows, ["doc_id", "chunk_index", "content"])

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, chunk_index int, content string")


def _lines(text: str, size: int) -> Iterator[tuple[int, int, str]]:
    held: list[str] = []
    lines, length = text.split("\n"), 0
    for at, line in enumerate(lines, 1):
        held.append(line)
        length += len(line) + 1
        if length >= size or at == len(lines):
            if content := "\n".join(held).strip(" \t\n\x0b\f\r") and "\n".join(held):
                yield at - len(held) + 1, at, content
            held, length = [], 0


def line_chunks(docs: DataFrame, size: int = 500) -> DataFrame:
    """doc_id, line_start, line_end, content: whole lines, closed once they hold ``size`` characters (a line's end is one).

    Where a chunk ends depends on where it began, so each document is one pass. Blank chunks are left out.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = ((d, *r) for d, t in zip(frame["doc_id"], frame["text"]) for r in _lines(t or "", size))
            yield from in_pieces(rows, ["doc_id", "line_start", "line_end", "content"])

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, line_start int, line_end int, content string")


def families(units: DataFrame) -> DataFrame:
    """``units`` (doc_id, unit, kind, ...) and family: texts in a row share one, tables and code stand alone, the rest goes."""
    order = Window.partitionBy("doc_id").orderBy("unit")
    kept = units.where(F.col("kind").isin(TEXT_KINDS + ALONE)).withColumn("text_kind", F.col("kind").isin(TEXT_KINDS))
    new = ~F.col("text_kind") | ~F.coalesce(F.lag("text_kind").over(order), F.lit(False))
    return kept.withColumn("family", F.sum(new.cast("int")).over(order)).drop("text_kind")


def _packed(frame: list[tuple], most: int, overlap: int) -> Iterator[tuple[list[int], str, list[str]]]:
    """Units (number, heading path, text) in order -> numbers, content and heading of each chunk."""
    tokens = lambda text: max(1, len(text) // 4)
    held: list[tuple] = []
    for unit in frame:
        other = bool(held) and bool(unit[1]) and unit[1] != held[0][1]
        over = bool(held) and tokens("\n\n".join(u[2] for u in [*held, unit])) > most
        if other or over:
            yield [u[0] for u in held], "\n\n".join(u[2] for u in held), held[0][1]
            tail = len(held)
            if over and not other:
                room = overlap
                while tail and tokens(held[tail - 1][2]) <= room:
                    tail -= 1
                    room -= tokens(held[tail][2])
            held = held[tail:]
        held.append(unit)
    if held:
        yield [u[0] for u in held], "\n\n".join(u[2] for u in held), held[0][1]


DOC_CHUNKS = "doc_id long, family long, chunk int, unit_first int, unit_last int, heading_path array<string>, content string"


def document_chunks(units: DataFrame, most: int = MOST_TOKENS, overlap: float = OVERLAP) -> DataFrame:
    """Chunks of whole units of one family; a heading or the token limit closes one, and after the limit the next repeats its end.

    Which units a chunk holds depends on the one before, so units are dealt by document and family and streamed in
    order; what is held is the family at hand.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def cut(key, run):
            for i, (at, content, path) in enumerate(_packed(run, most, int(most * overlap))):
                yield (*key, i, at[0], at[-1], path, content)

        def rows():
            key, run = None, []
            for frame in frames:
                for doc, family, unit, path, text in zip(frame["doc_id"], frame["family"], frame["unit"], frame["heading_path"], frame["text"]):
                    if (doc, family) != key:
                        if run:
                            yield from cut(key, run)
                        key, run = (doc, family), []
                    run.append((unit, list(path), text or ""))
            if run:
                yield from cut(key, run)

        yield from in_pieces(rows(), [c.split()[0] for c in DOC_CHUNKS.split(", ")])

    dealt = families(units).select("doc_id", "family", "unit", "heading_path", "text").repartition("doc_id", "family").sortWithinPartitions("doc_id", "family", "unit")
    return dealt.mapInPandas(pack, DOC_CHUNKS)


def parents(chunks: DataFrame, most: int = PARENT_TOKENS) -> DataFrame:
    """doc_id, seq, parent from (doc_id, seq, heading_path, tokens): chunks in a row under one heading share a parent of at most ``most`` tokens.

    A heading always begins a parent, so each run of chunks under one is packed for itself, in one pass that holds the open
    parent's tokens alone; a run's parents are then numbered after those of the runs before.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    rows = chunks.select("doc_id", F.col("seq").cast("int").alias("seq"), "tokens", F.concat_ws("\x01", "heading_path").alias("key"))
    begins = (~F.lag("key").over(order).eqNullSafe(F.col("key"))).cast("int")
    rows = rows.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order)).select("doc_id", "run", "seq", "tokens")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, n = None, 0, 0
        for frame in frames:
            numbers = []
            for doc, run, tokens in zip(frame["doc_id"], frame["run"], frame["tokens"]):
                if (doc, run) != at:
                    at, held, n = (doc, run), 0, 0
                n, held = (n, held + tokens) if n and held + tokens <= most else (n + 1, tokens)
                numbers.append(n)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "run": frame["run"], "seq": frame["seq"], "n": numbers})

    kind = chunks.schema["doc_id"].dataType.simpleString()
    dealt = rows.repartition("doc_id", "run").sortWithinPartitions("doc_id", "run", "seq")
    packed = scratch.saved(dealt.mapInPandas(pack, f"doc_id {kind}, run long, seq int, n int"), "parents")
    before = Window.partitionBy("doc_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = packed.groupBy("doc_id", "run").agg(F.max("n").alias("m"))
    starts = runs.select("doc_id", "run", F.coalesce(F.sum("m").over(before), F.lit(0)).cast("int").alias("start"))
    return packed.join(starts, ["doc_id", "run"]).select("doc_id", "seq", (F.col("start") + F.col("n")).alias("parent"))


def sequenced(chunks: DataFrame, most: int = PARENT_TOKENS) -> DataFrame:
    """doc_id, sequence_no, kind, seq, parent, parent_sequence_no: a document's chunks in order, then its parents, numbered from 1.

    A chunk names its parent's number; ``seq`` is null for parents.
    """
    placed = scratch.saved(parents(chunks, most), "placed")
    order = Window.partitionBy("doc_id").orderBy("seq")
    counts = placed.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    children = placed.withColumn("sequence_no", F.row_number().over(order)).join(counts, "doc_id")
    children = children.select("doc_id", "sequence_no", F.lit("chunk").alias("kind"), "seq", "parent", (F.col("n") + F.col("parent")).alias("parent_sequence_no"))
    above = placed.select("doc_id", "parent").distinct().join(counts, "doc_id")
    null = F.lit(None).cast("int")
    return children.unionByName(above.select("doc_id", (F.col("n") + F.col("parent")).alias("sequence_no"), F.lit("parent").alias("kind"), null.alias("seq"), "parent", null.alias("parent_sequence_no")))


def parent_chunks(chunks: DataFrame, most: int = PARENT_TOKENS) -> DataFrame:
    """doc_id, parent, n_chunks, content, heading_path from (doc_id, seq, heading_path, tokens, content)."""
    placed = chunks.join(parents(chunks, most), ["doc_id", "seq"])
    piece = F.sort_array(F.collect_list(F.struct("seq", "content", "heading_path"))).alias("p")
    return placed.groupBy("doc_id", "parent").agg(piece).select("doc_id", "parent", F.size("p").alias("n_chunks"), F.array_join(F.transform("p", lambda x: x["content"]), "\n\n").alias("content"), F.get("p", F.lit(0))["heading_path"].alias("heading_path"))


def merged_locator(locator: str, order: Column) -> Column:
    """One locator for several: pages and lines from the first to the last; of other fields the first in ``order`` that is known."""
    of = lambda f: F.col(f"{locator}.{f}")
    first = lambda f: F.min_by(of(f), F.when(of(f).isNotNull(), order))
    return F.struct(
        first("file_path").alias("file_path"), F.min(of("page_start")).alias("page_start"), F.max(of("page_end")).alias("page_end"),
        F.min(of("line_start")).alias("line_start"), F.max(of("line_end")).alias("line_end"), first("block_index").alias("block_index"),
    )


def located_chunks(chunks: DataFrame, units: DataFrame) -> DataFrame:
    """``chunks`` (doc_id, unit_first, unit_last, ...) with the merged locator of their units (doc_id, unit, locator), null without any."""
    keys = ["doc_id", "unit_first", "unit_last"]
    each = chunks.select(*keys).distinct().withColumn("unit", F.explode(F.sequence("unit_first", "unit_last")))
    met = each.join(units.select("doc_id", "unit", "locator"), ["doc_id", "unit"]).groupBy(*keys).agg(merged_locator("locator", F.col("unit")).alias("locator"))
    return chunks.join(met, keys, "left")


_SEPARATOR = re.compile(r"\s*\|?(\s*:?-+:?\s*\|)*\s*:?-+:?\s*\|?\s*")


def _row_groups(text: str, most: int) -> Iterator[str]:
    """Rows of a table in groups of at most ``most`` tokens, counted row by row; each group has the header, and a row at least."""
    tokens = lambda row: max(1, len(row) // 4)
    rows = [x.strip() for x in text.splitlines() if x.strip()]
    head = rows[: 2 if len(rows) > 1 and _SEPARATOR.fullmatch(rows[1]) else 1]
    base = sum(map(tokens, head))
    held, size = list(head), base
    for row in rows[len(head) :]:
        if len(held) > len(head) and size + tokens(row) > most:
            yield "\n".join(held)
            held, size = list(head), base
        held.append(row)
        size += tokens(row)
    if held:
        yield "\n".join(held)


def table_groups(tables: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """table, chunk, content from (table, text): whole rows up to ``most`` tokens a chunk, each under the header and its separator."""
    kind = tables.schema["table"].dataType.simpleString()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = ((t, i, c) for t, text in zip(frame["table"], frame["text"]) for i, c in enumerate(_row_groups(text or "", most)))
            yield from in_pieces(rows, ["table", "chunk", "content"])

    return tables.select("table", "text").mapInPandas(cut, f"table {kind}, chunk int, content string")
