"""Source code to chunks: blocks between blank lines, and the objects of PL/SQL files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import MOST_TOKENS, _runs

# Languages cut by objects, what begins an object or a subprogram, what ends a header, where an object may be cut.
PLSQL = ["plsql", "sql"]
OBJECT = re.compile(r"create\s+(?:or\s+replace\s+)?(package\s+body|package|procedure|function|trigger|type\s+body|type)\s+([a-z_][\w$#]*)", re.I | re.A)
SUBPROGRAM = re.compile(r"\s*(procedure|function)\s+([a-z_][\w$#]*)", re.I | re.A)
BODY = re.compile(r"\b(?:is|as)\b", re.I)
CUT = re.compile(r"\s*(?:$|(?:begin|loop|if|for|while|case|exception|declare|elsif|else|when|end)\b)", re.I)
#: Comments and literals, quoted ones with their own marks too; what is not closed goes to the end.
_HIDDEN = re.compile(
    r"--[^\n]*|/\*.*?(?:\*/|\Z)|(?<![\w$#])n?q'(?:\[.*?(?:\]'|\Z)|\{.*?(?:\}'|\Z)|\(.*?(?:\)'|\Z)|<.*?(?:>'|\Z)|(?P<mark>\S).*?(?:(?P=mark)'|\Z))|'(?:[^']|'')*(?:'|\Z)", re.S | re.I
)

_CHUNK = "file string, chunk int, part int, kind string, name string, enclosing string, signature string, line_start int, line_end int, content string"


def tokens(text: str) -> int:
    return max(1, len(text) // 4)


def stripped(text: str) -> str:
    """PL/SQL without comments and literals; each line stays where it was."""
    return _HIDDEN.sub(lambda m: "\n" * m.group().count("\n"), text)


def _packed(blocks: list[tuple[int, int, str]], most: int) -> Iterator[list[tuple[int, int, str]]]:
    """Neighbouring blocks (first line, last line, text) together while they hold ``most`` tokens; a larger one stands alone."""
    held, size = [], 0
    for block in blocks:
        n = tokens(block[2])
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(block)
        size += n
    if held:
        yield held


def _code(text: str, most: int) -> Iterator[tuple]:
    runs = list(_runs(text))
    if not runs:
        return
    whole = [[(1, text.count("\n") + 1, text)]] if tokens(text) <= most else _packed(runs, most)
    for i, group in enumerate(whole):
        yield i, 0, "code", None, None, None, group[0][0], group[-1][1], "\n".join(t for _, _, t in group)


def _objects(clean: list[str]) -> Iterator[tuple[int, str, str | None, str | None]]:
    """Where a segment begins, its kind, its name, and the package around it."""
    package = None
    for at, line in enumerate(clean):
        if m := OBJECT.match(line):
            kind, name = " ".join(m[1].upper().split()), m[2].upper()
            package = name if kind == "PACKAGE BODY" else None
            yield at, kind, name, None
        elif package and (m := SUBPROGRAM.match(line)):
            yield at, m[1].upper(), m[2].upper(), package
        elif at == 0:
            yield 0, "SECTION", None, None


def _signature(lines: list[str]) -> str:
    opened = next((i for i, line in enumerate(lines) if BODY.search(line)), 0)
    return " ".join(line.strip() for line in lines[: opened + 1])


def _plsql(text: str, most: int) -> Iterator[tuple]:
    lines, clean = text.split("\n"), stripped(text).split("\n")
    begins = list(_objects(clean))
    ends = [b[0] for b in begins[1:]] + [len(lines)]
    chunk = -1
    for (begin, kind, name, package), end in zip(begins, ends):
        content = "\n".join(lines[begin:end])
        if not content.strip():
            continue
        chunk += 1
        signature = None if kind == "SECTION" else _signature(lines[begin:end])
        yield chunk, 0, kind, name, package, signature, begin + 1, end, content
        if tokens(content) > most:
            cuts = [begin, *(i for i in range(begin + 1, end) if CUT.match(clean[i])), end]
            blocks = [(a + 1, z, "\n".join(lines[a:z])) for a, z in zip(cuts, cuts[1:])]
            parts = [g for g in _packed(blocks, most) if any(t.strip() for _, _, t in g)]
            for i, group in enumerate(parts, 1):
                yield chunk, i, kind, name, package, signature, group[0][0], group[-1][1], "\n".join(t for _, _, t in group)


def _cut(files: DataFrame, chunks: Callable[[str, int], Iterator[tuple]], most: int) -> DataFrame:
    columns = [c.split()[0] for c in _CHUNK.split(", ")]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(f, *r) for f, t in zip(frame["file"], frame["text"]) for r in chunks((t or "").replace("\r\n", "\n"), most)], columns=columns)

    return files.select(F.col("file").cast("string").alias("file"), "text").mapInPandas(rows, _CHUNK)


def code_chunks(files: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """file, chunk, part, kind, name, enclosing, signature, line_start, line_end, content from (file, language, text).

    Code of up to ``most`` tokens is one chunk; beyond, blocks between blank lines are put together. ``line_end`` is the last
    line that a chunk holds; blank lines between its blocks are left out of ``content``. Null and blank texts have no chunks.

    PL/SQL and SQL are cut by their objects: what CREATE begins, subprograms of a package body, and ``SECTION`` for what stands
    before. An object over ``most`` tokens is part 0, whole, and parts from 1 on, cut where a block begins or a line is blank;
    each carries the object's name, package and header. Words in comments and literals begin nothing.
    """
    plsql = F.coalesce(F.lower("language").isin(PLSQL), F.lit(False))
    return _cut(files.where(~plsql), _code, most).unionByName(_cut(files.where(plsql), _plsql, most))


def with_symbols(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """``chunks`` with ``symbols``: names from (file, name, line_start, line_end) that share a line with them, by first line."""
    s = symbols.select("file", F.col("name").alias("_name"), F.col("line_start").alias("_a"), F.col("line_end").alias("_z"))
    met = chunks.select("file", "chunk", "part", "line_start", "line_end").join(s, "file").where("_a <= line_end AND _z >= line_start")
    found = met.groupBy("file", "chunk", "part").agg(F.transform(F.sort_array(F.collect_set(F.struct("_a", "_name"))), lambda x: x["_name"]).alias("symbols"))
    return chunks.join(found, ["file", "chunk", "part"], "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>")))
