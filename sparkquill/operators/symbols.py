"""Source files to symbols, Markdown to units."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunking import in_pieces

#: A line that begins a symbol, by language: the first group is its kind, the second its name.
BEGINS = {
    "python": r"^\s*(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)",
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class|const|let)\s+([A-Za-z_$][\w$]*)",
    "java": r"^\s*(?:(?:public|protected|private|static|final|abstract)\s+)*(class|interface|enum|record)\s+([A-Za-z_]\w*)",
    "sql": r"(?i)^\s*create\s+(?:or\s+replace\s+)?(table|view|package(?:\s+body)?|procedure|function|trigger)\s+([\w.\"]+)",
    "config": r"^\s*([\"']?)([A-Za-z_][\w.-]*)\1\s*:",
}


def symbols(files: DataFrame) -> DataFrame:
    """file, language, name, kind, line_start, line_end from (file, language, text).

    A symbol ends where the next begins, or with the file. Lines are 1-based; files in other languages have none.
    """
    lines = files.where(F.col("language").isin(*BEGINS)).select("file", "language", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines"))
    name, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for language, pattern in BEGINS.items():
        here = F.col("language") == language
        name = F.when(here, F.regexp_extract("line", pattern, 2)).otherwise(name)
        kind = F.when(here, F.lit("key") if language == "config" else F.lower(F.regexp_extract("line", pattern, 1))).otherwise(kind)
    found = lines.withColumn("name", name).withColumn("kind", kind).where("name <> ''").withColumn("line_start", F.col("at") + 1)
    following = F.lead("line_start").over(Window.partitionBy("file").orderBy("line_start"))
    return found.select("file", "language", "name", "kind", "line_start", F.coalesce(following - 1, F.col("n_lines")).alias("line_end"))


_HEADING, _ITEM, _FENCE = re.compile(r"^(#{1,6})\s+(.*?)\s*#*$"), re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+(.*)$"), re.compile(r"^\s*(```+|~~~+)\s*(\S*)")


def markdown_units(text: str) -> list[tuple[str, list[str], int, int, str]]:
    """(kind, heading path, first line, last line, text): headings, fences, tables, one unit for each list item, paragraphs."""
    lines, units = text.split("\n"), []
    path: list[tuple[int, str]] = []
    i = 0

    def plain(j: int) -> bool:
        line = lines[j]
        return bool(line.strip()) and not (_HEADING.match(line) or _ITEM.match(line) or _FENCE.match(line) or line.lstrip().startswith("|"))

    while i < len(lines):
        line, start = lines[i], i
        names = [h for _, h in path]
        if fence := _FENCE.match(line):
            i += 1
            while i < len(lines) and not lines[i].strip().startswith(fence[1]):
                i += 1
            units.append(("code", names, start + 1, min(i, len(lines) - 1) + 1, "\n".join(lines[start + 1 : i])))
            i += 1
        elif heading := _HEADING.match(line):
            while path and path[-1][0] >= len(heading[1]):
                path.pop()
            path.append((len(heading[1]), heading[2]))
            units.append(("heading", [h for _, h in path], start + 1, start + 1, heading[2]))
            i += 1
        elif line.lstrip().startswith("|"):
            while i < len(lines) and lines[i].lstrip().startswith("|"):
                i += 1
            units.append(("table", names, start + 1, i, "\n".join(lines[start:i])))
        elif item := _ITEM.match(line):
            units.append(("list_item", names, start + 1, start + 1, item[1]))
            i += 1
        elif line.strip():
            while i < len(lines) and plain(i):
                i += 1
            units.append(("paragraph", names, start + 1, i, "\n".join(lines[start:i])))
        else:
            i += 1
    return units


def markdown(docs: DataFrame) -> DataFrame:
    """doc_id, unit, kind, heading_path, line_start, line_end, text. The heading stack runs through a document, so one row is one walk."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = ((d, n, *u) for d, t in zip(frame["doc_id"], frame["text"]) for n, u in enumerate(markdown_units(t or "")))
            yield from in_pieces(rows, ["doc_id", "unit", "kind", "heading_path", "line_start", "line_end", "text"])

    return docs.select("doc_id", "text").mapInPandas(parse, "doc_id long, unit int, kind string, heading_path array<string>, line_start int, line_end int, text string")


def table_chunks(tables: DataFrame, most_rows: int = 20) -> DataFrame:
    """table, chunk, content from (table, text): whole rows in groups, each under the header and its separator."""
    lines = F.split("text", "\n")
    rows = F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0)))
    groups = F.greatest(F.ceil(F.size(rows) / most_rows).cast("int"), F.lit(1))
    cut = tables.select("table", F.slice(lines, 1, 2).alias("head"), rows.alias("rows"), F.explode(F.sequence(F.lit(0), groups - 1)).alias("chunk"))
    content = F.array_join(F.concat("head", F.slice("rows", F.col("chunk") * most_rows + 1, F.lit(most_rows))), "\n")
    return cut.select("table", "chunk", content.alias("content"))
