"""Files to ordered units: what a file is, Word documents, texts of pages, source code; and a limit on what a parser may give.

Every unit has a place: file_path, page_start, page_end, line_start, line_end and block_index, as far as its kind of file has them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import code

#: Characters that a file's units may hold together; bytes of a package's part, and parts.
MOST_CHARS, MOST_PART, MOST_PARTS = 20_000_000, 256 << 20, 10_000
#: A recognised image under this confidence is to be reviewed.
LEAST_CONFIDENCE = 0.6
LOCATOR = "struct<file_path:string,page_start:int,page_end:int,line_start:int,line_end:int,block_index:int>"
# Kinds by extension, by MIME type, by the first bytes.
CODE_EXTENSIONS = (
    "py pyi pyw java kt kts scala go rs c h cc cpp cxx c++ hh hpp hxx cs js mjs cjs jsx ts mts cts tsx rb php swift m mm sh bash zsh fish ps1 bat cmd "
    "sql plsql pks pkb prc fnc trg vw json yaml yml toml xml html htm css scss sass less tf hcl proto graphql gql r lua ex exs erl hrl hs clj cljs dart vue svelte dockerfile"
).split()
BY_EXTENSION = {
    "txt": "plain_text", "text": "plain_text", "log": "plain_text", "md": "markdown", "markdown": "markdown", "docx": "docx", "pdf": "pdf",
    "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "bmp": "image", "tif": "image", "tiff": "image", "webp": "image",
} | dict.fromkeys(CODE_EXTENSIONS, "code")
BY_MIME = {
    "application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "text/plain": "plain_text", "text/markdown": "markdown", "text/x-markdown": "markdown",
}
CODE_MIME = ["application/json", "text/json", "text/python", "text/javascript", "application/javascript", "application/sql", "application/xml", "text/xml", "text/yaml"]
FIRST_BYTES = {"255044462D": "pdf", "89504E47": "image", "FFD8FF": "image", "47494638": "image", "49492A00": "image", "4D4D002A": "image", "504B0304": "zip"}
#: The end of a line, whichever way it is written.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _looked_up(key: Column, pairs: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def detected(name: Column, mime: Column, content: Column) -> Column:
    """source_type and error of a file: its first bytes decide; a ZIP is a Word document if name or MIME type says so.

    Without known first bytes the MIME type decides, else the extension; ``ambiguous`` if these differ, ``unsupported`` without any.
    """
    base = F.element_at(F.split(F.coalesce(name, F.lit("")), "/"), -1)
    by_name = _looked_up(F.lower(F.regexp_extract(base, r"[^.].*[.]([^.]*)$", 1)), BY_EXTENSION)
    plain = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    coded = plain.isin(CODE_MIME) | plain.rlike("^(?:text|application)/x-")
    by_mime = F.coalesce(_looked_up(plain, BY_MIME), F.when(F.startswith(plain, F.lit("image/")), "image").when(coded, "code"))
    first = F.hex(F.substring(content, 1, 8))
    magic = F.coalesce(*[F.when(F.startswith(first, F.lit(b)), F.lit(kind)) for b, kind in FIRST_BYTES.items()])
    magic = F.when(magic == "zip", F.when(F.coalesce(by_name, F.lit("")) == "docx", "docx").when(F.coalesce(by_mime, F.lit("")) == "docx", "docx")).otherwise(magic)
    unlike = magic.isNull() & (by_name != by_mime)
    kind = F.when(F.coalesce(unlike, F.lit(False)), None).otherwise(F.coalesce(magic, by_mime, by_name))
    error = F.when(F.coalesce(unlike, F.lit(False)), "ambiguous").when(kind.isNull(), "unsupported")
    return F.struct(kind.alias("source_type"), error.alias("error"))


def capped(units: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """``units`` (file, kind, text, ...) without the files that hold more than ``most`` characters, each of which leaves a row of kind error."""
    sizes = units.groupBy("file").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("_n")).where(F.col("_n") > most)
    said = F.concat(F.lit("output of "), F.col("_n").cast("string"), F.lit(f" characters, limit {most}"))
    rest = [F.lit(None).cast(t).alias(c) for c, t in units.dtypes if c not in ("file", "kind", "text")]
    errors = sizes.select("file", F.lit("error").alias("kind"), said.alias("text"), *rest).select(*units.columns)
    return units.join(sizes, "file", "left_anti").unionByName(errors)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_HEADING = re.compile(r"(?:heading|başlık)\s*(\d+)", re.I)
# What stands in a run besides its text, and beginnings of a list style's name.
_IN_RUN = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}
_LISTS = ("liste", "madde", "numara")
DOCX_UNITS = "file string, unit int, kind string, text string, markdown string, heading_path array<string>, style string, cells array<array<string>>, block_index int"


def _part(package: zipfile.ZipFile, name: str, most: int) -> bytes | None:
    """A part's bytes; refused where it declares entities, or unpacks to more than ``most``."""
    try:
        info = package.getinfo(name)
    except KeyError:
        return None
    with package.open(info) as f:
        raw = f.read(most + 1)
    if len(raw) > most:
        raise ValueError(f"{name} unpacks to more than {most} bytes")
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw:
        raise ValueError(f"{name} declares entities")
    return raw


def _runs(paragraph: ElementTree.Element) -> str:
    """The text of a paragraph's own runs and of those in its links; drawings and text boxes are left out."""
    out = []
    for child in paragraph:
        for run in [child] if child.tag == f"{_W}r" else child.findall(f"{_W}r") if child.tag == f"{_W}hyperlink" else []:
            out += [(x.text or "") if x.tag == f"{_W}t" else _IN_RUN.get(x.tag, "") for x in run]
    return "".join(out)


def _cells(table: ElementTree.Element) -> list[list[str]]:
    """Rows of cells: a cell over several columns or rows stands in each of them."""
    rows: list[list[str]] = []
    for tr in table.findall(f"{_W}tr"):
        row: list[str] = []
        for tc in tr.findall(f"{_W}tc"):
            of = lambda name: tc.find(f"{_W}tcPr/{_W}{name}")  # noqa: B023, E731
            span, merged = of("gridSpan"), of("vMerge")
            text = "\n".join(t for p in tc.findall(f"{_W}p") if (t := _runs(p)).strip())
            if merged is not None and merged.get(f"{_W}val", "continue") == "continue" and rows and len(row) < len(rows[-1]):
                text = rows[-1][len(row)]
            row += [text] * (int(span.get(f"{_W}val", "1")) if span is not None else 1)
        rows.append(row)
    return rows


def table_text(cells: list[list[str]]) -> tuple[str, str]:
    """Rows of cells as plain text and as a Markdown table whose first row is the header."""
    width = max(map(len, cells), default=0)
    line = lambda row: "| " + " | ".join(c.replace("|", "\\|").replace("\n", "<br>") for c in row + [""] * (width - len(row))) + " |"
    lines = [line(row) for row in cells]
    return "\n".join(" | ".join(row) for row in cells), "\n".join([*lines[:1], "|" + "|".join(["---"] * width) + "|", *lines[1:]]) if cells else ""


def _styles(raw: bytes | None) -> tuple[dict[str, str], str]:
    """Names of paragraph styles by id, and the name of the style that holds where none is named."""
    names, default = {}, ""
    for style in ElementTree.fromstring(raw).findall(f"{_W}style") if raw else []:
        name = style.find(f"{_W}name")
        if style.get(f"{_W}type") == "paragraph" and name is not None:
            names[style.get(f"{_W}styleId")] = name.get(f"{_W}val", "")
            if style.get(f"{_W}default") in ("1", "true"):
                default = name.get(f"{_W}val", "")
    return names, default


def _around(package: zipfile.ZipFile, sections: list[ElementTree.Element], most: int) -> Iterator[tuple[str, str]]:
    """(header or footer, text) of each section; one that a section doesn't have is that of the section before."""
    raw = _part(package, "word/_rels/document.xml.rels", most)
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(raw)} if raw else {}
    last: dict[tuple[str, str], list[str]] = {}
    found = []
    for section in sections:
        for kind in ("header", "footer"):
            for which in ("default", "first", "even"):
                for ref in section.findall(f"{_W}{kind}Reference"):
                    if ref.get(f"{_W}type", "default") == which:
                        part = _part(package, "word/" + targets.get(ref.get(f"{_R}id"), "").removeprefix("/word/"), most)
                        last[kind, which] = [t for p in ElementTree.fromstring(part).findall(f"{_W}p") if (t := _runs(p).strip())] if part else []
                found += [(kind, t) for t in last.get((kind, which), [])]
    yield from sorted(found, key=lambda x: x[0] == "footer")


def _docx(raw: bytes, most: int) -> Iterator[tuple]:
    """unit, kind, text, markdown, heading_path, style, cells of a document's body in order; then headers and footers as unit 0."""
    with zipfile.ZipFile(io.BytesIO(raw)) as package:
        if len(package.infolist()) > MOST_PARTS:
            raise ValueError(f"more than {MOST_PARTS} parts")
        body = _part(package, "word/document.xml", most)
        if body is None:
            raise ValueError("no document in the package")
        names, default = _styles(_part(package, "word/styles.xml", most))
        path: list[str] = []
        at, depth, sections = 0, 0, []
        # pulled block by block: a block's elements go as soon as it is read
        for event, element in ElementTree.iterparse(io.BytesIO(body), ("start", "end")):
            depth += 1 if event == "start" else -1
            if event == "start" or depth != 2:
                continue
            if element.tag == f"{_W}sectPr":
                sections.append(element)
            elif element.tag == f"{_W}tbl":
                at += 1
                cells = _cells(element)
                yield (at, "table", *table_text(cells), list(path), None, cells)
            elif element.tag == f"{_W}p":
                at += 1
                inner = element.find(f"{_W}pPr/{_W}sectPr")
                sections += [] if inner is None else [inner]
                named = element.find(f"{_W}pPr/{_W}pStyle")
                style = names.get(named.get(f"{_W}val"), default) if named is not None else default
                text = _runs(element).strip()
                if heading := _HEADING.fullmatch(style.strip()):
                    level = int(heading[1])
                    del path[max(level - 1, 0) :]
                    path.append(text)
                    yield at, "heading", text, f"{'#' * level} {text}".strip(), list(path), style, None
                elif text:
                    low = style.lower()
                    listed = element.find(f"{_W}pPr/{_W}numPr") is not None or "list" in low or low.startswith(_LISTS)
                    yield at, "list_item" if listed else "paragraph", text, f"- {text}" if listed else text, list(path), style, None
            if element.tag != f"{_W}sectPr" and element.find(f"{_W}pPr/{_W}sectPr") is None:
                element.clear()
        for kind, text in _around(package, sections, most):
            yield 0, kind, text, text, [], None, None


def docx_units(files: DataFrame, most_part: int = MOST_PART) -> DataFrame:
    """``DOCX_UNITS`` of Word documents (file, content); a file that can't be read is one row of kind error that says why.

    A table's cells that reach over columns or rows stand in each of them. Text boxes are left out. Headers and footers are rows of unit 0.
    """
    names = [c.split()[0] for c in DOCX_UNITS.split(", ")]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, content in zip(frame["file"], frame["content"]):
                try:
                    rows += [(file, *unit, unit[0] or None) for unit in list(_docx(content or b"", most_part))]
                except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, NotImplementedError, EOFError, OSError) as e:
                    rows.append((file, None, "error", f"{type(e).__name__}: {e}", None, [], None, None, None))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"unit": "Int32", "block_index": "Int32"})

    return files.select("file", "content").mapInPandas(parse, DOCX_UNITS)


def located(units: DataFrame) -> DataFrame:
    """``units`` with a locator of the columns they have."""
    fields = [f.split(":") for f in LOCATOR.removeprefix("struct<").removesuffix(">").split(",")]
    held = {"file_path": "file"} | {c: c for c in units.columns}
    return units.withColumn("locator", F.struct(*[(F.col(held[n]) if n in held else F.lit(None)).cast(t).alias(n) for n, t in fields]))


def page_units(pages: DataFrame) -> DataFrame:
    """file, unit, kind, text, page from pages (file, page, text): lines in a row without a blank one are a paragraph, joined by blanks.

    Units are numbered through a file by the numbers of paragraphs on the pages before, so no file's paragraphs meet in one task.
    """
    trimmed = F.transform(F.split(F.coalesce("text", F.lit("")), LINE_END), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    whole = F.regexp_replace(F.array_join(trimmed, "\n"), "^\n+|\n+$", "")
    rows = pages.select("file", "page", F.when(whole != "", F.split(whole, "\n{2,}")).otherwise(F.array().cast("array<string>")).alias("ps"))
    before = Window.partitionBy("file").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.select("file", "page", F.size("ps").alias("n"))
    starts = counted.select("file", "page", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("start"))
    found = rows.select("file", "page", F.posexplode("ps").alias("at", "p")).join(starts, ["file", "page"])
    return found.select("file", (F.col("start") + F.col("at") + 1).alias("unit"), F.lit("paragraph").alias("kind"), F.replace("p", F.lit("\n"), F.lit(" ")).alias("text"), "page")


# What begins a symbol at a line's start, by language: its type (by the first group, where that is asked for) and its name.
_TYPES = {"class": "class", "def": "function"}
DECLARATIONS = {
    "python": [(r"^(?:async\s+)?(def|class)\s+([A-Za-z_][A-Za-z0-9_]*)", None, 2)],
    "javascript": [
        (r"^(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)", "class", 1),
        (r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)", "function", 1),
    ],
    "java": [
        (r"^\s*(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp)\s+)*(?:class|interface|enum|record|@interface)\s+([A-Za-z_][A-Za-z0-9_]*)", "class", 1),
        (r"^\s*(?:public|private|protected)\s+(?:static\s+|final\s+|abstract\s+|synchronized\s+)*[A-Za-z_][\w<>\[\],.\s]*?\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", "method", 1),
    ],
    "config": [
        (r'^"([^"]+)"\s*:', "config_key", 1),
        (r"^(?!---)([A-Za-z_][A-Za-z0-9_.-]*):", "config_key", 1),
        (r"^<([A-Za-z_][A-Za-z0-9_.-]*)", "config_element", 1),
    ],
    "plsql": [(r"(?i)^CREATE\s+(?:OR\s+REPLACE\s+)?(PACKAGE\s+BODY|PACKAGE|PROCEDURE|FUNCTION|TRIGGER|TYPE\s+BODY|TYPE)\s+([A-Za-z_][A-Za-z0-9_$#]*)", None, 2)],
}
SPOKEN = {"typescript": "javascript", "sql": "plsql", "json": "config", "yaml": "config", "toml": "config", "xml": "config"}


def lines_of(text: Column) -> Column:
    """The lines of a text; an end of line at its end begins no further one."""
    every = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(every, -1) == "", F.slice(every, F.lit(1), F.size(every) - 1)).otherwise(every)


def _declared(lines: Column, patterns: list[tuple[str, str | None, int]], upper: bool) -> Column:
    """(at, name, type) of lines that begin a symbol; the first pattern that fits decides."""

    def found(line: Column, at: Column) -> Column:
        name, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
        for pattern, fixed, group in reversed(patterns):
            word = F.regexp_replace(F.regexp_extract(line, pattern, 1), r"\s+", " ")
            given = F.lit(fixed) if fixed else F.upper(word) if upper else F.coalesce(*[F.when(word == k, F.lit(v)) for k, v in _TYPES.items()])
            named = F.regexp_extract(line, pattern, group)
            hit = line.rlike(pattern)
            name, kind = F.when(hit, F.upper(named) if upper else named).otherwise(name), F.when(hit, given).otherwise(kind)
        return F.struct(at.alias("at"), name.alias("name"), kind.alias("type"))

    return F.filter(F.transform(lines, found), lambda s: s["name"].isNotNull())


def code_units(files: DataFrame) -> DataFrame:
    """file, unit, kind, text, heading_path, line_start, line_end, symbol_name, symbol_type, signature from (file, language, text).

    A header unit, the whole file, then each symbol up to the next one; PL/SQL is searched without its comments and
    strings. All is done within a file's row; files in other languages have the first two units alone.
    """
    spoken = F.coalesce(_looked_up(F.col("language"), SPOKEN), F.col("language"))
    rows = files.select("file", spoken.alias("language"), "text")
    plain = rows.where(~F.col("language").eqNullSafe("plsql"))
    cleaned = F.pandas_udf(lambda s: s.map(lambda t: code.stripped(t or "")), "string")
    plsql = rows.where("language = 'plsql'")
    out = None
    for part, searched in ((plain, F.col("text")), (plsql, cleaned("text"))):
        part = part.select("file", "language", lines_of(F.col("text")).alias("lines"), lines_of(searched).alias("searched"))
        none = F.array().cast("array<struct<at:int,name:string,type:string>>")
        symbols = none
        for language, patterns in DECLARATIONS.items():
            symbols = F.when(F.col("language") == language, _declared(F.col("searched"), patterns, language == "plsql")).otherwise(symbols)
        part = part.select("file", "lines", symbols.alias("s"))
        unit = lambda kind, text, path, a, z, name, type_, signature: F.struct(
            F.lit(kind).alias("kind"), text.alias("text"), path.alias("heading_path"), a.cast("int").alias("line_start"), z.cast("int").alias("line_end"), name.alias("symbol_name"), type_.alias("symbol_type"), signature.alias("signature")
        )
        null, n, file = F.lit(None).cast("string"), F.size("lines"), F.col("file").cast("string")
        first = F.array(
            unit("file_header", file, F.array(file), F.lit(1), F.lit(1), null, null, null),
            unit("code", F.array_join("lines", "\n"), F.array(file), F.lit(1), n, null, null, null),
        )
        end = lambda i: F.greatest(F.coalesce(F.get("s", i + 1)["at"] - 1, n - 1), F.get("s", i)["at"])  # noqa: B023, E731
        each = F.transform("s", lambda s, i: unit("symbol", F.array_join(F.slice("lines", s["at"] + 1, end(i) - s["at"] + 1), "\n"), F.array(file, s["name"]), s["at"] + 1, end(i) + 1, s["name"], s["type"], F.trim(F.get("lines", s["at"]))))  # noqa: B023
        one = part.select("file", F.posexplode(F.concat(first, each)).alias("at", "u")).select("file", (F.col("at") + 1).alias("unit"), "u.*")
        out = one if out is None else out.unionByName(one)
    return out


_ITEM, _CELL = re.compile(r"([-*+]|\d+[.)])\s+"), re.compile(r":?-+:?")
MARKDOWN_UNITS = "file string, unit int, kind string, text string, markdown string, heading_path array<string>, depth int, parent int, language string, line_start int, line_end int"


def _separator(line: str) -> bool:
    """Whether a line parts a table's header from its rows."""
    cells = [c.strip() for c in line.strip().strip("|").split("|")]
    return any(cells) and all(_CELL.fullmatch(c) for c in cells if c)


def _kind(lines: list[str], i: int) -> str:
    """What a line begins; blank where it has nothing to read."""
    line = lines[i].strip()
    hashes = len(line) - len(line.lstrip("#"))
    if not line:
        return "blank"
    if 1 <= hashes <= 6 and line[hashes:].strip():
        return "heading"
    if line.startswith(("```", "~~~")):
        return "code"
    if line.startswith("|") and i + 1 < len(lines) and _separator(lines[i + 1]):
        return "table"
    return "list_item" if _ITEM.match(line) else "paragraph"


def markdown_blocks(text: str) -> Iterator[tuple]:
    """kind, text, markdown, heading_path, depth, parent, language, line_start, line_end of a text's units in order.

    A heading has 1 to 6 hashes and a text, with a blank between or without; a fence goes on to a line that is its mark alone, or to
    the end; a table has a separator as its second line and goes on to a blank line, a heading or a fence; each list
    item is a unit; other lines go on to a blank line or to what begins another unit but a table. ``parent``: the last heading's number.
    """
    lines = [x for x in re.split(LINE_END, text)]
    lines = lines[:-1] if lines[-1] == "" else lines
    path: list[str] = []
    parent, n, i = None, 0, 0
    while i < len(lines):
        kind, line, end, language, depth = _kind(lines, i), lines[i].strip(), i + 1, None, len(path)
        if kind == "blank":
            i += 1
            continue
        content = written = line
        if kind == "heading":
            depth = len(line) - len(line.lstrip("#"))
            content = line[depth:].strip()
            del path[depth - 1 :]
            path.append(content)
        elif kind == "code":
            language = line[3:].strip() or None
            while end < len(lines) and lines[end].strip() != line[:3]:
                end += 1
            content = "\n".join(lines[i + 1 : end])
            end += 1
            written = "\n".join(lines[i:end])
        elif kind == "table":
            while end < len(lines) and _kind(lines, end) not in ("blank", "heading", "code"):
                end += 1
            content, written = "\n".join(x.strip() for x in lines[i:end]), "\n".join(lines[i:end])
        elif kind == "list_item":
            written = lines[i].rstrip()
        else:
            while end < len(lines) and _kind(lines, end) in ("paragraph", "table"):
                end += 1
            content = written = "\n".join(lines[i:end]).strip()
        n += 1
        yield kind, content, written, list(path), depth, None if kind == "heading" else parent, language, i + 1, end
        parent = n if kind == "heading" else parent
        i = end


def markdown_units(files: DataFrame) -> DataFrame:
    """``MARKDOWN_UNITS`` of (file, text): the heading stack and the fences run through a file, so one row is one walk."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MARKDOWN_UNITS.split(", ")]
        for frame in frames:
            rows = [(f, n, *u) for f, t in zip(frame["file"], frame["text"]) for n, u in enumerate(markdown_blocks(t or ""), 1)]
            yield pd.DataFrame(rows, columns=names).astype({"parent": "Int32"})

    return files.select("file", "text").mapInPandas(parse, MARKDOWN_UNITS)


def image_units(images: DataFrame) -> DataFrame:
    """file, unit, kind, text, page, confidence, block_index, bbox, needs_review, reason of recognised images.

    images (file, error, full_text, confidence, blocks of text, page, confidence and bbox as left, top, width, height): a header,
    then the whole text with the box around all blocks, then each block that has a text or a box. An image without a result is a
    unit of kind image with the reason; one without a confidence or under LEAST_CONFIDENCE is to be reviewed.
    """
    boxes = F.filter(F.transform("blocks", lambda b: b["bbox"]), lambda b: b.isNotNull())
    of = lambda at: F.transform(boxes, lambda b: F.get(b, F.lit(at)))
    left, top = F.array_min(of(0)), F.array_min(of(1))
    right, bottom = (F.array_max(F.transform(boxes, lambda b: F.get(b, F.lit(at)) + F.get(b, F.lit(at + 2)))) for at in (0, 1))
    around = F.when(F.size(boxes) > 0, F.array(left, top, right - left, bottom - top))
    failed = F.col("full_text").isNull()
    low = ~failed & (F.col("confidence").isNull() | (F.col("confidence") < LEAST_CONFIDENCE))
    why = F.when(failed, F.concat(F.lit("OCR unavailable: "), F.coalesce("error", F.lit("")))).when(low, F.when(F.col("confidence").isNull(), "missing OCR confidence").otherwise("low OCR confidence"))
    null = F.lit(None)
    unit = lambda kind, text, page, confidence, index, bbox: F.struct(
        F.lit(kind).alias("kind"), text.cast("string").alias("text"), page.cast("int").alias("page"), confidence.cast("double").alias("confidence"), index.cast("int").alias("block_index"), bbox.cast("array<double>").alias("bbox")
    )
    seen = F.filter(F.transform("blocks", lambda b, i: F.struct(b.alias("b"), (i + 1).alias("i"))), lambda x: (F.trim(F.coalesce(x["b"]["text"], F.lit(""))) != "") | x["b"]["bbox"].isNotNull())
    parts = F.transform(seen, lambda x: unit("ocr_text", x["b"]["text"], F.coalesce(x["b"]["page"], F.lit(0)), x["b"]["confidence"], x["i"], x["b"]["bbox"]))
    header = F.array(unit("file_header", F.col("file"), null, null, null, null))
    read = F.concat(F.array(unit("ocr_text", F.col("full_text"), F.lit(0), F.col("confidence"), null, around)), F.coalesce(parts, F.slice(header, 1, 0)))
    units = F.concat(header, F.when(failed, F.array(unit("image", F.col("file"), null, null, null, null))).otherwise(read))
    rows = images.select("file", why.isNotNull().alias("needs_review"), why.alias("reason"), F.posexplode(units).alias("at", "u"))
    return rows.select("file", (F.col("at") + 1).alias("unit"), "u.*", "needs_review", "reason")


def _plain(name: str | None, raw: bytes | None, most: int) -> tuple[str | None, str | None]:
    """The text of a file by its extension alone, or why there is none."""
    extension = (name or "").rpartition("/")[2].rpartition(".")
    kind = extension[2].lower() if extension[0] else ""
    try:
        if kind in ("txt", "md"):
            return (raw or b"").decode("utf-8"), None
        if kind == "docx":
            with zipfile.ZipFile(io.BytesIO(raw or b"")) as package:
                body = ElementTree.fromstring(_part(package, "word/document.xml", most) or b"").find(f"{_W}body")
            return "\n".join(map(_runs, body.findall(f"{_W}p"))), None
    except (UnicodeDecodeError, zipfile.BadZipFile, ElementTree.ParseError, ValueError, AttributeError, NotImplementedError, EOFError, OSError) as e:
        return None, f"{type(e).__name__}: {e}"
    return None, "page texts are needed" if kind == "pdf" else f"unsupported: {kind}"


def legacy_text(files: DataFrame, most_part: int = MOST_PART) -> DataFrame:
    """file, text, error of (file, content): .txt and .md as UTF-8, the paragraphs of .docx a line each; other extensions have an error."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(f, *_plain(f, c, most_part)) for f, c in zip(frame["file"], frame["content"])], columns=["file", "text", "error"])

    return files.select("file", "content").mapInPandas(read, "file string, text string, error string")
