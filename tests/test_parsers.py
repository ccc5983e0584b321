"""Parsers against hand-made files."""

import io
import zipfile

import pytest
from oracle import same
from pyspark.sql import functions as F

from sparkquill.plans.catalog import ORACLES, QUERIES
from sparkquill.sources import parsers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
STYLES = f"""<w:styles {W}><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>
<w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:type="paragraph" w:styleId="H2"><w:name w:val="Başlık 2"/></w:style>
<w:style w:type="paragraph" w:styleId="LB"><w:name w:val="List Bullet"/></w:style><w:style w:type="character" w:styleId="C"><w:name w:val="heading 9"/></w:style></w:styles>"""


def p(text, style=None, more=""):
    named = f'<w:pStyle w:val="{style}"/>' if style else ""
    return f"<w:p><w:pPr>{named}{more}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def tc(text, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{''.join(p(t) for t in text.split('/'))}</w:tc>"


BODY = "".join([
    p("Top", "H1"), p(" first "), p(""), p("Sub", "H2"), p("item", "LB"), p("numbered", None, "<w:numPr/>"),
    f"<w:tbl><w:tr>{tc('a|b')}{tc('c/d')}</w:tr><w:tr>{tc('wide', '<w:gridSpan w:val=&quot;2&quot;/>'.replace('&quot;', chr(34)))}</w:tr></w:tbl>",
    p("Next", "H1"), '<w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t><w:br/><w:t>three</w:t></w:r><w:hyperlink><w:r><w:t> link</w:t></w:r></w:hyperlink><w:r><w:pict><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></w:pict></w:r></w:p>',
    p("styled by a character style", "C"),
    f"<w:tbl><w:tr>{tc('x', '<w:vMerge w:val=%srestart%s/>' % (chr(34), chr(34)))}{tc('1')}</w:tr><w:tr>{tc('', '<w:vMerge/>')}{tc('2')}</w:tr></w:tbl>",
    '<w:sectPr><w:headerReference w:type="default" r:id="rId1"/><w:footerReference w:type="default" r:id="rId2"/></w:sectPr>',
])


def docx(body=BODY, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", STYLES)
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="rId1" Target="header1.xml"/><Relationship Id="rId2" Target="footer1.xml"/></Relationships>')
        z.writestr("word/header1.xml", f"<w:hdr {W}>{p('Page head')}{p('  ')}</w:hdr>")
        z.writestr("word/footer1.xml", f"<w:ftr {W}>{p(' Page foot ')}</w:ftr>")
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def units(spark, *files, **limits):
    rows = parsers.docx_units(spark.createDataFrame(list(files), "file string, content binary"), **limits).collect()
    return [tuple(r) for r in sorted(rows, key=lambda r: (r.file, r.unit is None, r.unit == 0, r.unit or 0))]


def test_docx(spark):
    got = [(u, k, t, m, h, s) for _, u, k, t, m, h, s, _, _ in units(spark, ("f", docx()))]
    assert got == [
        (1, "heading", "Top", "# Top", ["Top"], "heading 1"), (2, "paragraph", "first", "first", ["Top"], "Normal"), (4, "heading", "Sub", "## Sub", ["Top", "Sub"], "Başlık 2"),
        (5, "list_item", "item", "- item", ["Top", "Sub"], "List Bullet"), (6, "list_item", "numbered", "- numbered", ["Top", "Sub"], "Normal"),
        (7, "table", "a|b | c\nd\nwide | wide", "| a\\|b | c<br>d |\n|---|---|\n| wide | wide |", ["Top", "Sub"], None),
        (8, "heading", "Next", "# Next", ["Next"], "heading 1"), (9, "paragraph", "one\ttwo\nthree link", "one\ttwo\nthree link", ["Next"], "Normal"),
        (10, "paragraph", "styled by a character style", "styled by a character style", ["Next"], "Normal"), (11, "table", "x | 1\nx | 2", "| x | 1 |\n|---|---|\n| x | 2 |", ["Next"], None),
        (0, "header", "Page head", "Page head", [], None), (0, "footer", "Page foot", "Page foot", [], None),
    ]


def test_broken_documents_are_rows(spark):
    empty = io.BytesIO()
    with zipfile.ZipFile(empty, "w") as z:
        z.writestr("other.xml", "")
    entity = "<!DOCTYPE x [<!ENTITY a 'b'>]><w:document/>"
    with zipfile.ZipFile(bad := io.BytesIO(), "w") as z:
        z.writestr("word/document.xml", entity)
    files = [("a", b"no zip"), ("b", None), ("c", empty.getvalue()), ("d", docx("<w:p>")), ("e", bad.getvalue()), ("f", docx("<w:p/>" * 300_000)), ("g", docx(p("fine")))]
    got = {r[0]: r[2:4] for r in units(spark, *files, most_part=1 << 20) if r[2] not in ("header", "footer")}
    assert {k for k, (kind, _) in got.items() if kind == "error"} == set("abcdef") and got["g"] == ("paragraph", "fine")
    assert "entities" in got["e"][1] and "more than" in got["f"][1] and "no document" in got["c"][1]


def test_output_limit(spark):
    rows = spark.createDataFrame([("a", 1, "p", "x" * 10), ("a", 2, "p", "y" * 10), ("b", 1, "p", "z" * 19), ("c", 1, "p", None)], "file string, unit int, kind string, text string")
    got = sorted((r.file, r.kind) for r in parsers.capped(rows, 19).collect())
    assert got == [("a", "error"), ("b", "p"), ("c", "p")]


@pytest.mark.parametrize("name,mime,content,want", [
    ("a.pdf", None, b"x", ("pdf", None)), ("a.txt", "text/plain", b"%PDF-1", ("pdf", None)), ("a.docx", None, b"PK\x03\x04..", ("docx", None)), ("a.zip", None, b"PK\x03\x04..", (None, "unsupported")),
    ("a.bin", "application/vnd.openxmlformats-officedocument.wordprocessingml.document; x", b"PK\x03\x04", ("docx", None)), ("a.md", "text/plain", b"", (None, "ambiguous")), (".md", None, None, (None, "unsupported")),
    ("d/a.PY", "text/x-python", b"", ("code", None)), (None, "image/x", None, ("image", None)), ("a.png", None, b"\xff\xd8\xff", ("image", None)), ("a.unknown", "text/plain", b"", ("plain_text", None)),
])
def test_detection(spark, name, mime, content, want):
    row = spark.createDataFrame([(name, mime, content)], "n string, m string, c binary").select(parsers.detected(F.col("n"), F.col("m"), F.col("c")).alias("d")).first().d
    assert tuple(row) == want


def test_page_units(spark):
    pages = spark.createDataFrame([("f", 0, " one\ntwo  \r\n\r\n\r\nthree\n"), ("f", 1, None), ("f", 2, "\n\nfour\u2028five\n \n six"), ("g", 7, "x")], "file string, page int, text string")
    got = sorted((r.file, r.unit, r.text, r.page) for r in parsers.page_units(pages).collect())
    assert got == [("f", 1, "one two", 0), ("f", 2, "three", 0), ("f", 3, "four five", 2), ("f", 4, "six", 2), ("g", 1, "x", 7)]


def test_code_units(spark):
    files = [
        ("a.py", "python", "import x\nclass A:\n    def inner(self): pass\nasync def b():\n    pass\n"),
        ("a.ts", "typescript", "export default class K {}\nconst x = 1\nexport async function go() {\n}"),
        ("A.java", "java", "public final class A {\n  private static List<String> names(int x) {\n  }\n  int local() {}\n  @interface Q {}\n}"),
        ("a.sql", "sql", "-- create table no\n/* CREATE TYPE c */ x\ncreate or replace package  body Pkg is\nbegin null; end;\nCREATE TYPE BODY t$1 as\n"),
        ("a.json", "json", '{\n"a": 1,\n  "b": 2\n}'),
        ("a.yaml", "yaml", "---\nkey: 1\n- x: 2\n# c: d\nother.key:\n  in: 3"),
        ("a.xml", "xml", "<root>\n <in/>\n</root>\n<tail x='1'/>"),
        ("a.go", "go", "func x() {}"),
        ("n", None, None),
    ]
    rows = parsers.code_units(spark.createDataFrame(files, "file string, language string, text string")).orderBy("file", "unit").collect()
    symbols = [(r.file, r.symbol_name, r.symbol_type, r.line_start, r.line_end) for r in rows if r.kind == "symbol"]
    assert symbols == sorted([
        ("a.py", "A", "class", 2, 3), ("a.py", "b", "function", 4, 5), ("a.ts", "K", "class", 1, 2), ("a.ts", "go", "function", 3, 4),
        ("A.java", "A", "class", 1, 1), ("A.java", "names", "method", 2, 4), ("A.java", "Q", "class", 5, 6),
        ("a.sql", "PKG", "PACKAGE BODY", 3, 4), ("a.sql", "T$1", "TYPE BODY", 5, 5), ("a.json", "a", "config_key", 2, 4),
        ("a.yaml", "key", "config_key", 2, 4), ("a.yaml", "other.key", "config_key", 5, 6), ("a.xml", "root", "config_element", 1, 3), ("a.xml", "tail", "config_element", 4, 4),
    ], key=lambda r: (r[0], r[3]))
    first = {r.file: (r.text, r.line_end) for r in rows if r.kind == "code"}
    assert first["a.go"] == ("func x() {}", 1) and first["n"] == ("", 0) and sum(r.kind == "file_header" for r in rows) == len(files)
    assert [r.text for r in rows if r.symbol_name == "b"] == ["async def b():\n    pass"] and [r.signature for r in rows if r.symbol_name == "names"] == ["private static List<String> names(int x) {"]


@pytest.mark.parametrize("name", ["page_texts", "source_types", "code_symbols", "locator_merge"])
def test_on_more_rows(spark, name):
    same(QUERIES[name](spark, "/root/testdata/sf0.01"), ORACLES[name], "/root/testdata/sf0.01")


def test_text_by_extension(spark):
    files = [("a/b.TXT", "é".encode()), ("c.md", b"\xff"), ("d.docx", docx(p("one") + p("") + "<w:tbl/>" + p(" two "))), ("e.docx", b"x"), ("f.pdf", b"%PDF"), ("g.rtf", b""), ("txt", b"z"), (None, None)]
    got = {r.file: (r.text, r.error) for r in parsers.legacy_text(spark.createDataFrame(files, "file string, content binary")).collect()}
    assert got["a/b.TXT"] == ("é", None) and got["d.docx"] == ("one\n\n two ", None) and got["f.pdf"] == (None, "page texts are needed")
    assert got["c.md"][1].startswith("UnicodeDecodeError") and got["e.docx"][1].startswith("BadZipFile") and got["g.rtf"][1] == "unsupported: rtf" and got["txt"][1] == got[None][1] == "unsupported: "
