from sparkquill.operators import code

PLSQL = """-- create package none
PROMPT x

CREATE OR REPLACE PACKAGE Pkg AS
  PROCEDURE a;
END;
create or replace package  body pkg is
  v varchar2(9) := 'procedure fake
procedure fake2';
  PROCEDURE a(x number)
  IS
  BEGIN
    null; /* function no
function no2 */
  END;

  function b return number is
  begin return q'[it's
function no3]'; end;
END pkg;
CREATE TRIGGER trg BEFORE INSERT ON t
BEGIN null; END;"""


def chunks(spark, rows, most):
    frame = spark.createDataFrame(rows, "file string, language string, text string").repartition(2)
    return code.code_chunks(frame, most)


def test_stripped_keeps_lines():
    cases = {"a -- b\nc": "a \nc", "a 'x''y' b": "a  b", "a '/*' b /* ' */ c": "a  b  c", "q'[it's]' d": " d", "q'!a'b!' d": " d", "seq'x' d": "seq d", "'open\nend": "\n", "/* open\nend": "\n", "nq'{x}' 'y": " ", "": ""}
    for text, want in cases.items():
        assert code.stripped(text) == want
    assert code.stripped(PLSQL).count("\n") == PLSQL.count("\n")


def test_objects(spark):
    got = [(r.kind, r.name, r.enclosing, r.signature, r.line_start, r.line_end) for r in chunks(spark, [("p", "PLSQL", PLSQL)], 900).orderBy("chunk").collect()]
    assert got == [
        ("SECTION", None, None, None, 1, 3), ("PACKAGE", "PKG", None, "CREATE OR REPLACE PACKAGE Pkg AS", 4, 6), ("PACKAGE BODY", "PKG", None, "create or replace package  body pkg is", 7, 9),
        ("PROCEDURE", "A", "PKG", "PROCEDURE a(x number) IS", 10, 16), ("FUNCTION", "B", "PKG", "function b return number is", 17, 20), ("TRIGGER", "TRG", None, "CREATE TRIGGER trg BEFORE INSERT ON t", 21, 22),
    ]


def test_large_objects_are_cut_at_blocks(spark):
    body = "create procedure p is\nbegin\n" + "".join(f"if a{i} then\n  x := '{'y' * 30}';\nend if;\n" for i in range(6)) + "end;"
    got = chunks(spark, [("p", "sql", body)], 30).orderBy("part").collect()
    assert got[0].part == 0 and got[0].content == body and len(got) > 3
    assert "\n".join(r.content for r in got[1:]) == body and all(code.CUT.match(r.content) for r in got[2:])
    assert all(len(r.content) <= 4 * 36 and r.name == "P" and r.signature == "create procedure p is" for r in got[1:])


def test_code_blocks_and_symbols(spark):
    text = "def a():\n    1\n\n\ndef b():\n    " + "x" * 40 + "\n\nc = 1\n"
    rows = [("f", "python", text), ("g", None, "one\r\ntwo"), ("h", "go", " \n\t\n"), ("i", "go", None), ("j", "go", "z" * 200)]
    got = chunks(spark, rows, 12)
    assert sorted((r.file, r.chunk, r.line_start, r.line_end) for r in got.collect()) == [("f", 0, 1, 2), ("f", 1, 5, 6), ("f", 2, 8, 8), ("g", 0, 1, 2), ("j", 0, 1, 1)]
    assert {r.content for r in got.where("file = 'f'").collect()} == {"def a():\n    1", "def b():\n    " + "x" * 40, "c = 1"}
    named = spark.createDataFrame([("f", "a", 1, 4), ("f", "b", 5, 9)], "file string, name string, line_start int, line_end int")
    assert {(r.file, r.chunk): r.symbols for r in code.with_symbols(got, named).collect()} == {("f", 0): ["a"], ("f", 1): ["b"], ("f", 2): ["b"], ("g", 0): [], ("j", 0): []}
    assert got.where("false").count() == 0
