"""Delimited files, JSON lines, SQLite and the quality tools."""

import sqlite3

import pytest

from tabulon import catalog_io
from tabulon.api import Engine
from tabulon.errors import IOHandlingError
from tabulon.plans.table import from_rows
from tabulon.quality import tools
from tabulon.sources.delimited import detect_file, read_delimited, set_header, sink_warnings, write_delimited
from tabulon.sources.dialect import Dialect, detect_by_content, detect_by_frequency, detect_by_width, named_format, split_line
from tabulon.sources.memory import read_json_lines, read_sqlite, write_json_lines


def put(tmp_path, text, name="t.csv", encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(text.encode(encoding))
    return str(p)


def rows(t):
    return [list(r) for r in t.result(ordered=True).collect()]


QUOTED = ['a,b,c', '"x ""q"" y",2,', ' "p,q" ,r,s', 'bad"q,1,2', '"a""",z,"",', '', ',', '"open,1', '"a"b,c']


def test_native_splitter_equals_its_twin(spark, tmp_path):
    d = Dialect(",", "quoted")
    t = read_delimited(spark, put(tmp_path, "".join(x + "\n" for x in QUOTED)), d)
    want = [split_line(x, d) for x in QUOTED]
    got = [[v for v in r if v is not None] for r in rows(t)]
    assert got == [f for f, _ in want]
    bad = next(i for i, (_, b) in enumerate(want, 1) if b)
    assert any(f"line {bad}" in w for w in t.warnings)


def test_several_files_keep_their_order(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for i in range(3):
        (tmp_path / "d" / f"p{i}.csv").write_text("".join(f"{i},{k}\n" for k in range(5 - i)))
    assert rows(read_delimited(spark, str(tmp_path / "d"), Dialect(","))) == [[str(i), str(k)] for i in range(3) for k in range(5 - i)]


def test_policies(spark, tmp_path):
    assert rows(read_delimited(spark, put(tmp_path, "a~#~b~#~\nc~#~d~#~e\n"), Dialect("~#~", "simple"))) == [["a", "b", ""], ["c", "d", "e"]]
    assert rows(read_delimited(spark, put(tmp_path, "  a   b\nc d  \n"), Dialect(" ", "whitespace"))) == [["a", "b"], ["c", "d"]]
    assert rows(read_delimited(spark, put(tmp_path, "a,b\n"), Dialect("", "monocolumn"))) == [["a,b"]]
    assert rows(read_delimited(spark, put(tmp_path, " a , b \n"), Dialect(",", "simple", strip_fields=True))) == [["a", "b"]]


def test_line_ends_bom_latin1_comments(spark, tmp_path):
    assert rows(read_delimited(spark, put(tmp_path, "﻿a,b\r\nc,d\r\n"), Dialect(","))) == [["a", "b"], ["c", "d"]]
    assert rows(read_delimited(spark, put(tmp_path, "é,b\nc,d\n", encoding="latin-1"), Dialect(",", encoding="latin-1"))) == [["é", "b"], ["c", "d"]]
    with pytest.raises(Exception, match="UTF-8"):
        rows(read_delimited(spark, put(tmp_path, "é,b\n", encoding="latin-1"), Dialect(",")))
    assert rows(read_delimited(spark, put(tmp_path, "#x\na,b\n#y\nc,d\n"), Dialect(",", comment_prefix="#"))) == [["a", "b"], ["c", "d"]]


def test_rfc_multiline(spark, tmp_path):
    text = 'h1,h2\n"a\n#no comment\n""b""",1\n# comment\n"c",2\nd,"e\n"\n'
    t = read_delimited(spark, put(tmp_path, text), Dialect(",", "quoted_rfc", header=True, comment_prefix="#"))
    assert t.header == ["h1", "h2"] and rows(t) == [['a\n#no comment\n"b"', "1"], ["c", "2"], ["d", "e\n"]]
    with pytest.raises(IOHandlingError):
        read_delimited(spark, put(tmp_path, 'a"b,c\n'), Dialect(",", "quoted_rfc"))


def test_header_switch_and_ragged(spark, tmp_path):
    t = read_delimited(spark, put(tmp_path, "n,m\n1,2\n3\n"), Dialect(",", "quoted", header=True))
    assert t.warnings and rows(t) == [["1", "2"], ["3", None]]
    assert rows(set_header(t, False))[0] == ["n", "m"]
    got = Engine(spark).query("select a1, NR, NF with (noheader)", t).rows()
    assert got == [["n", 1, 2], ["1", 2, 2], ["3", 3, 1]]


@pytest.mark.parametrize("d", [Dialect(",", "quoted_rfc", header=True), Dialect("|", "quoted_rfc", header=True)])
def test_round_trip(spark, tmp_path, d):
    data = [['a"b', "x,y", "1"], ["", "line\nfeed", " "], ["|", '""', "é"]]
    t = from_rows(spark, data, ["p", "q", "r"])
    write_delimited(t, str(tmp_path / "out"), d, single_file=True)
    back = read_delimited(spark, str(tmp_path / "out"), d)
    assert back.header == ["p", "q", "r"] and rows(back) == data


def test_sink_values_and_warnings(spark, tmp_path):
    t = from_rows(spark, [["a,b", None, 1.0, True], ["c", ["x", "y"], 2.5e20, False]])
    d = Dialect(",", "simple")
    write_delimited(t, str(tmp_path / "o"), d, single_file=True)
    assert [r[0] for r in spark.read.text(str(tmp_path / "o")).collect()][1].startswith("c,") and len(sink_warnings(t, d)) == 2
    with pytest.raises(IOHandlingError):
        write_delimited(t, str(tmp_path / "m"), named_format("monocolumn"))


def test_json_lines(spark, tmp_path):
    path = put(tmp_path, '{"a": {"k": [1, 2]}, "s": "x"}\n\n{"s": "y"}\n', "t.json")
    got = Engine(spark).query("select str(a['s']) as s, int(a['a']['k'][1]) as k where a.s == 'x'", read_json_lines(spark, path)).rows()
    assert got == [["x", 2]]
    with pytest.raises(Exception, match="JSON"):
        rows(read_json_lines(spark, put(tmp_path, "{bad\n", "b.json")))
    write_json_lines(from_rows(spark, [[1, "é"]]), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '[1, "é"]'


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as c:
        c.execute("create table t (x integer, y text, z real)")
        c.executemany("insert into t values (?, ?, ?)", [(i, f"s{i}", i / 2) for i in range(50)])
    assert Engine(spark).query("select a.x, a.y, a.z where a.x > 47", read_sqlite(spark, path, "t")).rows() == [[48, "s48", 24.0], [49, "s49", 24.5]]
    with pytest.raises(IOHandlingError):
        read_sqlite(spark, path, "t; drop")
    with pytest.raises(IOHandlingError):
        read_sqlite(spark, path, "missing")


def test_pandas_source_counts_every_supplier(spark, tmp_path):
    spark.range(2500).selectExpr("id as s_suppkey", "cast(id % 25 as int) as s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    got = catalog_io.pandas_source(spark, str(tmp_path))
    assert dict(got.dtypes)["n"] == "bigint" and sorted(map(tuple, got.collect())) == [(k, 100) for k in range(25)]


def test_detection():
    lines = [f"{i};a,b;{i}" for i in range(12)]
    assert detect_by_content(lines).delim == ";"
    assert detect_by_content(["no", "table"]) is None
    assert detect_by_frequency("a\tb\tc\n1\t2,3\t4").delim == "\t"
    assert detect_by_width(["a,b", "c,d"]).policy == "quoted"
    with pytest.raises(IOHandlingError):
        Dialect('"', "quoted")


def test_detection_sees_the_whole_file(spark, tmp_path):
    sound = [f"{i},b;{i}" for i in range(80)]
    texts = [
        sound, sound[:70] + ["1,2,3;4"] + sound[70:], sound[:70] + ['x,"y"z;4'] + sound[70:], ["#x;y,z", *sound, "#,,,"], sound[:5], [],
        ["no table"] * 60, [f'{i},"p{i}' if i % 2 else f'q,";{i}"' for i in range(60)], ["a,b", *['"x,\ny",z'] * 60], ["a,b"] * 60 + ['c,"open'],
    ]
    for k, text in enumerate(texts):
        found = detect_file(spark, put(tmp_path, "".join(x + "\n" for x in text), f"{k}.csv"))
        assert found == detect_by_content([x for t in text for x in t.split("\n")]), k
    last_ragged = put(tmp_path, "\n".join([f"{i},b,c" for i in range(60)] + ["1,2"] + [""]), "r.csv")
    assert detect_file(spark, last_ragged) is None
    multi = put(tmp_path, "a,b\n" + '"x\ny",z\n' * 60, "m.csv")  # the 50th line is inside a record
    assert detect_file(spark, multi).policy == "quoted_rfc"


def test_detect_dialect_query_sees_the_whole_table(spark, tmp_path, monkeypatch):
    def write(t, path, d, **_):  # the last record has one comma less
        spark.createDataFrame([(f"{i},x,y;b" if i < 60 else f"{i},x;b",) for i in range(61)], "line string").coalesce(1).write.text(path)

    spark.range(1).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(catalog_io, "write_delimited", write)
    assert [tuple(r) for r in catalog_io.detect_dialect(spark, str(tmp_path)).collect()] == [(";", "quoted")]


def test_lint(spark, tmp_path):
    r = tools.lint_file(spark, put(tmp_path, 'a,b\n1,2\n3\n"x"y, z\n'), Dialect(","))
    assert not r.ok and r.widths == [(2, 1), (1, 3)] and r.first_bad_line == 4 and r.first_spaced_line == 4
    assert tools.lint_file(spark, put(tmp_path, "a,b\n1,2\n"), Dialect(",")).ok


def test_align_shrink_markdown(spark):
    t = from_rows(spark, [["a", "1.5"], ["bbb", "10"], ["日本", ""]], ["name", "number"])
    stats = {r["name"]: r for r in tools.column_stats(t).collect()}
    assert stats["number"]["is_numeric"] and (stats["number"]["max_int"], stats["number"]["max_frac"]) == (2, 2) and not stats["name"]["is_numeric"]
    lines = [r["line"] for r in tools.align(t, Dialect(",")).collect()]
    assert lines[0] == "name, number" and lines[1].startswith("a   , ") and lines[2].index("10") == lines[1].index("1.5") - 1
    assert max(r["max_width"] for r in tools.column_stats(t, wide=True).where("name = 'name'").collect()) == 4
    assert rows(tools.shrink(from_rows(spark, [[" a ", "x \n y"]]))) == [["a", "x\ny"]]
    assert tools.changes_by_shrink(from_rows(spark, [[" a"]])) and not tools.changes_by_shrink(from_rows(spark, [["a"]]))
    md = [r["line"] for r in tools.markdown(from_rows(spark, [["a|b", "1"]], ["x", "yy"])).collect()]
    assert md == ["| x    | yy |", "| ---- | -- |", "| a\\|b | 1  |"]
    with pytest.raises(IOHandlingError):
        tools.markdown(from_rows(spark, [["a\nb"]], ["x"]))
    with pytest.raises(Exception, match="tab"):
        tools.tsv(from_rows(spark, [["a\tb"]])).collect()


def test_align_of_fields_with_line_feeds(spark):
    t = from_rows(spark, [["a", "x\n longer \n", "1"], ["bb\nc", "y", "20"], ["d", "", "3\n"]], ["n", "two\nlines", "v"])
    lines = [r["line"] for r in tools.align(t, Dialect(";;", "simple")).collect()]
    assert lines[0] == "n ;; two\n" + " " * 5 + "lines ;; v"
    assert lines[1] == "a ;; x\n" + " " * 5 + "longer\n" + " " * 5 + " " * 6 + ";; 1"
    assert lines[2] == "bb\nc ;; y     ;; 20" and lines[3] == "d ;;       ;; 3\n" + " " * 14
    wide = [r["line"] for r in tools.align(from_rows(spark, [["日本\na", "x"], ["bcde", "y"]]), Dialect(","), wide=True).collect()]
    assert wide == ["日本\na   , x", "bcde, y"]


def test_head_and_tail(spark, tmp_path):
    path = put(tmp_path, "\n".join(str(i) for i in range(1000)))
    assert tools.head_of_file(spark, path, 10) == "0\n1\n2\n3\n4"
    assert tools.head_of_file(spark, path, 8, tail=True) == "998\n999"
