"""Entry points: files in and out, command line, completions, streams."""

import sqlite3
import subprocess
import sys
from pathlib import Path

import pytest

from tabulon.api import Engine, query_csv, query_json, query_sqlite
from tabulon.errors import QueryParsingError
from tabulon.lang.suggest import suggest
from tabulon.sources.dialect import Dialect
from tabulon.streaming.query import query_stream, read_stream

ROOT = str(Path(__file__).resolve().parent.parent)


def test_query_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\nx,1\ny,2\n")
    (tmp_path / "b.csv").write_text("k,w\nx,X\n")
    d = Dialect(",", "quoted", header=True)
    r = query_csv(spark, "select a.k, b.w left join b on a.k == b.k", str(tmp_path / "a.csv"), d, str(tmp_path / "out"), join_paths={"b": str(tmp_path / "b.csv")})
    assert [x[0] for x in spark.read.text(str(tmp_path / "out")).collect()] == ["k,w", "x,X", "y,"] and len(r.warnings) == 2


def test_query_json_and_sqlite(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"a": 1}\n{"a": 2}\n')
    query_json(spark, "select int(a['a']) + 1", str(tmp_path / "t.json"), str(tmp_path / "j"))
    assert [x[0] for x in spark.read.text(str(tmp_path / "j")).collect()] == ["2", "3"]
    with sqlite3.connect(tmp_path / "d.db") as c:
        c.execute("create table t (x integer)")
        c.execute("insert into t values (5)")
    query_sqlite(spark, "select a.x, NR", str(tmp_path / "d.db"), "t", str(tmp_path / "s"))
    assert [x[0] for x in spark.read.text(str(tmp_path / "s")).collect()] == ["x,NR", "5,1"]


def test_from_catalog(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert Engine(spark).query("select SUM(a.id) from three").rows() == [[3]]
    with pytest.raises(QueryParsingError):
        Engine(spark).query("select a1")


def test_suggest():
    assert "a.name" in suggest("select a.n", ["name", "two words"], 2)
    assert 'a["two words"]' in suggest("select a", ["name", "two words"], 2)
    assert suggest("select a1 WHE", None, 1) == ["WHERE"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text('1,"a,b"\n2,c\n')
    stream = read_stream(spark, str(tmp_path / "in"), Dialect(",", "quoted"), ["n", "t"])
    q = query_stream(spark, "select int(a.n) * 2 as m, a.t where a.n != '2'", stream)
    q.writeStream.format("memory").queryName("s1").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("s1").collect()] == [(2, "a,b")]
    for text in ("select NR", "select a.n order by a.n", "select distinct a.n", "select top 1 a.n"):
        with pytest.raises(QueryParsingError):
            query_stream(spark, text, stream)


def test_command_line(tmp_path):
    (tmp_path / "t.csv").write_text('name,n\n"a, b",1\nc,2\n')
    run = lambda *a: subprocess.run([sys.executable, "-m", "tabulon", *a], cwd=ROOT, capture_output=True, text=True, timeout=170)
    r = run("-q", "select a.name, int(a.n) * 2.5 as m", "-i", str(tmp_path / "t.csv"), "--delim", ",", "--with-headers")
    assert r.stdout == 'name,m\n"a, b",2.5\nc,5.0\n', r.stderr[-500:]
    r = run("-q", "select a.zzz", "-i", str(tmp_path / "t.csv"), "--delim", ",", "--with-headers")
    assert r.returncode == 1 and "query parsing" in r.stderr


def test_shell(spark, tmp_path):
    from tabulon.shell import HISTORY_LENGTH, History, coloured, result_path, run_shell, write_template
    from tabulon.sources.delimited import read_delimited

    (tmp_path / "t.csv").write_text("name,n\na,1\nb,2\n")
    d = Dialect(",", "quoted", header=True)
    t = read_delimited(spark, str(tmp_path / "t.csv"), d)
    asked = iter(["select a.name", "select a.zzz", "history", "select int(a.n) + 1 as m where a.name == 'b'", "quit"])
    shown, wrote, history = [], [], History(str(tmp_path / "h"))

    def ask(prompt, complete):
        assert "a.name" in complete("select a.n")
        return next(asked)

    def run(query, path):
        table = Engine(spark).query(query, t).table
        wrote.append([list(r) for r in table.result(ordered=True).collect()])
        return table

    assert run_shell(spark, t, d, result_path("t", ","), ask, shown.append, run, history) == 2
    assert wrote == [[["a"], ["b"]], [[3]]] and any("query parsing" in x for x in shown) and "1: select a.zzz" in shown
    assert history.read() == ["select int(a.n) + 1 as m where a.name == 'b'", "select a.zzz", "select a.name"]
    for i in range(2 * HISTORY_LENGTH):
        history.add(f"q{i % 30}")
    assert len(history.read()) == HISTORY_LENGTH and history.read()[0] == "q9"
    assert [result_path("x", s) for s in (",", "\t", ";")] == ["x.csv", "x.tsv", "x.txt"]
    assert coloured(["p", "q"], ",", names=True) == "\x1b[0ma1:p,\x1b[31ma2:q\x1b[0m"
    assert write_template(str(tmp_path / "i.py")) and not write_template(str(tmp_path / "i.py"))


def test_one_sorted_file_of_many_parts(spark, tmp_path):
    from tabulon.plans.table import from_dataframe
    from tabulon.sources.delimited import write_delimited

    df = spark.range(5000).selectExpr("id", "hash(id) as h").repartition(7)
    result = Engine(spark).query("select a.id order by a.id", from_dataframe(df))
    write_delimited(result.table, str(tmp_path / "o"), Dialect(","), single_file=True)
    files = [p for p in (tmp_path / "o").iterdir() if not p.name.startswith(".")]
    assert len(files) == 1 and files[0].read_text().split() == ["id", *map(str, range(5000))]
    with pytest.raises(Exception, match="exists"):
        write_delimited(result.table, str(tmp_path / "o"), Dialect(","), single_file=True)
    write_delimited(result.table, str(tmp_path / "o"), Dialect(","), single_file=True, mode="overwrite")
