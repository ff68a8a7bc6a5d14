"""Operators of the query language over small tables, compared with results worked out by hand."""

import pytest

from tabulon.api import Engine, query_pandas, query_rows
from tabulon.errors import QueryParsingError, error_info
from tabulon.lang.clauses import clean, parse_stage, split_stages
from tabulon.plans.table import from_rows

ROWS = [["x", 1, 2.5], ["y", 2, 3.5], ["x", 3, None], [None, 4, 1.0], ["y", 2, 3.5]]
HEAD = ["k", "n", "v"]
JOIN = [["x", "X1"], ["y", "Y1"], [None, "N"], ["y", "Y2"]]


def run(spark, text, rows=ROWS, head=HEAD, join=JOIN, join_head=("k", "w"), **options):
    return query_rows(spark, text, rows, head, join, list(join_head) if join_head else None, **options)


CASES = [
    ("select a1, a.n * 2 as m, NR where a.n > 1", [["y", 4, 2], ["x", 6, 3], [None, 8, 4], ["y", 4, 5]], ["k", "m", "NR"]),
    ("select top 2 * order by a.n desc", [[None, 4, 1.0], ["x", 3, None]], HEAD),
    ("select a2 order by a2 desc limit 3 where a1 == 'y' or a2 == 1", [[2], [2], [1]], ["n"]),
    ("select NR order by a2 desc", [[4], [3], [5], [2], [1]], ["NR"]),
    ("select distinct a1", [["x"], ["y"], [None]], ["k"]),
    ("select distinct a1 order by a2 desc", [[None], ["x"], ["y"]], ["k"]),
    ("select distinct count a1", [[2, "x"], [2, "y"], [1, None]], ["count", "k"]),
    ("select a1, COUNT(*), SUM(a2) group by a1", [[None, 1, 4], ["x", 2, 4], ["y", 2, 4]], ["k", "col2", "col3"]),
    ("select a1, ARRAY_AGG(a3, lambda v: len(v)) as c group by a1", [[None, 1], ["x", 2], ["y", 2]], ["k", "c"]),
    ("select MEDIAN(a2), VARIANCE(a2), ANY_VALUE(a1), MAX(a2), MIN(a2), AVG(a2)", [[2.0, pytest.approx(1.04), "x", 4, 1, 2.4]], None),
    ("select COUNT(1) where a2 > 100", [], None),
    ("select a1, b.w join b on a1 == b1", [["x", "X1"], ["y", "Y1"], ["y", "Y2"], ["x", "X1"], [None, "N"], ["y", "Y1"], ["y", "Y2"]], ["k", "w"]),
    ("select a.n, b.w, bNR left join b on a.k == b.w", [[1, None, None], [2, None, None], [3, None, None], [4, None, None], [2, None, None]], ["n", "w", "bNR"]),
    ("select NR, bNR join b on NR == bNR", [[1, 1], [2, 2], [3, 3], [4, 4]], ["NR", "bNR"]),
    ("update set a2 = a2 + 1, a1 = 'z' where a1 == 'x'", [["z", 2, 2.5], ["y", 2, 3.5], ["z", 4, None], [None, 4, 1.0], ["y", 2, 3.5]], HEAD),
    ("update set a.n = NU where a2 > 1", [["x", 1, 2.5], ["y", 1, 3.5], ["x", 2, None], [None, 3, 1.0], ["y", 4, 3.5]], HEAD),
    ("update set a1 = b2 inner join b on a2 == bNR where b2 != 'N'", [["X1", 1, 2.5], ["Y1", 2, 3.5], ["x", 3, None], ["Y2", 4, 1.0], ["Y1", 2, 3.5]], HEAD),
    ("select * except a2", [["x", 2.5], ["y", 3.5], ["x", None], [None, 1.0], ["y", 3.5]], ["k", "v"]),
    ("select a2, unnest([a2, 9]) where a2 < 3", [[1, 1], [1, 9], [2, 2], [2, 9], [2, 2], [2, 9]], ["n", "col2"]),
    ("select a2 | select SUM(a1) as s |> select a.s + 1", [[13]], ["col1"]),
    ("select a2 // 2, -a2 % 3, a2 ** 2, a2 / 2 where a2 == 3", [[1, 0, 9, 1.5]], None),
    ("select f'{a2:03d}|{a1}' where NR == 4", [["004|None"]], None),
    ("select a1 if a1 is not None else '-' where a1 != 'x'", [["y"], ["-"], ["y"]], None),
    ("select NF, a9 where NR == 1", [[3, None]], ["NF", "col2"]),
    ("select a1 group by a1", [[None], ["x"], ["y"]], ["k"]),
    ("select *[a2, a2 * 2], *'p,q'.split(',') where NR == 2", [[2, 4, "p", "q"]], None),
    ("select a1.center(5) where a1 == 'x'", [["  x  "], ["  x  "]], None),
    ("# a comment\nselect a1 -- \n".replace(" -- ", " ") + " where NR == 1;", [["x"]], ["k"]),
]


@pytest.mark.parametrize("text,rows,header", CASES, ids=[c[0][:50] for c in CASES])
def test_query(spark, text, rows, header):
    got, head, _ = run(spark, text)
    assert got == rows
    if header is not None:
        assert head == header


@pytest.mark.parametrize("text", [
    "select a1 where a1 = 'x'", "select MAX(a2) / 2", "select a1, a2 group by a1 order by a2", "update set a1 = 2 order by a2", "select a.zzz", "select a1 limit x",
    "where a1 == 2", "select a1 select a2", "select distinct COUNT(a1)", "select unnest([1]), unnest([2])", "select * except b1 join b on a1 == b1", "select a1 join b on a1 > b1",
    "select a1 join c on a1 == c1", "select nosuch(a1", "select a1 where a1 > 3", "update set a7 = 1", "update set a1 = 'q' limit 3", "select *  as x",
])
def test_parsing_errors(spark, text):
    with pytest.raises(QueryParsingError):
        run(spark, text)


@pytest.mark.parametrize("text", ["select a1, b2 strict left join b on a1 == b1", "select a1, a2 group by a1", "update set a1 = b2 join b on a1 == b1", "select SUM(a1)", "select 1 // (a2 - 1)"])
def test_execution_errors(spark, text):
    with pytest.raises(Exception) as e:
        run(spark, text)
    assert error_info(e.value)[0] == "query execution"


def test_no_header_names(spark):
    got, head, _ = run(spark, "select a1, a2 + 1", head=None, join_head=None)
    assert head is None and got[0] == ["x", 2]
    assert run(spark, "select a1, a2 as b", head=None, join_head=None)[1] == ["col1", "b"]


def test_ragged_rows_warn(spark):
    got, _, warnings = query_rows(spark, "select NF, a3", [["a", "b", "c"], ["d"]], None)
    assert got == [[3, "c"], [1, None]] and len(warnings) == 1


def test_fallback_and_user_functions(spark):
    assert run(spark, "select a1.swapcase() where NR == 1")[0] == [["X"]]
    assert run(spark, "select twice(a2) where NR < 3", init_source="def twice(x) -> int:\n    return x * 2")[0] == [[2], [4]]
    with pytest.raises(QueryParsingError):
        run(spark, "select a1.swapcase()", allow_fallback=False)


def test_js_dialect(spark):
    assert run(spark, "select a2 * 10 + '!', a1 === 'x' ? a1.toUpperCase() : `${a2}?` where a2 < 3 && a1 != null", dialect="js")[0] == [["10!", "X"], ["20!", "2?"], ["20!", "2?"]]
    assert run(spark, "select [3,1,2].sort().slice(0, 2).map(x => x * 2).join('-') where NR == 1", dialect="js")[0] == [["2-4"]]


def test_pandas(spark):
    import pandas as pd

    out = query_pandas(spark, "select a.k, SUM(a.n) as s group by a.k", pd.DataFrame({"k": ["p", "q", "p"], "n": [1, 2, 3]}))
    assert out.values.tolist() == [["p", 4], ["q", 2]]


def test_clauses():
    assert split_stages("select 'a | select' | select a1 |> update set a1 = 1 | 2") == ["select 'a | select'", "select a1", "update set a1 = 1 | 2"]
    spec = parse_stage("select top 3 distinct a1, f('x, where y') where g(a1) limit 2 order by a2 desc with (noheader)")
    assert (spec.limit, spec.distinct, spec.descending, spec.with_header, spec.items[1]) == (2, True, True, False, "f('x, where y')")
    assert clean("# c\nselect a1 ;\n") == "select a1"


def test_plan_prunes_and_pushes_down(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100).selectExpr("id", "id * 2 as x", "cast(id as string) as s").coalesce(1).write.parquet(path)
    plan = Engine(spark, ordered=False).query("select a.x where a.x > 10 and a.id in [3, 50]", path).df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,10)" in plan and "In(id" in plan and "ReadSchema: struct<id:bigint,x:bigint" in plan and "s:string" not in plan


def test_numbering_over_partitions(spark):
    from tabulon.plans.table import from_dataframe

    got = Engine(spark).query("select NR, a.id where NR % 100 == 0", from_dataframe(spark.range(1000).repartitionByRange(5, "id"))).rows()
    assert got == [[i, i - 1] for i in range(100, 1001, 100)]


def test_left_join_nulls_and_widths(spark):
    joins = {"b": from_rows(spark, [["k1", 1, 2]], ["a", "b", "c"])}
    got = Engine(spark).query("select a.a, b.b, bNF left join b on a.a == b.a", from_rows(spark, [["k1"], ["k2"]], ["a"]), joins).rows()
    assert got == [["k1", 1, 3], ["k2", None, 3]]
