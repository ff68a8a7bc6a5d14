"""Named queries for sources, sinks, clauses, errors and tools that one table and one expression don't show, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .api import Engine
from .errors import error_info
from .lang.suggest import suggest
from .operators.ordering import dense_numbers
from .plans.table import NUMBER, Table, from_dataframe, from_parquet, from_rows
from .quality import tools
from .sources.delimited import read_delimited, set_header, table_of_lines, write_delimited
from .sources.dialect import Dialect, default_policy, detect_by_frequency, detect_by_width, named_format
from .sources.memory import read_json_lines, write_json_lines
from .sources.scratch import scratch_path

_PARTS = 7  # files that the queries over many files write


def _read(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return from_parquet(spark, f"{sf_dir}/{name}.parquet")


def _in_order(spark: SparkSession, text: str, a: Table, b: Table | None = None, **options) -> DataFrame:
    """The query's result with pos, the place of each record in the order of the output."""
    result = Engine(spark, **options).query(text, a, {k: b for k in ("b", "B")} if b else None)
    return dense_numbers(result.df, "pos")


def _text_file(spark: SparkSession, lines: DataFrame, **options) -> str:
    """A folder with lines (pos, line) as one text file, in order."""
    path = scratch_path(spark, "text")
    write = lines.orderBy("pos").select("line").coalesce(1).write
    for k, v in options.items():
        write = write.option(k, v)
    write.text(path)
    return path


def _many_files(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The rows of a sample table over several files of unequal size, in the order of the table."""
    path = scratch_path(spark, "files")
    t = _read(spark, sf_dir, name).numbered()
    n = t.df.count()
    columns = [F.col(c).alias(h) for c, h in zip(t.columns, t.header, strict=True)]
    for i in range(_PARTS):
        low, high = n * i * i // _PARTS**2, n * (i + 1) ** 2 // _PARTS**2
        part = t.df.where((F.col(NUMBER) > low) & (F.col(NUMBER) <= high)).orderBy(NUMBER).select(*columns).coalesce(1)
        part.write.parquet(f"{path}/part={i}")
    return path


def _files_table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    # the files stand in folders part=0, part=1, ..., and the recursive reader takes no column from them
    return from_parquet(spark, _many_files(spark, sf_dir, name), recursiveFileLookup="true")


# -- records over many files -------------------------------------------------------------------------------------------

def nr_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, ordered=False).query("SELECT NR, a.l_orderkey, a.l_linenumber, a.l_extendedprice", _files_table(spark, sf_dir, "lineitem")).df


def nu_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, ordered=False).query("UPDATE SET a.o_custkey = NU WHERE a.o_orderstatus == 'F'", _files_table(spark, sf_dir, "orders")).df


def top_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_order(spark, "SELECT TOP 40 a.o_orderkey, a.o_totalprice WHERE a.o_orderstatus == 'P'", _files_table(spark, sf_dir, "orders"))


def join_nr_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _files_table(spark, sf_dir, "customer"), _files_table(spark, sf_dir, "orders")
    return Engine(spark, ordered=False).query("SELECT NR, a.c_custkey, b.o_orderkey JOIN B ON NR == bNR", a, {"B": b}).df


def csv_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    write_delimited(_read(spark, sf_dir, "orders").numbered(), path, Dialect(",", "quoted", header=True))
    text = "SELECT NR, int(a.o_orderkey) AS o_orderkey, float(a.o_totalprice) AS o_totalprice"
    return Engine(spark, ordered=False).query(text, read_delimited(spark, path, Dialect(",", "quoted", header=True))).df


def rfc_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, d = scratch_path(spark, "csv"), Dialect(",", "quoted_rfc", header=True)
    write_delimited(_read(spark, sf_dir, "documents").numbered(), path, d)
    return Engine(spark, ordered=False).query("SELECT NR, int(a.doc_id) AS doc_id, a.text", read_delimited(spark, path, d)).df


# -- delimited files ---------------------------------------------------------------------------------------------------

def _lines(spark: SparkSession, sf_dir: str, name: str, *exprs: str) -> DataFrame:
    """(pos, line) of a table, its fields joined by commas."""
    t = _read(spark, sf_dir, name).numbered()
    named = t.df.select(F.col(NUMBER).alias("pos"), *[F.col(c).alias(h) for c, h in zip(t.columns, t.header, strict=True)])
    return named.select("pos", F.expr(f"concat_ws(',', {', '.join(exprs)})").alias("line"))


def csv_monocolumn(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _text_file(spark, _lines(spark, sf_dir, "customer", "c_custkey", "c_name"))
    t = read_delimited(spark, path, named_format("monocolumn"))
    kept = Engine(spark).query("SELECT a1 WHERE a1.endswith('7')", t)
    out = scratch_path(spark, "mono")
    write_delimited(kept.table, out, named_format("monocolumn"))
    return spark.read.text(out)


def csv_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _text_file(spark, _lines(spark, sf_dir, "nation", "n_name || ' éüß'", "n_nationkey"), encoding="ISO-8859-1")
    raw = spark.read.text(path).select(F.col("value").cast("binary").alias("b"))  # Spark writes UTF-8; recode to one byte a character
    path = scratch_path(spark, "latin1")
    raw.select(F.encode(F.decode("b", "UTF-8"), "ISO-8859-1").cast("string").alias("value")).write.text(path)
    return Engine(spark, ordered=False).query("SELECT a1 AS name, int(a2) AS k", read_delimited(spark, path, Dialect(",", encoding="latin-1"))).df


def csv_bom(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir, "nation", "concat(if(pos = 1, '﻿', ''), n_name)", "n_nationkey")
    return Engine(spark, ordered=False).query("SELECT NR, a1 AS name, len(a1) AS n", read_delimited(spark, _text_file(spark, lines), Dialect(","))).df


def csv_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir, "nation", "'  ' || n_name || ' '", "' ' || n_nationkey")
    return Engine(spark, ordered=False).query("SELECT a1 AS name, a2 AS k", read_delimited(spark, _text_file(spark, lines), Dialect(",", strip_fields=True))).df


def csv_line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _text_file(spark, _lines(spark, sf_dir, "supplier", "s_suppkey", "s_name"), lineSep="\r\n")
    return Engine(spark, ordered=False).query("SELECT NR, int(a1) AS k, a2 AS name, NF", read_delimited(spark, path, Dialect(","))).df


def csv_with_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    write_delimited(_read(spark, sf_dir, "nation"), path, Dialect(",", header=True))
    return Engine(spark, ordered=False).query("SELECT a.n_name, NR WITH (header)", read_delimited(spark, path, Dialect(","))).df


def csv_with_noheader(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    write_delimited(_read(spark, sf_dir, "nation"), path, Dialect(",", header=True))
    return Engine(spark, ordered=False).query("SELECT NR AS nr, a2 AS name WITH (noheader)", read_delimited(spark, path, Dialect(",", header=True))).df


def csv_virtual_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names given by the user to a file without a header."""
    path = _text_file(spark, _lines(spark, sf_dir, "nation", "n_nationkey", "n_name"))
    t = read_delimited(spark, path, Dialect(","))
    t.header = ["key", "name"]
    return Engine(spark, ordered=False).query("SELECT a.name, int(a.key) AS key WHERE a.key != '3'", t).df


def sink_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a sink: booleans, missing values and lists as text."""
    r = Engine(spark).query("SELECT a.n_nationkey, a.n_regionkey == 1, None, a.n_name.split('_'), a.n_regionkey / 2", _read(spark, sf_dir, "nation"))
    path = scratch_path(spark, "csv")
    r.table.header = None
    write_delimited(r.table, path, Dialect(",", "quoted"))
    return spark.read.text(path)


def sink_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table by the names of its output formats."""
    t = _read(spark, sf_dir, "region")
    out = None
    for name in ("csv", "tsv", "input"):
        path = scratch_path(spark, "format")
        write_delimited(t, path, named_format(name, Dialect(";", "simple")), single_file=True)
        part = spark.read.text(path).select(F.lit(name).alias("format"), F.col("value").alias("line"))
        out = part if out is None else out.unionByName(part)
    return out


def csv_entry_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, path, other, out = Dialect(",", "quoted", header=True), scratch_path(spark, "csv"), scratch_path(spark, "csv"), scratch_path(spark, "csv")
    write_delimited(_read(spark, sf_dir, "customer"), path, d)
    write_delimited(_read(spark, sf_dir, "nation"), other, d)
    api.query_csv(spark, "SELECT a.c_custkey, b.n_name JOIN nations ON a.c_nationkey == b.n_nationkey", path, d, out, join_paths={"nations": other})
    return spark.read.text(out)


def json_entry_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = scratch_path(spark, "json"), scratch_path(spark, "json")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.json(path)
    api.query_json(spark, "SELECT int(a.n_nationkey) * 2 WHERE int(a.n_regionkey) < 3", path, out)
    return spark.read.text(out)


def sqlite_entry_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    import sqlite3

    path, out = scratch_path(spark, "sqlite").removeprefix("file:") + ".db", scratch_path(spark, "csv")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").collect()]
    with sqlite3.connect(path) as c:
        c.execute("create table region (r_regionkey integer, r_name text)")
        c.executemany("insert into region values (?, ?)", rows)
    api.query_sqlite(spark, "SELECT a.r_name, a.r_regionkey + NR AS s", path, "region", out)
    return spark.read.text(out)


# -- tables in memory, registries, entry points --------------------------------------------------------------------------

def _small(spark: SparkSession, sf_dir: str) -> tuple[list[list], list[str]]:
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return sorted([list(r) for r in df.collect()]), df.columns


def rows_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, header = _small(spark, sf_dir)
    return Engine(spark, ordered=False).query("SELECT NR, a.n_name, NF", from_rows(spark, rows, header)).df


def rows_entry_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, header = _small(spark, sf_dir)
    got, names, _ = api.query_rows(spark, "SELECT a.n_name, b.n_name AS first JOIN B ON a.n_regionkey == b.n_nationkey", rows, header, rows[:5], header)
    return spark.createDataFrame([tuple(r) for r in got], names)


def pandas_entry_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/nation.parquet").toPandas()
    return spark.createDataFrame(api.query_pandas(spark, "SELECT a.n_regionkey, COUNT(*) AS n GROUP BY a.n_regionkey", frame))


def dataframe_entry_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.query_df(spark, "SELECT a.c_mktsegment, MAX(a.c_custkey) AS last GROUP BY a.c_mktsegment", spark.read.parquet(f"{sf_dir}/customer.parquet"))


def from_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {"people": _read(spark, sf_dir, "customer"), "lands": _read(spark, sf_dir, "nation")}
    return Engine(spark, ordered=False).query("SELECT a.c_name, b.n_name FROM people JOIN lands ON a.c_nationkey == b.n_nationkey WHERE a.c_acctbal > 5000", None, known).df


def view_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("tabulon_nations")
    return Engine(spark, ordered=False).query("SELECT a.n_name WHERE a.n_regionkey == 2", "tabulon_nations").df


def notebook_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the notebook's line magic gives for DataFrames and functions of the notebook."""
    from .lang.suggest import load_ipython_extension

    def shout(v: str) -> str:
        return v + "!"

    class Shell:
        user_ns = {"nations": spark.read.parquet(f"{sf_dir}/nation.parquet"), "shout": shout}

        def register_magic_function(self, run, kind, name):
            self.run = run

    shell = Shell()
    load_ipython_extension(shell)
    return spark.createDataFrame(shell.run("SELECT udf.shout(a.n_name) AS loud FROM nations WHERE a.n_nationkey < 7"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = spark.read.parquet(f"{sf_dir}/region.parquet").columns
    rows = [(t, x) for t in ("SELECT a.r", "SELECT a1 WHE", "SELECT b") for x in suggest(t, header, len(header), ["k k"], 1)]
    return spark.createDataFrame(rows, "typed string, completion string")


def joined_output_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a join's records: that of the first table, then that of the second."""
    return _in_order(spark, "SELECT a.c_custkey, b.o_orderkey JOIN B ON a.c_custkey == b.o_custkey", _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders"))


def sorted_output_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_order(spark, "SELECT a.c_custkey, a.c_nationkey ORDER BY a.c_nationkey DESC", _read(spark, sf_dir, "customer"))


def distinct_output_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_order(spark, "SELECT DISTINCT a.o_orderpriority", _read(spark, sf_dir, "orders"))


def group_output_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_order(spark, "SELECT a.l_suppkey, COUNT(*) AS n GROUP BY a.l_suppkey", _read(spark, sf_dir, "lineitem"))


def unnest_output_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_order(spark, "SELECT UNNEST(a.p_name.split(' ')) AS word, a.p_partkey", _read(spark, sf_dir, "part"))


# -- errors --------------------------------------------------------------------------------------------------------------

#: case: (query, whether with a join table)
_BAD: dict[str, tuple[str, bool]] = {
    "aggregate_in_expression": ("SELECT SUM(a.n_nationkey) + 1", False),
    "aggregate_in_aggregate": ("SELECT SUM(MAX(a.n_nationkey))", False),
    "aggregate_with_order_by": ("SELECT COUNT(*) ORDER BY a.n_name", False),
    "aggregate_with_distinct": ("SELECT DISTINCT COUNT(a.n_name) GROUP BY a.n_name", False),
    "assignment_in_where": ("SELECT a.n_name WHERE a.n_nationkey = 3", False),
    "except_with_join": ("SELECT * EXCEPT a.n_name JOIN B ON a.n_regionkey == b.r_regionkey", True),
    "from_with_input": ("SELECT a1 FROM somewhere", False),
    "join_of_one_side": ("SELECT a1 JOIN B ON a1 == a2", True),
    "limit_in_update": ("UPDATE SET a1 = 1 LIMIT 3", False),
    "lone_star_alias": ("SELECT * AS x", False),
    "order_by_in_update": ("UPDATE SET a1 = 1 ORDER BY a2", False),
    "two_unnests": ("SELECT UNNEST([1]), UNNEST([2])", False),
    "two_wheres": ("SELECT a1 WHERE a1 > 1 WHERE a2 > 2", False),
    "unknown_field": ("SELECT a.nothing", False),
    "unknown_table": ("SELECT a1 JOIN nowhere ON a1 == b1", False),
    "unknown_update_field": ("UPDATE SET a9 = 1", False),
    "varying_constant": ("SELECT a.n_name, COUNT(*) GROUP BY a.n_regionkey", False),
    "division_by_zero_text": ("SELECT int(a.n_name)", False),
}


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of the error that each of the bad queries ends with."""
    a, b = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    rows = []
    for case, (text, joined) in sorted(_BAD.items()):
        try:
            Engine(spark).query(text, a, {"B": b} if joined else {}).rows()
            rows.append((case, "none"))
        except Exception as e:  # noqa: BLE001 - told by category
            rows.append((case, error_info(e)[0]))
    return spark.createDataFrame(rows, "case string, category string")


def error_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the message for a keyword that the language lacks names what to use instead."""
    a = _read(spark, sf_dir, "nation")
    rows = []
    cases = (("second stage", "SELECT a1, COUNT(*) GROUP BY a1 HAVING COUNT(*) > 1"), ("call like(", "SELECT a1 WHERE a.n_name LIKE 'N%'"), ("FROM isn't needed", "SELECT a1 FROM x"))
    for word, text in cases:
        try:
            Engine(spark).query(text, a).rows()
            rows.append((word, False))
        except Exception as e:  # noqa: BLE001 - its message is the result
            rows.append((word, word in error_info(e)[1]))
    return spark.createDataFrame(rows, "word string, named boolean")


def missing_join_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record too short for its join key fails the query, while missing values of whole records match each other."""
    names = [r[0] for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_name").orderBy("r_regionkey").collect()]
    ragged, whole = from_rows(spark, [[n, n] if i else [n] for i, n in enumerate(names)]), from_rows(spark, [[n, n if i else None] for i, n in enumerate(names)])
    rows = []
    for kind, t in (("ragged", ragged), ("whole", whole)):
        try:
            rows.append((kind, str(len(Engine(spark).query("SELECT a1, b1 JOIN B ON a2 == b2", t, {"B": t}).rows()))))
        except Exception as e:  # noqa: BLE001 - told by category
            rows.append((kind, error_info(e)[0]))
    return spark.createDataFrame(rows, "kind string, result string")


def header_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of which one has a header don't join; a bare name that both have is ambiguous."""
    a = _read(spark, sf_dir, "nation")
    plain = from_dataframe(spark.read.parquet(f"{sf_dir}/region.parquet"), header=False)
    rows = []
    for case, b, options, text in (("header", plain, {}, "SELECT a1, b1 JOIN B ON a.n_regionkey == b1"), ("bare", a, {"bare_names": True}, "SELECT n_name JOIN B ON a.n_nationkey == b.n_nationkey")):
        try:
            Engine(spark, **options).query(text, a, {"B": b}).rows()
            rows.append((case, "none"))
        except Exception as e:  # noqa: BLE001 - told by category
            rows.append((case, error_info(e)[0]))
    return spark.createDataFrame(rows, "case string, category string")


# -- tools ---------------------------------------------------------------------------------------------------------------

def lint_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of the records with the first record of each, and the first line with a blank around a field."""
    path = _text_file(spark, _lines(spark, sf_dir, "part", "replace(p_name, ' ', if(p_size % 2 = 0, ',', ' ,'))", "if(pos % 10 = 0, 'x', null)"))
    r = tools.lint_file(spark, path, Dialect(","))
    return spark.createDataFrame([(w, n, r.first_spaced_line, r.n_records) for w, n in r.widths], "width int, first_record long, first_spaced long, n_records long")


def detect_by_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialects by the most frequent separator and by the width of ten lines, and default policies."""
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").limit(10).collect()]
    out = []
    for sep in ("\t", ",", ";", "|"):
        lines = [f"{k}{sep}{n}" for k, n in rows]
        by_count, by_width = detect_by_frequency("\n".join(lines)), detect_by_width(lines)
        out.append((sep, by_count.delim, by_count.policy, by_width.delim, by_width.policy, default_policy(sep)))
    return spark.createDataFrame(out, "sep string, count_delim string, count_policy string, width_delim string, width_policy string, default_policy string")


def display_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal columns of a text: wide East Asian characters count twice, combining ones not at all."""
    base = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.concat("n_name", F.when(F.col("n_regionkey") == 1, "日本").when(F.col("n_regionkey") == 2, "é").otherwise("")).alias("t"))
    return base.select("n_nationkey", F.element_at(tools.visual(F.split("t", "\n"), True), 1).cast("long").alias("width"))


def comments_put_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with comment lines whose records are changed while the comments stay in their places."""
    lines = _lines(spark, sf_dir, "nation", "if(n_regionkey = 4, '# ' || n_name, n_name)")
    numbered = lines.select(F.col("pos").alias("ln"), "line")
    records = numbered.where(~F.col("line").startswith("#")).withColumn("line", F.lower("line"))
    return tools.with_comments(records, numbered.where(F.col("line").startswith("#")))


def head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _text_file(spark, _lines(spark, sf_dir, "orders", "o_orderkey", "o_custkey"))
    rows = [(e, i, x) for e, t in (("head", False), ("tail", True)) for i, x in enumerate(tools.head_of_file(spark, path, 60, tail=t).split("\n"))]
    return spark.createDataFrame(rows, "side string, place long, line string")


def sampling_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first records of a file, for previews and width estimates."""
    path = scratch_path(spark, "csv")
    write_delimited(_read(spark, sf_dir, "customer"), path, Dialect(",", header=True), single_file=True)
    t = tools.preview(read_delimited(spark, path, Dialect(",", header=True)), 0, 15, 12)
    return t.select(F.col(NUMBER).alias("nr"), F.col("c2").alias("name"))


def markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.markdown(_read(spark, sf_dir, "region").numbered()).select("line")


def custom_source_and_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any DataFrame is a source, and a result's DataFrame goes wherever Spark writes."""
    source = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * F.col("id")).alias("square"))
    path = scratch_path(spark, "orc")
    Engine(spark, ordered=False).query("SELECT a.k, a.square - 1 AS less WHERE a.k % 7 == 0", source).df.write.orc(path)
    return spark.read.orc(path)


def header_switched_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    write_delimited(_read(spark, sf_dir, "region"), path, Dialect("\t", "simple", header=True))
    t = set_header(set_header(read_delimited(spark, path, Dialect("\t", "simple", header=True)), False), True)
    return Engine(spark, ordered=False).query("SELECT a.r_name, NR", t).df


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "json")
    write_json_lines(Engine(spark).query("SELECT a.n_name", _read(spark, sf_dir, "nation")).table, path)
    return Engine(spark, ordered=False).query("SELECT str(a) AS name", read_json_lines(spark, path)).df


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    nr_many_files, nu_many_files, top_many_files, join_nr_many_files, csv_many_files, rfc_many_files, csv_monocolumn, csv_latin1, csv_bom, csv_trim, csv_line_ends, csv_with_header,
    csv_with_noheader, csv_virtual_header, sink_values, sink_formats, csv_entry_point, json_entry_point, sqlite_entry_point, rows_source, rows_entry_point, pandas_entry_point,
    dataframe_entry_point, from_clause, view_registry, notebook_magic, completions, joined_output_order, sorted_output_order, distinct_output_order, group_output_order,
    unnest_output_order, errors, error_hints, missing_join_key, header_mismatch, lint_widths, detect_by_head, display_widths, comments_put_back, head_and_tail, sampling_scan,
    markdown_export, custom_source_and_sink, header_switched_twice, json_round_trip,
)}

_COMPLETIONS = [
    ("SELECT a.r", "a.r_regionkey"), ("SELECT a.r", "a.r_name"), ("SELECT a1 WHE", "WHERE"),
    ("SELECT b", "b1"), ("SELECT b", 'b["k k"]'), ("SELECT b", "bNR"), ("SELECT b", "bNF"),
]
_CATEGORY = {"division_by_zero_text": "query execution", "varying_constant": "query execution"}
_values = lambda rows: "values " + ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)

SQL: dict[str, str] = {
    "nr_many_files": 'select row_number() over () "NR", l_orderkey, l_linenumber, l_extendedprice from lineitem',
    "nu_many_files": "select o_orderkey, case when o_orderstatus = 'F' then sum((o_orderstatus = 'F')::int) over (order by nr) else o_custkey end::bigint o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from (select *, row_number() over () nr from orders)",
    "top_many_files": "select o_orderkey, o_totalprice, row_number() over (order by nr) pos from (select *, row_number() over () nr from orders) where o_orderstatus = 'P' order by nr limit 40",
    "join_nr_many_files": 'select a.nr "NR", c_custkey, o_orderkey from (select *, row_number() over () nr from customer) a join (select *, row_number() over () nr from orders) b using (nr)',
    "csv_many_files": 'select row_number() over () "NR", o_orderkey, o_totalprice from orders',
    "rfc_many_files": "select row_number() over () \"NR\", doc_id, coalesce(text, '') as text from documents",
    "csv_monocolumn": "select c_custkey || ',' || c_name as value from customer where c_name like '%7'",
    "csv_latin1": "select n_name || ' éüß' as name, n_nationkey::bigint k from nation",
    "csv_bom": 'select row_number() over () "NR", n_name as name, length(n_name)::bigint n from nation',
    "csv_trim": "select n_name as name, n_nationkey::varchar k from nation",
    "csv_line_ends": 'select row_number() over () "NR", s_suppkey k, s_name as name, 2::bigint "NF" from supplier',
    "csv_with_header": 'select n_name, row_number() over () "NR" from nation',
    "csv_with_noheader": "select 1::bigint nr, 'n_name' as name union all select row_number() over () + 1, n_name from nation",
    "csv_virtual_header": "select n_name as name, n_nationkey::bigint as key from nation where n_nationkey <> 3",
    "sink_values": "select n_nationkey || ',' || case when n_regionkey = 1 then 'True' else 'False' end || ',,' || replace(n_name, '_', '|') || ',' || (n_regionkey / 2)::double as value from nation",
    "sink_formats": "select f as format, unnest(['r_regionkey' || s || 'r_name'] || (select list(r_regionkey || s || r_name) from region)) line from (values ('csv', ','), ('tsv', chr(9)), ('input', ';')) v(f, s)",
    "csv_entry_point": "select 'c_custkey,n_name' as value union all select c_custkey || ',' || n_name from customer join nation on c_nationkey = n_nationkey",
    "json_entry_point": "select (n_nationkey * 2)::varchar as value from nation where n_regionkey < 3",
    "sqlite_entry_point": "select 'r_name,s' as value union all select r_name || ',' || (r_regionkey + row_number() over (order by r_regionkey)) from region",
    "rows_source": 'select row_number() over (order by n_nationkey) "NR", n_name, 3::bigint "NF" from nation',
    "rows_entry_point": "select a.n_name, b.n_name as first from nation a join nation b on a.n_regionkey = b.n_nationkey where b.n_nationkey < 5",
    "pandas_entry_point": "select n_regionkey::bigint n_regionkey, count(*) n from nation group by 1",
    "dataframe_entry_point": "select c_mktsegment, max(c_custkey) as last from customer group by 1",
    "from_clause": "select c_name, n_name from customer join nation on c_nationkey = n_nationkey where c_acctbal > 5000",
    "view_registry": "select n_name from nation where n_regionkey = 2",
    "notebook_magic": "select n_name || '!' loud from nation where n_nationkey < 7",
    "completions": f"select col0 typed, col1 completion from ({_values(_COMPLETIONS)})",
    "joined_output_order": "select c_custkey, o_orderkey, row_number() over (order by a.nr, b.nr) pos from (select *, row_number() over () nr from customer) a join (select *, row_number() over () nr from orders) b on c_custkey = o_custkey",
    "sorted_output_order": "select c_custkey, c_nationkey, row_number() over (order by c_nationkey desc, nr desc) pos from (select *, row_number() over () nr from customer)",
    "distinct_output_order": "select o_orderpriority, row_number() over (order by f) pos from (select o_orderpriority, min(nr) f from (select o_orderpriority, row_number() over () nr from orders) group by 1)",
    "group_output_order": "select l_suppkey, n, row_number() over (order by l_suppkey) pos from (select l_suppkey, count(*) n from lineitem group by 1)",
    "unnest_output_order": "select w[i] as word, p_partkey, row_number() over (order by nr, i) pos from (select *, unnest(range(1, len(w) + 1)) i from (select p_partkey, string_split(p_name, ' ') w, row_number() over () nr from part))",
    "errors": f"select col0 as case, col1 category from ({_values([(k, _CATEGORY.get(k, 'query parsing')) for k in sorted(_BAD)])})",
    "error_hints": "select unnest(['second stage', 'call like(', 'FROM isn''t needed']) word, true named",
    "missing_join_key": "select 'ragged' kind, 'query execution' result union all select 'whole', count(*)::varchar from region",
    "header_mismatch": "select unnest(['header', 'bare']) as case, 'query parsing' category",
    "lint_widths": """
with p as (select row_number() over () nr, (1 + length(p_name) - length(replace(p_name, ' ', '')))::int + ((row_number() over ()) % 10 = 0)::int w, p_size % 2 = 1 spaced from part)
select w::int width, min(nr) first_record, (select min(nr) from p where spaced) first_spaced, (select count(*) from p) n_records from p group by w""",
    "detect_by_head": "select s sep, s count_delim, p count_policy, s width_delim, p width_policy, p default_policy from (values (chr(9), 'simple'), (',', 'quoted'), (';', 'quoted'), ('|', 'simple')) v(s, p)",
    "display_widths": "select n_nationkey, length(n_name) + case n_regionkey when 1 then 4 when 2 then 1 else 0 end width from nation",
    "comments_put_back": "select row_number() over () ln, case when n_regionkey = 4 then '# ' || n_name else lower(n_name) end line from nation",
    "head_and_tail": """
with l as (select row_number() over () nr, o_orderkey || ',' || o_custkey line from orders),
s as (select *, sum(length(line) + 1) over (order by nr) h, sum(length(line) + 1) over (order by nr desc) t from l)
select 'head' side, row_number() over (order by nr) - 1 place, line from s where h <= 60
union all select 'tail', row_number() over (order by nr) - 1, line from s where t <= 60""",
    "sampling_scan": "select nr, substr(c_name, 1, 12) as name from (select row_number() over () nr, c_name from customer) where nr <= 15",
    "markdown_export": """
with w as (select greatest(max(length(r_regionkey::varchar)), 11) a, greatest(max(length(r_name)), 6) b from region)
select '| ' || rpad(x, a::int, ' ') || ' | ' || rpad(y, b::int, ' ') || ' |' line from w, (select 'r_regionkey' x, 'r_name' y union all select r_regionkey::varchar, r_name from region)
union all select '| ' || repeat('-', a::int) || ' | ' || repeat('-', b::int) || ' |' from w""",
    "custom_source_and_sink": "select k, k * k - 1 as less from range(100) r(k) where k % 7 = 0",
    "header_switched_twice": 'select r_name, row_number() over () "NR" from region',
    "json_round_trip": "select n_name as name from nation",
}
