"""Named queries over sources, sinks, quality tools and streams, each on files made from the sample tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Engine
from .plans.table import NUMBER, Table, from_dataframe, from_parquet
from .quality import tools
from .sources.delimited import detect_file, read_delimited, table_of_lines, write_delimited
from .sources.dialect import Dialect
from .sources.memory import from_pandas, read_json_lines, write_json_lines
from .sources.scratch import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return from_parquet(spark, f"{sf_dir}/{name}.parquet").numbered()


def _round_trip(spark: SparkSession, t: Table, d: Dialect) -> Table:
    path = scratch_path(spark, "csv")
    write_delimited(t, path, d, single_file=False)
    return read_delimited(spark, path, d)


def csv_roundtrip_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _round_trip(spark, _table(spark, sf_dir, "events"), Dialect(",", "quoted", header=True))
    return Engine(spark, ordered=False).query("SELECT int(a.event_id) AS event_id, a.event_type, a.props, float(a.value) AS value", t).df


def csv_rfc_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _round_trip(spark, _table(spark, sf_dir, "documents"), Dialect(",", "quoted_rfc", header=True))
    return Engine(spark, ordered=False).query("SELECT int(a.doc_id) AS doc_id, a.text, a.lang", t).df


def csv_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _round_trip(spark, _table(spark, sf_dir, "nation"), Dialect("|", "simple", header=True))
    lines = t.df.select(F.lit("f").alias("file"), F.col(NUMBER).alias("at"), F.concat_ws("   ", *t.columns).alias("line"))
    w = table_of_lines(lines, Dialect(" ", "whitespace"))
    return Engine(spark, ordered=False).query("SELECT int(a1) AS n_nationkey, a2 AS n_name, NF", w).df


def csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "part").ordered()
    lines = t.df.select(F.lit("f").alias("file"), F.col(NUMBER).alias("at"), F.replace(F.col(t.columns[1]), F.lit(" "), F.lit(",")).alias("line"))
    ragged = table_of_lines(lines, Dialect(",", "simple"))
    return Engine(spark, ordered=False).query("SELECT NR, NF, a1 AS word, a9 AS ninth WHERE NF >= 1", ragged).df


def csv_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _round_trip(spark, _table(spark, sf_dir, "customer"), Dialect("\t", "simple", header=True))
    return Engine(spark, ordered=False).query("SELECT a.c_mktsegment, SUM(a.c_custkey) AS s, COUNT(*) AS n GROUP BY a.c_mktsegment", t).df


def csv_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "nation")
    lines = t.df.select(F.lit("f").alias("file"), F.col(NUMBER).alias("at"), F.concat(F.when(F.col(t.columns[2]) == 1, F.lit("#")).otherwise(""), F.concat_ws(",", t.columns[0], t.columns[1])).alias("line"))
    return Engine(spark, ordered=False).query("SELECT NR, int(a1) AS k, a2 AS name", table_of_lines(lines, Dialect(",", "quoted", comment_prefix="#"))).df


def jsonl_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "json")
    spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.expr("from_json(props, 'k int')").alias("p")).write.json(path)
    return Engine(spark, ordered=False).query("SELECT int(a.event_id) AS event_id, int(a['p']['k']) AS k WHERE a.event_type == 'click'", read_json_lines(spark, path)).df


def jsonl_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "json")
    result = Engine(spark, ordered=False).query("SELECT a.n_nationkey, a.n_name", _table(spark, sf_dir, "nation"))
    write_json_lines(result.table, path)
    return spark.read.text(path)


def pandas_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every supplier is counted before the driver: the frame has a row a nation, whatever the number of suppliers
    frame = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy("s_nationkey").count().toPandas()
    return Engine(spark, ordered=False).query("SELECT a.s_nationkey, SUM(a['count']) AS n GROUP BY a.s_nationkey", from_pandas(spark, frame)).df


def sqlite_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    import sqlite3

    from .sources.memory import read_sqlite

    path = scratch_path(spark, "sqlite").removeprefix("file:") + ".db"  # the executors read it too
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()]
    with sqlite3.connect(path) as c:
        c.execute("create table nation (n_nationkey integer, n_name text, n_regionkey integer)")
        c.executemany("insert into nation values (?, ?, ?)", rows)
    return Engine(spark, ordered=False).query("SELECT a.n_name, a.n_regionkey WHERE a.n_regionkey > 1", read_sqlite(spark, path, "nation")).df


def lint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    d = Dialect(",", "quoted", header=True)
    write_delimited(_table(spark, sf_dir, "orders"), path, d)
    r = tools.lint_file(spark, path, d)
    return spark.createDataFrame([(r.ok, r.n_records, r.widths[0][0])], "ok boolean, n_records long, width long")


def detect_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    write_delimited(_table(spark, sf_dir, "customer"), path, Dialect(";", "quoted", header=True))
    d = detect_file(spark, path)
    return spark.createDataFrame([(d.delim, d.policy)], "delim string, policy string")


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "part")
    return tools.column_stats(t).select("index", "name", "max_width", "is_numeric", "only_ascii")


def align_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "nation")
    return tools.align(Table(t.df, t.columns, None, t.order, t.nr), Dialect(",")).select("line")


def shrink_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("  "), "n_name", F.lit(" ")).alias("n_name"), F.lpad("n_name", 30, " ").alias("padded"))
    return tools.shrink(from_dataframe(padded)).result()


def tsv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.tsv(_table(spark, sf_dir, "nation")).select("line")


def preview_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tools.preview(_table(spark, sf_dir, "documents"), 10, 20, 40)
    return t.select(F.col(NUMBER).alias("nr"), F.col("c2").alias("text"))


def stream_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.query import query_stream

    path, out = scratch_path(spark, "stream"), scratch_path(spark, "stream-out")
    base = spark.read.parquet(f"{sf_dir}/events.parquet")
    base.select("event_id", "event_type", "value").write.parquet(path)
    stream = spark.readStream.schema("event_id long, event_type string, value double").parquet(path)
    q = query_stream(spark, "SELECT a.event_id, a.value * 2 AS twice WHERE a.event_type == 'click'", stream)
    q.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def stream_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.query import query_stream

    path = scratch_path(spark, "stream")
    spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type").write.parquet(path)
    stream = spark.readStream.schema("event_id long, event_type string").parquet(path)
    name = "stream_" + path.rsplit("-", 1)[1]
    q = query_stream(spark, "SELECT a.event_type, COUNT(*) AS n GROUP BY a.event_type", stream)
    q.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def js_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT a.p_partkey, a.p_size * 10 + '!' AS x, a.p_name.toUpperCase().length AS n, a.p_size > 25 ? 'big' : 'small' AS s WHERE a.p_brand.indexOf('1') > -1 && a.p_size % 2 === 0"
    return Engine(spark, dialect="js", ordered=False).query(text, _table(spark, sf_dir, "part")).df


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    csv_roundtrip_quoted, csv_rfc_multiline, csv_whitespace, csv_ragged, csv_tsv, csv_comments, jsonl_query, jsonl_write, pandas_source, sqlite_source,
    lint_report, detect_dialect, column_stats, align_table, shrink_table, tsv_export, preview_window, stream_select, stream_group, js_dialect,
)}

_PARTS = [("p_partkey", 1), ("p_name", 2), ("p_brand", 3), ("p_type", 4), ("p_size", 5)]
_STAT = "select {i}::int as index, '{c}' as name, max(length({c}::varchar))::int max_width, bool_and(regexp_matches({c}::varchar, '^[0-9]+([.][0-9]+)?$')) is_numeric, true only_ascii from part"

SQL: dict[str, str] = {
    "csv_roundtrip_quoted": "select event_id, event_type, props, value from events",
    "csv_rfc_multiline": "select doc_id, text, lang from documents",
    "csv_whitespace": 'select n_nationkey::bigint n_nationkey, n_name, 3::bigint "NF" from nation where n_name not like \'% %\'',
    "csv_ragged": "select row_number() over () \"NR\", len(string_split(p_name, ' '))::bigint \"NF\", string_split(p_name, ' ')[1] word, null::varchar ninth from part",
    "csv_tsv": "select c_mktsegment, sum(c_custkey)::double s, count(*) n from customer group by 1",
    "csv_comments": 'select row_number() over () "NR", n_nationkey::bigint k, n_name as name from nation where n_regionkey <> 1',
    "jsonl_query": "select event_id, (props::json ->> 'k')::bigint k from events where event_type = 'click'",
    "jsonl_write": "select '[' || n_nationkey || ', \"' || n_name || '\"]' as value from nation",
    "pandas_source": "select s_nationkey, count(*) n from supplier group by 1",
    "sqlite_source": "select n_name, n_regionkey::bigint n_regionkey from nation where n_regionkey > 1",
    "lint_report": "select true ok, count(*) + 1 n_records, 6::bigint width from orders",
    "detect_dialect": "select ';' delim, 'quoted' as policy",
    "column_stats": " union all ".join(_STAT.format(i=i, c=c) for c, i in _PARTS) + " union all select 6::int, 'p_retailprice', max(length(p_retailprice::varchar))::int, true, true from part",
    "align_table": "with w as (select max(length(n_nationkey::varchar)) a, max(length(n_name)) b, max(length(n_regionkey::varchar)) c from nation) select lpad(n_nationkey::varchar, a::int, ' ') || ', ' || rpad(n_name, b::int, ' ') || ', ' || lpad(n_regionkey::varchar, c::int, ' ') line from nation, w",
    "shrink_table": "select n_name, n_name padded from nation",
    "tsv_export": "select n_nationkey || chr(9) || n_name || chr(9) || n_regionkey line from nation",
    "preview_window": "select nr, substr(text, 1, 40) as text from (select row_number() over () nr, text from documents) where nr between 11 and 30",
    "stream_select": "select event_id, value * 2 twice from events where event_type = 'click'",
    "stream_group": "select event_type, count(*) n from events group by 1",
    "js_dialect": "select p_partkey, p_size * 10 || '!' x, length(p_name)::bigint n, case when p_size > 25 then 'big' else 'small' end s from part where contains(p_brand, '1') and p_size % 2 = 0",
}
