"""Engine: queries over tables, DataFrames, rows, pandas, delimited files, JSON lines and SQLite."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .errors import QueryParsingError, with_hints
from .lang.clauses import clean, parse_stage, split_stages
from .lang.udf import load_functions, make_fallback, user_function
from .plans.builder import Options, build
from .plans.table import Table, from_dataframe, from_parquet, from_rows


@dataclass
class Result:
    df: DataFrame
    header: list[str] | None
    warnings: list[str]
    table: Table

    def rows(self) -> list[list]:
        return [list(r) for r in self.df.collect()]


@dataclass
class Engine:
    """dialect: python or js. ordered: results come in the reference order even where that costs a sort of its own.

    functions: Python functions for queries, plain or with a Spark type as (function, type). init_source: Python
    code whose functions become available. allow_fallback: expressions without a column form run as Python
    functions. bare_names: header names are variables. strict_nulls: numeric aggregates fail on nulls.
    """

    spark: SparkSession
    dialect: str = "python"
    ordered: bool = True
    bare_names: bool = False
    strict_nulls: bool = False
    allow_fallback: bool = True
    functions: dict[str, Callable] = field(default_factory=dict)
    init_source: str = ""

    def _options(self) -> Options:
        known = {k: user_function(*v) if isinstance(v, tuple) else user_function(v) for k, v in self.functions.items()}
        if self.init_source:
            known |= load_functions(self.init_source)[0]
        return Options(self.dialect, self.bare_names, self.strict_nulls, self.ordered, known, make_fallback(self.init_source) if self.allow_fallback else None)

    def as_table(self, source: Table | DataFrame | str) -> Table:
        """A Table as it is, a DataFrame with its names as header, or a path or catalog name."""
        if isinstance(source, Table):
            return source
        if isinstance(source, str):
            return from_parquet(self.spark, source) if source.endswith(".parquet") or "/" in source else from_dataframe(self.spark.table(source))
        return from_dataframe(source)

    def query(self, text: str, table: Table | DataFrame | str | None = None, joins: dict | Table | DataFrame | str | None = None) -> Result:
        """Run a query; its stages, split by '|', feed each other. joins: tables by name, or the one table 'b'."""
        try:
            return self._query(text, table, joins)
        except (QueryParsingError, SyntaxError) as e:
            raise with_hints(e, text) from e

    def _query(self, text: str, table: Table | DataFrame | str | None, joins: dict | Table | DataFrame | str | None) -> Result:
        options = self._options()
        known = joins if isinstance(joins, dict) else {} if joins is None else {"b": joins, "B": joins}
        current = self.as_table(table) if table is not None else None
        for stage in split_stages(clean(text, self.dialect), self.dialect):
            spec = parse_stage(stage, self.dialect)
            if spec.source is not None and not (current is not None and spec.source == "a"):
                if current is not None and spec.source not in known:
                    raise QueryParsingError("FROM can't be used when the input table is given")
                current = self._find(spec.source, known)
            if current is None:
                raise QueryParsingError("The query needs an input table: FROM is missing")
            right = self._find(spec.join.table, known) if spec.join else None
            if spec.with_header is not None:
                from .sources.delimited import set_header

                current, right = set_header(current, spec.with_header), set_header(right, spec.with_header) if right else None
            current = build(spec, current, right, options)
        return Result(current.result(self.ordered), current.header, list(dict.fromkeys(current.warnings)), current)

    def _find(self, name: str, known: dict) -> Table:
        if name in known:
            return self.as_table(known[name])
        if name.lower() in known and self.dialect == "js":
            return self.as_table(known[name.lower()])
        if self.spark.catalog.tableExists(name):
            return from_dataframe(self.spark.table(name))
        raise QueryParsingError(f"Table '{name}' was not found")


def query_df(spark: SparkSession, text: str, df: DataFrame, joins=None, **options) -> DataFrame:
    return Engine(spark, **options).query(text, df, joins).df


def query_rows(spark: SparkSession, text: str, rows: list[list], header: list[str] | None = None, join_rows: list[list] | None = None, join_header: list[str] | None = None, **options) -> tuple[list[list], list[str] | None, list[str]]:
    """(records, header, warnings) of a query over lists."""
    joins = {k: from_rows(spark, join_rows, join_header) for k in ("b", "B")} if join_rows is not None else None
    result = Engine(spark, **options).query(text, from_rows(spark, rows, header), joins)
    return result.rows(), result.header, result.warnings


def query_pandas(spark: SparkSession, text: str, frame, join=None, **options):
    """A pandas frame from a query over pandas frames; a frame with default column labels has no header."""
    from .sources.memory import from_pandas

    joins = {k: from_pandas(spark, join) for k in ("b", "B")} if join is not None else None
    return Engine(spark, **options).query(text, from_pandas(spark, frame), joins).df.toPandas()


def query_csv(spark: SparkSession, text: str, input_path: str, dialect, output_path: str | None = None, output_dialect=None, join_paths: dict[str, str] | None = None, mode: str = "errorifexists", **options) -> Result:
    """A query over a delimited file; join tables are read in the same dialect. With an output path the result is
    written there, and what the format can't hold is added to the warnings."""
    from .sources.delimited import read_delimited, sink_warnings, write_delimited

    joins = {k: read_delimited(spark, p, dialect) for k, p in (join_paths or {}).items()}
    result = Engine(spark, **options).query(text, read_delimited(spark, input_path, dialect), joins)
    if joins and dialect.header:
        result.warnings.append("The first record of the join table was taken as its header")
    if output_path is not None:
        target = output_dialect or dialect
        result.warnings += sink_warnings(result.table, target)
        write_delimited(result.table, output_path, target, single_file=True, mode=mode)
    return result


def query_json(spark: SparkSession, text: str, input_path: str, output_path: str | None = None, mode: str = "errorifexists", **options) -> Result:
    """A query over JSON lines: `a` is the record's object."""
    from .sources.memory import read_json_lines, write_json_lines

    result = Engine(spark, **options).query(text, read_json_lines(spark, input_path))
    if output_path is not None:
        write_json_lines(result.table, output_path, mode)
    return result


def query_sqlite(spark: SparkSession, text: str, database: str, table: str, output_path: str | None = None, output_dialect=None, join_tables: tuple[str, ...] = (), mode: str = "errorifexists", **options) -> Result:
    """A query over a table of a SQLite database; other tables can be joined by their names."""
    from .sources.delimited import write_delimited
    from .sources.dialect import Dialect
    from .sources.memory import read_sqlite

    joins = {t: read_sqlite(spark, database, t) for t in join_tables}
    result = Engine(spark, **options).query(text, read_sqlite(spark, database, table), joins)
    if output_path is not None:
        write_delimited(result.table, output_path, output_dialect or Dialect(",", "quoted"), single_file=True, mode=mode)
    return result
