"""Command line: python -m tabulon --query ... --input FILE [--delim D --policy P] [csv|sqlite|json]; without a query, a shell."""

from __future__ import annotations

import argparse
import os
import sys
import tempfile

from pyspark.sql import SparkSession

from .api import Engine
from .errors import IOHandlingError, error_info
from .plans.table import Table
from .shell import coloured, result_path, run_shell, write_template
from .sources.delimited import read_delimited, sink_warnings, to_text
from .sources.dialect import Dialect, default_policy, detect_by_width, named_format
from .sources.memory import read_json_lines, read_sqlite


def resolve_table(name: str, near: str | None) -> str:
    """A join table's path: as given (with ~), beside the main table, or by the index file of table names."""
    for path in (os.path.expanduser(name), os.path.join(os.path.dirname(near or ""), name)):
        if os.path.exists(path):
            return path
    index = os.path.expanduser("~/.tabulon_tables")
    if os.path.exists(index):
        for line in open(index, encoding="utf-8"):
            key, _, path = line.rstrip("\n").partition("\t")
            if key == name:
                return path
    raise IOHandlingError(f"Unable to find the join table '{name}'")


def _print(t: Table, header: list[str] | None, d: Dialect, out, colour: bool = False) -> None:
    import csv

    df = t.result(ordered=True)
    texts = df.select(*[to_text(df[c], ty.dataType).alias(c) for c, ty in zip(df.columns, df.schema.fields)])
    quoted = d.policy.startswith("quoted")
    write = csv.writer(out, delimiter=d.delim or "\x1f", lineterminator="\n", quoting=csv.QUOTE_MINIMAL if quoted else csv.QUOTE_NONE, escapechar=None if quoted else "\x00", quotechar='"')
    rows = ([*r] for r in texts.toLocalIterator())
    try:
        if colour:
            for r in ([header] if header else []):
                out.write(coloured(r, d.delim or " ") + "\n")
            for r in rows:
                out.write(coloured(r, d.delim or " ") + "\n")
            return
        for r in ([header] if header else []):
            write.writerow(r) if quoted else out.write(d.delim.join(r) + "\n")
        for r in rows:
            write.writerow(r) if quoted else out.write(d.delim.join(r) + "\n")
    except BrokenPipeError:
        pass


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("tabulon")
    p.add_argument("mode", nargs="?", default="csv", choices=["csv", "json", "sqlite", "parquet"])
    p.add_argument("--query", "-q", help="without one, queries are asked for")
    p.add_argument("--input", "-i")
    p.add_argument("--output", "-o")
    p.add_argument("--delim", "-d")
    p.add_argument("--policy")
    p.add_argument("--with-headers", action="store_true")
    p.add_argument("--out-format", default="input")
    p.add_argument("--encoding", default="utf-8")
    p.add_argument("--comment-prefix")
    p.add_argument("--table")
    p.add_argument("--dialect", default="python", choices=["python", "js"])
    p.add_argument("--init-source-file")
    p.add_argument("--new-init-source-file", help="make a file for functions of your own, and end")
    p.add_argument("--color", action="store_true", help="a colour a column in what is printed")
    p.add_argument("--strip-spaces", action="store_true")
    p.add_argument("--comment-regex")
    args = p.parse_args(argv)
    if args.new_init_source_file:
        print("made" if write_template(args.new_init_source_file) else "The file exists")
        return 0
    if args.color and (args.output or not args.query):
        p.error("--color is for printed results")
    if args.policy and args.delim is None and args.policy != "monocolumn":
        p.error("--policy needs --delim")
    if not args.query and not args.input:
        p.error("the shell needs --input")
    spark = SparkSession.builder.appName("tabulon").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        path = args.input
        if path is None:
            with tempfile.NamedTemporaryFile("w", suffix=".txt", delete=False, encoding="utf-8") as f:
                f.write(sys.stdin.read())
                path = f.name
        d = named_format("csv")
        if args.mode == "json":
            table = read_json_lines(spark, path)
        elif args.mode == "sqlite":
            table = read_sqlite(spark, path, args.table or "")
        elif args.mode == "parquet":
            from .plans.table import from_parquet

            table = from_parquet(spark, path)
        else:
            delim = {"TAB": "\t", r"\t": "\t"}.get(args.delim, args.delim)
            if delim is None:
                with open(path, encoding=args.encoding) as f:
                    d = detect_by_width([line.rstrip("\r\n") for _, line in zip(range(10), f)], path) or named_format("monocolumn")
            else:
                d = Dialect(delim, args.policy or default_policy(delim))
            d = d.but(header=args.with_headers, encoding=args.encoding, comment_prefix=args.comment_prefix, comment_regex=args.comment_regex, strip_fields=args.strip_spaces)
            table = read_delimited(spark, path, d)
        init = open(args.init_source_file, encoding="utf-8").read() if args.init_source_file else ""
        engine = Engine(spark, dialect=args.dialect, init_source=init)
        out_d = named_format(args.out_format, d)
        if not args.query:
            return _shell(spark, engine, table, d, out_d, path, args.output or result_path(path, out_d.delim), args.encoding)
        result = engine.query(args.query, table, _Joins(spark, d, path))
        for w in result.warnings + sink_warnings(result.table, out_d):
            print(f"Warning: {w}", file=sys.stderr)
        with open(args.output, "w", encoding=args.encoding) if args.output else sys.stdout as out:
            _print(result.table, result.header, out_d, out, args.color)
        return 0
    except Exception as e:  # noqa: BLE001 - reported by category
        kind, message = error_info(e)
        print(f"Error [{kind}]: {message}", file=sys.stderr)
        return 1


def _shell(spark: SparkSession, engine: Engine, table: Table, d: Dialect, out_d: Dialect, path: str, output: str, encoding: str) -> int:
    def ask(prompt: str, complete) -> str:
        try:
            import readline

            readline.set_completer(lambda word, n: [*complete(readline.get_line_buffer()), None][n])
            readline.set_completer_delims(" ,()")
            readline.parse_and_bind("tab: complete")
        except ImportError:  # no completion on this platform
            pass
        return input(prompt)

    def run(query: str, to: str) -> Table:
        result = engine.query(query, table, _Joins(spark, d, path))
        with open(to, "w", encoding=encoding) as out:
            _print(result.table, result.header, out_d, out)
        return result.table

    run_shell(spark, table, d, output, ask, print, run)
    return 0


class _Joins(dict):
    """Join tables by path, read with the main table's dialect."""

    def __init__(self, spark: SparkSession, d: Dialect, near: str):
        super().__init__()
        self.spark, self.dialect, self.near = spark, d, near

    def __contains__(self, name) -> bool:
        return True

    def __getitem__(self, name):
        return read_delimited(self.spark, resolve_table(name, self.near), self.dialect)


if __name__ == "__main__":
    sys.exit(main())
