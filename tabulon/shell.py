"""The interactive command line: a coloured preview, queries one after another, a history, and names for results."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import SparkSession

from .errors import IOHandlingError, error_info
from .lang.suggest import suggest
from .plans.table import Table
from .sources.delimited import to_text
from .sources.dialect import Dialect

HISTORY_LENGTH = 20
PREVIEW = 10  # records
#: Terminal colours, by column in turn (plain, the dark colours, then bright ones), and their end.
COLOURS = ("\x1b[0m", "\x1b[31m", "\x1b[32m", "\x1b[33m", "\x1b[34m", "\x1b[35m", "\x1b[36m", "\x1b[31;1m", "\x1b[32;1m", "\x1b[33;1m")
END = "\x1b[0m"
#: Endings of result files by separator.
ENDINGS = {",": ".csv", "\t": ".tsv"}
TEMPLATE = '''# Functions that are defined here can be called in queries. A return type saves a conversion to text:
#
# def initials(name: str) -> str:
#     return "".join(word[0] for word in name.split())
#
# select a1, initials(a.name)
'''


def result_path(input_path: str, delim: str) -> str:
    """Where a result goes if the user names no file: beside the input, with the ending of its format."""
    return input_path + ENDINGS.get(delim, ".txt")


def coloured(fields: Iterable[str], delim: str, *, names: bool = False) -> str:
    """A record with a colour a column; names: each field under its positional name."""
    shown = (f"{COLOURS[i % len(COLOURS)]}{f'a{i + 1}:' if names else ''}{f}" for i, f in enumerate(fields))
    return delim.join(shown) + END


class History:
    """The last queries, the newest first, each once."""

    def __init__(self, path: str = "~/.tabulon_history"):
        self.path = Path(os.path.expanduser(path))

    def read(self) -> list[str]:
        return self.path.read_text(encoding="utf-8").split("\0")[:HISTORY_LENGTH] if self.path.exists() and self.path.stat().st_size else []

    def add(self, query: str) -> None:
        kept = [query, *(q for q in self.read() if q != query)][:HISTORY_LENGTH]
        self.path.write_text("\0".join(kept), encoding="utf-8")


def write_template(path: str) -> bool:
    """Make a file for user functions unless there is one; whether it was made."""
    target = Path(os.path.expanduser(path))
    if target.exists():
        return False
    target.write_text(TEMPLATE, encoding="utf-8")
    return True


def texts(t: Table, limit: int) -> list[list[str]]:
    df = t.result(ordered=True)
    return [list(r) for r in df.select(*[to_text(df[f"`{c}`"], f.dataType).alias(c) for c, f in zip(df.columns, df.schema.fields, strict=True)]).limit(limit).collect()]


def preview(t: Table, d: Dialect, out: Callable[[str], None]) -> None:
    out("Input table:")
    if t.header:
        out(coloured(t.header, d.delim or " ", names=True))
    for r in texts(t, PREVIEW):
        out(coloured(r, d.delim or " ", names=not t.header))


def run_shell(spark: SparkSession, table: Table, d: Dialect, output: str, ask: Callable[[str, Callable[[str], list[str]]], str], out: Callable[[str], None], run: Callable[[str, str], Table], history: History | None = None) -> int:
    """Ask for queries until there is none, write each result to output and show its head. Returns the number that ran.

    ask: gets the prompt and a function that completes what was typed. run: writes a query's result and returns it.
    """
    history = history or History()
    preview(table, d, out)
    out(f"Results go to {output}")
    done = 0
    complete = lambda typed: suggest(typed, table.header, len(table.columns))
    while True:
        try:
            query = ask("query (or history, or quit)> ", complete).strip()
        except EOFError:
            return done
        if query in ("", "quit", "exit"):
            return done
        if query == "history":
            for n, q in enumerate(history.read(), 1):
                out(f"{n}: {q}")
            continue
        history.add(query)
        try:
            result = run(query, output)
            for r in ([result.header] if result.header else []) + texts(result, PREVIEW):
                out(coloured(r, d.delim or " "))
            out(f"The result is in {output}")
            done += 1
        except IOHandlingError as e:
            out(f"Error [IO handling]: {e}")
        except Exception as e:  # noqa: BLE001 - shown by category, and the shell goes on
            out("Error [{}]: {}".format(*error_info(e)))
