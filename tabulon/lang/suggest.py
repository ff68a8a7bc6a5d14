"""Completions for a query that is being typed, and a notebook magic."""

from __future__ import annotations

import re

KEYWORDS = ("SELECT", "UPDATE", "SET", "TOP", "DISTINCT", "COUNT", "WHERE", "ORDER BY", "GROUP BY", "LIMIT", "EXCEPT", "FROM", "JOIN", "INNER JOIN", "LEFT JOIN", "STRICT LEFT JOIN", "ON", "AND", "ASC", "DESC", "WITH (header)", "WITH (noheader)")
AGGREGATES = ("COUNT(", "SUM(", "MIN(", "MAX(", "AVG(", "VARIANCE(", "MEDIAN(", "ANY_VALUE(", "ARRAY_AGG(", "UNNEST(")


def variables(header: list[str] | None, width: int, prefix: str = "a") -> list[str]:
    """Every way to name the columns of a table: positions, attributes where the name allows, keys."""
    out = [f"{prefix}{i + 1}" for i in range(width)]
    for name in header or []:
        if re.fullmatch(r"[A-Za-z_]\w*", name):
            out.append(f"{prefix}.{name}")
        out.append(f'{prefix}["' + name.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"]')
    return [*out, "NR" if prefix == "a" else "bNR", "NF" if prefix == "a" else "bNF"]


def suggest(text: str, header: list[str] | None, width: int, join_header: list[str] | None = None, join_width: int = 0) -> list[str]:
    """Completions of the last word: variables first, then aggregates and keywords."""
    word = re.search(r"[\w.\[\"']*$", text)[0]
    known = variables(header, width) + (variables(join_header, join_width, "b") if join_width else [])
    known += [*AGGREGATES, *KEYWORDS]
    return [x for x in known if x.lower().startswith(word.lower()) and x != word] if word else known


def load_ipython_extension(shell) -> None:
    """%tabulon SELECT ... FROM name: the tables are DataFrames of the notebook, its functions are udf.name."""
    import inspect

    from pyspark.sql import DataFrame, SparkSession

    from ..api import Engine
    from ..errors import error_info

    def run(line: str):
        space = shell.user_ns
        tables = {k: v for k, v in space.items() if isinstance(v, DataFrame)}
        functions = {k: v for k, v in space.items() if inspect.isfunction(v) and re.search(rf"\budf\.{k}\b", line)}
        try:
            return Engine(SparkSession.active(), functions=functions).query(line, None, tables).df.toPandas()
        except Exception as e:  # noqa: BLE001 - shown to the user
            print("Error [{}]: {}".format(*error_info(e)))

    shell.register_magic_function(run, "line", "tabulon")
