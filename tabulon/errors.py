"""Error categories."""

from __future__ import annotations

import re


class TabulonError(Exception):
    """Base of all errors of this engine."""

    category = "unexpected"


class QueryParsingError(TabulonError):
    category = "query parsing"


class QueryExecutionError(TabulonError):
    category = "query execution"


class IOHandlingError(TabulonError):
    category = "IO handling"


class UnsupportedExpression(QueryParsingError):
    """The expression has no column form; a Python function may stand in."""


#: What to write instead of a keyword that the language lacks.
HINTS = (
    (r"\bhaving\b", "There is no HAVING: filter the groups in a second stage, as in SELECT a1, COUNT(*) AS n GROUP BY a1 | SELECT * WHERE a.n > 1"),
    (r"\blike\s+['\"]", "There is no LIKE operator: call like(a1, 'x%')"),
    (r"\bfrom\b", "FROM isn't needed where the input table is given with the query"),
)


def with_hints(exc: BaseException, query: str) -> BaseException:
    """A parsing error whose message also tells what stands in for keywords of other dialects in the query."""
    found = [hint for pattern, hint in HINTS if re.search(pattern, query, re.I)]
    if not found or not isinstance(exc, (QueryParsingError, SyntaxError)):
        return exc
    return QueryParsingError("\n".join([str(exc), *found]))


def error_info(exc: BaseException) -> tuple[str, str]:
    """(category, message) of an exception; Spark's runtime errors count as query execution."""
    if isinstance(exc, TabulonError):
        return exc.category, str(exc)
    if isinstance(exc, SyntaxError):
        return "syntax error", str(exc)
    if type(exc).__module__.startswith(("pyspark", "py4j")) or "Spark" in type(exc).__name__:
        return "query execution", str(exc).split("\n", 1)[0]
    return "unexpected", str(exc)
