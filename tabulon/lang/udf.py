"""Python functions in queries: user functions by name, and the fallback for expressions without a column form."""

from __future__ import annotations

import ast
import copy
import inspect
import typing

from pyspark.sql import functions as F

from ..errors import QueryParsingError, UnsupportedExpression
from .names import Expr, kind_of
from .pyexpr import Compiler, referenced

_DDL = {int: "bigint", float: "double", str: "string", bool: "boolean"}


def return_type(fn) -> str | None:
    """Spark type of a function's return annotation."""
    try:
        hint = typing.get_type_hints(fn).get("return")
    except Exception:  # noqa: BLE001 - annotations are the user's
        hint = getattr(fn, "__annotations__", {}).get("return")
    if hint in _DDL:
        return _DDL[hint]
    if typing.get_origin(hint) is list and typing.get_args(hint)[0] in _DDL:
        return f"array<{_DDL[typing.get_args(hint)[0]]}>"
    return None


def is_vectorised(fn) -> bool:
    """Whether the function takes and gives whole pandas Series, by its annotations."""
    import pandas as pd

    hints = {k: v for k, v in getattr(fn, "__annotations__", {}).items() if k != "return"}
    return bool(hints) and all(v is pd.Series or str(v) in ("pd.Series", "pandas.Series") for v in hints.values())


def user_function(fn, ddl: str | None = None):
    """A callable on Exprs that runs a Python function over Arrow batches; unannotated results become strings.

    A function annotated to take pandas Series gets a batch at once, and must be given with its type.
    """
    declared = ddl or return_type(fn)
    if is_vectorised(fn) and ddl is None:
        raise QueryParsingError("A function on pandas Series must be given with its type, as (function, type)")

    def call(x):
        return None if x is None else str(x)

    target = fn if declared else (lambda *a: call(fn(*a)))
    wrapped = F.pandas_udf(lambda *a: fn(*a), declared, F.PandasUDFType.SCALAR) if is_vectorised(fn) else F.udf(target, declared or "string", useArrow=True)

    def apply(*args: Expr) -> Expr:
        from pyspark.sql.types import _parse_datatype_string

        kind, item = kind_of(_parse_datatype_string(declared or "string"))
        return Expr(wrapped(*[a.col for a in args]), kind, item, risky=True)

    return apply


def load_functions(source: str) -> tuple[dict, dict]:
    """Run initialisation code; its functions become user functions. Returns them and the whole namespace."""
    space: dict = {}
    exec(compile(source, "<init>", "exec"), space)  # noqa: S102 - the user's own code
    found = {k: user_function(v) for k, v in space.items() if inspect.isfunction(v)}
    return found, {k: v for k, v in space.items() if not k.startswith("__")}


class _Rename(ast.NodeTransformer):
    def __init__(self, to: dict[str, str]):
        self.to = to

    def visit(self, node: ast.AST) -> ast.AST:
        name = self.to.get(ast.dump(node))
        return ast.Name(name, ast.Load()) if name else self.generic_visit(node)


def make_fallback(init_source: str = ""):
    """A fallback that evaluates the expression's own source per record; booleans stay, all else becomes a string."""

    def fallback(node: ast.AST, compiler: Compiler) -> Expr:
        if compiler.dialect != "python":
            raise UnsupportedExpression("The expression has no column form in this dialect")
        used: dict[str, Expr] = {}
        for x, e in referenced(node, compiler.names):
            used.setdefault(ast.dump(x), e)
        to = {k: f"v{i}_" for i, k in enumerate(used)}
        source = ast.unparse(ast.fix_missing_locations(_Rename(to).visit(copy.deepcopy(node))))
        text = f"lambda {', '.join(to.values())}: ({source})"
        truth = isinstance(node, (ast.Compare, ast.BoolOp)) or (isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not))
        try:
            compile(text, "<expression>", "eval")
        except SyntaxError as e:
            raise QueryParsingError(f"Unable to parse '{source}': {e.msg}") from None
        held: list = []

        def run(*args):
            if not held:
                space: dict = {}
                exec("import re, math, random, datetime, json\n" + init_source, space)  # noqa: S102 - the user's own code
                held.append(eval(text, space))  # noqa: S307
            out = held[0](*args)
            return bool(out) if truth else None if out is None else str(out)

        cols = [e.col for e in used.values()] or [F.lit(1)]
        target = run if used else (lambda _: run())
        return Expr(F.udf(target, "boolean" if truth else "string", useArrow=True)(*cols), "bool" if truth else "str", risky=True)

    return fallback
