"""Aggregates. String arguments are numbers in text form and fail the query if they aren't."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryParsingError
from ..functions.scalar import strip
from ..lang.names import Expr

NAMES = ("COUNT", "MIN", "MAX", "SUM", "AVG", "VARIANCE", "MEDIAN", "ANY_VALUE", "ARRAY_AGG", "FOLD")


def canonical(name: str) -> str | None:
    """The aggregate that a function name means: all upper, all lower or capitalised; FOLD is ARRAY_AGG."""
    upper = name.upper()
    if upper in NAMES and name in (upper, name.lower(), name.capitalize()):
        return "ARRAY_AGG" if upper == "FOLD" else upper
    return None


def numeric(e: Expr) -> Column:
    if e.kind == "str":
        return strip(e.col).cast("double")
    if e.kind == "bool":
        return e.col.cast("bigint")
    if e.kind in ("variant", "any"):
        return e.col.cast("double")
    if e.kind in ("int", "float", "null"):
        return e.col
    raise QueryParsingError(f"A numeric aggregate can't take {e.kind}")


def in_order(e: Expr, order: list[Column]) -> Column:
    """All values as an array in record order, nulls kept."""
    pairs = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], e.col.alias("x"))))
    return F.transform(pairs, lambda p: p["x"])


def aggregate(name: str, e: Expr, order: list[Column], strict: bool = False) -> Expr:
    """order: columns of the record order. strict: nulls in numeric aggregates fail the query."""
    if name == "COUNT":
        return Expr(F.count(F.lit(1)), "int")
    if name == "ANY_VALUE":
        return Expr(F.min_by(e.col, order[0] if len(order) == 1 else F.struct(*order)), e.kind, e.item, dtype=e.dtype)
    if name == "ARRAY_AGG":
        return Expr(in_order(e, order), "array", e.kind)
    if e.kind == "ts" and name in ("MIN", "MAX"):
        return Expr({"MIN": F.min, "MAX": F.max}[name](e.col), "ts", dtype=e.dtype)
    x = numeric(e)
    if strict:
        x = F.when(x.isNull(), F.raise_error(F.lit(f"{name} of a missing value")).cast("double")).otherwise(x)
    whole = "int" if e.kind in ("int", "bool") else "float"
    if name in ("MIN", "MAX", "SUM"):
        return Expr({"MIN": F.min, "MAX": F.max, "SUM": F.sum}[name](x), whole)
    fn = {"AVG": F.avg, "VARIANCE": F.var_pop, "MEDIAN": F.median}[name]
    return Expr(fn(x), "float")


def constant(e: Expr, label: str) -> Expr:
    """The value of an expression that must not vary within a group."""
    if e.kind in ("array", "map", "struct", "variant", "any"):
        return Expr(F.first(e.col), e.kind, e.item, dtype=e.dtype)
    same = (F.count(e.col) == 0) | ((F.count(e.col) == F.count(F.lit(1))) & F.min(e.col).eqNullSafe(F.max(e.col)))
    fail = F.raise_error(F.lit(f"'{label}' has several values within a group; aggregate it or group by it"))
    return Expr(F.when(same, F.min(e.col)).otherwise(fail), e.kind, dtype=e.dtype)
