"""Variables of the query language: a1, a[1], a.name, a["name"], NR, NF and the b forms."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryParsingError


@dataclass
class Expr:
    """A compiled expression: a column, its static kind, and for arrays the kind of the elements.

    risky: evaluating it may raise, so boolean operators must not reorder it.
    """

    col: Column
    kind: str  # str int float bool null array ts map struct variant any
    item: str | None = None
    risky: bool = False
    name: str | None = None  # output name, if it has one of its own
    dtype: T.DataType | None = None


def kind_of(t: T.DataType) -> tuple[str, str | None]:
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "str", None
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int", None
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float", None
    if isinstance(t, T.BooleanType):
        return "bool", None
    if isinstance(t, T.ArrayType):
        return "array", kind_of(t.elementType)[0]
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "ts", None
    if isinstance(t, T.MapType):
        return "map", kind_of(t.valueType)[0]
    if isinstance(t, T.StructType):
        return "struct", None
    if isinstance(t, T.VariantType):
        return "variant", None
    return ("null", None) if isinstance(t, T.NullType) else ("any", None)


@dataclass
class Side:
    """What a prefix (a or b) resolves to."""

    prefix: str
    columns: list[str]  # internal column names, by position
    types: list[T.DataType]
    header: list[str] | None
    nr: str | None = None  # column of the record number, if numbered
    nf: Column | None = None
    ragged: bool = False  # whether records may be shorter than the table is wide


class Names:
    def __init__(self, a: Side, b: Side | None = None, bare: bool = False):
        self.sides = {"a": a} | ({"b": b} if b else {})
        self.bare = bare
        if bare and b and a.header and b.header and set(a.header) & set(b.header):
            self.ambiguous = set(a.header) & set(b.header)
        else:
            self.ambiguous = set()

    def _field(self, side: Side, i: int, name: str | None = None) -> Expr:
        if i < 0 or i >= len(side.columns):
            return Expr(F.lit(None), "null", name=name)
        kind, item = kind_of(side.types[i])
        header = side.header[i] if side.header else None
        return Expr(F.col(side.columns[i]), kind, item, name=name or header, dtype=side.types[i])

    def position(self, prefix: str, n: int) -> Expr:
        return self._field(self._side(prefix), n - 1)

    def _side(self, prefix: str) -> Side:
        if prefix not in self.sides:
            raise QueryParsingError(f"Table '{prefix}' is not available: the query has no JOIN")
        return self.sides[prefix]

    def named(self, prefix: str, name: str) -> Expr:
        side = self._side(prefix)
        if name == "NR":
            return self.special(prefix, "NR")
        if name == "NF":
            return self.special(prefix, "NF")
        if side.header is None or name not in side.header:
            raise QueryParsingError(f"Unable to find column '{name}' in table '{prefix}'")
        return self._field(side, side.header.index(name), name)

    def special(self, prefix: str, what: str) -> Expr:
        side = self._side(prefix)
        if what == "NR":
            if side.nr is None:
                raise QueryParsingError("NR is not available for this table")
            return Expr(F.col(side.nr), "int", name="NR" if prefix == "a" else "bNR")
        return Expr(side.nf if side.nf is not None else F.lit(len(side.columns)), "int", name="NF" if prefix == "a" else "bNF")

    def resolve(self, node: ast.AST) -> Expr | None:
        """The variable that a syntax node names, or None."""
        if isinstance(node, ast.Name):
            m = re.fullmatch(r"([ab])([1-9]\d*)", node.id)
            if m and m[1] in self.sides:
                return self.position(m[1], int(m[2]))
            special = {"NR": ("a", "NR"), "aNR": ("a", "NR"), "bNR": ("b", "NR"), "NF": ("a", "NF"), "aNF": ("a", "NF"), "bNF": ("b", "NF")}
            if node.id in special:
                return self.special(*special[node.id])
            if self.bare:
                if node.id in self.ambiguous:
                    raise QueryParsingError(f"Column '{node.id}' is in both tables")
                for prefix, side in self.sides.items():
                    if side.header and node.id in side.header:
                        return self.named(prefix, node.id)
            if node.id == "a" and len(self.sides["a"].columns) == 1 and kind_of(self.sides["a"].types[0])[0] in ("variant", "struct", "map"):
                return self.position("a", 1)
            return None
        base = getattr(node, "value", None)
        if not (isinstance(base, ast.Name) and base.id in ("a", "b")):
            return None
        side = self.sides.get(base.id)
        if side is not None and len(side.columns) == 1 and kind_of(side.types[0])[0] in ("variant", "struct", "map") and not (isinstance(node, ast.Attribute) and node.attr in ("NR", "NF")):
            return None  # one object per record: attributes and keys go into the object
        if isinstance(node, ast.Attribute):
            return self.named(base.id, node.attr)
        if isinstance(node, ast.Subscript) and isinstance(node.slice, ast.Constant):
            if isinstance(node.slice.value, str):
                return self.named(base.id, node.slice.value)
            if isinstance(node.slice.value, int):
                return self.position(base.id, node.slice.value)
        return None
