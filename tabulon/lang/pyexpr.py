"""Expression compiler: Python syntax to typed Spark columns.

Comparisons with None are two-valued as in Python, 'and' and 'or' keep their short circuit where an operand may
raise, and nothing outside the supported syntax is guessed at: UnsupportedExpression lets the caller fall back on a
Python function for the smallest expression that needs it.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from functools import reduce

from pyspark.sql import functions as F

from ..errors import QueryParsingError, UnsupportedExpression
from ..functions import scalar as S
from .names import Expr, Names, kind_of

AGGREGATES = {"COUNT", "MIN", "MAX", "SUM", "AVG", "VARIANCE", "MEDIAN", "ANY_VALUE", "ARRAY_AGG", "UNNEST"}
_NUMERIC = ("int", "float", "bool")


class Compiler:
    """functions: user functions by name, as callables on Expr. fallback: makes an Expr of what has no column form."""

    def __init__(self, names: Names, functions: dict[str, Callable[..., Expr]] | None = None, fallback: Callable[[ast.AST, Compiler], Expr] | None = None, dialect: str = "python"):
        self.names, self.functions, self.fallback, self.dialect = names, functions or {}, fallback, dialect
        self.locals: dict[str, Expr] = {}

    # -- entry points --------------------------------------------------------------------------------------------
    def parse(self, text: str) -> ast.AST:
        if self.dialect == "js":
            from .jsexpr import parse

            return parse(text)
        try:
            return ast.parse(text.strip(), mode="eval").body
        except SyntaxError as e:
            raise QueryParsingError(f"Unable to parse the expression '{text}': {e.msg}") from None

    def column(self, text: str) -> Expr:
        return self.compile(self.parse(text))

    def predicate(self, text: str) -> F.Column:
        return self._condition(self.parse(text))

    def _condition(self, node: ast.AST) -> F.Column:
        """A filter condition: null is as good as false here, so comparisons stay bare and reach the scan."""
        if isinstance(node, ast.BoolOp):
            parts = [self.compile(x) for x in node.values]
            if not any(p.risky for p in parts[1:]):
                conditions = [self._condition(x) for x in node.values]
                return reduce(lambda x, y: x & y if isinstance(node.op, ast.And) else x | y, conditions)
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and isinstance(node.ops[0], ast.In) and isinstance(node.comparators[0], (ast.List, ast.Tuple, ast.Set)):
            values = [x.value for x in node.comparators[0].elts if isinstance(x, ast.Constant)]
            e = self.compile(node.left)
            if values and len(values) == len(node.comparators[0].elts) and all(v is not None and isinstance(v, str) == (e.kind == "str") for v in values) and not e.risky:
                return e.col.isin(*values)
        e = self.compile(node)
        return e.col if isinstance(node, ast.Compare) and e.kind == "bool" else S.truthy(e).col

    def compile(self, node: ast.AST) -> Expr:
        try:
            return self._compile(node)
        except UnsupportedExpression:
            if self.fallback is None or self.locals:
                raise
            return self.fallback(node, self)

    # -- nodes -----------------------------------------------------------------------------------------------------
    def _compile(self, node: ast.AST) -> Expr:
        if isinstance(node, ast.Name) and node.id in self.locals:
            return self.locals[node.id]
        found = self.names.resolve(node)
        if found is not None:
            return found
        method = getattr(self, "_" + type(node).__name__.lower(), None)
        if method is None:
            raise UnsupportedExpression(f"{type(node).__name__} has no column form")
        return method(node)

    def _constant(self, node: ast.Constant) -> Expr:
        out = S.literal(node.value)
        out.value = node.value
        return out

    def _name(self, node: ast.Name) -> Expr:
        if node.id == "undefined":
            return S.literal(None)
        if node.id in self.functions:
            raise UnsupportedExpression(f"Function '{node.id}' used as a value")
        raise QueryParsingError(f"Unknown name '{node.id}'")

    def _dotted(self, node: ast.AST) -> str | None:
        if isinstance(node, ast.Attribute):
            base = self._dotted(node.value)
            return f"{base}.{node.attr}" if base else None
        return node.id if isinstance(node, ast.Name) and node.id not in self.locals else None

    def _attribute(self, node: ast.Attribute) -> Expr:
        dotted = self._dotted(node)
        if dotted in S.CONSTANTS:
            return S.literal(S.CONSTANTS[dotted])
        base = self.compile(node.value)
        if base.kind == "ts" and node.attr in S.TIME_PARTS:
            return Expr(S.TIME_PARTS[node.attr](base.col).cast("bigint"), "int")
        if self.dialect == "js" and node.attr == "length":
            return S.checked(S.BUILTINS["len"], base)
        if base.kind in ("struct", "variant", "map"):
            return self._key(base, node.attr)
        raise UnsupportedExpression(f"Attribute '{node.attr}'")

    def _key(self, base: Expr, key) -> Expr:
        if base.kind == "variant":
            path = f"$[{key}]" if isinstance(key, int) else "$['" + str(key).replace("'", "\\'") + "']"
            return Expr(F.try_variant_get(base.col, path, "variant"), "variant")
        if base.kind == "struct":
            field = next((f for f in base.dtype.fields if f.name == key), None) if base.dtype is not None else None
            if field is None:
                raise QueryParsingError(f"Unknown field '{key}'")
            kind, item = kind_of(field.dataType)
            return Expr(base.col.getField(key), kind, item, dtype=field.dataType)
        kind = base.item or "any"
        return Expr(F.try_element_at(base.col, F.lit(key)), kind)

    def _subscript(self, node: ast.Subscript) -> Expr:
        base = self.compile(node.value)
        if isinstance(node.slice, ast.Slice):
            if node.slice.step is not None:
                if base.kind in ("str", "array") and node.slice.lower is None and node.slice.upper is None and getattr(self._slice_step(node), "value", None) == -1:
                    return Expr(F.reverse(base.col), base.kind, base.item)
                raise UnsupportedExpression("Slices with a step")
            lo, hi = (S.number(self.compile(x)).col if x is not None else None for x in (node.slice.lower, node.slice.upper))
            if base.kind == "str":
                return Expr(S.slice_string(base.col, lo, hi), "str")
            if base.kind == "array":
                return Expr(S.slice_array(base.col, lo, hi), "array", base.item)
            raise UnsupportedExpression(f"Slice of {base.kind}")
        index = self.compile(node.slice)
        if base.kind in ("variant", "struct", "map"):
            return self._key(base, S.const(index))
        n = S.number(index).col
        if base.kind == "str":
            at = F.when(n < 0, F.length(base.col) + n).otherwise(n)
            inside = (at >= 0) & (at < F.length(base.col))
            fail = F.raise_error(F.lit("string index out of range")).cast("string") if self.dialect == "python" else F.lit(None).cast("string")
            return Expr(F.when(inside | base.col.isNull(), F.substr(base.col, (at + 1).cast("int"), F.lit(1))).otherwise(fail), "str", risky=True)
        if base.kind == "array":
            one = F.when(n < 0, n).otherwise(n + 1).cast("int")
            return Expr((F.element_at if self.dialect == "python" else F.try_element_at)(base.col, one), base.item or "any", risky=True)
        raise UnsupportedExpression(f"Index of {base.kind}")

    def _slice_step(self, node: ast.Subscript) -> Expr:
        step = node.slice.step
        if isinstance(step, ast.UnaryOp) and isinstance(step.op, ast.USub) and isinstance(step.operand, ast.Constant):
            step = ast.Constant(-step.operand.value)
        return self.compile(step)

    def _call(self, node: ast.Call) -> Expr:
        if node.keywords:
            raise UnsupportedExpression("Keyword arguments")
        if isinstance(node.func, ast.Name):
            name = node.func.id
            if name in self.functions:
                return self.functions[name](*[self.compile(a) for a in node.args])
            if name in S.BUILTINS:
                return self._sorted_by(node) if name == "sorted" and len(node.args) > 1 else S.checked(S.BUILTINS[name], *[self.compile(a) for a in node.args])
            if name in ("map", "filter") and len(node.args) == 2:
                return self._mapped(name, node)
            raise UnsupportedExpression(f"Unknown function '{name}'")
        if not isinstance(node.func, ast.Attribute):
            raise UnsupportedExpression("Calls of expressions")
        dotted = self._dotted(node.func)
        if dotted in S.MODULES:
            return S.checked(S.MODULES[dotted], *[self.compile(a) for a in node.args])
        if dotted and dotted.startswith("udf.") and dotted[4:] in self.functions:
            return self.functions[dotted[4:]](*[self.compile(a) for a in node.args])
        if dotted and dotted.split(".")[0] in ("math", "re", "random", "json", "datetime", "os", "time"):
            raise UnsupportedExpression(f"Unknown function '{dotted}'")
        base, method = self.compile(node.func.value), node.func.attr
        args = [self.compile(a) for a in node.args]
        if base.kind == "str" and method in S.STRING_METHODS:
            return S.checked(S.STRING_METHODS[method], base, *args)
        if base.kind == "array" and method in S.ARRAY_METHODS:
            return S.checked(S.ARRAY_METHODS[method], base, *args)
        if base.kind == "ts" and method in S.TIME_METHODS:
            return S.checked(S.TIME_METHODS[method], base, *args)
        if base.kind in ("variant", "map", "struct") and method == "get":
            got = self._key(base, S.const(args[0]))
            return got if len(args) == 1 else Expr(F.coalesce(got.col, args[1].col), got.kind)
        raise UnsupportedExpression(f"Method '{method}' of {base.kind}")

    def _sorted_by(self, node: ast.Call) -> Expr:
        raise UnsupportedExpression("sorted() with a key")

    def _mapped(self, name: str, node: ast.Call) -> Expr:
        fn, xs = node.args
        base = self.compile(xs)
        if base.kind != "array":
            raise UnsupportedExpression(f"{name}() of {base.kind}")
        if isinstance(fn, ast.Name):
            fn = ast.Lambda(ast.arguments([], [ast.arg("x_")], None, [], [], None, []), ast.Call(fn, [ast.Name("x_")], []))
        if name == "map":
            return self._transform(base, fn.args.args[0].arg, fn.body)
        return Expr(F.filter(base.col, lambda x: S.truthy(self.inner(fn.args.args[0].arg, Expr(x, base.item or "any"), fn.body)).col), "array", base.item)

    def inner(self, name: str, value: Expr, body: ast.AST) -> Expr:
        """Compile a lambda's body with its parameter bound."""
        before = dict(self.locals)
        self.locals[name] = value
        try:
            return self._compile(body)
        finally:
            self.locals = before

    def _transform(self, base: Expr, name: str, body: ast.AST) -> Expr:
        kind: list[Expr] = []

        def run(x):
            out = self.inner(name, Expr(x, base.item or "any"), body)
            kind.append(out)
            return out.col

        return Expr(F.transform(base.col, run), "array", kind[0].kind if kind else None)

    def _test(self, name: str, kind: str, body: ast.AST):
        return lambda x: S.truthy(self.inner(name, Expr(x, kind), body)).col

    def _listcomp(self, node: ast.ListComp) -> Expr:
        if len(node.generators) != 1 or not isinstance(node.generators[0].target, ast.Name):
            raise UnsupportedExpression("Nested comprehensions")
        loop = node.generators[0]
        base = self.compile(loop.iter)
        if base.kind == "str":
            base = S.BUILTINS["list"](base)
        if base.kind != "array":
            raise UnsupportedExpression(f"Comprehension over {base.kind}")
        for test in loop.ifs:
            base = Expr(F.filter(base.col, self._test(loop.target.id, base.item or "any", test)), "array", base.item)
        return self._transform(base, loop.target.id, node.elt)

    _generatorexp = _listcomp

    def _list(self, node: ast.List | ast.Tuple) -> Expr:
        items = [self.compile(x) for x in node.elts]
        kinds = {x.kind for x in items if x.kind != "null"}
        if not items:
            return Expr(F.array().cast("array<string>"), "array", "str")
        if len(kinds) > 1 and kinds <= {"int", "float"}:
            return Expr(F.array(*[x.col.cast("double") for x in items]), "array", "float")
        if len(kinds) > 1:
            raise UnsupportedExpression("Lists of mixed types")
        return Expr(F.array(*[x.col for x in items]), "array", next(iter(kinds), "null"), risky=any(x.risky for x in items))

    _tuple = _set = _list

    def _joinedstr(self, node: ast.JoinedStr) -> Expr:
        parts = []
        for x in node.values:
            if isinstance(x, ast.Constant):
                parts.append(F.lit(x.value))
            else:
                if x.conversion not in (-1, 115):
                    raise UnsupportedExpression("Conversions in f-strings")
                spec = "".join(v.value for v in x.format_spec.values if isinstance(v, ast.Constant)) if x.format_spec else ""
                parts.append(S.formatted(self.compile(x.value), spec))
        return Expr(F.concat(*parts) if parts else F.lit(""), "str")

    def _ifexp(self, node: ast.IfExp) -> Expr:
        test, a, b = (self.compile(x) for x in (node.test, node.body, node.orelse))
        a, b = self._same(a, b)
        return Expr(F.when(S.truthy(test).col, a.col).otherwise(b.col), a.kind if a.kind != "null" else b.kind, a.item or b.item, risky=test.risky or a.risky or b.risky)

    def _same(self, a: Expr, b: Expr) -> tuple[Expr, Expr]:
        if a.kind == b.kind or "null" in (a.kind, b.kind):
            return a, b
        if {a.kind, b.kind} <= set(_NUMERIC):
            kind = "float" if "float" in (a.kind, b.kind) else "int"
            return tuple(Expr(x.col.cast(S.SPARK_TYPE[kind]), kind, risky=x.risky) for x in (a, b))
        raise UnsupportedExpression(f"A value that is either {a.kind} or {b.kind}")

    def _boolop(self, node: ast.BoolOp) -> Expr:
        parts = [self.compile(x) for x in node.values]
        if all(p.kind == "bool" for p in parts):
            out = S.truthy(parts[0])
            for p in parts[1:]:
                t = S.truthy(p)
                if isinstance(node.op, ast.And):
                    col = F.when(out.col, t.col).otherwise(False) if p.risky else out.col & t.col
                else:
                    col = F.when(out.col, True).otherwise(t.col) if p.risky else out.col | t.col
                out = Expr(col, "bool", risky=out.risky or p.risky)
            return out
        try:
            out = parts[0]
            for p in parts[1:]:
                a, b = self._same(out, p)
                test = S.truthy(out).col
                pick = F.when(test, b.col).otherwise(a.col) if isinstance(node.op, ast.And) else F.when(test, a.col).otherwise(b.col)
                out = Expr(pick, a.kind if a.kind != "null" else b.kind, a.item or b.item, risky=a.risky or b.risky)
            return out
        except UnsupportedExpression:  # operands of several types: only the truth of the whole is kept
            return self._boolop_truth(node, parts)

    def _boolop_truth(self, node: ast.BoolOp, parts: list[Expr]) -> Expr:
        out = S.truthy(parts[0]).col
        for p in parts[1:]:
            t = S.truthy(p).col
            out = F.when(out, t).otherwise(False) if isinstance(node.op, ast.And) else F.when(out, True).otherwise(t)
        return Expr(out, "bool", risky=any(p.risky for p in parts))

    def _unaryop(self, node: ast.UnaryOp) -> Expr:
        x = self.compile(node.operand)
        if isinstance(node.op, ast.Not):
            return Expr(~S.truthy(x).col, "bool", risky=x.risky)
        n = self._js_number(x) if self.dialect == "js" else S.number(x)
        if isinstance(node.op, ast.USub):
            out = Expr(-n.col, n.kind, risky=n.risky)
            if hasattr(x, "value"):
                out.value = -x.value
            return out
        if isinstance(node.op, ast.Invert):
            return Expr(F.bitwise_not(n.col), "int")
        return n

    def _js_number(self, x: Expr) -> Expr:
        """JavaScript's Number(): strings are cast, the empty string is 0."""
        if x.kind == "str":
            text = S.strip(x.col)
            return Expr(F.when(text == "", 0.0).otherwise(F.coalesce(text.try_cast("double"), F.lit(float("nan")))), "float")
        if x.kind in _NUMERIC:
            return S.number(x)
        if x.kind == "null":
            return Expr(F.lit(0.0), "float")
        raise UnsupportedExpression(f"Arithmetic with {x.kind}")

    def _binop(self, node: ast.BinOp) -> Expr:
        a, b, op = self.compile(node.left), self.compile(node.right), type(node.op)
        risky = a.risky or b.risky
        if op is ast.Add:
            if self.dialect == "js" and "str" in (a.kind, b.kind):
                return Expr(F.concat(S.to_str(a), S.to_str(b)), "str", risky=risky)
            if a.kind == b.kind == "str":
                return Expr(F.concat(a.col, b.col), "str", risky=risky)
            if a.kind == b.kind == "array":
                return Expr(F.concat(a.col, b.col), "array", a.item, risky=risky)
        if op is ast.Mult and self.dialect == "python":
            for x, y in ((a, b), (b, a)):
                if x.kind == "str" and y.kind in ("int", "bool"):
                    return Expr(F.repeat(x.col, F.greatest(y.col.cast("int"), F.lit(0))), "str", risky=risky)
        if op is ast.Mod and a.kind == "str" and self.dialect == "python":
            raise UnsupportedExpression("% formatting")
        if self.dialect == "python" and "str" in (a.kind, b.kind):
            raise QueryParsingError(f"Operator {op.__name__} between {a.kind} and {b.kind}: convert with int(), float() or str()")
        if a.kind == "ts" and b.kind == "ts" and op is ast.Sub:
            return Expr((F.unix_micros(a.col) - F.unix_micros(b.col)) / 1e6, "float")
        x, y = (self._js_number(a), self._js_number(b)) if self.dialect == "js" else (S.number(a), S.number(b))
        kind = "float" if "float" in (x.kind, y.kind) else "int"
        p, q = (x.col.cast("double"), y.col.cast("double")) if kind == "float" else (x.col, y.col)
        if op in (ast.Add, ast.Sub, ast.Mult):
            return Expr({ast.Add: p + q, ast.Sub: p - q, ast.Mult: p * q}[op], kind, risky=risky)
        if op is ast.Div:
            p, q = p.cast("double"), q.cast("double")
            return Expr(F.try_divide(p, q) if self.dialect == "js" else p / q, "float", risky=True)
        if op is ast.Mod:
            return Expr(p % q if self.dialect == "js" else (p % q + q) % q, kind, risky=True)
        if op is ast.FloorDiv:
            if kind == "int":
                return Expr(F.call_function("div", p - (p % q + q) % q, q), "int", risky=True)
            return Expr(F.floor(p / q).cast("double"), "float", risky=True)
        if op is ast.Pow:
            power = F.pow(p.cast("double"), q.cast("double"))
            whole = kind == "int" and getattr(b, "value", -1) >= 0
            return Expr(power.cast("bigint") if whole else power, "int" if whole else "float", risky=True)
        bits = {ast.BitAnd: "bitwiseAND", ast.BitOr: "bitwiseOR", ast.BitXor: "bitwiseXOR"}
        if op in bits and kind == "int":
            return Expr(getattr(p, bits[op])(q), "int", risky=risky)
        if op in (ast.LShift, ast.RShift) and kind == "int" and hasattr(b, "value"):
            return Expr((F.shiftleft if op is ast.LShift else F.shiftright)(p, b.value), "int", risky=risky)
        raise UnsupportedExpression(f"Operator {op.__name__}")

    def _compare(self, node: ast.Compare) -> Expr:
        left, out = self.compile(node.left), None
        for op, right_node in zip(node.ops, node.comparators, strict=True):
            right = self.compile(right_node)
            one = self._one_comparison(type(op), left, right, right_node)
            out = one if out is None else Expr(out.col & one.col if not one.risky else F.when(out.col, one.col).otherwise(False), "bool", risky=out.risky or one.risky)
            left = right
        return out

    def _one_comparison(self, op: type, a: Expr, b: Expr, node: ast.AST) -> Expr:
        risky = a.risky or b.risky
        if op in (ast.In, ast.NotIn):
            hit = self._member(a, b, node)
            return Expr(hit if op is ast.In else ~hit, "bool", risky=risky)
        if op in (ast.Is, ast.IsNot, ast.Eq, ast.NotEq):
            if "null" in (a.kind, b.kind) and "match" in (a.item, b.item):
                hit = ~(b if a.kind == "null" else a).col  # the truth of a match stands for the match itself
            elif "null" in (a.kind, b.kind):
                hit = (b if a.kind == "null" else a).col.isNull() if a.kind != b.kind else F.lit(True)
                if "bool" in (a.kind, b.kind) and op in (ast.Is, ast.IsNot):
                    hit = (b if a.kind == "null" else a).col.isNull()
            else:
                x, y = self._comparable(a, b, equality=True)
                hit = F.lit(False) if x is None else x.eqNullSafe(y)
            return Expr(hit if op in (ast.Is, ast.Eq) else ~hit, "bool", risky=risky)
        x, y = self._comparable(a, b, equality=False)
        return Expr({ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}[op], "bool", risky=risky)

    def _comparable(self, a: Expr, b: Expr, equality: bool):
        if a.kind == b.kind or {a.kind, b.kind} <= {"int", "float", "bool"}:
            if a.kind != b.kind:
                return S.number(a).col, S.number(b).col
            return a.col, b.col
        if self.dialect == "js" and {a.kind, b.kind} <= {"int", "float", "bool", "str"}:
            return self._js_number(a).col, self._js_number(b).col
        for x, y in ((a, b), (b, a)):
            if x.kind in ("variant", "any") and y.kind in ("str", "int", "float", "bool"):
                got = F.try_variant_get(x.col, "$", S.SPARK_TYPE[y.kind]) if x.kind == "variant" else x.col.cast(S.SPARK_TYPE[y.kind])
                return (got, y.col) if x is a else (y.col, got)
            if x.kind == "ts" and y.kind == "str":
                when = y.col.cast("timestamp")
                return (x.col, when) if x is a else (when, x.col)
        if equality:
            return None, None
        raise QueryParsingError(f"Comparison of {a.kind} with {b.kind}: convert with int(), float() or str()")

    def _member(self, a: Expr, b: Expr, node: ast.AST) -> F.Column:
        if isinstance(node, (ast.List, ast.Tuple, ast.Set)) and all(isinstance(x, ast.Constant) for x in node.elts):
            values = [x.value for x in node.elts if x.value is not None]
            same = [v for v in values if isinstance(v, str) == (a.kind == "str")]
            hit = F.coalesce(a.col.isin(*same), F.lit(False)) if same else F.lit(False)
            return hit | a.col.isNull() if any(x.value is None for x in node.elts) else hit
        if b.kind == "str":
            return F.coalesce(F.contains(b.col, S.string(a)), F.lit(False))
        if b.kind == "array":
            return F.coalesce(F.exists(b.col, lambda x: x.eqNullSafe(a.col)), F.lit(False))
        if b.kind == "map":
            return F.coalesce(F.map_contains_key(b.col, a.col), F.lit(False))
        raise UnsupportedExpression(f"Membership in {b.kind}")


def referenced(node: ast.AST, names: Names) -> list[tuple[ast.AST, Expr]]:
    """The variables in an expression, outermost first."""
    found = names.resolve(node)
    if found is not None:
        return [(node, found)]
    return [x for child in ast.iter_child_nodes(node) for x in referenced(child, names)]
