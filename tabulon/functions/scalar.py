"""Python's scalar functions, methods and modules as Spark columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from string import Formatter

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryParsingError, UnsupportedExpression
from ..lang.names import Expr

SPARK_TYPE = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean"}
_SPACE = r"[\s\x1c-\x1f\x85]"


def literal(value) -> Expr:
    if value is None:
        return Expr(F.lit(None), "null")
    if isinstance(value, bool):
        return Expr(F.lit(value), "bool")
    if isinstance(value, int):
        return Expr(F.lit(value).cast("bigint") if abs(value) < 2**63 else F.lit(float(value)), "int")
    if isinstance(value, float):
        return Expr(F.lit(value), "float")
    if isinstance(value, str):
        return Expr(F.lit(value), "str")
    raise UnsupportedExpression(f"Literal {value!r} has no column form")


def truthy(e: Expr) -> Expr:
    """Host truthiness as a two-valued boolean."""
    c = e.col
    if e.kind == "bool":
        out = F.coalesce(c, F.lit(False))
    elif e.kind == "str":
        out = F.coalesce(c != "", F.lit(False))
    elif e.kind in ("int", "float"):
        out = F.coalesce(c != 0, F.lit(False))
    elif e.kind in ("array", "map"):
        out = F.coalesce(F.size(c) > 0, F.lit(False))
    elif e.kind == "null":
        out = F.lit(False)
    else:
        out = c.isNotNull()
    return Expr(out, "bool", risky=e.risky)


def to_str(e: Expr) -> F.Column:
    """Python's str(): True/False, None, and floats with a decimal point."""
    if e.kind == "str":
        return e.col
    if e.kind == "bool":
        return F.when(e.col.isNull(), F.lit("None")).when(e.col, F.lit("True")).otherwise(F.lit("False"))
    if e.kind == "float":
        return float_text(e.col)
    if e.kind == "null":
        return F.lit("None")
    if e.kind == "array":
        inner = F.transform(e.col, lambda x: F.concat(F.lit("'"), x, F.lit("'")) if e.item == "str" else to_str(Expr(x, e.item or "any")))
        return F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]"))
    return e.col.cast("string")


def float_text(c: F.Column) -> F.Column:
    """Shortest text of a double in Python's form: exponents from 1e16 and below 1e-4."""
    text, size = c.cast("string"), F.abs(c)
    trimmed = lambda t: F.regexp_replace(F.regexp_replace(t, "0+$", ""), r"\.$", ".0")
    large, small = trimmed(c.cast("decimal(38,18)").cast("string")), trimmed(c.cast("decimal(38,22)").cast("string"))
    power = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E-(\d)$", "e-0$1")
    power = F.regexp_replace(F.regexp_replace(power, "E-", "e-"), "E", "e+")
    return (
        F.when(c.isNull(), F.lit("None")).when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
        .when(~text.contains("E"), text).when((size >= 1e7) & (size < 1e16), large).when((size >= 1e-4) & (size < 1e-3), small).otherwise(power)
    )


def number(e: Expr) -> Expr:
    """A numeric operand; booleans count as integers."""
    if e.kind in ("int", "float"):
        return e
    if e.kind == "bool":
        return Expr(e.col.cast("bigint"), "int", risky=e.risky)
    if e.kind == "null":
        return Expr(F.lit(None).cast("double"), "float")
    raise UnsupportedExpression(f"A number is needed, not {e.kind}")


def string(e: Expr) -> F.Column:
    if e.kind in ("str", "null"):
        return e.col if e.kind == "str" else F.lit(None).cast("string")
    raise UnsupportedExpression(f"A string is needed, not {e.kind}")


def const(e: Expr):
    """The value of a literal argument."""
    value = getattr(e, "value", None)
    if value is None:
        raise UnsupportedExpression("A literal is needed here")
    return value


def strip(c: F.Column, chars: Expr | None = None, left: bool = True, right: bool = True) -> F.Column:
    space = _SPACE if chars is None else "[" + re.escape(const(chars)) + "]"
    sides = "|".join(x for x, on in ((f"^{space}+", left), (f"{space}+$", right)) if on)
    return F.regexp_replace(c, sides.replace("$", r"\z"), "")


def split(c: F.Column, sep: Expr | None = None) -> F.Column:
    if sep is None:
        return F.filter(F.split(c, f"{_SPACE}+"), lambda x: x != "")
    return F.split(c, r"\Q" + const(sep).replace(r"\E", r"\E\\E\Q") + r"\E", -1)


def find(c: F.Column, what: F.Column) -> F.Column:
    return F.call_function("locate", what, c).cast("bigint") - 1


def like_pattern(pattern: str) -> str:
    """Anchored regular expression of a LIKE pattern: % is any run without line feeds, _ any one character."""
    body = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return f"(?d)^{body}$"


def like(text: Expr, pattern: Expr) -> Expr:
    value = getattr(pattern, "value", None)
    if value is not None:
        return Expr(F.coalesce(string(text).rlike(like_pattern(value)), F.lit(False)), "bool")
    escaped = F.regexp_replace(string(pattern), r"([\\.^$|()\[\]{}*+?\-])", r"\\$1")
    regex = F.concat(F.lit("(?d)^"), F.replace(F.replace(escaped, F.lit("%"), F.lit(".*")), F.lit("_"), F.lit(".")), F.lit("$"))
    return Expr(F.coalesce(F.regexp_like(string(text), regex), F.lit(False)), "bool")


def slice_string(c: F.Column, lo: F.Column | None, hi: F.Column | None) -> F.Column:
    n = F.length(c)
    at = lambda x: F.when(x < 0, F.greatest(n + x, F.lit(0))).otherwise(F.least(x, n))
    start = at(lo) if lo is not None else F.lit(0)
    stop = at(hi) if hi is not None else n
    return F.substr(c, (start + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))


def slice_array(c: F.Column, lo: F.Column | None, hi: F.Column | None) -> F.Column:
    n = F.size(c)
    at = lambda x: F.when(x < 0, F.greatest(n + x, F.lit(0))).otherwise(F.least(x, n))
    start = at(lo) if lo is not None else F.lit(0)
    stop = at(hi) if hi is not None else n
    return F.slice(c, (start + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))


# -- functions by name ---------------------------------------------------------------------------------------------

def _int(a: Expr, base: Expr | None = None) -> Expr:
    if base is not None:
        return Expr(F.conv(string(a), const(base), 10).cast("bigint"), "int", risky=True)
    if a.kind == "str":
        return Expr(F.regexp_replace(strip(a.col), r"(?<=\d)_(?=\d)", "").cast("bigint"), "int", risky=True)
    if a.kind == "float":
        return Expr(F.when(a.col < 0, F.ceil(a.col)).otherwise(F.floor(a.col)).cast("bigint"), "int", risky=True)
    if a.kind in ("int", "bool"):
        return Expr(a.col.cast("bigint"), "int", risky=a.risky)
    if a.kind in ("variant", "any"):
        return Expr(a.col.cast("bigint"), "int", risky=True)
    raise UnsupportedExpression(f"int() of {a.kind}")


def _float(a: Expr) -> Expr:
    if a.kind == "str":
        return Expr(strip(a.col).cast("double"), "float", risky=True)
    if a.kind in ("int", "float", "bool", "variant", "any"):
        return Expr(a.col.cast("double"), "float", risky=a.kind in ("variant", "any") or a.risky)
    raise UnsupportedExpression(f"float() of {a.kind}")


def _len(a: Expr) -> Expr:
    if a.kind == "str":
        return Expr(F.length(a.col).cast("bigint"), "int")
    if a.kind in ("array", "map"):
        return Expr(F.size(a.col).cast("bigint"), "int")
    raise UnsupportedExpression(f"len() of {a.kind}")


def _round(a: Expr, n: Expr | None = None) -> Expr:
    x = number(a)
    if n is None:
        return Expr(F.bround(x.col, 0).cast("bigint"), "int", risky=a.risky)
    return Expr(F.bround(x.col, const(n)), x.kind, risky=a.risky)


def _fold(name: str) -> Callable[..., Expr]:
    def run(*args: Expr) -> Expr:
        if len(args) == 1:
            a = args[0]
            if a.kind != "array":
                raise UnsupportedExpression(f"{name}() of {a.kind}")
            return Expr({"min": F.array_min, "max": F.array_max}[name](a.col), a.item or "any")
        kinds = {x.kind for x in args}
        if kinds == {"str"}:
            return Expr({"min": F.least, "max": F.greatest}[name](*[x.col for x in args]), "str")
        xs = [number(x) for x in args]
        kind = "float" if any(x.kind == "float" for x in xs) else "int"
        return Expr({"min": F.least, "max": F.greatest}[name](*[x.col.cast(SPARK_TYPE[kind]) for x in xs]), kind)

    return run


def _sum(a: Expr) -> Expr:
    kind = a.item if a.item in ("int", "float") else None
    if a.kind != "array" or kind is None:
        raise UnsupportedExpression(f"sum() of {a.kind}")
    return Expr(F.aggregate(a.col, F.lit(0).cast(SPARK_TYPE[kind]), lambda s, x: s + x), kind)


def _sorted(a: Expr) -> Expr:
    if a.kind == "str":
        return Expr(F.array_sort(F.filter(F.split(a.col, ""), lambda x: x != "")), "array", "str")
    if a.kind != "array":
        raise UnsupportedExpression(f"sorted() of {a.kind}")
    return Expr(F.array_sort(a.col), "array", a.item)


def _set(a: Expr) -> Expr:
    if a.kind != "array":
        raise UnsupportedExpression(f"set() of {a.kind}")
    return Expr(F.array_distinct(a.col), "array", a.item)


def _list(a: Expr) -> Expr:
    if a.kind == "str":
        return Expr(F.filter(F.split(a.col, ""), lambda x: x != ""), "array", "str")
    if a.kind == "array":
        return a
    raise UnsupportedExpression(f"list() of {a.kind}")


def _abs(a: Expr) -> Expr:
    x = number(a)
    return Expr(F.abs(x.col), x.kind, risky=a.risky)


BUILTINS: dict[str, Callable[..., Expr]] = {
    "int": _int, "float": _float, "len": _len, "round": _round, "abs": _abs,
    "str": lambda a: Expr(to_str(a), "str", risky=a.risky), "bool": truthy, "sum": _sum, "min": _fold("min"), "max": _fold("max"),
    "sorted": _sorted, "set": _set, "list": _list, "tuple": _list, "like": like, "LIKE": like,
    "ord": lambda a: Expr(F.call_function("ascii", string(a)).cast("bigint"), "int"), "chr": lambda a: Expr(F.call_function("char", number(a).col), "str"),
    "reversed": lambda a: Expr(F.reverse(a.col), a.kind, a.item),
}


def _math(fn, kind: str = "float") -> Callable[..., Expr]:
    return lambda *a: Expr(fn(*[number(x).col.cast("double") for x in a]).cast(SPARK_TYPE[kind]), kind, risky=True)


def _match(prefix: str, suffix: str = "") -> Callable[..., Expr]:
    return lambda p, s, *flags: Expr(F.coalesce(string(s).rlike(prefix + java_regex(const(p)) + suffix), F.lit(False)), "bool", "match")


def java_regex(p: str) -> str:
    return p.replace("(?P<", "(?<").replace(r"\Z", r"\z")


MODULES: dict[str, Callable[..., Expr]] = {
    "math.ceil": _math(F.ceil, "int"), "math.floor": _math(F.floor, "int"), "math.trunc": lambda a: _int(number(a)),
    "math.sqrt": _math(F.sqrt), "math.exp": _math(F.exp), "math.log2": _math(F.log2), "math.log10": _math(F.log10),
    "math.log": lambda a, b=None: _math(F.ln)(a) if b is None else Expr(F.ln(number(a).col) / F.ln(number(b).col), "float", risky=True),
    "math.sin": _math(F.sin), "math.cos": _math(F.cos), "math.tan": _math(F.tan), "math.atan": _math(F.atan), "math.atan2": _math(F.atan2), "math.asin": _math(F.asin), "math.acos": _math(F.acos),
    "math.pow": _math(F.pow), "math.fabs": _math(F.abs), "math.hypot": _math(F.hypot), "math.degrees": _math(F.degrees), "math.radians": _math(F.radians),
    "math.isnan": lambda a: Expr(F.isnan(number(a).col), "bool"),
    "re.match": _match("^(?:", ")"), "re.search": _match("", ""), "re.fullmatch": _match("^(?:", r")\z"),
    "re.sub": lambda p, r, s: Expr(F.regexp_replace(string(s), java_regex(const(p)), re.sub(r"\\(\d)", r"$\1", const(r).replace("$", r"\$"))), "str"),
    "re.findall": lambda p, s: Expr(F.regexp_extract_all(string(s), F.lit(java_regex(const(p))), F.lit(1 if re.compile(const(p)).groups else 0)), "array", "str"),
    "re.split": lambda p, s: Expr(F.split(string(s), java_regex(const(p)), -1), "array", "str"),
    "random.random": lambda: Expr(F.rand(), "float"),
    "json.loads": lambda a: Expr(F.parse_json(string(a)), "variant", risky=True),
    "datetime.datetime.strptime": lambda s, f: Expr(F.to_timestamp(string(s), java_format(const(f))), "ts", risky=True),
    "datetime.datetime.fromisoformat": lambda s: Expr(F.to_timestamp(string(s)), "ts", risky=True),
    "datetime.datetime.now": lambda: Expr(F.current_timestamp(), "ts"),
}
CONSTANTS = {"math.pi": 3.141592653589793, "math.e": 2.718281828459045, "math.inf": float("inf"), "math.nan": float("nan")}


def java_format(f: str) -> str:
    """Date pattern of a strftime format."""
    table = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "p": "a", "I": "hh", "%": "%"}
    out = []
    for i, part in enumerate(re.split(r"%(.)", f)):
        out.append(table[part] if i % 2 and part in table else re.sub(r"([A-Za-z]+)", r"'\1'", part))
    return "".join(out)


def _title(c: F.Column) -> F.Column:
    return F.initcap(c)


def _format(fmt: Expr, *args: Expr) -> Expr:
    out, auto = [], 0
    for text, name, spec, conversion in Formatter().parse(const(fmt)):
        if text:
            out.append(F.lit(text))
        if name is None:
            continue
        if conversion or not (name == "" or name.isdigit()):
            raise UnsupportedExpression(f"Format field '{name}'")
        i = int(name) if name else auto
        auto += 1
        if i >= len(args):
            raise QueryParsingError("format() has too few arguments")
        out.append(formatted(args[i], spec))
    return Expr(F.concat(*out) if out else F.lit(""), "str")


def formatted(e: Expr, spec: str) -> F.Column:
    """format(value, spec) for widths, zero padding, fixed decimals and thousands."""
    if not spec:
        return F.coalesce(to_str(e), F.lit("None"))
    m = re.fullmatch(r"([<>])?(0)?(\d+)?(,)?(?:\.(\d+))?([dfs])?", spec)
    if not m:
        raise UnsupportedExpression(f"Format '{spec}'")
    side, zero, width, comma, decimals, kind = m.groups()
    if decimals is not None or kind == "f" or comma:
        places = int(decimals) if decimals is not None else 6 if kind == "f" else 0
        text = F.format_number(number(e).col, places) if comma else F.format_string(f"%.{places}f", number(e).col.cast("double"))
    else:
        text = to_str(e)
    if width:
        size = F.greatest(F.length(text), F.lit(int(width)))
        right = side == ">" or (side is None and e.kind in ("int", "float"))
        text = F.lpad(text, size, F.lit("0" if zero else " ")) if right or zero else F.rpad(text, size, F.lit(" "))
    return text


def _join_method(sep: Expr, xs: Expr) -> Expr:
    if xs.kind != "array":
        raise UnsupportedExpression(f"join() of {xs.kind}")
    return Expr(F.array_join(xs.col, const(sep)), "str")


def _count(s: Expr, what: Expr) -> Expr:
    c, w = string(s), string(what)
    return Expr(((F.length(c) - F.length(F.replace(c, w, F.lit("")))) / F.length(w)).cast("bigint"), "int")


def _pad(fn, fill: str | None = None):
    return lambda s, n, f=None: Expr(fn(string(s), F.greatest(F.length(s.col), F.lit(const(n))), F.lit(fill or (const(f) if f else " "))), "str")


STRING_METHODS: dict[str, Callable[..., Expr]] = {
    "lower": lambda s: Expr(F.lower(s.col), "str"), "upper": lambda s: Expr(F.upper(s.col), "str"), "title": lambda s: Expr(_title(s.col), "str"),
    "capitalize": lambda s: Expr(F.concat(F.upper(F.substring(s.col, 1, 1)), F.lower(F.substr(s.col, F.lit(2)))), "str"),
    "strip": lambda s, ch=None: Expr(strip(s.col, ch), "str"), "lstrip": lambda s, ch=None: Expr(strip(s.col, ch, right=False), "str"), "rstrip": lambda s, ch=None: Expr(strip(s.col, ch, left=False), "str"),
    "replace": lambda s, a, b: Expr(F.replace(s.col, string(a), string(b)), "str"),
    "startswith": lambda s, p: Expr(F.coalesce(s.col.startswith(string(p)), F.lit(False)), "bool"), "endswith": lambda s, p: Expr(F.coalesce(s.col.endswith(string(p)), F.lit(False)), "bool"),
    "find": lambda s, p: Expr(find(s.col, string(p)), "int"), "split": lambda s, sep=None: Expr(split(s.col, sep), "array", "str"), "join": _join_method, "count": _count,
    "zfill": _pad(F.lpad, "0"), "ljust": _pad(F.rpad), "rjust": _pad(F.lpad), "format": _format,
    "isdigit": lambda s: Expr(F.coalesce(s.col.rlike(r"^\d+\z"), F.lit(False)), "bool"), "isalpha": lambda s: Expr(F.coalesce(s.col.rlike(r"^\p{L}+\z"), F.lit(False)), "bool"),
    "isnumeric": lambda s: Expr(F.coalesce(s.col.rlike(r"^\p{N}+\z"), F.lit(False)), "bool"), "isspace": lambda s: Expr(F.coalesce(s.col.rlike(rf"^{_SPACE}+\z"), F.lit(False)), "bool"),
    "isalnum": lambda s: Expr(F.coalesce(s.col.rlike(r"^[\p{L}\p{N}]+\z"), F.lit(False)), "bool"),
    "isupper": lambda s: Expr(F.coalesce((F.upper(s.col) == s.col) & (F.lower(s.col) != s.col), F.lit(False)), "bool"), "islower": lambda s: Expr(F.coalesce((F.lower(s.col) == s.col) & (F.upper(s.col) != s.col), F.lit(False)), "bool"),
    "splitlines": lambda s: Expr(F.split(s.col, r"\r\n|\n|\r"), "array", "str"),
}
ARRAY_METHODS: dict[str, Callable[..., Expr]] = {
    "index": lambda a, x: Expr(F.array_position(a.col, x.col).cast("bigint") - 1, "int"),
    "count": lambda a, x: Expr(F.size(F.filter(a.col, lambda y: y.eqNullSafe(x.col))).cast("bigint"), "int"),
}
TIME_METHODS: dict[str, Callable[..., Expr]] = {
    "strftime": lambda t, f: Expr(F.date_format(t.col, java_format(const(f))), "str"), "isoformat": lambda t: Expr(F.date_format(t.col, "yyyy-MM-dd'T'HH:mm:ss"), "str"),
    "date": lambda t: Expr(t.col.cast("date"), "ts", dtype=T.DateType()), "timestamp": lambda t: Expr(F.unix_micros(t.col) / 1e6, "float"),
    "weekday": lambda t: Expr(F.weekday(t.col).cast("bigint"), "int"), "isoweekday": lambda t: Expr(F.weekday(t.col).cast("bigint") + 1, "int"),
}
TIME_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}


def checked(fn: Callable[..., Expr], *args: Expr) -> Expr:
    try:
        return fn(*args)
    except TypeError as e:
        if "positional argument" in str(e) or "unexpected keyword" in str(e):
            raise QueryParsingError(f"Wrong number of arguments: {e}") from None
        raise
