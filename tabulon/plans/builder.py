"""QuerySpec and tables to DataFrames, in the fixed order
join, where, unnest, project or aggregate or update, sort, distinct, limit."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryParsingError
from ..functions import scalar as S
from ..lang.clauses import QuerySpec, split_alias
from ..lang.names import Expr, Names, Side, kind_of
from ..lang.pyexpr import Compiler
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators.ordering import distinct_rows, first_rows, running_count
from .table import Table, order_by

_STAR = re.compile(r"^(?:([ab])\s*\.\s*)?\*$")
_COUNT_STAR = re.compile(r"^(count)\s*\(\s*\*\s*\)$", re.I)


@dataclass
class Options:
    dialect: str = "python"
    bare_names: bool = False
    strict_nulls: bool = False
    ordered: bool = True
    functions: dict | None = None
    fallback: object = None


def _mentions(spec: QuerySpec, pattern: str) -> bool:
    texts = [*spec.items, *(x for p in spec.assignments for x in p), spec.where or "", *spec.order_by, *(spec.group_by or [])]
    texts += [x for p in (spec.join.pairs if spec.join else []) for x in p]
    return any(re.search(pattern, t) for t in texts)


def _side(prefix: str, t: Table) -> tuple[DataFrame, Side, list[tuple[str, bool]]]:
    """The table's DataFrame under names of its prefix, with order columns if the table has them."""
    columns = [f"{prefix}_{i + 1}" for i in range(len(t.columns))]
    picked = [F.col(c).alias(n) for c, n in zip(t.columns, columns, strict=True)]
    order = [(f"{prefix}_o{i}", up) for i, (_, up) in enumerate(t.order)]
    picked += [F.col(c).alias(n) for (c, _), (n, _) in zip(t.order, order, strict=True)]
    nr = nf = None
    if t.nr:
        nr = f"{prefix}_nr"
        picked.append(F.col(t.nr).alias(nr))
    if t.nf:
        picked.append(F.col(t.nf).alias(f"{prefix}_nf"))
        nf = F.col(f"{prefix}_nf").cast("bigint")
    side = Side(prefix, columns, t.types, t.header, nr, nf if nf is not None else F.lit(len(columns)).cast("bigint"), ragged=bool(t.nf))
    return t.df.select(*picked), side, order


def build(spec: QuerySpec, a: Table, b: Table | None, options: Options) -> Table:
    select = spec.action == "select"
    agg = select and (spec.group_by is not None or any(_aggregate_call(i, options.dialect) for i in spec.items))
    ranked = agg and any((c := _aggregate_call(i, options.dialect)) and c[0] in ("ANY_VALUE", "ARRAY_AGG") for i in spec.items)
    if _mentions(spec, r"\b(?:aNR|NR|NU)\b"):
        a = a.numbered()
    if b is not None and _mentions(spec, r"\b(?:bNR|b\.NR)\b"):
        b = b.numbered()
    wants_order = bool(spec.order_by or spec.limit is not None or spec.distinct or spec.distinct_count) and not agg or ranked or (options.ordered and (b is not None or not a.sorted and not agg))
    if wants_order:
        a, b = a.ordered(), b.ordered() if b is not None else None
    df, a_side, order = _side("a", a)
    names = Names(a_side, bare=options.bare_names)
    matches = None
    if spec.join is not None:
        if b is None:
            raise QueryParsingError(f"Join table '{spec.join.table}' was not found")
        df, names, b_order, matches = _joined(spec, df, a_side, b, options)
        order = order + b_order
    compiler = Compiler(names, options.functions, options.fallback, options.dialect)
    where = compiler.predicate(spec.where) if spec.where else None
    if not select:
        return _update(spec, df, a, names, compiler, where, order, matches)
    if not agg and any(_unnest(i, options.dialect) is None and not _STAR.match(i) and _nested_aggregate(_tree(i, compiler)) for i in spec.items if spec.excepted is None):
        raise QueryParsingError("Aggregates can't be part of an expression: use a second stage after '|'")
    if where is not None:
        df = df.where(where)
    warnings = a.warnings + (b.warnings if b else [])
    out = _aggregate(spec, df, compiler, order, options) if agg else _project(spec, df, a, names, compiler, order, options, shuffled=b is not None)
    return replace(out, warnings=warnings)


# -- join ------------------------------------------------------------------------------------------------------------

def _joined(spec: QuerySpec, df: DataFrame, a_side: Side, b: Table, options: Options):
    if (a_side.header is None) != (b.header is None):
        raise QueryParsingError("Both tables of a JOIN must have headers, or neither")
    right, b_side, b_order = _side("b", b)
    both = Names(a_side, b_side, options.bare_names)
    pairs = []
    for x, y in spec.join.pairs:
        sides = {}
        for text in (x, y):
            prefix, e = _join_key(text, both, options)
            sides[prefix] = e
        if set(sides) != {"a", "b"}:
            raise QueryParsingError(f"JOIN must compare a field of each table: '{x} == {y}'")
        ka, kb = sides["a"].kind, sides["b"].kind
        if ka != kb and not {ka, kb} <= {"int", "float"}:
            raise QueryParsingError(f"JOIN keys '{x}' and '{y}' differ in type ({ka} and {kb})")
        pairs.append((sides["a"].col, sides["b"].col))
    if spec.action == "update":
        kind, matches = spec.join.kind, "__matches"
        keys = [f"b_k{i}" for i in range(len(pairs))]
        keyed = right.withColumns({k: p[1] for k, p in zip(keys, pairs, strict=True)})
        by_key = [(p[0], F.col(k)) for k, p in zip(keys, pairs, strict=True)]
        if kind == "strict":
            return J.strict_left_join(df, keyed, by_key, keys).withColumn(matches, F.lit(1)), both, [], matches
        out = J.equi_join(df, J.with_matches(keyed, keys, matches), by_key, "left")
        out = J.require(out, F.coalesce(F.col(matches), F.lit(0)) <= 1, F.lit("More than one record of the join table matches a record that UPDATE would change"))
        return out.withColumn(matches, F.lit(1) if kind == "left" else F.coalesce(F.col(matches), F.lit(0))), both, [], matches
    if spec.join.kind == "strict":
        keys = [f"b_k{i}" for i in range(len(pairs))]
        keyed = right.withColumns({k: p[1] for k, p in zip(keys, pairs, strict=True)})
        out = J.strict_left_join(df, keyed, [(p[0], F.col(k)) for k, p in zip(keys, pairs, strict=True)], keys)
        return out, both, [], None
    out = J.equi_join(df, right, pairs, spec.join.kind)
    if spec.join.kind == "left":
        b_side.nf = F.coalesce(F.col("b_nf") if b.nf else F.when(pairs[0][1].isNotNull(), F.lit(len(b.columns))), F.lit(len(b.columns))).cast("bigint")
    return out, both, b_order, None


def _join_key(text: str, names: Names, options: Options) -> tuple[str, Expr]:
    node = Compiler(names, dialect=options.dialect).parse(text)
    e = names.resolve(node)
    if e is None:
        raise QueryParsingError(f"JOIN can only compare fields: '{text}'")
    base = node.value if isinstance(node, (ast.Attribute, ast.Subscript)) else node
    if base.id in ("bNR", "bNF") or re.fullmatch(r"b\d*", base.id):
        prefix = "b"
    elif re.fullmatch(r"a\d*", base.id) or base.id in ("NR", "aNR", "NF", "aNF"):
        prefix = "a"
    else:
        prefix = "a" if names.sides["a"].header and base.id in names.sides["a"].header else "b"
    return prefix, _present(e, names.sides[prefix])


def _present(e: Expr, side: Side) -> Expr:
    """A key that fails the query where a record is too short to have it, instead of passing for a null."""
    place = next((i for i, c in enumerate(side.columns) if e.kind != "null" and e.col._jc.toString() == F.col(c)._jc.toString()), None)
    if place is None or not side.ragged:
        return e
    missing = F.raise_error(F.lit(f"The record has no field {place + 1}, which is a JOIN key")).cast(side.types[place])
    return replace(e, col=F.when(F.col(f"{side.prefix}_nf") > place, e.col).otherwise(missing))


# -- select ----------------------------------------------------------------------------------------------------------

@dataclass
class Item:
    expr: Expr
    name: str | None
    alias: str | None = None


def _positional(text: str) -> bool:
    return bool(re.fullmatch(r"[ab]\d+|[ab]\[\d+\]", text.strip()))


def _items(spec: QuerySpec, df: DataFrame, names: Names, compiler: Compiler) -> list[Item]:
    if spec.excepted is not None:
        drop = set()
        for text in spec.excepted:
            e = names.resolve(compiler.parse(text))
            columns = names.sides["a"].columns
            hit = [i for i, c in enumerate(columns) if e is not None and e.kind != "null" and e.col._jc.toString() == F.col(c)._jc.toString()]
            if not hit:
                raise QueryParsingError(f"Unknown field in EXCEPT: '{text}'")
            drop.update(hit)
        return [Item(e := names.position("a", i + 1), e.name) for i in range(len(names.sides["a"].columns)) if i not in drop]
    out: list[Item] = []
    for item in spec.items:
        text, alias = split_alias(item)
        star = _STAR.match(text)
        if star:
            if alias:
                raise QueryParsingError("A star can't have an alias")
            for prefix in [star[1]] if star[1] else list(names.sides):
                side = names.sides.get(prefix)
                if side is None:
                    raise QueryParsingError("b.* needs a JOIN")
                out += [Item(e := names.position(prefix, i + 1), e.name) for i in range(len(side.columns))]
            continue
        unpack = re.match(r"^(?:\*|\.\.\.)\s*(?=[^*])(.+)$", text, re.S)
        if unpack:
            out += _unpacked(unpack[1], df, compiler)
            continue
        node = compiler.parse(text)
        e = compiler.compile(node)
        own = e.name if names.resolve(node) is not None else None
        out.append(Item(e, alias or own, alias))
    return out


def _unpacked(text: str, df: DataFrame, compiler: Compiler) -> list[Item]:
    """Columns of a list: as many as a literal has, or as its longest value in the data."""
    node = compiler.parse(text)
    if isinstance(node, (ast.List, ast.Tuple)):
        return [Item(compiler.compile(x), None) for x in node.elts]
    e = compiler.compile(node)
    if e.kind == "str":
        e = S.BUILTINS["list"](e)
    if e.kind != "array":
        raise QueryParsingError(f"Unable to unpack {e.kind}")
    width = df.agg(F.max(F.size(e.col))).first()[0] or 0
    return [Item(Expr(F.get(e.col, F.lit(i)), e.item or "any"), None) for i in range(width)]


def _header(items: list[Item], names: Names) -> list[str] | None:
    """Header of the output: none if the input has none and no alias is given."""
    if names.sides["a"].header is None and not any(i.alias for i in items):
        return None
    return [i.name or f"col{n + 1}" for n, i in enumerate(items)]


def _unnest(item: str, dialect: str) -> str | None:
    m = re.fullmatch(r"(UNNEST|Unnest|unnest|UNFOLD)\s*\((.*)\)", split_alias(item)[0].strip(), re.S)
    return m[2] if m else None


def _project(spec: QuerySpec, df: DataFrame, a: Table, names: Names, compiler: Compiler, order: list[tuple[str, bool]], options: Options, shuffled: bool) -> Table:
    exploded = [i for i, x in enumerate(spec.items) if _unnest(x, options.dialect) is not None]
    if len(exploded) > 1:
        raise QueryParsingError("Only one UNNEST is allowed in a query")
    unnest = None
    if exploded:
        inner = compiler.column(_unnest(spec.items[exploded[0]], options.dialect))
        inner = S.BUILTINS["list"](inner) if inner.kind == "str" else inner
        if inner.kind != "array":
            raise QueryParsingError(f"UNNEST needs a list, not {inner.kind}")
        unnest = split_alias(spec.items[exploded[0]])[1]
        df = df.select("*", F.posexplode(inner.col).alias("u_pos", "u_val"))
        order = [*order, ("u_pos", True)] if order else order
        names.sides["u"] = Side("u", ["u_val"], [df.schema["u_val"].dataType], None)
        spec = replace(spec, items=[x if i != exploded[0] else "u_unnested" + (f" AS {unnest}" if unnest else "") for i, x in enumerate(spec.items)])
        kind, item = kind_of(df.schema["u_val"].dataType)
        compiler.locals = {"u_unnested": Expr(F.col("u_val"), kind, item)}
    items = _items(spec, df, names, compiler)
    names.sides.pop("u", None)
    header = _header(items, names)
    keys = [compiler.column(x) for x in spec.order_by]
    columns = [f"c{i + 1}" for i in range(len(items))]
    picked = [x.expr.col.alias(c) for x, c in zip(items, columns, strict=True)]
    places = [e.col.alias(f"k_{i}") for i, e in enumerate(keys)]
    sort = [(f"k_{i}", not spec.descending) for i in range(len(keys))]
    if order:
        places += [F.col(c) for c, _ in order]
        sort += [(c, up if not spec.descending else not up) for c, up in order]
    out = df.select(*picked, *places)
    is_sorted = not keys and not shuffled and a.sorted
    if spec.distinct or spec.distinct_count:
        count = "n_1" if spec.distinct_count else None
        out = distinct_rows(out, columns, sort, count)
        columns = ([count] if count else []) + columns
        header = (["count"] + header if count else header) if header is not None else None
        is_sorted = False
    if spec.limit is not None:
        in_scan_order = not (keys or shuffled or spec.distinct or spec.distinct_count)
        if in_scan_order and a.one_scan:
            out = first_rows(out, spec.limit, sort)
        elif in_scan_order and a.by_file:
            out = first_rows(out, spec.limit, sort, a.by_file)
        else:
            out = out.orderBy(*order_by(sort)).limit(spec.limit) if sort else out.limit(spec.limit)
        is_sorted = True
    elif keys:
        out, is_sorted = out.orderBy(*order_by(sort)), True
    if is_sorted and keys:  # a later stage takes this order as it stands
        return Table(out, columns, header, sort, sorted=True)
    return Table(out, columns, header, sort, sorted=is_sorted)


# -- aggregates ------------------------------------------------------------------------------------------------------

def _aggregate_call(item: str, dialect: str) -> tuple[str, list[str]] | None:
    """(aggregate, argument texts) if the item is an aggregate call."""
    from ..lang.clauses import split_top

    text = split_alias(item)[0].strip()
    if _COUNT_STAR.match(text):
        return "COUNT", ["1"]
    m = re.match(r"^([A-Za-z_]+)\s*\((.*)\)$", text, re.S)
    name = A.canonical(m[1]) if m else None
    if name is None:
        return None
    try:
        args = [x.strip() for x in split_top(m[2], ",", dialect)]
    except QueryParsingError:
        return None
    if name in ("MIN", "MAX", "SUM") and m[1].islower() and (len(args) != 1 or args[0][:1] in "[(" or re.search(r"\bfor\b.+\bin\b|\.split\(", args[0])):
        return None  # Python's own function over values of one record
    return name, args


def _tree(item: str, compiler: Compiler) -> ast.AST:
    return compiler.parse(re.sub(r"^(\*|\.\.\.)", "", split_alias(item)[0].strip()))


def _nested_aggregate(node: ast.AST) -> bool:
    for x in ast.walk(node):
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and A.canonical(x.func.id) and not (x.func.id.islower() and x.func.id in ("min", "max", "sum")):
            return True
    return False


def _aggregate(spec: QuerySpec, df: DataFrame, compiler: Compiler, order: list[tuple[str, bool]], options: Options) -> Table:
    if spec.order_by:
        raise QueryParsingError("ORDER BY can't be used with aggregates: groups come sorted by their keys")
    if spec.distinct or spec.distinct_count:
        raise QueryParsingError("DISTINCT can't be used with aggregates")
    place = [F.col(c) for c, _ in order]
    key_nodes = [compiler.parse(x) for x in spec.group_by or []]
    keys = [compiler.compile(n) for n in key_nodes]
    dumps = [ast.dump(n) for n in key_nodes]
    columns, exprs, header_items = [], [], []
    by_key: dict[str, str] = {}
    names = compiler.names
    for item in spec.items:
        text, alias = split_alias(item)
        call = _aggregate_call(item, options.dialect)
        label = f"c{len(columns) + 1}"
        if call:
            name, args = call
            if name == "ARRAY_AGG":
                e = A.aggregate(name, compiler.column(args[0]), place)
                if len(args) > 1:
                    e = _post_process(", ".join(args[1:]), e, compiler)
            else:
                if len(args) != 1 or not args[0]:
                    raise QueryParsingError(f"{name} takes one argument")
                node = compiler.parse(args[0])
                if _nested_aggregate(node):
                    raise QueryParsingError("Aggregates can't be nested")
                e = A.aggregate(name, compiler.compile(node), place, options.strict_nulls)
            columns.append(label)
            exprs.append(e.col.alias(label))
            header_items.append(Item(e, alias, alias))
            continue
        star = _STAR.match(text)
        if star:
            for prefix in [star[1]] if star[1] else list(names.sides):
                for i in range(len(names.sides[prefix].columns)):
                    e = names.position(prefix, i + 1)
                    columns.append(f"c{len(columns) + 1}")
                    exprs.append(A.constant(e, e.name or f"{prefix}{i + 1}").col.alias(columns[-1]))
                    header_items.append(Item(e, e.name))
            continue
        node = compiler.parse(text)
        if _nested_aggregate(node):
            raise QueryParsingError("Aggregates can't be part of an expression: use a second stage after '|'")
        e = compiler.compile(node)
        own = e.name if names.resolve(node) is not None else None
        columns.append(label)
        if ast.dump(node) in dumps:
            by_key[label] = f"g_{dumps.index(ast.dump(node))}"  # taken from the key after grouping
        else:
            exprs.append(A.constant(e, text).col.alias(label))
        header_items.append(Item(e, alias or own, alias))
    if keys:
        keyed = df.withColumns({f"g_{i}": k.col for i, k in enumerate(keys)})
        groups = keyed.groupBy(*[f"g_{i}" for i in range(len(keys))])
        out = groups.agg(*exprs) if exprs else groups.agg(F.count(F.lit(1)).alias("n_all"))
        out = out.withColumns({c: F.col(k) for c, k in by_key.items()})
        sort = [(f"g_{i}", True) for i in range(len(keys))]
    else:
        out = df.agg(*exprs, F.count(F.lit(1)).alias("n_all")).where("n_all > 0").drop("n_all")
        sort = []
    if spec.limit is not None:
        out = out.orderBy(*order_by(sort)).limit(spec.limit) if sort else out.limit(spec.limit)
        return Table(out, columns, _header(header_items, names), sort, sorted=True)
    return Table(out, columns, _header(header_items, names), sort, sorted=not sort)


def _post_process(text: str, e: Expr, compiler: Compiler) -> Expr:
    node = compiler.parse(text)
    if isinstance(node, ast.Lambda):
        return compiler.inner(node.args.args[0].arg, e, node.body)
    if isinstance(node, ast.Name):
        return compiler.inner("v_", e, ast.Call(node, [ast.Name("v_")], []))
    raise QueryParsingError("The second argument of ARRAY_AGG must be a function")


# -- update ----------------------------------------------------------------------------------------------------------

def _update(spec: QuerySpec, df: DataFrame, a: Table, names: Names, compiler: Compiler, where: Column | None, order: list[tuple[str, bool]], matches: str | None) -> Table:
    if spec.limit is not None:
        raise QueryParsingError("LIMIT can't be used in UPDATE")
    hit = where if where is not None else F.lit(True)
    if matches:
        hit = (F.col(matches) == 1) & hit
    if _mentions(spec, r"\bNU\b"):
        df = running_count(df, hit, names.sides["a"].nr, "a_nu")
        compiler.locals = {"NU": Expr(F.col("a_nu"), "int")}
    side = names.sides["a"]
    new: dict[int, Column] = {}
    for target, text in spec.assignments:
        node = compiler.parse(target)
        e = names.resolve(node)
        i = next((i for i, c in enumerate(side.columns) if e is not None and e.kind != "null" and e.col._jc.toString() == F.col(c)._jc.toString()), None)
        if i is None:
            raise QueryParsingError(f"Unknown UPDATE field '{target}'")
        value, old = compiler.column(text), Expr(F.col(side.columns[i]), *kind_of(side.types[i]), dtype=side.types[i])
        if value.kind != old.kind and value.kind != "null":
            if {value.kind, old.kind} <= {"int", "float"}:
                old = replace(old, col=old.col.cast("double"))
                value = replace(value, col=value.col.cast("double"))
            else:
                old, value = replace(old, col=old.col if old.kind == "str" else S.to_str(old)), replace(value, col=value.col if value.kind == "str" else S.to_str(value))
        new[i] = F.when(hit, value.col).otherwise(old.col)
        if side.nf is not None and a.nf:
            outside = hit & (F.col("a_nf") <= i)
            new[i] = F.when(outside, F.raise_error(F.lit(f"The record has no field {i + 1} to update"))).otherwise(new[i])
    columns = [f"c{i + 1}" for i in range(len(side.columns))]
    picked = [new.get(i, F.col(c)).alias(n) for i, (c, n) in enumerate(zip(side.columns, columns, strict=True))]
    keep = [F.col(c) for c, _ in order]
    if side.nr and side.nr not in [c for c, _ in order]:
        keep.append(F.col(side.nr))
    if a.nf:
        keep.append(F.col("a_nf"))
    return Table(df.select(*picked, *keep), columns, a.header, order, side.nr, "a_nf" if a.nf else None, sorted=a.sorted and matches is None and not _mentions(spec, r"\bNU\b"), warnings=a.warnings)


def types_of(df: DataFrame) -> list[T.DataType]:
    return [f.dataType for f in df.schema.fields]
