"""Lint, statistics, align, shrink, markdown and TSV export, previews: each one aggregate and one projection."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..errors import IOHandlingError
from ..functions.scalar import strip
from ..plans.table import NUMBER, WIDTH, Table
from ..sources.delimited import broken_quotes, fields, read_lines, records
from ..sources.dialect import Dialect

NUMBER_PATTERN = r"^([0-9]+)(\.[0-9]+)?$"


@dataclass
class Lint:
    ok: bool
    n_records: int
    widths: list[tuple[int, int]]  # (width, first record), by first record
    first_bad_line: int | None
    first_spaced_line: int | None


def lint_lines(lines: DataFrame, d: Dialect) -> Lint:
    """One aggregate over the records: widths, the first bad quote, the first field with outer blanks."""
    r = records(lines, d)
    f = fields(F.col("text"), d.but(strip_fields=False))
    spaced = F.exists(f, lambda x: x.rlike(r"^\s|\s\z"))
    parsed = r.select("ln", NUMBER, F.size(f).alias("n"), broken_quotes(F.col("text"), d).alias("bad"), spaced.alias("spaced"))
    rows = parsed.groupBy("n").agg(F.min(NUMBER).alias("r"), F.count(F.lit(1)).alias("k"), F.min(F.when(F.col("bad"), F.col("ln"))).alias("bad"), F.min(F.when(F.col("spaced"), F.col("ln"))).alias("sp")).orderBy("r").collect()
    bad = min((x["bad"] for x in rows if x["bad"] is not None), default=None)
    return Lint(bad is None and len(rows) <= 1, sum(x["k"] for x in rows), [(x["n"], x["r"]) for x in rows], bad, min((x["sp"] for x in rows if x["sp"] is not None), default=None))


def lint_file(spark: SparkSession, path: str, d: Dialect) -> Lint:
    return lint_lines(read_lines(spark, path, d.encoding), d)


def _width(t: str) -> int:
    import unicodedata

    if t.isascii() and t.isprintable():
        return len(t)
    total = 0
    for ch in t:
        kind = unicodedata.category(ch)
        if kind in ("Mn", "Me", "Cf", "Cc") or "\u1160" <= ch <= "\u11ff":
            continue
        total += 2 if unicodedata.east_asian_width(ch) in "WF" else 1
    return total


@F.pandas_udf(ArrayType(IntegerType()))
def display_width(texts: pd.Series) -> pd.Series:
    """Columns that each line takes in a terminal: wide East Asian characters two, combining and control ones none."""
    return texts.map(lambda t: None if t is None else [_width(x) for x in t.split("\n")])


def visual(lines: Column, wide: bool) -> Column:
    """Display width of each line; only texts that aren't plain ASCII go to Python, and only if asked for."""
    plain = F.transform(lines, F.length)
    if not wide:
        return plain
    text = F.array_join(lines, "\n")
    ascii_only = text.rlike(r"^[\x20-\x7e\n]*\z")
    return F.when(ascii_only, plain).otherwise(F.coalesce(display_width(F.when(~ascii_only, text)), plain))


def field_lines(x: Column) -> Column:
    return F.transform(F.split(x, "\n"), lambda v: strip(v))


def column_stats(t: Table, *, header_in_data: bool = False, wide: bool = False) -> DataFrame:
    """A row a column: index, name, max_width, is_numeric, max_int, max_frac, only_ascii, n_empty.

    A column is numeric if every non-empty field is digits with an optional fraction; multi-line fields aren't.
    header_in_data: the first record is a header, whose text doesn't count against a numeric column.
    """
    parts = []
    for i, c in enumerate(t.columns):
        x = F.coalesce(F.col(c).cast("string"), F.lit(""))
        is_head = F.col(t.nr) == 1 if header_in_data and t.nr else F.lit(False)
        whole = F.trim(x)
        num = whole.rlike(NUMBER_PATTERN) & ~x.contains("\n")
        width = F.array_max(visual(field_lines(x), wide))
        parts.append(F.struct(
            F.lit(i + 1).alias("index"), F.lit(t.header[i] if t.header else f"c{i + 1}").alias("name"), F.max(width).alias("max_width"),
            (F.bool_and(num | (whole == "") | is_head) & F.bool_or(num)).alias("is_numeric"),
            F.coalesce(F.max(F.when(num, F.length(F.regexp_extract(whole, NUMBER_PATTERN, 1)))), F.lit(0)).alias("max_int"),
            F.coalesce(F.max(F.when(num, F.length(F.regexp_extract(whole, NUMBER_PATTERN, 2)))), F.lit(0)).alias("max_frac"),
            F.bool_and(x.rlike(r"^[\x00-\x7f]*\z")).alias("only_ascii"), F.count(F.when(whole == "", 1)).alias("n_empty"),
        ))
    row = t.df.agg(F.array(*parts).alias("s"))
    out = row.select(F.explode("s").alias("s")).select("s.*")
    numeric = F.coalesce("is_numeric", F.lit(False))
    return out.select("index", "name", F.coalesce("max_width", F.lit(0)).alias("max_width"), numeric.alias("is_numeric"),
                      F.when(numeric, F.col("max_int")).otherwise(0).alias("max_int"), F.when(numeric, F.col("max_frac")).otherwise(0).alias("max_frac"), F.coalesce("only_ascii", F.lit(True)).alias("only_ascii"), "n_empty")


def align(t: Table, d: Dialect, *, wide: bool = False) -> DataFrame:
    """(line) records padded to their columns: text left, numbers on the dot, one blank after the delimiter.

    A field of several lines goes on in lines of its own, which begin at its column; the record is one row all the same.
    The statistics are one row a column, so they go into the plan as constants. A header counts as a record.
    """
    stats = {r["index"]: r for r in column_stats(t, wide=wide).collect()}
    heads = {i: [v.strip() for v in h.split("\n")] for i, h in enumerate(t.header or [], 1)}
    cells, titles = [], []
    last, offset = len(t.columns), 0
    for i, c in enumerate(t.columns, 1):
        s = stats[i]
        number = s["is_numeric"] and len(heads.get(i, [])) < 2
        frac = s["max_frac"]
        total = max(s["max_width"], *map(len, heads.get(i, [""])), s["max_int"] + frac if number else 0)
        whole = max(s["max_int"], total - frac)
        lines = field_lines(F.coalesce(F.col(c).cast("string"), F.lit("")))
        x = F.array_join(lines, "\n" + " " * offset)
        dot = F.when(F.locate(".", x) > 0, F.locate(".", x) - 1).otherwise(F.length(x))
        text = F.concat(x, F.repeat(F.lit(" "), F.greatest(F.lit(total) - F.element_at(visual(lines, wide), -1), F.lit(0)))) if i < last else x
        if number:
            after = F.repeat(F.lit(" "), F.greatest(F.lit(frac) - (F.length(x) - dot), F.lit(0))) if i < last else F.lit("")
            text = F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(whole) - dot, F.lit(0))), x, after)
        cells.append(text)
        if t.header:
            title = ("\n" + " " * offset).join(heads[i])
            titles.append(title + " " * (total - len(heads[i][-1])) if i < last else title)
        offset += total + len(d.delim) + 1
    sep = d.delim + " "
    body = t.df.select(F.concat_ws(sep, *cells).alias("line"), *[F.col(c) for c, _ in t.order])
    if t.header:
        order = [F.lit(0).cast("bigint").alias(c) for c, _ in t.order]
        body = t.df.sparkSession.range(1).select(F.lit(sep.join(titles)).alias("line"), *order).unionByName(body)
    return body


def shrink(t: Table) -> Table:
    """Every line of every field trimmed."""
    trimmed = {c: F.array_join(F.transform(F.split(F.col(c), "\n"), lambda v: strip(v)), "\n") for c, ty in zip(t.columns, t.types, strict=True) if ty.simpleString() == "string"}
    return replace(t, df=t.df.withColumns({c: F.when(F.col(c).isNotNull(), v) for c, v in trimmed.items()}))


def changes_by_shrink(t: Table) -> bool:
    return not t.df.where(F.greatest(*[F.coalesce(F.col(c).rlike(r"^\s|\s\z|\n\s|\s\n"), F.lit(False)) for c in t.columns], F.lit(False))).isEmpty()


def markdown(t: Table) -> DataFrame:
    """(line) of a markdown table: bars escaped, cells padded, a rule under the header (or the first record)."""
    cells = {c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in t.columns}
    head = [h.replace("|", "\\|") for h in t.header] if t.header else None
    row = t.df.agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.greatest(*[x.contains("\n") for x in cells.values()], F.lit(False))).alias("multi"),
                   *[F.max(F.length(x)).alias(f"w{i}") for i, x in enumerate(cells.values())],
                   *([F.count_distinct(WIDTH).alias("widths")] if t.nf == WIDTH else [F.lit(1).alias("widths")])).first()
    if row["n"] + (head is not None) < 2:
        raise IOHandlingError("A markdown table needs a header and a record at least")
    if row["multi"]:
        raise IOHandlingError("Fields with line feeds have no markdown form")
    if row["widths"] > 1:
        raise IOHandlingError("All records must have the same number of fields")
    widths = [max(row[f"w{i}"] or 0, len(head[i]) if head else 0) for i in range(len(t.columns))]
    pad = lambda x, w: F.concat(x, F.repeat(F.lit(" "), F.lit(w) - F.length(x)))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[pad(x, w) for x, w in zip(cells.values(), widths)]), F.lit(" |"))
    t = t.ordered()
    key = t.order[0][0]
    body = t.df.select(line.alias("line"), F.col(key).cast("bigint").alias("k"))
    rule = "| " + " | ".join("-" * w for w in widths) + " |"
    spark = t.df.sparkSession
    if head is not None:
        title = "| " + " | ".join(h.ljust(w) for h, w in zip(head, widths)) + " |"
        top = spark.createDataFrame([(title, -2), (rule, -1)], "line string, k bigint")
    else:
        first = t.df.agg(F.min(F.col(key).cast("bigint"))).first()[0]
        body = body.withColumn("k", F.when(F.col("k") == first, F.lit(-2)).otherwise(F.col("k")))
        top = spark.createDataFrame([(rule, -1)], "line string, k bigint")
    return top.unionByName(body).orderBy("k").select("line")


def tsv(t: Table) -> DataFrame:
    """(line) of tab-separated text for spreadsheets; a field with a tab or line feed fails the query."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in t.columns]
    safe = [F.when(x.rlike(r"[\t\r\n]"), F.raise_error(F.lit("A field holds a tab or a line feed")).cast("string")).otherwise(x) for x in cells]
    return t.df.select(F.concat_ws("\t", *safe).alias("line"), *[F.col(c) for c, _ in t.order])


def preview(t: Table, start: int = 0, size: int = 100, chars: int = 250) -> DataFrame:
    """Records start + 1 to start + size, fields cut at a number of characters."""
    t = t.numbered()
    return t.df.where((F.col(t.nr) > start) & (F.col(t.nr) <= start + size)).select(*[F.left(F.col(c).cast("string"), F.lit(chars)).alias(c) for c in t.columns], t.nr)


def head_of_file(spark: SparkSession, path: str, size: int = 1_024_000, tail: bool = False) -> str:
    """The first or last ~1 MB of a text file, cut at a line boundary, read from any store."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    lines = lines.withColumn("n", F.octet_length("value") + 1)
    picked, total = [], 0
    # a line takes a byte at least, so no more lines than bytes can be needed
    for r in lines.orderBy(F.col("at").desc() if tail else F.col("at")).limit(size + 1).toLocalIterator():
        total += r["n"]
        if total > size and picked:
            break
        picked.append(r["value"])
    return "\n".join(reversed(picked) if tail else picked)


def with_comments(lines: DataFrame, comments: DataFrame) -> DataFrame:
    """Record lines and comment lines, both (ln, line), back in file order."""
    return lines.select("ln", "line").unionByName(comments.select("ln", "line")).orderBy("ln")
