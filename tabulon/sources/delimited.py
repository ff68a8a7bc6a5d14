"""Delimited files: lines to records to fields, natively, with record numbers, comments, headers and lint figures."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import IOHandlingError
from ..functions.scalar import float_text, strip
from ..lang.names import kind_of
from ..operators.ordering import Splits, count_splits, dense_numbers, rank_numbers, split_numbers
from ..plans.table import NUMBER, WIDTH, Table
from .dialect import Dialect, candidates
from .scratch import scratch_path

BOM = "﻿"


def read_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(file, start, at, line) of all lines; at orders the lines of a file. A UTF-8 mark at the start is dropped."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:  # files must be cut alike whenever they are read
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    line = F.col("value") if encoding != "latin-1" else F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), line.alias("line"))


def check_utf8(df: DataFrame) -> DataFrame:
    bad = ~F.is_valid_utf8("line")
    return df.where(F.when(~bad, True).otherwise(F.raise_error(F.lit("Unable to decode the input as UTF-8; try latin-1")).cast("boolean")))


def _comment(line: Column, d: Dialect) -> Column | None:
    tests = []
    if d.comment_prefix:
        tests.append(line.startswith(d.comment_prefix))
    if d.comment_regex:
        tests.append(line.rlike(d.comment_regex))
    return tests[0] if len(tests) == 1 else tests[0] | tests[1] if tests else None


def records(lines: DataFrame, d: Dialect, splits: Splits | None = None) -> DataFrame:
    """(ln, number, text): one row a record, ln the number of its first line. Comment lines go, but not inside a record.

    lines: (file, at, line), with the column start if they are a scan's as from read_lines. For quoted_rfc a record goes
    on while its quotes are odd: quote parities are summed per block of lines, then within blocks, so that no task sees
    the whole file. Lines that look like comments never open or close a quote.
    """
    comment = _comment(F.col("line"), d)
    scanned = "start" in lines.columns
    if d.policy != "quoted_rfc":
        keep = ~comment if comment is not None else None
        if scanned:
            return split_numbers(lines, keep, "ln", NUMBER, splits).select("ln", NUMBER, F.col("line").alias("text"))
        numbered = dense_numbers(lines.select("file", "at", "line"), "ln", [("file", True), ("at", True)])
        ranked = rank_numbers(numbered.where(keep), "ln", NUMBER) if keep is not None else numbered.withColumn(NUMBER, F.col("ln"))
        return ranked.select("ln", NUMBER, F.col("line").alias("text"))
    numbered = split_numbers(lines, None, "ln", "__same") if scanned else dense_numbers(lines.select("file", "at", "line"), "ln", [("file", True), ("at", True)])
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    odd = numbered.withColumn("q", (quotes % 2).cast("int"))
    odd = odd.withColumn("c", comment if comment is not None else F.lit(False)).withColumn("q", F.when(F.col("c"), 0).otherwise(F.col("q")))
    block = F.floor(F.col("ln") / 100_000)
    blocked = odd.withColumn("b", block)
    totals = blocked.groupBy("b").agg(F.sum("q").alias("s"))
    before = totals.withColumn("base", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    within = Window.partitionBy("b").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    open_before = (F.col("base") + F.coalesce(F.sum("q").over(within), F.lit(0))) % 2
    starts = blocked.join(before, "b").withColumn("start", open_before == 0).where(~(F.col("c") & F.col("start")))
    firsts = starts.groupBy("b").agg(F.max(F.when(F.col("start"), F.col("ln"))).alias("last"))
    carried = firsts.withColumn("carry", F.max("last").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    upto = Window.partitionBy("b").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.coalesce(F.max(F.when(F.col("start"), F.col("ln"))).over(upto), F.col("carry"))
    owned = starts.join(carried, "b").withColumn("rec", owner)
    glued = owned.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("x")).select(F.col("rec").alias("ln"), F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("text"))
    return dense_numbers(glued, NUMBER, [("ln", True)])


def fields(text: Column, d: Dialect) -> Column:
    """Fields of a record as array<string>, without Python."""
    if d.policy == "monocolumn":
        out = F.array(text)
    elif d.policy == "whitespace":
        out = F.regexp_extract_all(text, F.lit("[^ ]+"), F.lit(0))
    elif d.policy == "simple":
        out = F.split(text, r"\Q" + d.delim + r"\E", -1)
    else:
        sep = re.escape(d.delim)
        space = "" if d.delim == " " else " *"
        quoted = rf'{space}"[^"]*+(?:""[^"]*+)*+"{space}(?={sep}|\z)'
        token = rf"(?s){sep}({quoted}|[^{sep}]*)"
        parts = F.regexp_extract_all(F.concat(F.lit(d.delim), text), F.lit(token), F.lit(1))
        whole = rf'(?s)^{space}"((?:[^"]|"")*+)"{space}\z'
        clean = F.transform(parts, lambda x: F.when(x.rlike(whole), F.replace(F.regexp_extract(x, whole, 1), F.lit('""'), F.lit('"'))).otherwise(x))
        out = F.when(text.contains('"'), clean).otherwise(F.split(text, r"\Q" + d.delim + r"\E", -1))
    return F.transform(out, lambda x: strip(x)) if d.strip_fields else out


def broken_quotes(text: Column, d: Dialect) -> Column:
    """Whether some field outside proper quotes has a double quote."""
    if not d.policy.startswith("quoted"):
        return F.lit(False)
    sep = re.escape(d.delim)
    space = "" if d.delim == " " else " *"
    quoted = rf'{space}"[^"]*+(?:""[^"]*+)*+"{space}(?={sep}|\z)'
    parts = F.regexp_extract_all(F.concat(F.lit(d.delim), text), F.lit(rf"(?s){sep}({quoted}|[^{sep}]*)"), F.lit(1))
    whole = rf'(?s)^{space}"(?:[^"]|"")*+"{space}\z'
    return text.contains('"') & F.exists(parts, lambda x: x.contains('"') & ~x.rlike(whole))


def detect_lines(lines: DataFrame, delims: tuple[str, ...] = ("\t", ",", ";", "|"), *, min_lines: int = 10, comment_prefix: str = "#") -> Dialect | None:
    """The dialect that dialect.detect_by_content finds, judged over all lines of the file.

    One aggregate judges the policies of one line a record, and another quoted_rfc if some line has an odd number of
    quotes. Without such a line every line is a record, and quoted_rfc is what quoted is.
    """
    tried = candidates(delims, comment_prefix)
    comment = _comment(F.col("line"), Dialect(comment_prefix=comment_prefix))
    plain = (lines.where(~comment) if comment is not None else lines).select(F.col("line").alias("text"))
    odd = F.length(F.regexp_replace("text", '[^"]', "")) % 2 == 1

    def judged(df: DataFrame, some: list[Dialect]) -> tuple[dict[Dialect, tuple[int, int, int, bool]], bool]:
        parts = []
        for d in some:
            n = F.size(fields(F.col("text"), d))
            parts.append(F.struct(F.count(F.lit(1)).alias("k"), F.min(n).alias("low"), F.max(n).alias("high"), F.bool_or(broken_quotes(F.col("text"), d)).alias("bad")))
        row = df.agg(F.array(*parts).alias("x"), F.bool_or(odd).alias("odd")).first()
        return {d: tuple(x) for d, x in zip(some, row["x"], strict=True)}, bool(row["odd"])

    found, multi = judged(plain, [d for d in tried if d.policy != "quoted_rfc"])
    rfc = [d for d in tried if d.policy == "quoted_rfc"]
    if multi and rfc:
        found |= judged(records(lines, rfc[0]), rfc)[0]
    best, width = None, 1
    for d in tried:
        k, low, high, bad = found.get(d, (0, 0, 0, True))
        if k >= min_lines and not bad and low == high and high > width:
            best, width = d, high
    return best


def detect_file(spark: SparkSession, path: str, **options) -> Dialect | None:
    return detect_lines(read_lines(spark, path), **options)


@dataclass
class Raw:
    """What set_header needs to change its mind about the first record."""

    with_first: Table
    first: list[str]


_RAW: dict[int, Raw] = {}


def read_delimited(spark: SparkSession, path: str, d: Dialect = Dialect(), *, width: int | None = None, check: bool = True) -> Table:
    """A table of string columns with record numbers and widths. One pass finds the width unless it is given.

    With a broken quote, quoted_rfc fails and quoted warns; records of several widths are warned of and padded.
    """
    lines = read_lines(spark, path, d.encoding)
    if check and d.encoding == "utf-8":
        lines = check_utf8(lines)
    return table_of_lines(lines, d, width=width, check=check)


def table_of_lines(lines: DataFrame, d: Dialect, *, width: int | None = None, check: bool = True) -> Table:
    """A table of lines (file, at, line), in the order of file and at."""
    warnings: list[str] = []
    splits = made = None
    whole_lines = "start" in lines.columns and d.policy != "quoted_rfc" and not (d.comment_prefix or d.comment_regex)
    if check or width is None:
        if whole_lines:  # every line is a record, so one pass counts the splits and tells the widths apart
            parsed = lines.withColumn("f", fields(F.col("line"), d)).withColumn("bad", broken_quotes(F.col("line"), d))
            found = parsed.groupBy("file", "start", F.size("f").alias("w")).agg(
                F.count(F.lit(1)).alias("n"), F.min("at").alias("at"), F.count(F.lit(1)).alias("kept"), F.min(F.when(F.col("bad"), F.col("at"))).alias("bad")).collect()
            splits = Splits.of(found)
            firsts = sorted((min(splits.line(r["file"], r["start"], r["at"]) for r in found if r["w"] == w), w) for w in {r["w"] for r in found})
            bad = min((splits.line(r["file"], r["start"], r["bad"]) for r in found if r["bad"] is not None), default=None)
        else:
            if "start" in lines.columns and d.policy != "quoted_rfc":
                splits = count_splits(lines, ~_comment(F.col("line"), d))
            made = records(lines, d, splits)
            seen = made.withColumn("n", F.size(fields(F.col("text"), d))).withColumn("bad", broken_quotes(F.col("text"), d))
            per_width = seen.groupBy("n").agg(F.min(NUMBER).alias("r"), F.min(F.when(F.col("bad"), F.col("ln"))).alias("bad")).collect()
            firsts = sorted((r["r"], r["n"]) for r in per_width)
            bad = min((r["bad"] for r in per_width if r["bad"] is not None), default=None)
        width = max((w for _, w in firsts), default=0)
        if bad is not None:
            if d.policy == "quoted_rfc":
                raise IOHandlingError(f"Inconsistent double quotes at line {bad}")
            warnings.append(f"Inconsistent double quotes, first at line {bad}")
        if len(firsts) > 1:
            (r1, w1), (r2, w2) = firsts[:2]
            warnings.append(f"Number of fields is not consistent: record {r1} has {w1}, record {r2} has {w2}")
    numbered = (made if made is not None else records(lines, d, splits)).withColumn("f", fields(F.col("text"), d))
    columns = [f"c{i + 1}" for i in range(width)]
    df = numbered.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)], NUMBER, F.size("f").alias(WIDTH))
    one = splits is not None and len({s[0] for s in splits.starts}) <= 1  # several files are read by size
    whole = Table(df, columns, None, [(NUMBER, True)], NUMBER, WIDTH, warnings=warnings, sorted=one, one_scan=one)
    first_row = df.where(F.col(NUMBER) == 1).first()
    first = [first_row[c] or "" for c in columns] if first_row else []
    out = _headed(whole, first) if d.header else whole
    out.raw = Raw(whole, first)
    return out


def _headed(t: Table, first: list[str]) -> Table:
    df = t.df.where(F.col(NUMBER) > 1).withColumn(NUMBER, F.col(NUMBER) - 1)
    return replace(t, df=df, header=first)


def set_header(t: Table, header: bool) -> Table:
    """WITH (header) or WITH (noheader) for tables read from files; others keep what they have."""
    raw = getattr(t, "raw", None)
    if raw is None:
        return t if header else replace(t, header=None)
    out = _headed(raw.with_first, raw.first) if header else replace(raw.with_first)
    out.raw = raw
    return out


# -- writing ---------------------------------------------------------------------------------------------------------

def to_text(c: Column, dtype, sep: str = "|") -> Column:
    """A value as text: null is empty, numbers and booleans as Python prints them, lists joined by bars."""
    kind, item = kind_of(dtype)
    if kind == "array":
        inner = F.transform(c, lambda x: to_text(x, dtype.elementType, sep))
        return F.coalesce(F.array_join(inner, sep), F.lit(""))
    if kind == "float":
        return F.when(c.isNull(), "").otherwise(float_text(c.cast("double")))
    if kind == "bool":
        return F.when(c.isNull(), "").when(c, "True").otherwise("False")
    if kind in ("struct", "map", "variant"):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def quote(c: Column, d: Dialect) -> Column:
    need = c.contains(d.delim) | c.contains('"')
    if d.policy == "quoted_rfc":
        need = need | c.rlike(r"[\r\n]")
    return F.when(need, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def record_lines(t: Table, d: Dialect) -> DataFrame:
    """(line) of each record, plus the table's order columns."""
    if d.policy == "monocolumn" and len(t.columns) != 1:
        raise IOHandlingError("The monocolumn format holds exactly one field")
    sep = ";" if d.delim == "|" else "|"
    cells = [to_text(F.col(c), ty, sep) for c, ty in zip(t.columns, t.types, strict=True)]
    if d.policy.startswith("quoted"):
        cells = [quote(c, d) for c in cells]
    return t.df.select(F.concat_ws(d.delim if d.policy != "monocolumn" else "", *cells).alias("line"), *[F.col(c) for c, _ in t.order])


def sink_warnings(t: Table, d: Dialect) -> list[str]:
    """What the writer would lose: nulls written as empty strings, delimiters inside unquoted fields. One aggregate."""
    cells = [to_text(F.col(c), ty) for c, ty in zip(t.columns, t.types, strict=True)]
    nulls = F.bool_or(F.greatest(*[F.col(c).isNull() for c in t.columns], F.lit(False)))
    inside = F.bool_or(F.greatest(*[x.contains(d.delim) for x in cells], F.lit(False))) if d.policy in ("simple", "whitespace") and d.delim else F.lit(False)
    row = t.df.agg(nulls.alias("n"), F.bool_or(inside).alias("d") if d.policy not in ("simple", "whitespace") else inside.alias("d")).first()
    out = []
    if row["n"]:
        out.append("Missing values were written as empty strings")
    if row["d"]:
        out.append("Some fields hold the delimiter, which the output format can't quote")
    return out


def write_delimited(t: Table, path: str, d: Dialect = Dialect(), *, single_file: bool = False, mode: str = "errorifexists") -> None:
    """Write records as text in their order, with the header, if there is one, as the first line of the output."""
    from ..plans.table import order_by

    t = t.ordered()
    lines = record_lines(t, d).withColumn("__part", F.lit(1))
    if t.header is not None:
        if len(t.header) != len(t.columns):
            raise IOHandlingError("The header and the records differ in width")
        cells = [quote(F.lit(h), d) if d.policy.startswith("quoted") else F.lit(h) for h in t.header]
        types = dict(lines.dtypes)
        head = t.df.sparkSession.range(1).select(F.concat_ws(d.delim, *cells).alias("line"), *[F.lit(None).cast(types[c]).alias(c) for c, _ in t.order], F.lit(0).alias("__part"))
        lines = head.unionByName(lines)
    key = [F.col("__part"), *order_by(t.order)]
    out = lines.orderBy(*key).select("line")
    if not single_file:
        out.write.mode(mode).option("lineSep", "\n").text(path)
        return
    spark = t.df.sparkSession
    parts = scratch_path(spark, "parts")
    out.write.option("lineSep", "\n").text(parts)
    join_parts(spark, parts, path, mode)


def join_parts(spark: SparkSession, parts: str, path: str, mode: str = "errorifexists") -> None:
    """One text file in the folder path from the part files of a sorted output, copied one after another, and the parts deleted."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    target, source = hadoop.fs.Path(path), hadoop.fs.Path(parts)
    store, scratch = target.getFileSystem(conf), source.getFileSystem(conf)
    if store.exists(target):
        if mode == "ignore":
            return
        if mode != "overwrite":
            raise IOHandlingError(f"The output '{path}' exists")
        store.delete(target, True)
    whole = store.create(hadoop.fs.Path(target, "part-00000.txt"))
    try:
        for status in sorted(scratch.listStatus(source), key=lambda s: s.getPath().getName()):
            if status.getPath().getName().startswith("part-"):
                piece = scratch.open(status.getPath())
                hadoop.io.IOUtils.copyBytes(piece, whole, 1 << 20, False)
                piece.close()
    finally:
        whole.close()
    scratch.delete(source, True)
