"""Record numbers, running counts, distinct rows and limits, all without a single-task window."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

BLOCK = 1_000_000
_PLACE = (1 << 33) - 1  # the part of monotonically_increasing_id that counts rows within a partition
_MOVED = "The input was cut into other partitions than when its records were counted"


def dense_numbers(df: DataFrame, name: str, order: list[tuple[str, bool]] | None = None) -> DataFrame:
    """1-based numbers in the given order, or in partition order if there is none.

    A second execution may deal rows to other partitions than the first, so the rows are written once, in order and
    with their places, to the shared folder; what was written is counted and numbered. No partition holds everything.
    """
    spark = df.sparkSession
    if order:
        df = df.orderBy(*[F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order])
    empty = [f.name for f in df.schema.fields if f.dataType.typeName() == "void"]
    placed = df.withColumns({c: F.col(c).cast("string") for c in empty}).withColumn("__mid", F.monotonically_increasing_id())
    path = scratch_path(spark, "numbered")
    placed.write.parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path).withColumn("__part", F.shiftright("__mid", 33))
    counts = sorted((r[0], r[1]) for r in stored.groupBy("__part").count().collect())
    rows, total = [], 0
    for part, n in counts:
        rows.append((part, total + 1))
        total += n
    starts = spark.createDataFrame(rows, "__part long, __base long")
    return stored.join(F.broadcast(starts), "__part").withColumn(name, F.col("__base") + F.col("__mid").bitwiseAND(F.lit(_PLACE))).drop("__mid", "__part", "__base")


def file_numbers(df: DataFrame, file: str, row: str, name: str) -> DataFrame:
    """1-based numbers of rows by file, in order of the files' paths, and 0-based row index in the file.

    One count by file gives the offsets. They are broadcast: a row a file, of which Spark's own list is on the driver.
    """
    rows, total = [], 1
    for path, n in sorted((r[0], r[1]) for r in df.groupBy(file).count().collect()):
        rows.append((path, total))
        total += n
    starts = df.sparkSession.createDataFrame(rows, f"{file} string, __base long")
    return df.join(F.broadcast(starts), file).withColumn(name, F.col("__base") + F.col(row)).drop("__base")


@dataclass
class Splits:
    """Where the numbers of each input split begin. starts: (file, start, partition, line, low, high, base): lines are numbered
    from line + their place in the partition, kept lines from base + their place among those kept, which is in [low, high)."""

    starts: list[tuple]

    @classmethod
    def of(cls, found: list) -> Splits:
        """found: rows with file, start, n (lines), at (the first line's place), kept (lines); several for a split add up."""
        merged: dict[tuple[str, int], list[int]] = {}
        for r in found:
            x = merged.setdefault((r["file"], r["start"]), [0, r["at"], 0])
            x[0], x[1], x[2] = x[0] + r["n"], min(x[1], r["at"]), x[2] + r["kept"]
        before: Counter[int] = Counter()
        place = {}
        for key, (_, at, kept) in sorted(merged.items(), key=lambda m: m[1][1]):  # kept lines of the splits that come before in the same partition
            place[key] = before[at >> 33]
            before[at >> 33] += kept
        rows, n_lines, n_kept = [], 1, 1
        for key, (n, at, kept) in sorted(merged.items()):
            rows.append((*key, at >> 33, n_lines - (at & _PLACE), place[key], place[key] + kept, n_kept - place[key]))
            n_lines, n_kept = n_lines + n, n_kept + kept
        return cls(rows)

    def line(self, file: str, start: int, at: int) -> int:
        """The number of the line at a place."""
        if not hasattr(self, "_lines"):
            self._lines = {r[:2]: r[3] for r in self.starts}
        return self._lines[file, start] + (at & _PLACE)


def count_splits(lines: DataFrame, keep: Column | None) -> Splits:
    kept = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True)
    return Splits.of(lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"), F.count_if(kept).alias("kept")).collect())


def split_numbers(lines: DataFrame, keep: Column | None, line_number: str, number: str, splits: Splits | None = None) -> DataFrame:
    """The kept ones of lines (file, start, at, line), numbered from 1 among all lines and among the kept ones.

    start: where the line's input split begins in its file; at: monotonically_increasing_id over the scan. One count by
    split, unless splits has it, gives the offsets, which are broadcast: a row a split, of which Spark's own list is on the
    driver. Rows aren't moved. Should the splits have changed since they were counted, the query fails rather than number
    rows wrongly.
    """
    splits = splits or count_splits(lines, keep)
    starts = lines.sparkSession.createDataFrame(splits.starts, "file string, start long, __part long, __line long, __low long, __high long, __base long")
    df = (lines.where(F.coalesce(keep, F.lit(False))) if keep is not None else lines).withColumn("__own", F.monotonically_increasing_id()).join(F.broadcast(starts), ["file", "start"], "left")
    at = F.col("__own").bitwiseAND(F.lit(_PLACE))
    sound = (F.shiftright("__own", 33) == F.col("__part")) & (at >= F.col("__low")) & (at < F.col("__high"))
    checked = lambda c: F.when(sound, c).otherwise(F.raise_error(F.lit(_MOVED)).cast("bigint"))
    return df.select("line", checked(F.col("__line") + F.col("at").bitwiseAND(F.lit(_PLACE))).alias(line_number), checked(F.col("__base") + at).alias(number))


def rank_numbers(df: DataFrame, key: str, name: str) -> DataFrame:
    """1-based numbers by a unique positive key: counts per block of keys, then places within blocks."""
    marked = df.withColumn("__block", F.floor(F.col(key) / BLOCK))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block of a million
    starts = marked.groupBy("__block").count().withColumn("__base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return marked.join(starts, "__block").withColumn(name, F.col("__base") + F.row_number().over(Window.partitionBy("__block").orderBy(key))).drop("__block", "__base")


def running_count(df: DataFrame, flag: Column, number: str, name: str) -> DataFrame:
    """Inclusive running count of true flags by a dense number: counts per block, then within blocks."""
    marked = df.withColumn("__flag", F.coalesce(flag, F.lit(False)).cast("bigint")).withColumn("__block", F.floor((F.col(number) - 1) / BLOCK))
    totals = marked.groupBy("__block").agg(F.sum("__flag").alias("__sum"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block of a million
    starts = totals.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    within = Window.partitionBy("__block").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    return marked.join(starts, "__block").withColumn(name, F.col("__base") + F.sum("__flag").over(within)).drop("__flag", "__block", "__base")


EARLY = 100_000  # rows that first_rows fetches at most


def first_rows(df: DataFrame, n: int, order: list[tuple[str, bool]], files: list[str] | None = None) -> DataFrame:
    """The first n rows of a scan in record order, from as few files and partitions as hold them.

    The rows, n at most, are fetched as Spark's own take does: the first partition, then more at a time. Without files
    df reads one file, whose partitions come in order. Otherwise the first order column is a row's file, and ranges of
    files are asked, in order, that grow fourfold. Larger limits are left to a top-k over the whole scan.
    """
    key = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order]
    if n > EARLY or any(kind in f.dataType.simpleString() for f in df.schema.fields for kind in ("variant", "void", "<timestamp", ":timestamp", ",timestamp")):
        return df.orderBy(*key).limit(n)
    names, schema = df.columns, df.schema
    times = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp"]  # they travel as numbers, as local times are ambiguous
    df = df.withColumns({c: F.unix_micros(c) for c in times})
    rows: list = df.limit(n).collect() if files is None else []
    at, size = 0, 1
    file = F.col(order[0][0])
    while files is not None and at < len(files) and len(rows) < n:
        part = df if at == 0 else df.where(file > files[at - 1])
        part = part if at + size >= len(files) else part.where(file <= files[at + size - 1])
        rows += (part if size == 1 < len(files) else part.orderBy(*key)).limit(n - len(rows)).collect()
        at, size = at + size, size * 4
    out = df.sparkSession.createDataFrame(rows, df.schema).withColumns({c: F.timestamp_micros(c) for c in times})
    return out.select(*[F.col(c) for c in names])


def distinct_rows(df: DataFrame, columns: list[str], order: list[tuple[str, bool]], count: str | None = None) -> DataFrame:
    """Distinct rows of the columns; each keeps the order columns of its first occurrence. count: multiplicity column."""
    if not order and count is None:
        return df.select(*columns).distinct()
    aggs = [F.count(F.lit(1)).alias(count)] if count else []
    if order:
        place = F.struct(*[F.col(c) for c, _ in order]) if len(order) > 1 else F.col(order[0][0])
        aggs.append((F.min if order[0][1] else F.max)(place).alias("__first"))
    out = df.groupBy(*columns).agg(*aggs)
    return out.select(*columns, *([count] if count else []), *[(F.col("__first")[c] if len(order) > 1 else F.col("__first")).alias(c) for c, _ in order])
