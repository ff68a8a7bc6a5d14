"""Tables: a DataFrame with positional columns, an optional header and, on demand, record order and numbers."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IOHandlingError
from ..operators.ordering import dense_numbers, file_numbers

ORDER, NUMBER, WIDTH = "__order", "__nr", "__nf"


@dataclass
class Table:
    """columns: names of the data columns in df, by position. header: their names in queries, or None.

    order: sort columns that restore the record order, as (name, ascending); empty if df's own order is all there is.
    nr: a column of dense 1-based numbers, if df has one. nf: a column of record widths, for ragged tables.
    sorted: whether df's rows already come in that order.
    """

    df: DataFrame
    columns: list[str]
    header: list[str] | None
    order: list[tuple[str, bool]] = field(default_factory=list)
    nr: str | None = None
    nf: str | None = None
    sorted: bool = True
    warnings: list[str] = field(default_factory=list)
    placed: Callable[[], Table] | None = None  # the table with its order columns, for sources that read them only on demand
    by_file: list[str] | None = None  # the files, in order, if the order columns are a row's file and its index there
    one_scan: bool = False  # whether df reads one file without a shuffle, so that its partitions come in record order

    @property
    def types(self) -> list[T.DataType]:
        by_name = {f.name: f.dataType for f in self.df.schema.fields}
        return [by_name[c] for c in self.columns]

    def numbered(self) -> Table:
        """The table with dense record numbers, made without a single-task window."""
        if self.nr:
            return self
        if self.placed:
            return self.placed().numbered()
        if self.by_file:
            df = file_numbers(self.df, self.order[0][0], self.order[1][0], NUMBER)
            return replace(self, df=df, nr=NUMBER, order=[(NUMBER, True)], by_file=None)
        df = dense_numbers(self.df, NUMBER, self.order)  # read back in any order of its files
        return replace(self, df=df, nr=NUMBER, order=[(NUMBER, True)], sorted=False, one_scan=False)

    def ordered(self) -> Table:
        """The table with order columns; a plain DataFrame gets its partition order."""
        if self.order:
            return self
        if self.placed:
            return self.placed()
        return replace(self, df=self.df.withColumn(ORDER, F.monotonically_increasing_id()), order=[(ORDER, True)])

    def result(self, ordered: bool = False) -> DataFrame:
        """Only the data columns, under their header names made unique."""
        df = self.df
        if ordered and self.order and not self.sorted:
            df = df.orderBy(*order_by(self.order))
        return df.select(*[F.col(c).alias(n) for c, n in zip(self.columns, unique_names(self.output_names()), strict=True)])

    def output_names(self) -> list[str]:
        return list(self.header) if self.header is not None else [f"col{i + 1}" for i in range(len(self.columns))]


def order_by(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order]


def unique_names(names: list[str]) -> list[str]:
    """Names made distinct without regard to case, as Parquet and Spark need them."""
    seen: set[str] = set()
    out = []
    for n in names:
        new, k = n, 2
        while new.lower() in seen:
            new, k = f"{n}_{k}", k + 1
        seen.add(new.lower())
        out.append(new)
    return out


def _plain(df: DataFrame) -> tuple[DataFrame, list[str]]:
    inner = [f"c{i + 1}" for i in range(len(df.columns))]
    return df.toDF(*inner), inner


def from_dataframe(df: DataFrame, header: list[str] | bool = True) -> Table:
    names = list(df.columns) if header is True else header or None
    plain, inner = _plain(df)
    if names is not None and len(names) != len(inner):
        raise IOHandlingError("The header and the records differ in width")
    return Table(plain, inner, names)


def from_parquet(spark: SparkSession, path: str, **options: str) -> Table:
    """A Parquet table, numbered by row index and, for several files, their offsets. Filters stay pushed down."""
    df = spark.read.options(**options).parquet(path)
    names = list(df.columns)
    inner = [f"c{i + 1}" for i in range(len(names))]
    picked = [F.col(f"`{n}`").alias(c) for n, c in zip(names, inner, strict=True)]

    files = df.inputFiles()

    def placed() -> Table:
        if len(files) == 1:
            return Table(df.select(*picked, (F.col("_metadata.row_index") + 1).alias(NUMBER)), inner, names, [(NUMBER, True)], NUMBER, one_scan=True)
        place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
        return Table(df.select(*picked, *place), inner, names, [("__file", True), ("__row", True)], by_file=sorted(re.sub("^([a-z0-9]+):///", r"\1:/", f) for f in files), sorted=False)

    return Table(df.select(*picked), inner, names, placed=placed, sorted=len(files) <= 1)  # several files are read by size


def from_rows(spark: SparkSession, rows: list[list], header: list[str] | None = None) -> Table:
    """An in-memory table. Short records are padded with nulls and warned of; columns of mixed types become strings."""
    width = max((len(r) for r in rows), default=len(header or []))
    if header is not None and rows and len(header) != len(rows[0]):
        raise IOHandlingError("The header and the records differ in width")
    warnings = []
    first = {}
    for n, r in enumerate(rows, 1):
        first.setdefault(len(r), n)
    if len(first) > 1:
        (w1, n1), (w2, n2) = list(first.items())[:2]
        warnings.append(f"Number of fields is not consistent: record {n1} has {w1}, record {n2} has {w2}")
    inner = [f"c{i + 1}" for i in range(width)]
    kinds = []
    for i in range(width):
        seen = {type(r[i]) for r in rows if i < len(r) and r[i] is not None}
        simple = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
        if seen == {int, float}:
            kinds.append(T.DoubleType())
        elif len(seen) == 1 and (t := next(iter(seen))) in simple:
            kinds.append(simple[t])
        elif seen and all(t in (list, tuple) for t in seen):
            kinds.append(T.ArrayType(T.StringType()))
        else:
            kinds.append(T.StringType())

    def fit(v, t):
        if v is None:
            return None
        if isinstance(t, T.DoubleType):
            return float(v)
        if isinstance(t, T.ArrayType):
            return [None if x is None else str(x) for x in v]
        return str(v) if isinstance(t, T.StringType) else v

    data = [(*[fit(r[i], kinds[i]) if i < len(r) else None for i in range(width)], n, len(r)) for n, r in enumerate(rows, 1)]
    schema = T.StructType([*[T.StructField(c, t) for c, t in zip(inner, kinds, strict=True)], T.StructField(NUMBER, T.LongType()), T.StructField(WIDTH, T.IntegerType())])
    return Table(spark.createDataFrame(data, schema), inner, header, [(NUMBER, True)], NUMBER, WIDTH, warnings=warnings)
