"""pandas, JSON lines and SQLite sources, and JSON lines output."""

from __future__ import annotations

import re
import sqlite3

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import IOHandlingError
from ..plans.table import NUMBER, Table, from_dataframe


def from_pandas(spark: SparkSession, frame) -> Table:
    """A pandas frame; default column labels mean no header, the index is not addressable."""
    import pandas as pd

    plain = isinstance(frame.columns, pd.RangeIndex)
    named = frame.set_axis([f"c{i + 1}" for i in range(frame.shape[1])], axis=1).reset_index(drop=True)
    named = named.assign(**{NUMBER: range(1, len(named) + 1)}).astype(object).where(lambda x: x.notna(), None).infer_objects()
    df = spark.createDataFrame(named)
    return Table(df, [c for c in df.columns if c != NUMBER], None if plain else [str(c) for c in frame.columns], [(NUMBER, True)], NUMBER)


def read_json_lines(spark: SparkSession, path: str) -> Table:
    """One object a record, as the one column of a headerless table; blank lines are skipped, bad ones fail the query."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("ok", F.try_parse_json("value"))
    bad = F.raise_error(F.concat(F.lit("Unable to decode a JSON record: "), F.substring("value", 1, 80)))
    df = lines.select(F.when(F.col("ok").isNotNull(), F.col("ok")).otherwise(F.parse_json(bad.cast("string"))).alias("c1"))
    return Table(df, ["c1"], None)


def write_json_lines(t: Table, path: str, mode: str = "errorifexists") -> None:
    """A single field is written as its value, several as an array."""
    names = t.columns
    value = F.to_json(F.to_variant_object(F.array(names[0]))) if len(names) == 1 else None
    if value is not None:
        out = t.df.select(F.regexp_replace(value, r"(?s)^\[(.*)\]$", "$1").alias("value"))
    else:
        parts = [F.regexp_replace(F.to_json(F.to_variant_object(F.array(c))), r"(?s)^\[(.*)\]$", "$1") for c in names]
        out = t.df.select(F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")).alias("value"))
    out.write.mode(mode).text(path)


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", 4))
        self.width = len(schema.fields) - 1

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            low, high = c.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, part):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            yield from c.execute(f'select *, rowid from "{self.table}" where rowid >= ? and rowid < ? order by rowid', (part.low, part.high))


class SqliteSource(DataSource):
    """Options: path, table, partitions. Rows are read by ranges of rowid, in parallel."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        kinds = {"INT": "bigint", "CHAR": "string", "CLOB": "string", "TEXT": "string", "BLOB": "binary", "REAL": "double", "FLOA": "double", "DOUB": "double"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            info = c.execute(f"pragma table_info(\"{self.options['table']}\")").fetchall()
        found = [f"`{name}` " + next((t for k, t in kinds.items() if k in (kind or "").upper()), "string") for _, name, kind, *_ in info]
        return ", ".join([*found, "__rowid bigint"])

    def reader(self, schema):
        return _SqliteReader(self.options, schema)


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 4) -> Table:
    if not re.fullmatch(r"[a-zA-Z0-9_]+", table):
        raise IOHandlingError(f"Bad table name '{table}'")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        if not c.execute("select 1 from sqlite_master where type in ('table', 'view') and name = ?", (table,)).fetchone():
            raise IOHandlingError(f"No table '{table}' in the database")
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", partitions).load()
    t = from_dataframe(df)
    return Table(t.df, t.columns[:-1], t.header[:-1], [(t.columns[-1], True)])


