"""Shared pieces of the training-data operators: scratch tables, id hashing and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (SQL pattern).
WORD = r"[^\x20\x09-\x0D]+"

_OWN_SCRATCH: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage.

    It is the one that the cluster names in ``spark.checkpoint.dir``; only where that is unset and all runs in this
    process (tests, a laptop) a temporary folder of this machine stands in.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_SCRATCH:
        _OWN_SCRATCH.append(tempfile.mkdtemp(prefix="tabulon-"))
    return _OWN_SCRATCH[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/tabulon-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lost executors cost a re-read, not a recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and nothing reads any more."""
    for t in tables:
        drop_path(t.sparkSession, t.scratch_path)


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Keep Arrow batches to Python workers small, so that a worker's memory doesn't depend on the rows' number or size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path in whatever store holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def unit_hash(*cols) -> F.Column:
    """A reproducible number in [0, 1) from the columns' text, the same in other SQL engines (md5 of the text)."""
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


FILTER_BITS = 1 << 25  # of the filter that may_hold broadcasts: 4 MB, whatever the number of ids


def may_hold(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """df with ``may``, which is true where the key is among ids (a column of the same name), and seldom elsewhere.

    The ids are marked in bitmaps of a fixed total size, which are broadcast; with many more ids than bits, may is just
    true everywhere. So rows that an exact join would drop needn't be shuffled for it. A null key may not be held.
    """
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BITS)) + 1
    marks = ids.where(F.col(key).isNotNull()).select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    found = df.withColumn("__p", place).withColumn("__own", F.bitmap_bucket_number("__p")).join(F.broadcast(marks), F.col("__own") == F.col("__bucket"), "left")
    at = F.bitmap_bit_position("__p")
    byte = F.conv(F.hex(F.col("__bits").substr((F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(__byte, __bit) & 1 = 1")
    found = found.withColumn("__byte", byte).withColumn("__bit", (at % 8).cast("int"))
    return found.withColumn("may", F.col(key).isNotNull() & F.coalesce(hit, F.lit(False))).drop("__p", "__own", "__bucket", "__bits", "__byte", "__bit")


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, so that extra columns can't clash with those that an operator makes."""
    return df.select(*[F.col(n) for n in names])


def components(edges: DataFrame, src: str, dst: str, *, max_rounds: int = 60) -> DataFrame:
    """Connected components by randomised contraction: (node, component), component the smallest node reachable.

    Every round maps each node to the neighbour (or itself) of smallest hash and contracts the edges; the number of
    nodes with edges falls by a constant factor a round, whatever the diameter. Rounds are written to the shared
    folder. Nodes without edges don't appear. Null ends and self loops are ignored; repeated edges count once.
    Hubs are handled by partial aggregation (min) and by joins that AQE can split.
    """
    spark = edges.sparkSession
    u, v = F.col("u"), F.col("v")
    level = materialize(
        edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v"))
        .where(u.isNotNull() & v.isNotNull() & (u != v)).distinct(), "edges")
    maps: list[DataFrame] = []
    node_type = dict(level.dtypes)["u"]
    while not level.isEmpty():
        if len(maps) >= max_rounds:
            raise RuntimeError("connected components did not converge")
        seed = F.lit(len(maps))
        rank = lambda c: F.struct(F.xxhash64(c, seed).alias("h"), c.alias("n"))
        both = level.select(u, rank(v).alias("m")).unionByName(level.select(v.alias("u"), rank(u).alias("m")))
        step = materialize(
            both.groupBy("u").agg(F.min("m").alias("m"))
            .select(u.alias("node"), F.least(rank(u), F.col("m"))["n"].alias("parent")), "parents")
        maps.append(step)
        moved = (
            level.join(step.select(u_alias("node", "u"), F.col("parent").alias("pu")), "u")
            .join(step.select(u_alias("node", "v"), F.col("parent").alias("pv")), "v")
            .where(F.col("pu") != F.col("pv"))
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        last, level = level, materialize(moved, "edges")
        release(last)
    release(level)
    if not maps:
        return spark.createDataFrame([], f"node {node_type}, component {node_type}")
    found = maps[0].select("node", F.col("parent").alias("root"))
    for step in maps[1:]:
        found = found.join(step.select(F.col("node").alias("root"), "parent"), "root", "left").select(
            "node", F.coalesce("parent", "root").alias("root"))
    found = materialize(found, "roots")
    release(*maps)
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", "component")


def u_alias(name: str, alias: str) -> F.Column:
    return F.col(name).alias(alias)
