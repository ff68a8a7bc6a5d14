"""Exact top-k inner-product search over a vector-approximation file.

The file holds a byte a component: the number of its cell on a grid that cuts each dimension's range into at most 256
cells of equal width. It is written once. Queries come in waves of bounded size; a wave scans the file, not the vectors:
a cell bounds a component from both sides, so a query's inner product with a vector is bounded from its cells. A task
hands on what can still be among the k best of what it has seen. Exact vectors are then read only for the survivors of
all tasks, those of the best bounds first, and the rest only as far as their upper bound reaches the k-th exact score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, may_hold, release

CELLS = 256
QUERIES = 512  # queries whose bounds are held at once
FIRST = 4  # times k candidates a query are read exactly before the rest is asked for
_LONG = 2**63 - 1


def integer_vectors(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component; rows with null or non-finite parts are left out."""
    x = F.col("v0")
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v0"))
        .where(x.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
        .select("vec_id", F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long")).alias("v"))
    )


def approximate(vectors: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The approximation file (vec_id, vkey, cells), and the grid: the low end and the cell width of each dimension.

    vkey tells vectors of one id apart. The grid has an entry a dimension, whatever the number of vectors.
    """
    ends = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("i").collect()
    low = np.array([r["a"] for r in ends], np.int64)
    width = np.array([max(1, -(-(r["b"] - r["a"] + 1) // CELLS)) for r in ends], np.int64)

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            at = lists.offsets.to_numpy()
            place = np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], np.diff(at))
            cells = ((lists.flatten().to_numpy(zero_copy_only=False) - low[place]) // width[place]).astype(np.uint8).tobytes()
            edges = (at - at[0]).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([cells[a:b] for a, b in zip(edges, edges[1:])], pa.binary())], ["vec_id", "vkey", "cells"])

    return materialize(vectors.select("vec_id", "vkey", "v").mapInArrow(run, "vec_id long, vkey long, cells binary"), "approximation"), low, width


class Bounds:
    """Scans blocks of cells for queries of one length: what may be among each query's k best, and the k best lower bounds."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, low: np.ndarray, width: np.ndarray, k: int):
        d = q.shape[1]
        self.ids, self.k, self.hits = ids, k, []
        q = q.astype(np.float64)
        self.scaled = q * width[:d]  # a cell further is so much more
        spread = (width[:d] - 1).astype(np.float64)
        self.base = q @ low[:d].astype(np.float64) + np.minimum(q, 0) @ spread  # least product within the first cells
        self.reach = np.abs(q) @ spread
        self.slack = (np.abs(self.scaled).sum(1) * CELLS + np.abs(self.base) + self.reach) * 1e-9 + 1e-6
        self.best = np.full((len(q), k), -np.inf)

    def scan(self, ids: np.ndarray, keys: np.ndarray, cells: np.ndarray) -> None:
        cells = cells.astype(np.float64).T
        for at in range(0, len(self.ids), QUERIES):
            own = slice(at, at + QUERIES)
            lower = self.scaled[own] @ cells + (self.base[own] - self.slack[own])[:, None]
            upper = lower + (self.reach[own] + 2 * self.slack[own])[:, None]
            same = self.ids[own][:, None] == ids[None, :]
            lower[same] = upper[same] = -np.inf
            both = np.concatenate((self.best[own], lower), 1)
            self.best[own] = np.partition(both, both.shape[1] - self.k, 1)[:, -self.k :]
            query, row = np.nonzero((upper >= self.best[own].min(1)[:, None]) & ~same)
            self.hits.append((query + at, ids[row], keys[row], lower[query, row], upper[query, row]))
        if sum(len(h[0]) for h in self.hits) > 2_000_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """The hits that the bar by now lets through."""
        if not self.hits:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float, float))
        parts = [np.concatenate(x) for x in zip(*self.hits)]
        ok = parts[4] >= self.best.min(1)[parts[0]]
        self.hits = [tuple(p[ok] for p in parts)]
        return self.hits[0]


def _wave(part: list, k: int, vectors: DataFrame, cells: DataFrame, low: np.ndarray, width: np.ndarray, block: int) -> DataFrame:
    """(query_id, vec_id, score) of the hits of some queries, as a table of its own."""
    spark = vectors.sparkSession
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for n, d in enumerate(sorted({len(r["v"]) for r in part})):
        own = [(i, r) for i, r in enumerate(part) if len(r["v"]) == d]
        by_size[d] = np.array([i for i, _ in own], np.int64), np.array([r["vec_id"] for _, r in own], np.int64), np.array([r["v"] for _, r in own], np.int64).reshape(len(own), d)
    sent = spark.sparkContext.broadcast(by_size)

    def scan(batches):
        bounds = {d: Bounds(ids, q, low, width, k) for d, (_, ids, q) in sent.value.items()}
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            raw = batch.column(2).to_pylist()
            sizes = np.array([len(x) for x in raw])
            for d in np.unique(sizes):
                if int(d) in bounds:
                    rows = np.flatnonzero(sizes == d)
                    for b in range(0, len(rows), block):
                        own = rows[b : b + block]
                        bounds[int(d)].scan(ids[own], keys[own], np.frombuffer(b"".join([raw[i] for i in own]), np.uint8).reshape(len(own), d))
        for d, x in bounds.items():
            query, vec, key, lower, upper = x.settle()
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[d][0][query]), pa.array(vec), pa.array(key), pa.array(lower), pa.array(upper)], ["q", "vec_id", "vkey", "lower", "upper"])

    def exact(batches):
        held = {int(i): v for at, _, q in sent.value.values() for i, v in zip(at, q)}
        ids = {int(i): int(x) for at, own, _ in sent.value.values() for i, x in zip(at, own)}
        for batch in batches:
            rows = batch.to_pydict()
            scores = []
            for i, v in zip(rows["q"], rows["v"]):
                s = sum(int(a) * int(b) for a, b in zip(held[i], v)) if _wide(held[i], v) else int(held[i] @ np.array(v, np.int64))
                scores.append(max(-_LONG - 1, min(_LONG, s)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ids[i] for i in rows["q"]], pa.int64()), batch.column(1), pa.array(scores, pa.int64())], ["q", "query_id", "vec_id", "score"])

    found = cells.mapInArrow(scan, "q long, vec_id long, vkey long, lower double, upper double").distinct()
    # repeated rows count once here, which can only lower the bar
    bar = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.col("lower").desc()))).where(F.col("n") == k).select("q", F.col("lower").alias("bar"))
    left = materialize(
        found.join(bar, "q", "left").where(F.col("bar").isNull() | (F.col("upper") >= F.col("bar")))
        .withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.col("upper").desc(), "vec_id", "vkey"))), "survivors")
    read = lambda x: x.select("q", "vec_id", "vkey").join(vectors, ["vec_id", "vkey"]).select("q", "vec_id", "v").mapInArrow(exact, "q long, query_id long, vec_id long, score long")
    first = materialize(read(left.where(F.col("n") <= FIRST * k)), "best")
    sure = first.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc()))).where(F.col("n") == k).select("q", F.col("score").cast("double").alias("sure"))
    # a double may round the score up by a little, which the tolerance takes back
    rest = left.where(F.col("n") > FIRST * k).join(sure, "q", "left").where(F.col("sure").isNull() | (F.col("upper") >= F.col("sure") - F.abs("sure") * 1e-12 - 1e-6))
    out = materialize(first.unionByName(read(rest)).select("query_id", "vec_id", "score"), "hits")
    release(left, first)
    sent.destroy()
    return out


def without_surplus(vectors: DataFrame, k: int) -> DataFrame:
    """The rows (vec_id, v, vkey) without those that can be in no result, as k + 1 smaller ids have the same vector.

    Only vectors whose fingerprint many rows share are looked at, so the others aren't shuffled.
    """
    hot = vectors.groupBy("vkey").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("vkey")
    marked = may_hold(vectors, "vkey", hot)
    rank = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    thinned = marked.where("may").drop("may").withColumn("n", rank).where(F.col("n") <= k + 1).drop("n")
    return marked.where("not may").drop("may").unionByName(thinned)


def _wide(a, b) -> bool:
    big = float(max(max(map(abs, a.tolist()), default=0), 1)) * float(max(max(map(abs, b), default=0), 1)) * max(len(b), 1)
    return big >= 2.0**62


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, wave_bytes: int = 16_000_000, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) over integer vectors (vec_id, v); ties go to the smaller vec_id.

    A query's own rows are those of its vec_id. Rows of one vec_id and vector count once as queries; queries that share
    an id with different vectors have their hits ranked together. Repeated candidates count each. Vectors of another
    length than the query's are no candidates for it. Scores beyond 64 bits stand at the end of the range. Queries are
    sent in waves of at most ``wave_bytes``, each of which is one scan of the approximation file and is given up before
    the next, so the driver never holds more than a wave. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    queries = queries.select("vec_id", "v").distinct()
    shape = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if not shape["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    keyed = materialize(without_surplus(vectors.select("vec_id", "v").withColumn("vkey", F.xxhash64("v")), k), "vectors")
    cells, low, width = approximate(keyed)
    waves = -(-shape["n"] * (8 * max(shape["d"], 1) + 16) // (wave_bytes // 2))
    found = None
    for w in range(waves):
        part = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(waves)) == w).orderBy("vec_id").collect()
        if part:
            hits = _wave(part, k, keyed, cells, low, width, block)
            found = hits if found is None else found.unionByName(hits)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
