"""MinHash near-duplicates by an inverted join of signature coordinates.

Documents of one word sequence collapse to a node first. Nodes are posted under each (coordinate, value) pair of their
signature. Two signatures that agree in at least ``matches`` of ``coordinates`` must meet in the first
coordinates - matches + 1 postings of both, under any one order of all pairs; the order is by rising posting length, so
pairs held by one node (never a meeting) use up the prefix, and long lists are skipped wherever a node has enough rare
ones.

A posting is never expanded into pairs. Its members meet its leader, the member with the fewest pairs of its own, and
postings of one leader are merged: (leader, member) stands once, however many postings it stands for. Members whose
signature agrees with the leader's and whose full shingle set is similar to it are linked to it. That leaves pairs with
an outsider, a member that its leader doesn't link. Groups that have outsiders are compared in memory, in blocks of
bounded size, where sizes and shingles that nobody else has rule most pairs out before their sets are intersected. Only
links become rows. So no link is lost, and a large family of near copies costs a row a member, not a row a pair.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, materialize, may_hold, release
from .textbatch import U64, Batch, mix, shingles, slices, trim


@dataclass(frozen=True)
class Params:
    """words: shingle size; similarity: percent of the union. A pair of exactly 80 % agrees in fewer than 36 of 64
    coordinates with a probability of about 3e-6, and the chance falls fast above that. block_bytes, block_nodes:
    what a task of an outsiders' comparison holds of either side."""

    words: int = 4
    similarity: int = 80
    coordinates: int = 64
    matches: int = 36
    block_bytes: int = 4_000_000
    block_nodes: int = 2000
    lower: bool = True

    @property
    def prefix(self) -> int:
        return self.coordinates - self.matches + 1


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RNG = np.random.Generator(np.random.PCG64(77))
_MUL = _RNG.integers(0, 2**63, 512, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_ADD = _RNG.integers(0, 2**63, 512, dtype=np.int64).astype(U64)


def folded(texts: list[bytes | None], p: Params) -> list[bytes]:
    return [(t or b"").translate(_LOWER) if p.lower else (t or b"") for t in texts]


def word_digest(text: bytes) -> bytes:
    """A cryptographic digest of the word sequence (bytes.split splits at the six ASCII white space characters)."""
    return hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()


def shingle_set(text: bytes, words: int) -> frozenset:
    """The set of word windows itself, for the final say."""
    w = text.split()
    return frozenset(zip(*[w[k:] for k in range(words)])) if len(w) >= words else frozenset([tuple(w)] if w else [])


def signatures(texts: list[bytes], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes and int32 signatures (n x coordinates; zeros for empty sets) of folded texts."""
    doc, value = shingles(Batch(texts), p.words)
    n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    sig = np.zeros((len(texts), p.coordinates), np.int32)
    if len(doc):
        full = np.flatnonzero(n)
        at = np.concatenate(([0], np.cumsum(n)))[full]
        for k in range(p.coordinates):
            low = np.minimum.reduceat(value * _MUL[k] + _ADD[k], at)
            sig[full, k] = (mix(low) >> U64(32)).astype(np.uint32).view(np.int32)
    return n, sig


def _signature_table(documents: DataFrame, p: Params) -> DataFrame:
    def run(batches):
        for piece, texts in slices(batches):
            raw = folded(texts, p)
            n, sig = signatures(raw, p)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, p.coordinates, dtype=np.int32)), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n), pa.array([word_digest(t) for t in raw], pa.binary()), lists], ["doc_id", "n", "digest", "sig"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, digest binary, sig array<int>")


def similar(both: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """Whether sets of sizes a and b with so many common elements are similar enough."""
    return 100 * both >= percent * (a + b - both)


def _verify(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. texts: (node, text)."""
    joined = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).hint("merge"), "b").select("a", "b", "ta", "tb")
    )

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                sets: dict[bytes, frozenset] = {}
                good = []
                for x, y in zip(*[folded(batch.column(i).cast(pa.large_binary()).to_pylist(), p) for i in (2, 3)]):
                    for t in (x, y):
                        if t not in sets:
                            sets[t] = shingle_set(t, p.words)
                    good.append(similar(len(sets[x] & sets[y]), len(sets[x]), len(sets[y]), p.similarity))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))
        trim()

    return joined.mapInArrow(run, "a long, b long")


def _agreeing(pairs: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) of sizes that allow the similarity and of signatures that agree in enough coordinates."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias("n" + k), F.col("sig").alias("s" + k)).hint("merge")
    size = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * p.similarity
    agree = F.expr(f"aggregate(zip_with(sa, sb, (x, y) -> if(x = y, 1, 0)), 0, (s, m) -> s + m) >= {p.matches}")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(size & agree).select("a", "b").distinct()


def near_duplicates(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Documents without words are linked with nothing. A document with fewer words than a shingle has one shingle.
    Rows that share a doc_id are one node of the graph, but a row whose text is an exact copy of a smaller id's goes
    by that one's node, so where ids repeat with different texts, rows need ids of their own. Rows with a null id
    stay alone. Extra columns are ignored; an empty table gives an empty result. Ties: the smallest id is kept.
    """
    bounded_batches(documents.sparkSession)
    sigs = materialize(_signature_table(documents, p), "signatures")
    full = sigs.where("n > 0 and doc_id is not null")
    shared = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "rep")
    # the tables joined here grow with the corpus, so none is broadcast: one plan at every size
    copies = materialize(full.select("doc_id", "digest").join(shared.hint("merge"), "digest").where("doc_id <> rep").select("doc_id", "digest", "rep"), "copies")
    nodes = full.join(copies.select("doc_id", "digest").hint("merge"), ["doc_id", "digest"], "left_anti").select(F.col("doc_id").alias("node"), "n", "sig")
    posts = nodes.select("node", F.posexplode("sig").alias("k", "v")).select("node", (F.col("k").cast("long") * F.lit(1 << 32) + F.col("v").cast("long")).alias("token"))
    common = posts.groupBy("token").agg(F.count(F.lit(1)).alias("len"))
    ranked = posts.join(common.where("len > 1").hint("merge"), "token").groupBy("node").agg(F.array_sort(F.collect_set(F.struct("len", "token"))).alias("held"))
    rare = F.lit(p.coordinates) - F.size("held")  # a node's pairs that nobody else has come first in the order
    index = materialize(
        ranked.withColumn("rare", rare).where(F.col("rare") < p.prefix)
        .select("node", "rare", F.explode(F.slice("held", F.lit(1), F.lit(p.prefix) - F.col("rare"))).alias("x")).select("node", "rare", F.col("x.token").alias("token")), "postings")
    leaders = index.groupBy("token").agg(F.min(F.struct("rare", F.xxhash64("node").alias("h"), "node")).alias("x")).select("token", F.col("x.node").alias("b"))
    met = materialize(index.join(leaders.hint("merge"), "token").where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "meetings")
    ends = materialize(met.select(F.col("a").alias("node")).unionByName(met.select(F.col("b").alias("node"))).distinct(), "candidates")
    known = documents.select(F.col("doc_id").cast("long").alias("node"), "text").where("text is not null")
    texts = materialize(may_hold(known, "node", ends).where("may").drop("may").join(ends.hint("merge"), "node", "left_semi").withColumn("size", F.octet_length("text")), "candidate-texts")
    candidates = materialize(may_hold(full.select(F.col("doc_id").alias("node"), "n", "sig"), "node", ends).where("may").drop("may").join(ends.hint("merge"), "node", "left_semi"), "candidate-signatures")
    linked = materialize(_verify(_agreeing(met, candidates, p), texts, p).distinct(), "links")
    links = linked.unionByName(materialize(_outsiders(met, linked, texts, p), "more-links"))
    release(index, met, ends, texts, candidates)
    groups = components(links, "a", "b")
    found = sigs.select("doc_id", "n", "digest").join(copies.distinct().hint("merge"), ["doc_id", "digest"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    component = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return found.join(groups.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _outsiders(met: DataFrame, linked: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Links (a, b) between members of one leader's postings of which one at least isn't linked to the leader.

    met: (a, b) members and their leaders; linked: those of them that are similar. A group is dealt into blocks, and
    every block meets those with outsiders in a task of its own.
    """
    members = met.join(linked.withColumn("inside", F.lit(True)).hint("merge"), ["a", "b"], "left").select("b", F.col("a").alias("node"), F.coalesce("inside", F.lit(False)).alias("inside"))
    sized = members.join(texts.select("node", "size").hint("merge"), "node")
    blocks = F.ceil(F.greatest(F.sum("size") / p.block_bytes, F.count(F.lit(1)) / p.block_nodes)).cast("int")
    mixed = sized.groupBy("b").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("k"), F.bool_and("inside").alias("closed")).where("k > 1 and not closed").select("b", "blocks")
    dealt = members.join(mixed.hint("merge"), "b").join(texts.select("node", "text").hint("merge"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    copied = dealt.select("b", "node", "inside", "text", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keyed = copied.select("b", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "inside", "text")

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        node, own = (table.column(c).to_numpy() for c in ("node", "own"))
        inside = table.column("inside").to_numpy(zero_copy_only=False).astype(bool)
        raw = folded(table.column("text").cast(pa.large_binary()).to_pylist(), p)
        found = [] if inside.all() else block_links(raw, inside, own == i, own == j, p)
        trim()
        a, b = np.array([node[x] for x, _ in found], np.int64), np.array([node[y] for _, y in found], np.int64)
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return keyed.groupBy("b", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def block_links(raw: list[bytes], inside: np.ndarray, left: np.ndarray, right: np.ndarray, p: Params) -> list[tuple[int, int]]:
    """Similar pairs (x, y) with x in one side and y in the other, x or y not inside.

    m(x), the size of x less its shingles that no other text here has, bounds every intersection of x, and
    100 * m(x) >= similarity * (n(x) + n(y) - m(x)) bounds the size of a partner.
    """
    doc, value = shingles(Batch(raw), p.words)
    n = np.bincount(doc, minlength=len(raw))
    order = np.argsort(value, kind="stable")
    by_value, holder = value[order], doc[order]
    lone = np.ones(len(by_value), bool)
    same = by_value[1:] == by_value[:-1]
    lone[1:] &= ~same
    lone[:-1] &= ~same
    most = n - np.bincount(holder[lone], minlength=len(raw))
    limit = most * (100 + p.similarity) // p.similarity - n  # partners' sizes
    edge = np.searchsorted(doc, np.arange(len(raw) + 1))
    sets: dict[int, frozenset] = {}
    out: list[tuple[int, int]] = []
    for x in np.flatnonzero(~inside & (left | right)).tolist():
        ok = (n <= limit[x]) & (limit >= n[x]) & ((left[x] & right) | (right[x] & left))
        ok[x] = False
        ok[:x] &= inside[:x]  # of two outsiders, the first looks for the second
        close = np.flatnonzero(ok)
        if not len(close):
            continue
        both = np.zeros(len(raw), np.int64)
        mine = value[edge[x] : edge[x + 1]]
        lo, hi = np.searchsorted(by_value, mine, "left"), np.searchsorted(by_value, mine, "right")
        for at in range(0, len(mine), 1024):  # a bounded number of holders at once
            a, width = lo[at : at + 1024], (hi - lo)[at : at + 1024]
            hits = np.repeat(a - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
            both += np.bincount(holder[hits], minlength=len(raw))
        for y in close[similar(both[close], n[x], n[close], p.similarity)].tolist():
            for k in (x, y):
                if k not in sets:
                    sets[k] = shingle_set(raw[k], p.words)
            if similar(len(sets[x] & sets[y]), len(sets[x]), len(sets[y]), p.similarity):
                out.append((x, y))
    return out
