"""Removal of repeated substrings with a distributed difference cover.

Positions of a document are sampled by a difference cover D modulo v: for any two positions there is a shift below v
that brings both into the sample. So two equal strings of ``length`` bytes hold equal sampled tuples of
length - v + 1 bytes at one place. The tuples are named, the names sorted in buckets, and names that occur once go: no
long match can hold them. Around the names that are left, every string of ``length`` bytes, sampled or not, is named in
its turn; equal names are neighbours in sorted buckets, and all but the earliest are repeats. There are no ranks: equal
strings are all that is asked for, not the order of suffixes, so the recursion on names and the merge of the other
suffixes by rank are left out. Names are fingerprints modulo a prime of 61 bits; among n of them, two different strings
share one with a chance of about n^2 / 2^62.

Texts travel in compressed slices. A slice sends each name once a bucket, in sorted order and delta-coded, and gets
one bit a name back, so a name that is frequent anywhere costs its bucket one entry a slice, not one an occurrence.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize
from .textbatch import U64, Batch, slices

#: A perfect difference set, 8 residues whose differences give every residue modulo 57 once.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
SLICE_BYTES = 2_000_000
BUCKET_NAMES = 1_000_000  # names that a bucket holds on average, at most


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as deltas, by byte planes, compressed: about 64 - log2(n) bits each."""
    if not len(values):
        return b""
    deltas = np.diff(values, prepend=U64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(deltas.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, U64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64)


def pack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(data)


def unpack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Slice:
    """A slice's documents, with the sampled names and the suffixes around repeated ones."""

    def __init__(self, ids: bytes, sizes: bytes, packed: bytes, length: int):
        self.ids, self.sizes, self.length = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), length
        text = unpack_bytes(packed)
        edge = np.concatenate(([0], np.cumsum(self.sizes)))
        self.batch = Batch([text[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())])
        self.width = length - PERIOD + 1

    def of(self, positions: np.ndarray) -> np.ndarray:
        """Index of the document that holds each position."""
        return np.searchsorted(self.batch.start, positions, "right") - 1

    def document_names(self) -> np.ndarray:
        return self.batch.hashes(self.batch.start, self.batch.end)

    def sampled(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the sample that have a whole tuple, and its name."""
        b = self.batch
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        at = np.flatnonzero(cover[(np.arange(len(b.buf)) - np.repeat(b.start, b.size + 1)) % PERIOD])
        at = at[at + self.width <= b.end[self.of(at)]]
        return at, b.hashes(at, at + self.width)

    def suffixes(self, at: np.ndarray, repeated: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Positions whose first ``length`` bytes hold a repeated tuple, outside documents that are copies (whole)."""
        b = self.batch
        change = np.zeros(len(b.buf) + 1, np.int64)
        s = at[repeated]
        np.add.at(change, np.maximum(s - PERIOD + 1, b.start[self.of(s)]), 1)
        np.add.at(change, s + 1, -1)
        p = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        doc = self.of(p)
        return p[(p + self.length <= b.end[doc]) & ~whole[doc]]


def _buckets(values: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted values by their first bits."""
    top = (values >> U64(64 - bits)).astype(np.int64)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(top)) + 1, [len(values)]))
    return [(int(top[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:]) if b > a]


def _order(names: np.ndarray, ids: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort by (name, document id, position): the order, where a name begins, and the rank of each entry's name."""
    order = np.lexsort((positions, ids, names))
    new = np.ones(len(order), bool)
    new[1:] = names[order[1:]] != names[order[:-1]]
    return order, new, np.cumsum(new) - 1


NAME, DOCUMENT, SUFFIX = 0, 1, 2


def _reduce(table: pa.Table) -> pa.Table:
    """One bucket: for every row's names a bit each. NAME: some other slice has it. Else: a smaller document id has it,
    or the same id in a slice that comes first."""
    kinds = table.column("kind").to_pylist()
    payload, ids = table.column("payload").to_pylist(), table.column("ids").to_pylist()
    slice_ids = table.column("slice").to_pylist()
    masks: list[bytes] = [b""] * len(kinds)
    counts, hits = [0] * len(kinds), [0] * len(kinds)
    for kind in set(kinds):
        rows = [i for i in range(len(kinds)) if kinds[i] == kind]
        parts = [unpack_sorted(payload[i]) for i in rows]
        sizes = [len(x) for x in parts]
        values = np.concatenate(parts)
        row = np.repeat(np.arange(len(rows)), sizes)
        if kind == NAME:
            order = np.argsort(values, kind="stable")
            ranked = values[order]
            hit = np.zeros(len(ranked), bool)
            hit[1:] = ranked[1:] == ranked[:-1]
            hit[:-1] |= hit[1:]
        else:
            owner = np.concatenate([np.frombuffer(unpack_bytes(ids[i]), np.int64) for i in rows])
            order = np.lexsort((np.array([slice_ids[i] for i in rows])[row], owner, values))
            ranked, ranked_owner = values[order], owner[order]
            hit = np.zeros(len(ranked), bool)
            hit[1:] = ranked[1:] == ranked[:-1]
            if kind == DOCUMENT:  # rows that repeat an id are no copies of each other
                first = np.maximum.accumulate(np.where(~hit, np.arange(len(hit)), 0))
                hit &= ranked_owner != ranked_owner[first]
        flag = np.zeros(len(values), bool)
        flag[order] = hit
        at = 0
        for i, n in zip(rows, sizes):
            masks[i], counts[i], hits[i] = np.packbits(flag[at : at + n]).tobytes(), n, int(flag[at : at + n].sum())
            at += n
    return pa.table({"slice": table.column("slice"), "kind": table.column("kind"), "bucket": table.column("bucket"), "n": pa.array(counts, pa.int64()), "hits": pa.array(hits, pa.int64()), "mask": pa.array(masks, pa.binary())})


_REPLY = "slice long, kind int, bucket int, n long, hits long, mask binary"
_SEND = "bucket int, slice long, kind int, payload binary, ids binary"
_SENT = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary()), ("ids", pa.binary())])


def _bits(masks: list[dict], kind: int, total: int) -> np.ndarray:
    """The reply bits of one kind, buckets in order; total is the number of names sent."""
    rows = sorted((m for m in masks or () if m["kind"] == kind), key=lambda m: m["bucket"])
    parts = [np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=m["n"]).astype(bool) for m in rows]
    out = np.concatenate(parts) if parts else np.zeros(0, bool)
    if len(out) != total:
        raise ValueError(f"{len(out)} reply bits for {total} names")
    return out


def _suffixes(part: Slice, masks: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Copies among the documents, suffix positions and their names, from the replies to the first names."""
    full = part.sizes >= part.length
    whole = np.zeros(len(full), bool)
    docs = part.document_names()
    which = np.flatnonzero(full)
    order, new, rank = _order(docs[which], part.ids[which], which)
    bits = _bits(masks, DOCUMENT, int(new.sum()))
    first_id = part.ids[which[order]][np.flatnonzero(new)] if len(order) else np.zeros(0, np.int64)
    whole[which[order]] = bits[rank] | (part.ids[which[order]] != first_id[rank]) if len(order) else False
    at, names = part.sampled()
    unique, inverse, count = np.unique(names, return_inverse=True, return_counts=True)
    repeated = (count > 1) | _bits(masks, NAME, len(unique))
    p = part.suffixes(at, repeated[inverse], whole)
    return whole, p, part.batch.hashes(p, p + part.length)


def remove_repeats(documents: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document of smaller id, or
    earlier in the same one. Null texts are empty; shorter texts stay whole. Rows that repeat an id come in the order in
    which they are read, null ids before all others. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    bounded_batches(spark, 8 << 20)

    def cut(batches):
        part = TaskContext.get().partitionId() << 31  # slices are numbered in the order in which rows are read
        for n, (piece, texts) in enumerate(slices(batches, target=SLICE_BYTES)):
            texts = [t or b"" for t in texts]
            sizes = np.array([len(t) for t in texts], np.int64)
            ids = piece.column(0).to_pylist()
            yield pa.RecordBatch.from_pylist([{
                "slice": part + n, "ids": np.array([-(2**63) if i is None else i for i in ids], np.int64).tobytes(), "sizes": sizes.tobytes(), "packed": pack_bytes(b"".join(texts)), "bytes": int(sizes.sum()),
            }], schema=pa.schema([("slice", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("packed", pa.binary()), ("bytes", pa.int64())]))

    parts = materialize(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "slice long, ids binary, sizes binary, packed binary, bytes long"), "slices")
    total = parts.agg(F.sum("bytes")).first()[0] or 0
    enough = lambda names: max(4, math.ceil(math.log2(max(names / BUCKET_NAMES, 1))))
    bits = enough(total * len(COVER) / PERIOD)

    def send(part: Slice, slice_id: int, kind: int, sorted_names: np.ndarray, owners: np.ndarray | None, bits: int = bits):
        for bucket, a, b in _buckets(sorted_names, bits):
            yield {"bucket": bucket, "slice": slice_id, "kind": kind, "payload": pack_sorted(sorted_names[a:b]), "ids": None if owners is None else pack_bytes(owners[a:b].tobytes())}

    def send_names(batches):
        for r in _rows(batches):
            part = Slice(r["ids"], r["sizes"], r["packed"], length)
            out = list(send(part, r["slice"], NAME, np.unique(part.sampled()[1]), None))
            which = np.flatnonzero(part.sizes >= length)
            names = part.document_names()[which]
            order, new, _ = _order(names, part.ids[which], which)
            first = order[new]
            out += send(part, r["slice"], DOCUMENT, names[first], part.ids[which[first]])
            yield pa.RecordBatch.from_pylist(out, schema=_SENT)

    def send_suffixes(batches):
        for r in _rows(batches):
            part = Slice(r["ids"], r["sizes"], r["packed"], length)
            _, p, names = _suffixes(part, r["masks"])
            owner = part.ids[part.of(p)]
            order, new, _ = _order(names, owner, p)
            first = order[new]
            yield pa.RecordBatch.from_pylist(list(send(part, r["slice"], SUFFIX, names[first], owner[first], more)), schema=_SENT)

    def finish(batches):
        for r in _rows(batches):
            part = Slice(r["ids"], r["sizes"], r["packed"], length)
            whole, p, names = _suffixes(part, r["masks"])
            owner = part.ids[part.of(p)]
            order, new, rank = _order(names, owner, p)
            repeat = np.ones(len(p), bool)
            repeat[order] = ~new | _bits(r["masks2"], SUFFIX, int(new.sum()))[rank] if len(p) else False
            b = part.batch
            change = np.zeros(len(b.buf) + 1, np.int64)
            np.add.at(change, p[repeat], 1)
            np.add.at(change, p[repeat] + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            for i in np.flatnonzero(whole).tolist():
                gone[b.start[i] : b.end[i]] = True
            begins = gone & ~np.concatenate(([False], gone[:-1]))
            removed, spans = b.counts(gone), b.counts(begins)
            digests = []
            for a, z in zip(b.start.tolist(), b.end.tolist()):
                own = b.buf[a:z]
                digests.append(hashlib.sha256((own[~gone[a:z]] if removed[z] > removed[a] else own).tobytes()).hexdigest())
            ids = pa.array([None if i == -(2**63) else i for i in part.ids.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(part.sizes), pa.array(removed[b.end] - removed[b.start]), pa.array(spans[b.end] - spans[b.start]), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    reply = F.struct("kind", "bucket", "n", "mask")
    first = materialize(parts.mapInArrow(send_names, _SEND).groupBy("bucket").applyInArrow(_reduce, _REPLY).groupBy("slice").agg(F.sum(F.when(F.col("kind") == NAME, F.col("hits"))).alias("hits"), F.collect_list(reply).alias("masks")), "sample-replies")
    more = enough((first.agg(F.sum("hits")).first()[0] or 0) * PERIOD / len(COVER))
    known = parts.join(first.hint("merge"), "slice", "left").select("slice", "ids", "sizes", "packed", "masks")
    second = known.mapInArrow(send_suffixes, _SEND).groupBy("bucket").applyInArrow(_reduce, _REPLY).groupBy("slice").agg(F.collect_list(reply).alias("masks2"))
    return known.join(second.hint("merge"), "slice", "left").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
