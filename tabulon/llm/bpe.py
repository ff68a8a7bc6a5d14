"""BPE encoding and decoding with content-defined chunk reuse.

A rolling (gear) hash over 32 bytes cuts texts where the content says so; equal passages give equal chunks. Chunks that
occur more than once in the corpus are encoded once, by their first holder, and handed to the others by digest; the
rest are encoded where they stand. A chunk's ids cover what lies between its first and its last white space: there
pre-tokenisation always splits, so those ids are exact in any context. What is left at a join of two chunks is
re-encoded as one string, which grows over chunks without white space until both its ends stand at a white space;
then the ids agree exactly with those of the whole text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize
from .textbatch import Batch, slices, trim

WINDOW, CUT_BITS = 32, 11  # a cut every 2048 bytes on average
CACHE = 300_000  # pre-tokens in either half of a worker's cache
_SPACES = b" \t\n\r\x0b\x0c"
_GEAR = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**32, 256, dtype=np.uint32)
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Texts of these characters need no Unicode normalisation but lower-casing, and _PIECE cuts them as the vocabulary's
#: own pattern does (fixed value: its contractions). Others are left to the library word by word.
_PLAIN = re.compile("[\x00-\x7f¡¿«»À-ÖØ-öø-ÿ]*")
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \t\n\v\f\r{_LETTERS}0-9]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Coder:
    """Encodes strings that begin and end at white space exactly as the tokenizers library does.

    Pre-tokens are encoded by the library's own model, many in one call, and remembered; every pre-token ends with a
    token that carries the vocabulary's end-of-word suffix, which tells them apart.
    """

    _held: dict[str, Coder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids are kept in two bytes")
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.tokens = [t.encode() for t in names]
        self.digits = [str(i).encode() for i in range(size)]
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.array([bool(suffix) and t.endswith(suffix) for t in names])
        steps = json.loads(self.tokenizer.pre_tokenizer.__getstate__()).get("pretokenizers", [{}])
        self.known = bool(suffix) and steps[0].get("pattern") == {"Regex": _PATTERN}
        self.marks = tuple(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Coder:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _learn(self, pieces: set[str]) -> None:
        """Have the ids of all the pieces in the newer half of the cache; what neither half has is encoded."""
        missing = [w for w in pieces if w not in self.cache]  # a difference of sets would walk the whole cache
        if len(self.cache) + len(missing) > CACHE:
            self.older, self.cache, missing = self.cache, {}, list(pieces)
        new = []
        for w in missing:
            have = self.older.get(w)
            if have is None:
                new.append(w)
            else:
                self.cache[w] = have
        ids = np.array(self.model.encode(" ".join(new), add_special_tokens=False).ids, np.uint16)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("the vocabulary doesn't mark the ends of words")
        raw, at = ids.tobytes(), 0
        for w, end in zip(new, (2 * ends).tolist()):
            self.cache[w] = raw[at:end]
            at = end

    def encode_all(self, parts: list[bytes]) -> list[bytes]:
        """Ids (two bytes each) of strings that begin and end at white space or at an end of their text."""
        out: list[bytes] = []
        for at in range(0, len(parts), 256):
            texts = [p.decode() for p in parts[at : at + 256]]
            lower = [t.lower() for t in texts]
            plain = [self.known and bool(_PLAIN.fullmatch(t)) and not any(m in low for m in self.marks) for t, low in zip(texts, lower)]
            cut = [_PIECE.findall(low) if ok else () for low, ok in zip(lower, plain)]
            pieces = set().union(*cut)
            if not pieces <= self.cache.keys():
                self._learn(pieces)
            get = self.cache.__getitem__
            for t, ok, own in zip(texts, plain, cut):
                out.append(b"".join(map(get, own)) if ok else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint16).tobytes())
        return out

    def digest(self, ids: bytes) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as decimals and of the decoded text."""
        numbers = np.frombuffer(ids, np.uint16).tolist()
        a = hashlib.sha256(b" ".join(map(self.digits.__getitem__, numbers))).hexdigest()
        b = hashlib.sha256(self.decode(numbers)).hexdigest()
        return len(numbers), a, b

    def decode(self, numbers: list[int]) -> bytes:
        """The decoded text: this vocabulary has no decoder, so tokens are joined by blanks."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(numbers, skip_special_tokens=False).encode()
        return b" ".join(map(self.tokens.__getitem__, numbers))


def rolling(buf: np.ndarray) -> np.ndarray:
    """The gear hash of the 32 bytes up to each byte, h = 2 * h + gear[byte] modulo 2^32, by doubling the window."""
    h = _GEAR[buf]
    for width in (1, 2, 4, 8, 16):
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h = wider
    return h


def chunks(texts: list[bytes]) -> list[list[bytes]]:
    """Content-defined chunks of each text; they join to the text. An empty text has none."""
    batch = Batch(texts)
    cuts = np.zeros(0, np.int64)
    if len(batch.buf) > WINDOW:
        after = np.flatnonzero(rolling(batch.buf)[:-1] >> np.uint32(32 - CUT_BITS) == 0) + 1
        cuts = after[(batch.buf[after] & 0xC0) != 0x80]
    out = []
    for i, text in enumerate(texts):
        lo, hi = int(batch.start[i]), int(batch.end[i])
        own = cuts[np.searchsorted(cuts, lo + WINDOW) : np.searchsorted(cuts, hi)] - lo
        edges = [0, *own.tolist(), len(text)]
        out.append([text[a:b] for a, b in zip(edges, edges[1:]) if b > a])
    return out


def parts(chunk: bytes) -> tuple[bytes, bytes | None, bytes]:
    """(head, body, tail): body lies between the first and the last white space; without any it is None."""
    head = chunk.split(None, 1)[0] if chunk[:1] not in _B_SPACES else b""
    if len(head) == len(chunk):
        return chunk, None, b""
    tail = chunk.rsplit(None, 1)[-1] if chunk[-1:] not in _B_SPACES else b""
    return head, chunk[len(head) : len(chunk) - len(tail)], tail


_B_SPACES = {bytes([c]) for c in _SPACES}


def encode_texts(coder: Coder, cut: list[list[bytes]], given: list[dict[int, tuple[bytes, bytes]]] | None = None) -> list[bytes]:
    """Ids of each text from its chunks. given[i]: (edges, body ids) of chunks that were encoded elsewhere."""
    todo: list[bytes] = []
    plans: list[list[bytes | int]] = []
    for i, own in enumerate(cut):
        ready = given[i] if given else {}
        plan: list[bytes | int] = []
        glue = b""
        for k, chunk in enumerate(own):
            head, body, tail = parts(chunk)
            if body is None:
                glue += head
                continue
            glue += head
            if glue:
                plan.append(len(todo))
                todo.append(glue)
            if k in ready:
                plan.append(ready[k])
            else:
                plan.append(len(todo))
                todo.append(body)
            glue = tail
        if glue:
            plan.append(len(todo))
            todo.append(glue)
        plans.append(plan)
    ids = coder.encode_all(todo)
    return [b"".join(ids[x] if isinstance(x, int) else x for x in plan) for plan in plans]


def name(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


_FIELDS = "kind int, doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, tk long, packed binary, chunk binary, ids binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("tk", pa.int64()), ("packed", pa.binary()), ("chunk", pa.binary()), ("ids", pa.binary())])
DONE, WAITING, CHUNK = 0, 1, 2


def encode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of documents (doc_id, text).

    A null text counts as empty; an empty text has no ids. Repeated rows are encoded alike; extra columns are
    ignored; an empty table gives an empty result. path: the vocabulary file, which every worker can read.
    """
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tk", F.xxhash64("text"))

    def list_chunks(batches) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            cut = chunks(texts)
            count = [len(c) for c in cut]
            yield pa.RecordBatch.from_arrays([
                piece.column(0).take(pa.array(np.repeat(np.arange(len(cut)), count))), piece.column(2).take(pa.array(np.repeat(np.arange(len(cut)), count))),
                pa.array([k for c in count for k in range(c)], pa.int32()), pa.array([name(x) for c in cut for x in c], pa.binary()),
            ], ["doc_id", "tk", "k", "chunk"])

    refs = materialize(docs.mapInArrow(list_chunks, "doc_id long, tk long, k int, chunk binary"), "chunks")
    owner = F.struct("doc_id", "tk", "k")
    shared = refs.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min(owner).alias("owner")).where("n > 1").drop("n")
    marked = materialize(
        refs.join(shared, "chunk").select("doc_id", "tk", "k", "chunk", owner.eqNullSafe(F.col("owner")).alias("own")).distinct(), "shared-chunks")
    flags = marked.groupBy("doc_id", "tk").agg(
        F.collect_list(F.when(F.col("own"), F.col("k"))).alias("own"), F.count(F.when(~F.col("own"), 1)).alias("foreign")
    ).select(F.col("doc_id").alias("fd"), F.col("tk").alias("ft"), "own", "foreign")

    def pack(batches) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [squeeze.compress(t) for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], ["doc_id", "tk", "packed"])

    small = docs.mapInArrow(pack, "doc_id long, tk long, packed binary")
    # the flags grow with the corpus, so they are never broadcast: one plan at every size
    joined = small.join(flags.hint("merge"), small["doc_id"].eqNullSafe(flags["fd"]) & (small["tk"] == flags["ft"]), "left").select("doc_id", "tk", "packed", "own", "foreign")

    def first_pass(batches) -> Iterator[pa.RecordBatch]:
        """Texts without foreign chunks are finished; owners also hand out the chunks that others wait for."""
        coder, loose = Coder.of(path), zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 300):
                rows = whole.slice(at, 300).to_pylist()
                cut = chunks([loose.decompress(r["packed"]) for r in rows])
                out = []
                owned = [c[k] for r, c in zip(rows, cut) for k in r["own"] or ()]
                bodies = [parts(x)[1] for x in owned]
                out += [{"kind": CHUNK, "chunk": name(x), "ids": i} for x, b, i in zip(owned, bodies, coder.encode_all([b or b"" for b in bodies])) if b is not None]
                now = [i for i, r in enumerate(rows) if not r["foreign"]]
                for i, ids in zip(now, encode_texts(coder, [cut[i] for i in now])):
                    n, a, b = coder.digest(ids)
                    out.append({"kind": DONE, "doc_id": rows[i]["doc_id"], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b})
                out += [{"kind": WAITING, "doc_id": r["doc_id"], "tk": r["tk"], "packed": r["packed"]} for r in rows if r["foreign"]]
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
        trim()

    state = materialize(joined.mapInArrow(first_pass, _FIELDS), "encoded")
    done = state.where(F.col("kind") == DONE).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    waiting = state.where(F.col("kind") == WAITING).select("doc_id", "tk", "packed")
    encoded = state.where(F.col("kind") == CHUNK).select("chunk", "ids")
    pieces = (
        marked.where(~F.col("own")).join(encoded, "chunk").groupBy("doc_id", "tk")
        .agg(F.collect_list(F.struct("k", "ids")).alias("pieces")).select(F.col("doc_id").alias("pd"), F.col("tk").alias("pt"), "pieces")
    )
    ready = waiting.join(pieces.hint("merge"), waiting["doc_id"].eqNullSafe(pieces["pd"]) & (waiting["tk"] == pieces["pt"]), "left").select("doc_id", "packed", "pieces")

    def second_pass(batches) -> Iterator[pa.RecordBatch]:
        coder, loose = Coder.of(path), zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 300):
                rows = whole.slice(at, 300).to_pylist()
                given = [{p["k"]: p["ids"] for p in r["pieces"] or ()} for r in rows]
                found = [coder.digest(ids) for ids in encode_texts(coder, chunks([loose.decompress(r["packed"]) for r in rows]), given)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        trim()

    return done.unionByName(ready.mapInArrow(second_pass, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
