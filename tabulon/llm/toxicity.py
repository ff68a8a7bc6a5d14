"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A document is cut into windows of words,
each window is compressed under either, and what the toxic dictionary saves over the ordinary one is its distance. A
logistic curve fitted on labelled rows turns a document's distances into a score: the calibrated threshold.

Words are runs of letters, lower-cased and cut to their stem, the first five letters, and a stem is spelled as an 8-byte
code before training and compression: zstandard then matches stems, never chance fragments of words, and code bytes
can't be squeezed by entropy coding, which would hide what a match saves. Whole windows of either class are mostly the
same language, so dictionaries trained on them differ by chance only (none of the marked held-out documents of the
sample was found that way). So both end with the stems that are frequent anywhere, and each class's own part is
trained, by zstandard's trainer, on the stems that its documents use far more often than the other's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize
from .textbatch import Batch, slices

WINDOW = 24  # words
STEM = 5  # letters
PAD = bytes(range(1, 33))  # the last bytes of a dictionary can't be matched, so none of its words end it
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[0x80:] = True


@dataclass
class Model:
    toxic: bytes  # codes of the toxic dictionary
    ordinary: bytes
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    prior: float | None = None  # set if there was nothing to learn from: the score of every document


def word_codes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """8-byte codes of the stems of the words of all texts, and where each text's codes begin (n + 1 entries)."""
    batch = Batch(texts)
    folded = _FOLD[batch.buf]
    accent = (folded[1:] >= 0x80) & (folded[1:] <= 0x9E) & (folded[1:] != 0x97) & (folded[:-1] == 0xC3)  # À to Þ in UTF-8
    folded[1:] += accent.astype(np.uint8) * np.uint8(32)
    letter = _LETTER[folded]
    edge = np.flatnonzero(np.diff(letter.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    batch.buf = folded
    first = np.searchsorted(starts, np.append(batch.start, len(folded)))
    if not len(starts):
        return np.zeros(0, np.uint64), first
    lead = np.append(np.flatnonzero((folded & 0xC0) != 0x80), len(folded))  # where letters begin
    stem = lead[np.minimum(np.searchsorted(lead, starts) + STEM, len(lead) - 1)]
    return batch.hashes(starts, np.minimum(ends, stem)), first


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        kind = zstandard.DICT_TYPE_RAWCONTENT
        level = zstandard.ZstdCompressionParameters(  # a search that indexes every place of the dictionary
            window_log=15, hash_log=14, chain_log=15, search_log=3, min_match=6, strategy=zstandard.STRATEGY_GREEDY, write_checksum=False, write_content_size=False, write_dict_id=False)
        make = lambda d: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d or PAD, dict_type=kind), compression_params=level)
        self.toxic, self.ordinary = make(model.toxic), make(model.ordinary)

    def distances(self, codes: np.ndarray) -> list[int]:
        """Bytes saved by the toxic dictionary in each window of the words."""
        raw = codes.tobytes()
        step = 8 * WINDOW
        a, b = self.ordinary.compress, self.toxic.compress
        return [len(a(w)) - len(b(w)) for w in (raw[i : i + step] for i in range(0, len(raw), step))]

    def features(self, codes: np.ndarray) -> tuple[float, float]:
        """The best window's saving, and the mean saving a window, both on a logarithmic scale."""
        d = self.distances(codes) or [0]
        gain = sum(x for x in d if x > 2)
        return math.log1p(max(max(d), 0)), math.log1p(gain / len(d))

    def score(self, codes: np.ndarray) -> float:
        if self.model.prior is not None:
            return self.model.prior
        x, y = self.features(codes)
        w = self.model.weights
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, w[0] + w[1] * x + w[2] * y))))


def trained(samples: list[bytes], codes: np.ndarray, size: int = 4096) -> bytes:
    """A dictionary trained on samples of the codes; codes that the trainer leaves out follow, if there are any."""
    out = b""
    try:
        out = zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        pass
    return out + b"".join(c for c in (x.tobytes() for x in codes) if c not in out)


def fit_curve(x: np.ndarray, y: np.ndarray, *, penalty: float = 0.05, steps: int = 50) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; x without the constant."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
    return tuple(float(v) for v in w)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(documents: DataFrame, labels: DataFrame, *, max_rows: int = 4000, contrast: float = 0.2, own_stems: int = 256, common_stems: int = 1024) -> Model:
    """Train on at most ``max_rows`` labelled rows outside the held-out third (the smallest id hashes), whole texts.

    A stem is a class's own if the two-proportion z score of its document frequencies reaches 5 and ``contrast`` times
    the highest one. What comes to the driver is bounded by the parameters: stems, and at most ``own_stems`` of each row.
    """
    bounded_batches(documents.sparkSession)
    known = labels.where("toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = materialize(documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), "toxic-sample")

    def per_document(make, field: str, kind: str, rows: DataFrame):
        def run(batches):
            for piece, texts in slices(batches):
                codes, first = word_codes(texts)
                made = [make(codes[first[i] : first[i + 1]], y) for i, y in enumerate(piece.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(made)], ["doc_id", "toxic", field])

        return rows.mapInArrow(run, f"doc_id long, toxic int, {field} {kind}")

    size = dict(sample.groupBy("toxic").count().collect())
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        return Model(b"", b"", prior=float(n1 > 0))
    held_by = per_document(lambda c, y: np.unique(c).view(np.int64).tolist(), "codes", "array<long>", sample).select("toxic", F.explode("codes").alias("code"))
    freq = held_by.groupBy("code").agg(F.sum(1 - F.col("toxic")).alias("f0"), F.sum("toxic").alias("f1"))
    pooled = (F.col("f0") + F.col("f1") + 1) / F.lit(float(n0 + n1 + 2))
    z = (F.col("f1") / F.lit(float(n1)) - F.col("f0") / F.lit(float(n0))) / F.sqrt(pooled * (1 - pooled) * F.lit(1 / n0 + 1 / n1))
    freq = materialize(freq.where("f0 + f1 > 1").withColumn("z", z), "stems")
    top = freq.agg(F.max("z"), F.max(-F.col("z"))).first()
    own = [
        np.array(sorted(r[0] for r in freq.where(sign * F.col("z") >= max(5.0, contrast * (top[k] or 0.0))).orderBy((sign * F.col("z")).desc(), "code").limit(own_stems).select("code").collect()), np.int64)
        for k, sign in ((0, 1), (1, -1))
    ]
    taken = [int(x) for x in np.concatenate(own)]
    shared = freq.where(~F.col("code").isin(taken)) if taken else freq
    common = np.array([r[0] for r in shared.orderBy((F.col("f0") + F.col("f1")).desc(), "code").limit(common_stems).select("code").collect()], np.int64)[::-1]
    of_class = [own[1].view(np.uint64), own[0].view(np.uint64)]

    def sampled(c: np.ndarray, y: int) -> bytes:
        c = c[np.isin(c, of_class[y])]
        return c[np.sort(np.unique(c, return_index=True)[1])].tobytes()

    samples = sorted((r["doc_id"], r["toxic"], bytes(r["x"])) for r in per_document(sampled, "x", "binary", sample).where(F.length("x") > 0).collect())
    toxic, ordinary = ([x for _, y, x in samples if y == k] for k in (1, 0))
    base = common.tobytes()
    # the shared part comes last, so that its matches are equally near, and cost the same, under either
    model = Model(trained(toxic, of_class[1]) + base + PAD, trained(ordinary, of_class[0]) + base + PAD)
    held: list[Scorer] = []

    def features(codes: np.ndarray, y: int) -> bytes:
        if not held:
            held.append(Scorer(model))
        return np.array(held[0].features(codes)).tobytes()

    found = sorted((r["doc_id"], r["toxic"], bytes(r["x"])) for r in per_document(features, "x", "binary", sample).collect())
    model.weights = fit_curve(np.array([np.frombuffer(x) for _, _, x in found]), np.array([y for _, y, _ in found], float))
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts, and those without letters, have no distance and get the score of an unmarked text.
    Repeated rows are scored alike; other columns are never read; an empty table gives an empty result.
    """

    def run(batches):
        scorer = Scorer(model)
        for piece, texts in slices(batches):
            codes, first = word_codes(texts)
            found = [scorer.score(codes[first[i] : first[i + 1]]) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
