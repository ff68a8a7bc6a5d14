"""Quality rules with line labelling by a linear-chain conditional random field.

Base rules count words, symbols, repeated lines and repeated word windows over whole texts. Then each line is
labelled content or boilerplate by Viterbi decoding under a two-label chain CRF, and the share of the words' code
points that stand in content lines decides retention. The CRF is trained here, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .textbatch import FACTOR, U64, Batch, mix, slices

#: Symbols that count.
SYMBOLS = b"#*$%&|<>"
FEATURES = ("bias", "under_4_words", "under_12_words", "symbols_5pc", "symbols_15pc", "digits_20pc", "upper_50pc", "ends_sentence", "repeated_line", "repeated_words_half", "marks_5pc", "first", "last")


@dataclass
class Model:
    """CRF weights: emission[label][feature] and transition[from][to]; label 1 is content."""

    emission: list[list[float]] = field(default_factory=lambda: [[0.0] * len(FEATURES), [1.0] + [0.0] * (len(FEATURES) - 1)])
    transition: list[list[float]] = field(default_factory=lambda: [[0.5, 0.0], [0.0, 0.5]])
    content_share: float = 0.5


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _DIGIT, _UPPER, _MARK, _STOP = _lut(SYMBOLS), _lut(b"0123456789"), _lut(bytes(range(65, 91))), _lut(b"!?~^=+_@\\"), _lut(b".!?:;\"')")
_LETTER = _lut(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0xF5)))
_LEAD = ~_lut(bytes(range(0x80, 0xC0)))


@dataclass
class Measured:
    """Figures per document and, for its lines, CRF features and words' code points."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_first: np.ndarray
    line_features: np.ndarray
    line_chars: np.ndarray


def _repeated(batch: Batch, word: np.ndarray, first: np.ndarray, width: int = 8) -> np.ndarray:
    """Mask of words that stand in a window of ``width`` words found twice or more in their document."""
    total = len(word)
    out = np.zeros(total, bool)
    if total < width + 1:
        return out
    of = np.repeat(np.arange(batch.n), np.diff(first))
    n = total - width + 1
    value, factor = np.zeros(n, U64), FACTOR[0]
    for k in range(width):
        value += mix(word[k : k + n] + U64(k)) * factor
        factor = FACTOR[k + 1]
    inside = np.flatnonzero(of[:n] == of[width - 1 :])
    if not len(inside):
        return out
    value = mix(value[inside] + of[inside].astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(value)
    ranked = value[order]
    same = np.zeros(len(ranked), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    same[:-1] |= same[1:]
    hit = inside[order[same]]
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + width, -1)
    return np.cumsum(change[:total]) > 0


def measure(texts: list[bytes | None]) -> Measured:
    b = Batch(texts)
    starts, ends, first = b.words()
    l_start, l_end, l_first = b.lines()
    lead = b.counts(_LEAD[b.buf])
    chars = lead[ends] - lead[starts]
    word_cum = np.concatenate(([0], np.cumsum(chars)))
    symbols = b.counts(_SYMBOL[b.buf])
    word = b.hashes(starts, ends) if len(starts) else np.zeros(0, U64)
    repeat_cum = np.concatenate(([0], np.cumsum(_repeated(b, word, first))))
    # lines
    w0, w1 = np.searchsorted(starts, l_start), np.searchsorted(starts, l_end)
    words_in = w1 - w0
    of = np.repeat(np.arange(b.n), np.diff(l_first))
    key = mix(b.hashes(l_start, l_end) + of.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    dup = np.zeros(len(key), bool)
    dup[order[1:]] = key[order[1:]] == key[order[:-1]]
    dup &= words_in > 0
    dup_cum = np.concatenate(([0], np.cumsum(dup)))
    n_chars = np.maximum(lead[l_end] - lead[l_start], 1)
    share = lambda lut: (lambda c: c[l_end] - c[l_start])(b.counts(lut[b.buf]))
    n_sym, n_letter = symbols[l_end] - symbols[l_start], np.maximum(share(_LETTER), 1)
    tail = np.maximum(l_end - 1, l_start)
    at = np.arange(len(l_start))
    columns = (
        np.ones(len(at)), words_in < 4, words_in < 12, n_sym > 0.05 * n_chars, n_sym > 0.15 * n_chars, share(_DIGIT) > 0.2 * n_chars,
        share(_UPPER) > 0.5 * n_letter, _STOP[b.buf[tail]] & (l_end > l_start), dup, 2 * (repeat_cum[w1] - repeat_cum[w0]) > np.maximum(words_in, 1),
        share(_MARK) > 0.05 * n_chars, at == l_first[of], at == l_first[of + 1] - 1,
    )
    features = np.stack([np.asarray(c, np.float32) for c in columns], 1)
    return Measured(
        np.diff(first), word_cum[first[1:]] - word_cum[first[:-1]], symbols[b.end] - symbols[b.start], dup_cum[l_first[1:]] - dup_cum[l_first[:-1]],
        repeat_cum[first[1:]] - repeat_cum[first[:-1]], l_first, features, word_cum[w1] - word_cum[w0],
    )


def viterbi(emission: np.ndarray, transition: np.ndarray, line_first: np.ndarray) -> np.ndarray:
    """Best labels for the chains line_first[i]:line_first[i+1]; equal scores: content."""
    labels = np.zeros(len(emission), np.int8)
    t00, t01, t10, t11 = (float(x) for x in transition.ravel())
    for d in range(len(line_first) - 1):
        i, j = int(line_first[d]), int(line_first[d + 1])
        if i == j:
            continue
        rows = emission[i:j].tolist()
        a, c = rows[0]
        back = []
        for e0, e1 in rows[1:]:
            x0, x1, y0, y1 = a + t00, c + t10, a + t01, c + t11
            b0, b1 = x1 >= x0, y1 >= y0
            back.append((b0, b1))
            a, c = (x1 if b0 else x0) + e0, (y1 if b1 else y0) + e1
        y = int(c >= a)
        labels[j - 1] = y
        for k in range(len(back) - 1, -1, -1):
            y = int(back[k][y])
            labels[i + k] = y
    return labels


def content_share(m: Measured, model: Model) -> np.ndarray:
    """Share of each document's word characters in content lines; 0 without words."""
    emission = m.line_features @ np.asarray(model.emission, np.float32).T
    labels = viterbi(emission, np.asarray(model.transition), m.line_first)
    total = np.concatenate(([0], np.cumsum(m.line_chars)))
    content = np.concatenate(([0], np.cumsum(m.line_chars * labels)))
    first = m.line_first
    return (content[first[1:]] - content[first[:-1]]) / np.maximum(total[first[1:]] - total[first[:-1]], 1)


def train(sequences: list[tuple[np.ndarray, int]]) -> Model:
    """Fit the CRF on sequences of (line features, document label). Without documents of both labels the default
    weights come back, which call every line content.

    Only documents are labelled, so lines get their labels in two steps. First all lines of a good document count as
    content and those of a bad one as boilerplate; as such labels never change within a document, transitions are held
    back by a penalty. Under the weights found so, each line of a bad document is labelled by itself, lines of good ones
    stay content, and the CRF is fitted again on these labels, transitions and all.
    """
    if len({y for _, y in sequences}) < 2:
        return Model()
    first = _fit(sequences, [np.full(len(x), y) for x, y in sequences], tie=1.0)
    score = lambda x: x @ np.array(first.emission).T
    return _fit(sequences, [np.ones(len(x), int) if y else (score(x)[:, 1] > score(x)[:, 0]).astype(int) for x, y in sequences])


def _fit(sequences: list[tuple[np.ndarray, int]], labels: list[np.ndarray], *, steps: int = 100, rate: float = 0.3, penalty: float = 0.01, tie: float = 0.01) -> Model:
    """Gradient ascent on the likelihood of the line labels; good and bad documents weigh the same in all, lines of a
    document share its weight. penalty, tie: ridge on emissions and on transitions."""
    # lines stand by their place in the document and documents by falling length, so nothing is padded or cut: the
    # lines at place t are edge[t]:edge[t + 1], and their predecessors are the first so many at place t - 1
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i][0]))
    sequences, labels = [sequences[i] for i in order], [labels[i] for i in order]
    n, f = len(sequences), len(FEATURES)
    y = np.array([label for _, label in sequences])
    n_lines = np.array([len(x) for x, _ in sequences])
    of = np.repeat(np.arange(n), n_lines)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
    order = np.lexsort((of, at))
    kinds, kind = np.unique(np.concatenate([x for x, _ in sequences]), axis=0, return_inverse=True)
    kind, of, at, line_label = kind.ravel()[order], of[order], at[order], np.concatenate(labels).astype(int)[order]
    kinds = kinds.astype(float)
    edge = np.concatenate(([0], np.cumsum(np.bincount(at)))) if len(at) else np.zeros(1, int)
    width = len(edge) - 1
    full = np.flatnonzero(n_lines)
    last = edge[n_lines[full] - 1] + full
    later = np.arange(edge[min(1, width)], len(of))
    earlier = edge[at[later] - 1] + of[later]
    weight = 1.0 / np.maximum(n_lines, 1)
    share = np.bincount(y, minlength=2) / n
    weight = weight * (0.5 / share[y])
    per_line, log_z = weight[of], np.zeros(n)
    emission, transition = np.zeros((2, f)), np.zeros((2, 2))
    memory = [np.zeros((2, f)) + 1e-6, np.zeros((2, 2)) + 1e-6]
    seen = np.zeros((2, 2))
    np.add.at(seen, (line_label[earlier], line_label[later]), per_line[later])
    for _ in range(steps):
        e = (kinds @ emission.T)[kind]
        alpha, beta = e.copy(), np.zeros_like(e)
        for t in range(1, width):
            i, j = edge[t], edge[t + 1]
            before = alpha[edge[t - 1] : edge[t - 1] + j - i]
            alpha[i:j] += np.logaddexp(before[:, :1] + transition[:1], before[:, 1:] + transition[1:])
        for t in range(width - 2, -1, -1):
            i, j = edge[t + 1], edge[t + 2]
            inner = beta[i:j] + e[i:j]
            beta[edge[t] : edge[t] + j - i] = np.logaddexp(inner[:, :1] + transition.T[:1], inner[:, 1:] + transition.T[1:])
        log_z[full] = np.logaddexp(alpha[last, 0], alpha[last, 1])
        diff = -np.exp(alpha + beta - log_z[of, None])
        diff[np.arange(len(of)), line_label] += 1
        diff *= per_line[:, None]
        g_e = np.stack([np.bincount(kind, diff[:, k], len(kinds)) for k in (0, 1)]) @ kinds / n - penalty * emission
        g_t = -tie * transition
        if len(later):
            joint = alpha[earlier, :, None] + transition + (e + beta)[later, None, :] - log_z[of[later], None, None]
            g_t = g_t + (seen - (np.exp(joint) * per_line[later, None, None]).sum(0)) / n
        for w, g, m in ((emission, g_e, memory[0]), (transition, g_t, memory[1])):
            m += g * g
            w += rate * g / np.sqrt(m)
    return Model(emission.tolist(), transition.tolist())


def fit(documents: DataFrame, labels: DataFrame, *, max_rows: int = 1000) -> Model:
    """Train on at most ``max_rows`` labelled documents (the smallest id hashes), all lines of each.

    Features are yes or no, so a line comes to the driver as two bytes.
    """
    bounded_batches(documents.sparkSession)
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")

    def lines(batches):
        for piece, texts in slices(batches):
            m = measure(texts)
            ids, good = piece.column(0).to_pylist(), piece.column(2).to_pylist()
            bits = np.packbits(m.line_features.astype(bool), axis=1)
            rows = [bits[m.line_first[i] : m.line_first[i + 1]].tobytes() for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(good, pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "quality", "lines"])

    rows = sample.mapInArrow(lines, "doc_id long, quality int, lines binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["lines"])))
    size = -(-len(FEATURES) // 8)
    return train([(np.unpackbits(np.frombuffer(bytes(r["lines"]), np.uint8).reshape(-1, size), axis=1, count=len(FEATURES)), r["quality"]) for r in rows])


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Figures and verdict for every row of documents (doc_id, text).

    Null and empty texts have no words, so that they fail the base rules. Repeated rows are judged each by itself.
    Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        for piece, texts in slices(batches):
            m = measure(texts)
            share = content_share(m, model)
            failed = (m.n_words < 20) | (100 * m.n_repeat_words > 30 * m.n_words)
            arrays = [piece.column(0)] + [pa.array(np.asarray(a, np.int64)) for a in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)]
            arrays += [pa.array(failed), pa.array(share), pa.array(~failed & (share >= model.content_share))]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _OUT.split(", ")])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _OUT)


def keep_good(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of documents that pass, with all their columns, judged where they are read (no shuffle)."""
    schema = documents.schema

    def run(batches):
        for piece, texts in slices(batches):
            m = measure(texts)
            good = (m.n_words >= 20) & (100 * m.n_repeat_words <= 30 * m.n_words) & (content_share(m, model) >= model.content_share)
            yield piece.filter(pa.array(good))

    return documents.mapInArrow(run, schema)
