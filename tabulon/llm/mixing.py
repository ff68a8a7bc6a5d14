"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents fall into cells of source, language and topic; values that the targets don't name pool in 'other', so the
number of cells is bounded by the targets, whatever the corpus. The cells' token counts, one small row, are raked to
the three marginals by a fold; inclusion probabilities follow from the raked weights and the token budget, and
documents are drawn by a hash of their id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, unit_hash

#: Topics by pattern, the first that matches; 'general' if none does.
TOPICS = (("legal", r"(?i)licen[cs]ed? under|copyright|licence|license"), ("tables", r"\|"), ("numbers", r"[0-9]{4}"))


@dataclass(frozen=True)
class Targets:
    """Shares of tokens wanted. Shares are scaled to the values that occur; unnamed values share 'other'."""

    source: dict[str, float] = field(default_factory=lambda: {f"src{i}": 0.05 for i in range(20)})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15})
    topic: dict[str, float] = field(default_factory=lambda: {"general": 0.6, "numbers": 0.2, "legal": 0.15, "tables": 0.05})
    other: float = 0.02
    tokens_kept: float = 0.5
    rounds: int = 40
    seed: str = "mix-1"


def topic_of(text: Column) -> Column:
    out = F.lit("general")
    for name, pattern in reversed(TOPICS):
        hit = text.contains("|") if pattern == r"\|" else text.rlike(pattern)
        out = F.when(hit, name).otherwise(out)
    return F.when(text.isNull(), "general").otherwise(out)


def _pooled(c: Column, named: dict[str, float]) -> Column:
    return F.when(c.isin(*named), c).otherwise("other")


def keyed(documents: DataFrame, targets: Targets, *columns: str) -> DataFrame:
    """The given columns, the cell (source_key, lang_key, topic_key) and the number of words as tokens."""
    return documents.select(
        *columns,
        _pooled(F.col("source"), targets.source).alias("source_key"), _pooled(F.col("lang"), targets.lang).alias("lang_key"),
        _pooled(topic_of(F.col("text")), targets.topic).alias("topic_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
    )


def _goals(targets: Targets) -> str:
    def one(named: dict[str, float]) -> str:
        pairs = {**named, "other": targets.other}
        return "array(" + ", ".join(f"named_struct('k', '{k.replace(chr(39), chr(92) + chr(39))}', 't', {float(v)!r}D)" for k, v in sorted(pairs.items())) + ")"

    return f"array({one(targets.source)}, {one(targets.lang)}, {one(targets.topic)})"


def let(name: str, value: str, body: str) -> str:
    """SQL that computes a value once and names it in the body."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def raked(cells: DataFrame, targets: Targets) -> DataFrame:
    """Cells with their raked share of tokens (share) and inclusion probability.

    cells: source_key, lang_key, topic_key, tokens, one row a cell. Cells without tokens get probability 1.
    With no tokens at all the result is empty.
    """
    row = cells.where("tokens > 0").agg(F.array_sort(F.collect_list(F.struct("source_key", "lang_key", "topic_key", F.col("tokens").cast("double").alias("tokens")))).alias("list")).where("size(list) > 0")
    start = """transform(list, x -> named_struct('k', array(x.source_key, x.lang_key, x.topic_key), 'a', x.tokens / total, 'w', x.tokens / total))"""
    total = "aggregate(list, 0D, (a, x) -> a + x.tokens)"
    row = row.select(F.expr(let("total", total, start)).alias("cells"), F.expr(_goals(targets)).alias("goals"))
    # targets of the values that occur, scaled to one
    present = "filter(g, t -> exists(cells, x -> x.k[d] = t.k))"
    scaled = let("p", present, let("s", "aggregate(p, 0D, (a, t) -> a + t.t)", "transform(p, t -> named_struct('k', t.k, 't', t.t / s))"))
    row = row.select("cells", F.expr(f"transform(goals, (g, d) -> {scaled})").alias("goals"))
    factors = "transform(goals[i % 3], t -> named_struct('k', t.k, 'f', t.t / aggregate(c, 0D, (a, x) -> a + if(x.k[i % 3] = t.k, x.w, 0D))))"
    update = "transform(c, x -> named_struct('k', x.k, 'a', x.a, 'w', x.w * aggregate(f, 1D, (a, y) -> if(y.k = x.k[i % 3], y.f, a))))"
    row = row.select(F.expr(f"aggregate(sequence(0, {3 * targets.rounds - 1}), cells, (c, i) -> {let('f', factors, update)})").alias("cells"))
    # the scale at which the expected tokens meet the budget, by bisection of its logarithm
    kept = "aggregate(cells, 0D, (a, x) -> a + x.a * least(1D, exp(m) * x.w / x.a))"
    halve = let("m", "(b.lo + b.hi) / 2", f"if({kept} < {targets.tokens_kept!r}D, named_struct('lo', m, 'hi', b.hi), named_struct('lo', b.lo, 'hi', m))")
    row = row.withColumn("scale", F.expr(f"aggregate(sequence(1, 60), named_struct('lo', -30D, 'hi', 30D), (b, i) -> {halve}, b -> exp(b.hi))"))
    return row.select("scale", F.explode("cells").alias("x")).select(
        F.expr("x.k[0]").alias("source_key"), F.expr("x.k[1]").alias("lang_key"), F.expr("x.k[2]").alias("topic_key"),
        F.expr("x.w").alias("share"), F.expr("x.w / x.a").alias("weight"), F.expr("least(1D, scale * x.w / x.a)").alias("probability"),
    )


_CELL = ["source_key", "lang_key", "topic_key"]


def drawn(keys: DataFrame, cells: DataFrame, targets: Targets) -> DataFrame:
    """keys with weight, probability and kept. The cells are broadcast: their number is bounded by the targets."""
    return keys.join(F.broadcast(cells.select(*_CELL, "weight", "probability")), _CELL, "left").withColumns({
        "weight": F.coalesce("weight", F.lit(1.0)), "probability": F.coalesce("probability", F.lit(1.0)),
    }).withColumn("kept", unit_hash(F.lit(targets.seed), "doc_id") < F.col("probability"))


def count_cells(keys: DataFrame) -> DataFrame:
    return keys.groupBy(*_CELL).agg(F.sum("tokens").alias("tokens"))


def mix(documents: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """doc_id, cell, tokens, weight, probability and kept of every document.

    Null sources, languages and texts fall in 'other', 'other' and 'general'; texts without words have no tokens.
    Repeated ids share one draw. Documents of equal draws are kept alike. An empty table gives an empty result.
    """
    from .common import materialize

    keys = materialize(keyed(documents, targets, "doc_id"), "mix-keys")
    return drawn(keys, raked(count_cells(keys), targets), targets)


def sample(documents: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """The documents drawn, with their own columns. The text is scanned twice rather than shuffled."""
    cells = raked(count_cells(keyed(documents, targets)), targets)
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "doc_id", "source", "lang", "text")
    return drawn(keyed(whole, targets, "row", "doc_id"), cells, targets).where("kept").select("row.*")
