"""Secret scans in DataFrame functions only: base patterns, and windowed entropy over candidate strings.

A candidate is a whole run of 20 or more base64 characters; its class is hex, base64 or, without a digit, letters by
the characters it has. A window slides over it, and the sum of c * log2(c) over the window's character counts is kept
up to date from the counts of the character that enters and the one that leaves. A candidate whose best window
reaches its class's entropy is a span. The parts of a run (between / _ - =) in which an allow-list pattern matches are
left out of the windows; what stands beside them is still looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns. Runs below the least length can be left to the quantifier, as a longer match
#: can't start inside a failed one; for assign it can, so there the length is checked after matching.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Known harmless strings: digests of nothing, counting runs, placeholders.
ALLOW = (
    r"(?i)example|sample|dummy|placeholder|changeme|test",
    r"(?i)0123456789|abcdefghij",
    r"(?i)^d41d8cd98f00b204e9800998ecf8427e$",
    r"(?i)^da39a3ee5e6b4b0d3255bfef95601890afd80709$",
    r"(?i)^e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855$",
)
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_letters")


@dataclass(frozen=True)
class Rules:
    window: int = 20
    hex_bits: float = 3.0
    base64_bits: float = 3.8
    letters_bits: float = 3.8
    allow: tuple[str, ...] = ALLOW


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _spans(text: str, pattern: str, group: int = 0) -> str:
    """SQL for the matches of a pattern as array<struct<s, e, v>> in code points; v is a group's text.

    What split() leaves between matches gives their places, which are summed up by runs of 256 matches, as an array
    that grows by one element at a time would cost the square of their number.
    """
    p = _sql(pattern)
    step = """named_struct('at', a.at + length(x['2']) + length(x['0']),
        'out', concat(a.out, array(named_struct('s', a.at + length(x['2']), 'e', a.at + length(x['2']) + length(x['0']), 'v', x['1']))))"""
    none = "cast(array() as array<struct<s:int,e:int,v:string>>)"
    return f"""element_at(transform(array(
      filter(arrays_zip(regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}), split({text}, {p}, -1)), x -> x['0'] is not null)),
      z -> aggregate(sequence(0, (size(z) - 1) div 256), named_struct('at', 0, 'out', cast(array() as array<array<struct<s:int,e:int,v:string>>>)),
        (b, j) -> element_at(transform(array(aggregate(slice(z, cast(j * 256 + 1 as int), 256), named_struct('at', b.at, 'out', {none}), (a, x) -> {step})),
          r -> named_struct('at', r.at, 'out', concat(b.out, array(r.out)))), 1),
        b -> flatten(b.out))), 1)"""


def window_entropy(text: str, window: int) -> str:
    """SQL for the highest Shannon entropy in bits of a window of the string; 0 if it is shorter than the window."""
    count = lambda at, size, c: f"size(filter(slice(cs, {at}, {size}), y -> y = {c}))"
    f = lambda c: f"if({c} > 0, {c} * log2({c}), 0D)"
    entering = count(f"greatest(i - {window}, 1)", f"i - greatest(i - {window}, 1)", "cs[i - 1]")
    leaving = count(f"i - {window}", window + 1, f"cs[i - {window} - 1]")
    return f"""element_at(transform(array(split({text}, '')), cs -> aggregate(
      sequence(1, size(cs)), named_struct('sum', 0D, 'best', 0D),
      (a, i) -> element_at(transform(array(
          a.sum + element_at(transform(array({entering}), c -> {f("(c + 1)")} - {f("c")}), 1)
          + if(i > {window}, element_at(transform(array(if(i > {window}, {leaving}, 1)), c -> {f("(c - 1)")} - {f("c")}), 1), 0D)),
        t -> named_struct('sum', t, 'best', if(i >= {window}, greatest(a.best, log2({window}) - t / {window}), a.best))), 1),
      a -> a.best)), 1)"""


def find(documents: DataFrame, rules: Rules = Rules(), *, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, text and ``found``: array of (start, kind, end), sorted, kind an index in KINDS.

    Null text is empty. Empty texts have no spans. Repeated rows are scanned each by itself; an empty table gives an
    empty result. Spans may overlap, as one string can be several kinds of secret.
    """
    none = "cast(array() as array<struct<s:int,e:int,v:string>>)"
    flagged = documents.select(
        "doc_id", *keep, F.coalesce("text", F.lit("")).alias("t"),
    ).withColumns({
        "f_assign": F.expr(r"rlike(t, r'(?i)password|passwd|secret|token|api_?key')"),
        "f_access": F.col("t").contains("AKIA"),
        "f_hex": F.expr("rlike(t, r'[0-9a-f]{16}')"),
        "f_high": F.expr(f"rlike(t, {_sql(CANDIDATE)})"),
    })
    raw = flagged.select(
        "doc_id", *keep, "t",
        F.expr(f"if(f_assign, filter({_spans('t', ASSIGN, 2)}, x -> length(x.v) >= 12), {none})").alias("assign"),
        F.expr(f"if(f_access, {_spans('t', ACCESS)}, {none})").alias("access"),
        F.expr(f"if(f_hex, {_spans('t', HEX)}, {none})").alias("hex"),
        F.expr(f"if(f_high, {_spans('t', CANDIDATE)}, {none})").alias("high"),
    )
    rest = "x.v"  # without the parts that the allow-list knows
    for p in rules.allow:
        rest = f"regexp_replace({rest}, {_sql(f'(?<![A-Za-z0-9+])[A-Za-z0-9+]*(?:{p})[A-Za-z0-9+]*')}, ' ')"
    hex_class, digit = "rlike(x.v, '^([0-9a-f]+|[0-9A-F]+)$')", "rlike(x.v, '[0-9]')"
    best = f"array_max(transform(split({rest}, ' '), z -> {window_entropy('z', rules.window)}))"
    high = f"""filter(high, x -> {best} >= if(not {digit}, {rules.letters_bits}D, if({hex_class}, {rules.hex_bits}D, {rules.base64_bits}D)))"""
    parts = [f"transform({k}, x -> named_struct('start', x.s, 'kind', {i}, 'end', x.e))" for i, k in enumerate(KINDS[:3])]
    scored = raw.withColumn("high", F.expr(f"if(size(high) > 0, {high}, high)"))
    parts.append(f"transform(high, x -> named_struct('start', x.s, 'kind', if(not {digit}, 5, if({hex_class}, 3, 4)), 'end', x.e))")
    return scored.select("doc_id", *keep, F.col("t").alias("text"), F.expr(f"array_sort(concat({', '.join(parts)}))").alias("found"))


def _listed(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({names}), x.kind + 1), x.start, x.end)), ',')"


def scan(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans as text."""
    n = lambda i: F.expr(f"cast(size(filter(found, x -> x.kind = {i})) as bigint)")
    return find(documents, rules).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.expr(f"sha2({_listed('filter(found, x -> x.kind < 3)')}, 256)").alias("base_sha256"),
        F.expr(_listed("found")).alias("spans"),
    )


def redact(documents: DataFrame, rules: Rules = Rules(), mask: str = "[SECRET]") -> DataFrame:
    """The documents with every maximal run of spans replaced by ``mask``; n_chars, if there, follows the new text.

    Rows without spans stay as they are, nulls included.
    """
    columns = documents.columns
    rest = tuple(c for c in columns if c not in ("doc_id", "text"))
    safe = documents.select("doc_id", F.col("text"), F.struct(F.col("text").alias("own"), *[F.col(f"`{c}`") for c in rest]).alias("row"))
    marked = find(safe, rules, keep=("row",))
    text = f"""aggregate(found, named_struct('out', '', 'at', 0),
      (a, x) -> if(x.start >= a.at and not (x.start = a.at and a.at > 0),
        named_struct('out', concat(a.out, substring(text, a.at + 1, x.start - a.at), '{mask}'), 'at', x.end),
        named_struct('out', a.out, 'at', greatest(a.at, x.end))),
      a -> concat(a.out, substring(text, a.at + 1)))"""
    cut = marked.withColumn("text", F.expr(f"if(size(found) > 0, {text}, row.own)"))
    out = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col(f"row.`{c}`") for c in rest}
    if "n_chars" in rest:
        out["n_chars"] = F.when(F.expr("size(found) > 0"), F.length("text").cast(dict(documents.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
    return cut.select(*[out[c].alias(c) for c in columns])
