"""Dialects of delimited files: separator, policy, and how they are guessed."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from ..errors import IOHandlingError

POLICIES = ("simple", "quoted", "quoted_rfc", "whitespace", "monocolumn")


@dataclass(frozen=True)
class Dialect:
    delim: str = ","
    policy: str = "quoted"
    encoding: str = "utf-8"
    header: bool = False
    comment_prefix: str | None = None
    comment_regex: str | None = None
    strip_fields: bool = False

    def __post_init__(self):
        if self.policy not in POLICIES:
            raise IOHandlingError(f"Unknown policy '{self.policy}'")
        if self.policy.startswith("quoted") and (self.delim == '"' or len(self.delim) != 1):
            raise IOHandlingError("A quoted policy needs a one-character delimiter other than a double quote")
        if self.policy == "whitespace" and self.delim != " ":
            raise IOHandlingError("The whitespace policy needs a blank as delimiter")
        if self.encoding not in ("utf-8", "latin-1"):
            raise IOHandlingError("The encoding must be utf-8 or latin-1")
        if self.encoding == "latin-1" and not self.delim.isascii():
            raise IOHandlingError("A latin-1 file needs an ASCII delimiter")

    def but(self, **changes) -> Dialect:
        return replace(self, **changes)


def default_policy(delim: str) -> str:
    return "quoted" if delim in (",", ";") else "whitespace" if delim == " " else "simple"


def named_format(name: str, source: Dialect | None = None) -> Dialect:
    """csv, tsv, monocolumn, or input: the dialect of the input."""
    if name == "input" and source is not None:
        return source
    table = {"csv": (",", "quoted"), "tsv": ("\t", "simple"), "monocolumn": ("", "monocolumn")}
    if name not in table:
        raise IOHandlingError(f"Unknown format '{name}'")
    return Dialect(*table[name])


def split_line(line: str, d: Dialect) -> tuple[list[str], bool]:
    """Fields of one record and whether its quoting is broken: the driver-side twin of the column splitter."""
    if d.policy == "monocolumn":
        return [line], False
    if d.policy == "whitespace":
        return re.findall("[^ ]+", line), False
    if d.policy == "simple" or '"' not in line:
        return line.split(d.delim), False
    space = "" if d.delim == " " else " *"
    sep = re.escape(d.delim)
    token = re.compile(rf'{sep}(?:({space}"(?:[^"]|"")*"{space})(?={sep}|\Z)|([^{sep}]*))', re.S)
    fields, bad = [], False
    for m in token.finditer(d.delim + line):
        if m[1] is not None:
            fields.append(m[1].strip(" ")[1:-1].replace('""', '"'))
        else:
            fields.append(m[2])
            bad = bad or '"' in m[2]
    return fields, bad


def candidates(delims: tuple[str, ...], comment_prefix: str) -> list[Dialect]:
    """What content detection tries, in order."""
    return [Dialect(x, policy, comment_prefix=comment_prefix) for x in delims for policy in [default_policy(x)] + (["quoted_rfc"] if x in (",", ";") else [])]


def detect_by_content(lines: list[str], delims: tuple[str, ...] = ("\t", ",", ";", "|"), *, min_lines: int = 10, comment_prefix: str = "#") -> Dialect | None:
    """The separator that gives every record the same width with sound quoting; most columns win, then order.

    lines: the whole text, as a cut one may end inside a record. For files, delimited.detect_lines does the same.
    """
    best, width = None, 1
    for d in candidates(delims, comment_prefix):
        records = _records([x for x in lines if not x.startswith(comment_prefix)], d)
        if records is None or len(records) < min_lines:
            continue
        parsed = [split_line(r, d) for r in records]
        widths = {len(f) for f, _ in parsed}
        if any(bad for _, bad in parsed) or len(widths) != 1:
            continue
        if (n := widths.pop()) > width:
            best, width = d, n
    return best


def _records(lines: list[str], d: Dialect) -> list[str] | None:
    if d.policy != "quoted_rfc":
        return lines
    out, held = [], []
    for line in lines:
        held.append(line)
        if sum(x.count('"') for x in held) % 2 == 0:
            out.append("\n".join(held))
            held = []
    return None if held else out


def detect_by_frequency(text: str, delims: tuple[str, ...] = (",", "\t", ";", "|")) -> Dialect:
    """The most frequent separator of the first 10000 characters, blanks and dots aside; comma if none occurs."""
    head = text[:10_000]
    counts = [(head.count(d), -i, d) for i, d in enumerate(delims) if d not in (" ", ".")]
    n, _, d = max(counts)
    return Dialect(d, default_policy(d)) if n else Dialect(",", "quoted")


def detect_by_width(lines: list[str], path: str = "") -> Dialect | None:
    """First of tab, comma, semicolon and bar that gives one width of two or more in ten lines; then the extension."""
    head = lines[:10]
    if len(head) >= 2:
        for delim in ("\t", ",", ";", "|"):
            d = Dialect(delim, default_policy(delim))
            parsed = [split_line(x, d) for x in head]
            widths = {len(f) for f, _ in parsed}
            if len(widths) == 1 and widths.pop() >= 2 and not any(bad for _, bad in parsed):
                return d
    if path.endswith(".csv"):
        return Dialect(",", "quoted")
    return Dialect("\t", "simple") if path.endswith(".tsv") else None
