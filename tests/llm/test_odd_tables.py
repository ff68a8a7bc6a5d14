"""Every operator on tables with nulls in any column, repeated rows, ties, empty and long texts, and clashing extra columns."""

import hashlib

import pytest

from tabulon.llm import bpe, mixing, neardup, quality, secrets, substrings, toxicity, url_filter
from tabulon.llm.queries import vocabulary

TEXT = "the quick brown fox jumps over the lazy dog and then it sleeps all day long under that old tree near the small house"
SECRET = "password = abcdefghijklmnop1234"
ROWS = [
    (1, TEXT, "en", "src1"), (1, TEXT, "en", "src1"), (2, TEXT, "en", "src1"), (None, TEXT, None, None), (None, None, None, None), (3, None, "en", "src2"),
    (4, "", "de", "src3"), (5, " \n\t ", "de", None), (6, SECRET, None, "src3"), (6, SECRET, None, "src3"), (7, (TEXT + "\n") * 400, "fr", "src4"), (8, "x" * 200_000, "en", "src1"),
]
#: Names that operators use inside.
CLASHING = ("node", "token", "text_", "k", "n", "rep", "may", "key", "score", "slice", "masks", "tk", "t", "row", "kept", "__p", "component", "digest", "label", "q")


@pytest.fixture(scope="module")
def odd(spark):
    names = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["z"] * len(CLASHING)) for r in ROWS], names).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, i % 2, "z", "z") for i in range(1, 9)] + [(None, 1, 1, "z", "z"), (1, 1, 1, "z", "z"), (2, None, None, "z", "z"), (99, 1, 0, "z", "z"), (3, 7, -1, "z", "z")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string, n string")


def check(out, ids=True):
    """One row a row of the input, equal ids of equal rows, and repeated rows alike."""
    rows = out.collect()
    assert len(rows) == len(ROWS) and sorted((r["doc_id"] for r in rows), key=str) == sorted((r[0] for r in ROWS), key=str)
    for i in (1, 6):
        assert len({tuple(r) for r in rows if r["doc_id"] == i}) == 1
    return {r["doc_id"]: r for r in rows}


def test_quality(odd, labels):
    model = quality.fit(odd, labels)
    got = check(quality.score(odd, model))
    assert all(got[i].base_failed and not got[i].kept for i in (3, 4, 5, 8)) and got[7].base_failed
    assert quality.keep_good(odd, model).columns == odd.columns


def test_near_duplicates(odd):
    got = check(neardup.near_duplicates(odd))
    assert got[1].kept and not got[2].kept and got[2].component_id == 1 and all(got[i].n_shingles == 0 and got[i].component_id == i for i in (3, 4, 5))
    assert got[8].n_shingles == 1 and got[None].component_id is None


def test_bpe(odd):
    got = check(bpe.encode(odd, vocabulary()))
    empty = hashlib.sha256(b"").hexdigest()
    assert all(tuple(got[i])[1:] == (0, empty, empty) for i in (3, 4, 5)) and got[1].ids_sha256 == got[2].ids_sha256


def test_mixing(odd):
    got = check(mixing.mix(odd))
    assert all(got[i].tokens == 0 for i in (3, 4, 5)) and got[8].tokens == 1
    sampled = mixing.sample(odd)
    assert sampled.columns == odd.columns and sampled.where("doc_id in (1, 6)").groupBy("doc_id").count().where("count <> 2").count() == 0


def test_secrets(odd):
    got = check(secrets.scan(odd))
    assert got[6].n_assign == 1 and all(got[i].spans == "" for i in (3, 4, 5))
    clean = secrets.redact(odd)
    assert clean.columns == odd.columns and {r.text for r in clean.where("doc_id = 6").collect()} == {"[SECRET]"}
    assert clean.where("doc_id = 3").first().text is None


def test_substrings(odd):
    got = check_substrings(substrings.remove_repeats(odd).collect())
    assert all(got[i] == [(0, 0, 0)] for i in (3, 4))
    assert got[8] == [(200_000, 199_999, 1)]  # the string at the second byte also starts at the first, and covers the second byte


def check_substrings(rows):
    """Null ids come first and rows of one id in the order in which they are read, so repeated rows differ in what they keep."""
    assert len(rows) == len(ROWS)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans))
    size = len(TEXT)
    assert sorted(got[None]) == [(0, 0, 0), (size, 0, 0)] and got[1] == got[1][:1] * 2 == [(size, size, 1)] * 2 and got[2] == [(size, size, 1)]
    return got


def test_toxicity(odd, labels):
    got = check(toxicity.score(odd, toxicity.fit(odd, labels)))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[3].score == got[4].score == got[5].score and got[None].held_out is False


def test_url_filter(spark):
    rows = [(1, "http://a.net/x", "h"), (1, "http://a.net/x", "h"), (None, None, None), (2, None, "h"), (3, "http://b.com/" + "p" * 50_000, None), (4, "", ""), (None, "http://a.net/x", "h")]
    df = spark.createDataFrame([(*r, "z", "z", "z", "z") for r in rows], "page_id long, url string, html string, host string, key string, best string, tag string")
    got = sorted(((r.page_id, r.host, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()), key=str)
    assert got == sorted([
        (1, "a.net", "net/", "block"), (1, "a.net", "net/", "block"), (None, "", None, "allow"), (2, "", None, "allow"), (3, "b.com", None, "allow"), (4, "", None, "allow"),
        (None, "a.net", "net/", "block")], key=str)
