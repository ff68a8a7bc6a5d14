"""URL filters, WARC archives, exact search and the pipeline."""

import base64
import hashlib
import os

import duckdb
import numpy as np
import pytest

from tabulon.llm import url_filter, vafile, warc
from tabulon.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_urls(spark):
    rows = [
        ("HTTP://A.Net/x?y#z", None), ("x://example.net/en/1", ""), ("x://example.net/de/1", ""), ("nourl", "<link rel=canonical href='http://b.net/'>"), (None, None), ("x://net", ""), ("x://net/", ""), ("x://mynet/", ""),
        ("x://alias.com/p", '<link rel="canonical" href="http://bad.net/q">'), ("x://hop.com/1", '<meta http-equiv="refresh" content="0; url=http://alias.com/p?u">'), ("x://ok.org/fr/1", '<link href="//hop2.com/2" rel="canonical">'),
        ("x://hop2.com/2", '<link rel="canonical" href="http://evil.net/z">'), ("x://free.com/a", '<link rel="canonical" href="/b">'),
    ]
    df = spark.createDataFrame([(i, u, h, "dup") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1] == ("example.net", "/en/1", "example.net/en/", "allow") and got[2][3] == "block"
    assert got[3] == ("", "", None, "allow") == got[4] and got[5] == ("net", "", None, "allow") and got[6][3] == "block" and got[7][2] is None
    assert got[8][2:] == (None, "block") == got[9][2:]  # aliases of a blocked url, over two hops
    assert got[10][2:] == ("org/fr/", "allow") and got[11][2:] == (None, "allow")  # an allowed alias clears the class
    assert got[12][3] == "allow"
    assert url_filter.filter_urls(df.where("page_id < 0")).count() == 0


def test_urls_relative_targets_and_queries(spark):
    link = "<link rel=canonical href='{}'>".format
    rows = [
        ("x://a.com/d/p", link("b.html")), ("x://a.com/d/b.html", link("http://bad.net/1")),  # beside the page
        ("x://c.com/d/e/p", link("../q")), ("x://c.com/d/q", link("http://bad.net/2")),
        ("x://d.com/v?id=1", link("http://bad.net/3")), ("x://d.com/v?id=2", link("http://fine.com/")), ("x://d.com/v", None), ("x://d.com/v?id=3", link("?id=1")),
        ("x://e.com", link("./f/../g?a=1&amp;b=2#z")), ("x://e.com/g?a=1&b=2", link("http://bad.net/4")), ("x://f.com/1", link("mailto:x@bad.net")),
        ("x://g.com/1", '<meta http-equiv="refresh" content="0; url=2?u=http://free.com/">'), ("x://g.com/2?u=http://free.com/", link("http://bad.net/5")), ("x://free.com/", link("http://fine.com/")),
    ]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df).collect()}
    assert sorted(i for i in got if got[i] == "allow") == [5, 6, 10, 13]


def test_relative_targets_resolve_as_in_the_standard(spark):
    from urllib.parse import urljoin

    base, targets = "http://a/b/c/d;p?q", ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", ";x", "g;x", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./g/.", "g/./h", "g/../h", "http://h/x?y"]
    df = spark.createDataFrame([(t,) for t in targets], "t string").selectExpr("t", f"'{base}' as u")
    got = {r.t: r.k for r in df.select("t", url_filter.key_of(url_filter.resolve(df["u"], df["t"])).alias("k")).collect()}
    assert got == {t: urljoin(base, t).split("#")[0].split("://")[1] for t in targets}


def test_warc(spark):
    html = ["a", "b", "a", None, "", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n", "é" * 50_000, "a"]
    df = spark.createDataFrame([(i, f"http://h/{i}\r\n" if i else None, h, 0) for i, h in enumerate(html)], "page_id long, url string, html string, payload int").repartition(3)
    got = {r.page_id: r for r in warc.archive_round_trip(df).collect()}
    original = {}
    for i, h in enumerate(html):
        original[h or ""] = i
    for i, h in enumerate(html):
        body = (h or "").encode()
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() and got[i].payload_bytes == len(body) and got[i].valid
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if original[h or ""] == i else ("revisit", original[h or ""]))
    small = warc.archive_round_trip(df, min_bytes=2).where("record_type = 'revisit'").count()
    assert small == 0
    assert warc.archive_round_trip(df.where("page_id < 0")).count() == 0


def test_warc_null_ids_and_repeated_rows(spark):
    rows = [(1, "x"), (1, "x"), (2, "x"), (2, "x"), (None, "x"), (None, "y"), (None, "y"), (5, "z"), (6, "\r\n\r\n"), (7, "\r\n\r\n\r\n\r\na"), (8, "\r\n\r\n")]
    df = spark.createDataFrame([(i, "u", h, 1, "k") for i, h in rows], "page_id long, url string, html string, size int, sha string").repartition(3)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.valid) for r in warc.archive_round_trip(df).collect()), key=str)
    assert got == sorted([
        (1, "revisit", 2, 1, True), (1, "revisit", 2, 1, True), (2, "response", None, 1, True), (2, "response", None, 1, True), (None, "revisit", 2, 1, True), (None, "response", None, 1, True),
        (None, "response", None, 1, True), (5, "response", None, 1, True), (6, "revisit", 8, 4, True), (7, "response", None, 9, True), (8, "response", None, 4, True)], key=str)


def brute_top(rows, queries_at, k):
    out = {}
    for q, v in rows:
        if q % queries_at == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("scale", [1, 10_000, 10**8])
def test_search(spark, scale):
    rng = np.random.default_rng(4)
    vectors = [[float(x) for x in rng.integers(-3, 4, 6) * scale / 256] for _ in range(300)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000, None), (1001, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    ints = vafile.integer_vectors(df, "vec_id", "embedding", 256)
    got: dict = {}
    for r in vafile.top_k(ints, ints.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_top([(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows[:300]], 50, 5)


def test_search_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0])], "vec_id long, embedding array<float>")
    ints = vafile.integer_vectors(df, "vec_id", "embedding", 256)
    assert [tuple(r) for r in vafile.top_k(ints, ints.where("vec_id = 0"), 5).collect()] == [(0, 1, 1, 256 * 128)]
    assert vafile.top_k(ints, ints.where("vec_id > 5"), 5).count() == 0


def test_search_waves(spark):
    df = spark.range(200).selectExpr("id as vec_id", "array(double(id % 17), double(id % 5)) as embedding")
    ints = vafile.integer_vectors(df, "vec_id", "embedding", 1)
    one = sorted(map(tuple, vafile.top_k(ints, ints, 3).collect()))
    assert one == sorted(map(tuple, vafile.top_k(ints, ints, 3, wave_bytes=3000).collect()))


def test_search_reads_few_exact_vectors(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=32)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    ints = vafile.integer_vectors(df, "vec_id", "embedding", 256)
    read = []
    kept = vafile.materialize
    monkeypatch.setattr(vafile, "materialize", lambda t, name: (lambda out: (read.append(out.count()) if name == "hits" else None, out)[1])(kept(t, name)))
    got: dict = {}
    for r in vafile.top_k(ints, ints.where("vec_id % 100 = 0"), 5, wave_bytes=8000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_top([(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows], 100, 5)
    assert 30 * 5 <= sum(read) < 0.05 * 30 * 3000 and len(read) > 1


def test_search_repeated_rows_and_extra_columns(spark):
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 3.0]), (2, [2.0, 0.0]), (None, [9.0, 9.0]), (3, [])]
    df = spark.createDataFrame([(i, v, 7, 8) for i, v in rows], "vec_id long, embedding array<double>, score int, q int")
    ints = vafile.integer_vectors(df, "vec_id", "embedding", 1)
    got = [tuple(r) for r in vafile.top_k(ints, ints.where("vec_id = 0"), 3).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 3), (0, 2, 2, 2), (0, 3, 1, 1)]
    huge = spark.createDataFrame([(0, [2**40, 2**40]), (1, [2**40, 1]), (2, [-(2**40), 0])], "vec_id long, v array<long>")
    assert [r.score for r in vafile.top_k(huge, huge.where("vec_id = 0"), 3).orderBy("rank").collect()] == [2**63 - 1, -(2**63)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    q = queries()[name](spark, SF)
    columns = sorted(q.columns)
    want = c.sql(oracle_sql()[name])
    assert columns == sorted(want.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key([tuple(r) for r in q.select(*columns).collect()]) == key(want.select(*[f'"{x}"' for x in columns]).fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        counts.append(docs.count())
        if name != "bpe_encoding":
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4] == counts[5] > 0


def test_near_dedup_of_repeated_ids(spark):
    import corpus_pipeline

    a, b, c, d = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue white black grey", "north south east west up down")
    rows = [(3, a), (7, a), (7, b), (7, b), (8, c), (8, d), (9, d), (10, ""), (10, ""), (11, None), (None, a), (None, a)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int").repartition(4)
    got = corpus_pipeline.near_dedup(spark, df, SF)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, a), (7, b), (8, c), (9, d), (10, ""), (11, None), (None, a), (None, a)], key=str)
