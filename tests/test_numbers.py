"""Record numbers over several files and many partitions, against brute force."""

import random

import pytest

from tabulon.api import Engine
from tabulon.errors import IOHandlingError
from tabulon.operators.ordering import split_numbers
from tabulon.plans.table import from_dataframe, from_parquet
from tabulon.quality import tools
from tabulon.sources import scratch
from tabulon.sources.delimited import read_delimited, read_lines
from tabulon.sources.dialect import Dialect

N = 40_000


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set(keys[0], "40000")
    spark.conf.set(keys[1], "1000")
    spark.conf.unset(keys[2])
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.fixture(scope="module")
def parquet_files(spark, tmp_path_factory):
    """Eight files of very different sizes; the rows of a file are in the order of v."""
    top = tmp_path_factory.mktemp("p")
    rng = random.Random(3)
    names = [f"f{i}.parquet" for i in range(8)]
    want, at = [], 0
    for name, n in zip(names, rng.sample([1, 50, 700, 3000, 9000, 12000, 20000, 400], 8)):
        spark.range(at, at + n).selectExpr("id * 7 as k", "cast(id % 5 as string) as g").coalesce(1).write.parquet(str(top / "tmp" / name))
        next((top / "tmp" / name).glob("part-*.parquet")).rename(top / name)
        want += [[k * 7, str(k % 5)] for k in range(at, at + n)]
        at += n
    return str(top / "*.parquet"), want


def test_numbers_of_many_parquet_files(spark, parquet_files, small_splits):
    path, want = parquet_files
    got = sorted(Engine(spark).query("select a.k, NR", from_parquet(spark, path)).rows(), key=lambda r: r[1])
    assert got == [[k, n] for n, (k, _) in enumerate(want, 1)]
    updated = Engine(spark).query("update set a.k = NU where a.g == '2'", from_parquet(spark, path)).rows()
    count, expected = 0, []
    for k, g in want:
        count += g == "2"
        expected.append([count if g == "2" else k, g])
    assert sorted(updated) == sorted(expected)


def test_top_of_many_parquet_files_stops_early(spark, parquet_files, small_splits):
    path, want = parquet_files
    assert Engine(spark).query("select top 900 a.k, a.g", from_parquet(spark, path)).rows() == want[:900]
    picked = [r for r in want if r[1] == "3"]
    assert Engine(spark).query("select top 2000 * where a.g == '3'", from_parquet(spark, path)).rows() == picked[:2000]
    assert Engine(spark).query("select top 99999 * where a.g == '3'", from_parquet(spark, path)).rows() == picked
    assert Engine(spark).query("select top 5 NR, a.k where a.k > 70000", from_parquet(spark, path)).rows() == [[n, k] for n, (k, _) in enumerate(want, 1) if k > 70000][:5]


@pytest.mark.parametrize("policy,comments", [("quoted", False), ("quoted", True), ("simple", True), ("quoted_rfc", False), ("quoted_rfc", True)])
def test_numbers_of_many_delimited_files(spark, tmp_path, small_splits, policy, comments):
    rng = random.Random(8)
    want = []
    for f, n in enumerate((10, 9000, 1, 4000, 15000, 2000, 300, 7)):
        lines = ["k,t\n"] if f == 0 else []
        for _ in range(n):
            k = len(want)
            multi = policy == "quoted_rfc" and k % 9 == 0
            if comments and rng.random() < 0.1:
                lines.append("# not a record\n")
            lines.append(f'{k},"x\ny {k}"\n' if multi else f"{k},y {k}\n")
            want.append([str(k), f"x\ny {k}" if multi else f"y {k}"])
        (tmp_path / f"{f}.csv").write_text("".join(lines))
    d = Dialect(",", policy, header=True, comment_prefix="#" if comments else None)
    got = Engine(spark).query("select a.k, a.t, NR", read_delimited(spark, str(tmp_path), d)).rows()
    assert sorted(got, key=lambda r: r[2]) == [[k, t, n] for n, (k, t) in enumerate(want, 1)]
    report = tools.lint_file(spark, str(tmp_path), d)
    assert report.ok and report.n_records == len(want) + 1


def test_numbers_of_one_large_file_with_line_feeds_in_fields(spark, tmp_path, small_splits):
    path = tmp_path / "t.csv"
    path.write_text("".join(f'{k},"a\nb"\n' if k % 3 else f"{k},c\n" for k in range(N)))
    t = read_delimited(spark, str(path), Dialect(",", "quoted_rfc"))
    got = Engine(spark).query("select int(a1) as k, NR", t).rows()
    assert sorted(got) == [[k, k + 1] for k in range(N)]


def test_numbers_after_a_shuffle_and_a_sort(spark):
    df = spark.range(30_000).selectExpr("id", "cast(hash(id) as bigint) as h").repartition(7)
    rows = Engine(spark).query("select a.id, a.h order by a.h | select NR, a.h", from_dataframe(df)).rows()
    assert sorted(r[0] for r in rows) == list(range(1, 30_001))
    assert [h for _, h in sorted(rows)] == sorted(h for _, h in rows)
    assert Engine(spark).query("select NR where a.id < 0", from_dataframe(df)).rows() == []


def test_changed_splits_fail_and_give_no_wrong_numbers(spark, tmp_path, small_splits):
    for f in range(6):
        (tmp_path / f"{f}.txt").write_text("".join(f"{f} {k}\n" for k in range(500)))
    lines = read_lines(spark, str(tmp_path))
    assert sorted(r.nr for r in split_numbers(lines, None, "ln", "nr").collect()) == list(range(1, 3001))
    numbered = split_numbers(lines, None, "ln", "nr")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000000")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    with pytest.raises(Exception, match="cut into other partitions"):
        numbered.collect()


def test_no_scratch_folder_of_this_machine_on_a_cluster(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(IOHandlingError):
        scratch.scratch_path(Session, "x")
    Session.sparkContext.master = "local-cluster[3,2,1000]"
    with pytest.raises(IOHandlingError):
        scratch.scratch_path(Session, "x")
    Session.sparkContext.master = "local[2]"
    assert scratch.scratch_path(Session, "x") != scratch.scratch_path(Session, "x")


def test_short_records_have_no_join_key(spark):
    from tabulon.plans.table import from_rows

    ragged = from_rows(spark, [["x", "1"], ["y"]])
    other = from_rows(spark, [["1", "one"], ["v"]])
    with pytest.raises(Exception, match="no field 2"):
        Engine(spark).query("select a1, b1 join b on a2 == b2", ragged, other).rows()
    assert Engine(spark).query("select a1, b2 join b on a1 == b1", from_rows(spark, [["1", "p"], [None, "q"]]), from_rows(spark, [["1", "one"], [None, "none"]])).rows() == [["1", "one"], [None, "none"]]
