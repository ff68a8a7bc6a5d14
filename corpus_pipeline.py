"""Corpus pipeline: quality rules, near-dedup, secret redaction, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import bpe, mixing, neardup, quality, secrets
from tabulon.llm.common import materialize, may_hold
from tabulon.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the line labels; rejected ones go. Null and empty texts are rejected, repeated
    rows judged each by itself; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id; of rows that repeat an id, one.

    It links word shingles of five words at a similarity of 0.8. Documents without words and rows with a null id
    have no duplicates, so they stay.
    """
    params = neardup.Params(words=5)
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _near_dedup_of_rows(spark, docs, params)
    found = materialize(neardup.near_duplicates(docs, params), "near-dedup")
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    own = [F.col(f"`{c}`") for c in docs.columns]
    marked = may_hold(docs.select(F.struct(*own).alias("row"), "doc_id"), "doc_id", gone)
    asked = marked.where("may").join(gone.hint("merge"), "doc_id", "left_anti")
    return marked.where("not may").select("row.*").unionByName(asked.select("row.*"))


def _near_dedup_of_rows(spark: SparkSession, docs: DataFrame, params: neardup.Params) -> DataFrame:
    """near_dedup where ids repeat: rows are linked, not ids, so that a text isn't dropped for another one of its id.

    A group is kept by the smallest id that has no row in other groups, if there is one, and else by the smallest.
    Of the rows that an id then keeps in several groups, the one with the smallest text digest stays.
    """
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    texts = rows.where("doc_id is not null").select(F.col("__row").alias("doc_id"), "text")
    found = materialize(neardup.near_duplicates(texts, params), "near-dedup").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("group"))
    named = materialize(rows.where("doc_id is not null").select("__row", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).join(found, "__row"), "groups")
    several = named.groupBy("doc_id").agg((F.min("group") != F.max("group")).alias("several"))
    first = named.join(several, "doc_id").groupBy("group").agg(F.min(F.struct("several", "doc_id", "digest", "__row")).alias("x")).select("x.*")
    stay = first.groupBy("doc_id").agg(F.min(F.struct("digest", "__row")).alias("x")).select("x.__row")
    kept = rows.where("doc_id is not null").join(stay, "__row", "left_semi")
    return kept.unionByName(rows.where("doc_id is null")).select(*[F.col(f"`{c}`") for c in docs.columns])


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with the secrets in its text masked. Null and empty texts stay as they are, repeated rows are
    masked alike, and an empty table stays empty."""
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probabilities. Null sources and languages count as others, null texts have no
    tokens; rows that repeat an id share one draw, null ids too; an empty table stays empty."""
    return mixing.sample(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every document, repeated rows included. A null text has
    no tokens; an empty table gives an empty result."""
    return bpe.encode(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: The CRF, the exact search for links of the near-dedup and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
