"""Joins: null keys match null keys; strict and first-match joins count the right side by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def condition(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda x, y: x & y, [a.eqNullSafe(b) for a, b in pairs])


def equi_join(a: DataFrame, b: DataFrame, pairs: list[tuple[Column, Column]], how: str) -> DataFrame:
    return a.join(b, condition(pairs), how)


def with_matches(b: DataFrame, keys: list[str], count: str) -> DataFrame:
    """The right side with the number of its rows that have the row's key."""
    return equi_join(b, b.groupBy(*[F.col(k).alias(f"m_{k}") for k in keys]).agg(F.count(F.lit(1)).alias(count)), [(F.col(k), F.col(f"m_{k}")) for k in keys], "inner").drop(*[f"m_{k}" for k in keys])


def require(df: DataFrame, test: Column, message: Column) -> DataFrame:
    """A filter that never drops a row but fails the query where the test is false; it can't be pruned away."""
    return df.where(F.when(test, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def strict_left_join(a: DataFrame, b: DataFrame, pairs: list[tuple[Column, Column]], keys: list[str]) -> DataFrame:
    joined = equi_join(a, with_matches(b, keys, "__matches"), pairs, "left")
    shown = F.concat_ws(", ", *[x.cast("string") for x, _ in pairs])
    message = F.concat(F.lit("STRICT LEFT JOIN needs exactly one match for the key '"), shown, F.lit("', found "), F.coalesce("__matches", F.lit(0)).cast("string"))
    return require(joined, F.coalesce("__matches", F.lit(0)) == 1, message).drop("__matches")
