"""Queries over streams (an extension): projections, filters, UPDATE, UNNEST and joins with a static table.

Aggregates work in complete output mode. Record numbers, ORDER BY outside aggregates, DISTINCT, limits and running
counts need the whole input in order, so they are refused.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..api import Engine
from ..errors import QueryParsingError
from ..lang.clauses import clean, parse_stage, split_stages
from ..plans.table import from_dataframe
from ..sources.delimited import fields
from ..sources.dialect import Dialect


def read_stream(spark: SparkSession, path: str, d: Dialect, columns: list[str]) -> DataFrame:
    """A stream of records from new files in a folder; the columns give names and width."""
    from pyspark.sql import functions as F

    lines = spark.readStream.text(path)
    cells = fields(F.col("value"), d)
    return lines.select(*[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def query_stream(spark: SparkSession, text: str, stream: DataFrame, joins: dict | None = None, **options) -> DataFrame:
    if not stream.isStreaming:
        raise QueryParsingError("The input isn't a stream")
    for stage in split_stages(clean(text)):
        spec = parse_stage(stage)
        if re.search(r"\b(?:NR|aNR|NU)\b", stage):
            raise QueryParsingError("Record numbers aren't available on a stream")
        if spec.order_by or spec.limit is not None or spec.distinct or spec.distinct_count:
            raise QueryParsingError("ORDER BY, TOP, LIMIT and DISTINCT aren't available on a stream")
    return Engine(spark, **({"ordered": False} | options)).query(text, from_dataframe(stream), joins).df
