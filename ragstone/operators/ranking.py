"""The one total order of scores: rounded to nine places, then by id, both falling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 9


def order(score: str = "score", key: str = "corpus_id") -> list[Column]:
    return [F.round(F.col(score), PLACES).desc(), F.col(key).desc()]


def ranked(run: DataFrame, score: str = "score", key: str = "corpus_id", by: str | list[str] = "query_id") -> DataFrame:
    """run with rank, from 1."""
    by = [by] if isinstance(by, str) else by
    return run.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order(score, key))))


def top_k(run: DataFrame, k: int | None, score: str = "score", key: str = "corpus_id", by: str | list[str] = "query_id") -> DataFrame:
    """The first k rows of each query with their rank.  The filter stands beside the
    window, so every task drops all but k rows of a query before the exchange."""
    out = ranked(run, score, key, by)
    return out if k is None else out.where(F.col("rank") <= k)
