"""Reranking: the protocol, an offline scorer, and the operator."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragstone.functions.text import title_text, truncated, words
from ragstone.operators.ranking import top_k


class CrossEncoder(Protocol):
    def predict(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has: deterministic, no model."""
    q, t = F.array_distinct(words(query)), F.array_distinct(words(text))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)


def rerank(run: DataFrame, queries: DataFrame, corpus: DataFrame, model: CrossEncoder | None = None, k: int = 100, chars: int | None = None) -> DataFrame:
    """query_id, corpus_id, score, rank: the k best candidates of each query with the
    model's score in place of their own.  Candidates are cut before texts are joined."""
    few = top_k(run.select("query_id", "corpus_id", "score"), k).select("query_id", "corpus_id")
    text = title_text(F.col("title"), F.col("text"))
    docs = corpus.select(F.col("id").alias("corpus_id"), (truncated(text, chars) if chars else text).alias("d"))
    pairs = few.join(queries.select(F.col("id").alias("query_id"), F.col("text").alias("q")), "query_id").join(docs, "corpus_id")
    if model is None:
        score = overlap_score(F.col("q"), F.col("d"))
    else:
        @F.pandas_udf("double")
        def predict(q: pd.Series, d: pd.Series) -> pd.Series:
            return pd.Series(model.predict([*zip(q, d, strict=True)]), dtype=float)

        score = predict("q", "d")
    return top_k(pairs.select("query_id", "corpus_id", score.alias("score")), None)
