"""Hybrid search: dense candidates, their BM25 scores, one weighted sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragstone.functions.vectors import min_max
from ragstone.operators.lexical import bm25
from ragstone.operators.ranking import top_k
from ragstone.session import written

ALPHA = 0.6


def fused(candidates: DataFrame, lexical: DataFrame, k: int | None, alpha: float = ALPHA) -> DataFrame:
    """Both runs scaled to 0..1 over each query's candidates, then alpha * dense +
    (1 - alpha) * lexical; a candidate without lexical score has 0 of it."""
    both = candidates.select("query_id", "corpus_id", F.col("score").alias("dense")).join(lexical.select("query_id", "corpus_id", F.col("score").alias("lexical")), ["query_id", "corpus_id"], "left")
    both = both.withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    scaled = both.select("query_id", "corpus_id", (alpha * min_max(F.col("dense"), "query_id") + (1 - alpha) * min_max(F.col("lexical"), "query_id")).alias("score"))
    return top_k(scaled, k)


def hybrid_search(queries: DataFrame, docs: DataFrame, dense_run: DataFrame, k: int = 100, alpha: float = ALPHA) -> DataFrame:
    """The k best of each query from the 2k best of dense_run, which is ranked alike."""
    candidates = written(top_k(dense_run.select("query_id", "corpus_id", "score"), 2 * k), "candidates")  # the search is run once
    return fused(candidates, bm25(queries, docs, candidates=candidates), k, alpha)
