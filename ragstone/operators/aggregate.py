"""Chunk scores to document scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragstone.operators.ranking import order, top_k

METHODS = ("max", "mean", "sum", "first", "weighted_rank", "weighted_position")


def to_documents(scores: DataFrame, method: str = "max", k: int | None = None) -> DataFrame:
    """query_id, corpus_id (the document), score, rank from chunk scores (query_id,
    chunk_id, doc_id, chunk_index, score).  The weighted ones weigh a document's i-th
    chunk by 1 / i: by score, or by its place in the document."""
    if method not in METHODS:
        raise ValueError(f"unknown aggregation {method!r}; there are {METHODS}")
    by = ["query_id", "doc_id"]
    if method == "first":
        out = scores.groupBy(*by).agg(F.min_by("score", "chunk_index").alias("score"))
    elif method.startswith("weighted"):
        place = order(key="chunk_id") if method == "weighted_rank" else [F.col("chunk_index")]
        weighed = scores.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(*place)))
        out = weighed.groupBy(*by).agg((F.sum(F.col("score") / F.col("i")) / F.sum(1 / F.col("i"))).alias("score"))
    else:
        out = scores.groupBy(*by).agg({"max": F.max, "mean": F.avg, "sum": F.sum}[method]("score").alias("score"))
    return top_k(out.withColumnRenamed("doc_id", "corpus_id"), k)
