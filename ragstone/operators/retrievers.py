"""Retrievers that put chunking, encoding, scoring and aggregation together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragstone.functions.text import query_classes, route
from ragstone.operators.dense import dense_documents, dense_topk
from ragstone.operators.encode import Encoder, HashingEncoder, encode
from ragstone.operators.ranking import top_k
from ragstone.operators.splitters import STRATEGIES, chunk_configs, chunk_corpus, parent_child
from ragstone.session import written


def _search(queries: DataFrame, chunks: DataFrame, encoder: Encoder, k: int | None) -> DataFrame:
    """query_id, chunk_id, score, rank of encoded texts."""
    q = encode(queries, encoder)
    c = encode(chunks.select(F.col("chunk_id").alias("id"), "text"), encoder)
    return dense_topk(q, c, k).withColumnRenamed("corpus_id", "chunk_id")


class ChunkedRetriever:
    """Chunks by a named strategy (balanced, if there's no such), all chunk scores to
    documents."""

    def __init__(self, corpus: DataFrame, encoder: Encoder | None = None, strategy: str = "balanced", aggregation: str = "max"):
        self.corpus, self.encoder, self.aggregation = corpus, encoder or HashingEncoder(), aggregation
        self.strategy = strategy if strategy in STRATEGIES else "balanced"
        self.chunks = chunk_corpus(corpus.select("id", "text"), **STRATEGIES[self.strategy])

    def retrieve(self, queries: DataFrame, k: int = 10, return_chunks: bool = False) -> DataFrame:
        """query_id, corpus_id, score, rank, num_chunks_matched, best_chunk_index, best_chunk, text."""
        if return_chunks:
            return _search(queries, self.chunks, self.encoder, k).join(self.chunks, "chunk_id")
        vectors = encode(self.chunks.select(F.struct("chunk_id", "doc_id", "chunk_index").alias("id"), "text"), self.encoder)
        docs = dense_documents(encode(queries, self.encoder), vectors.select("id.*", "embedding"), self.aggregation, k, best=True)
        # texts meet the k documents of each query
        out = docs.join(self.chunks.select("chunk_id", F.col("text").alias("best_chunk")), "chunk_id").join(self.corpus.select(F.col("id").alias("corpus_id"), "text"), "corpus_id")
        return out.select("query_id", "corpus_id", "score", "rank", "num_chunks_matched", "best_chunk_index", "best_chunk", "text")

    def info(self) -> DataFrame:
        """One row: documents, chunks, expansion, the vectors' dimension, strategy."""
        width = len(self.encoder.encode(["text"])[0])
        n = self.corpus.agg(F.count("*").alias("num_documents")).join(F.broadcast(self.chunks.agg(F.count("*").alias("num_chunks"))))
        return n.select("num_documents", "num_chunks", (F.col("num_chunks") / F.col("num_documents")).alias("expansion"), F.lit(width).alias("dimension"), F.lit(self.strategy).alias("strategy"))


class ParentChildRetriever:
    """Searches children, returns their parents."""

    def __init__(self, corpus: DataFrame, encoder: Encoder | None = None, **sizes):
        self.encoder = encoder or HashingEncoder()
        self.parents, self.children, self.relationships = parent_child(corpus.select("id", "text"), **sizes)

    def retrieve(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id, parent_id, score, rank, doc_id, text: the best child of 3k stands for its parent."""
        found = _search(queries, self.children.withColumnRenamed("child_id", "chunk_id"), self.encoder, 3 * k)
        return parents_of(found.withColumnRenamed("chunk_id", "child_id"), self.relationships, k).join(self.parents, "parent_id")


def parents_of(children_run: DataFrame, relationships: DataFrame, k: int) -> DataFrame:
    best = children_run.join(relationships, "child_id").groupBy("query_id", "parent_id").agg(F.max("score").alias("score"))
    return top_k(best, k, key="parent_id")


class AdaptiveRetriever:
    """Four chunk sets; a question's classes choose the one that is searched.

    The sets are one table with the set's name: one scan cuts the corpus for those names that
    the questions ask for, one search ranks each question within its own set."""

    #: fixed values: size and overlap of the chunk sets
    SETS = {"small": ("recursive", 300, 50), "medium": ("recursive", 800, 150), "large": ("recursive", 1500, 300), "table-aware": ("table_aware", 1000, 200)}

    def __init__(self, corpus: DataFrame, encoder: Encoder | None = None):
        self.encoder, self.docs = encoder or HashingEncoder(), corpus.select("id", "text")

    def chunks(self, names: list[str]) -> DataFrame:
        """The chunk sets of these names, with a column strategy."""
        cells = [dict(zip(("method", "size", "overlap"), self.SETS[n], strict=True)) for n in names]
        cut = chunk_configs(self.docs, cells)
        return cut.withColumn("strategy", F.element_at(F.lit(names), F.col("no") + 1)).drop("no")

    def retrieve(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id, chunk_id, score, rank, strategy, text: chunks, not documents."""
        routed = queries.withColumn("strategy", route(query_classes(F.col("text"))))
        names = sorted(r[0] for r in routed.select("strategy").distinct().collect())  # four at most
        if not names:
            return self.docs.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['id']}, chunk_id string, score double, rank int, text string, strategy string")
        chunks = written(self.chunks(names), "chunk-sets")
        asked = encode(routed.select(F.struct("id", "strategy").alias("id"), "text"), self.encoder).select("id.*", "embedding")
        vectors = encode(chunks.select(F.struct("chunk_id", "strategy").alias("id"), "text"), self.encoder).select(F.col("id.chunk_id").alias("id"), "id.strategy", "embedding")
        found = dense_topk(asked, vectors, k, by="strategy").withColumnRenamed("corpus_id", "chunk_id")
        return found.join(chunks.select("strategy", "chunk_id", "text"), ["strategy", "chunk_id"]).select("query_id", "chunk_id", "score", "rank", "text", "strategy")
