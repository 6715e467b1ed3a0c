"""Evaluating chunking strategies, and looking for the best one."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragstone.operators.encode import EmbeddingStore, Encoder, HashingEncoder, encode
from ragstone.operators.dense import dense_topk
from ragstone.operators.metrics import ndcg_list
from ragstone.operators.sampling import hash_sample, head, smart_sample
from ragstone.operators.splitters import check_method, chunk_configs, chunk_corpus
from ragstone.session import written


def evaluate_config(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, *, method: str, size: int | None = None, overlap: int = 0, k: int = 10, encoder: Encoder | None = None, n_queries: int = 50, most_docs: int = 3000, vectors: DataFrame | None = None, dataset: str = "") -> DataFrame:
    """One row: dataset, method, size, overlap, num_docs, num_chunks, expansion,
    num_queries, ndcg, std_ndcg of a sample under one way of chunking.  vectors (id,
    embedding of the sampled queries) saves encoding them again."""
    encoder = encoder or HashingEncoder()
    asked = hash_sample(queries.join(qrels.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi"), n_queries)
    docs = smart_sample(corpus, asked, qrels, most_docs)
    chunks = chunk_corpus(docs.select("id", "text"), method, size, overlap)
    found = dense_topk(vectors if vectors is not None else encode(asked, encoder), encode(chunks.select(F.col("chunk_id").alias("id"), "text"), encoder), k)
    run = found.withColumnRenamed("corpus_id", "chunk_id").join(chunks.select("chunk_id", F.col("doc_id").alias("corpus_id")), "chunk_id")
    ndcg = ndcg_list(run.select("query_id", "corpus_id", "score"), qrels, k, exponential=True, skip_empty=False)
    means = ndcg.agg(F.count("*").alias("num_queries"), F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg"), F.coalesce(F.stddev_pop("ndcg"), F.lit(0.0)).alias("std_ndcg"))
    sizes = docs.agg(F.count("*").alias("num_docs")).join(F.broadcast(chunks.agg(F.count("*").alias("num_chunks"))))
    return sizes.join(F.broadcast(means)).select(F.lit(dataset).alias("dataset"), F.lit(method).alias("method"), F.lit(size).cast("int").alias("size"), F.lit(overlap).alias("overlap"), "num_docs", "num_chunks", (F.col("num_chunks") / F.col("num_docs")).alias("expansion"), "num_queries", "ndcg", "std_ndcg")


def evaluate_many(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, cells: Sequence[dict], *, k: int = 10, encoder: Encoder | None = None, n_queries: int = 50, most_docs: int = 3000, vectors: DataFrame | None = None, dataset: str = "", store: tuple[EmbeddingStore, str] | None = None) -> DataFrame:
    """evaluate_config() for many cells (method, size, overlap) at once, with no, a cell's place.

    The sample is made once and cut under every cell in one scan; its chunks are encoded (by
    way of the store, (store, the encoder's name), if there's one) and searched in one pass that ranks each cell
    apart, and the metrics' groups are pairs of cell and query."""
    spark, encoder = corpus.sparkSession, encoder or HashingEncoder()
    made = (lambda rows: store[0].encode(rows, encoder, store[1])) if store else (lambda rows: encode(rows, encoder))
    cells = [{"size": None, "overlap": 0, **c} for c in cells]
    asked = written(hash_sample(queries.join(qrels.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi"), n_queries), "asked")
    docs = written(smart_sample(corpus, asked, qrels, most_docs), "sample")
    chunks = written(chunk_configs(docs.select("id", "text"), cells), "cells")
    each = made(chunks.select(F.struct("no", "chunk_id").alias("id"), "text")).select("id.no", F.col("id.chunk_id").alias("id"), "embedding")
    found = dense_topk(vectors if vectors is not None else made(asked.select("id", "text")), each, k, by="no").withColumnRenamed("corpus_id", "chunk_id")
    pair = F.struct("no", "query_id").alias("query_id")
    run = found.join(chunks.select("no", "chunk_id", F.col("doc_id").alias("corpus_id")), ["no", "chunk_id"]).select(pair, "corpus_id", "score")
    judged = qrels.withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(len(cells) - 1)))).select(pair, "corpus_id", "score")
    ndcg = ndcg_list(run, judged, k, exponential=True, skip_empty=False).withColumn("no", F.col("query_id.no"))
    means = ndcg.groupBy("no").agg(F.count("*").alias("num_queries"), F.avg("ndcg").alias("ndcg"), F.stddev_pop("ndcg").alias("std_ndcg"))
    counts = chunks.groupBy("no").agg(F.count("*").alias("num_chunks"))
    table = spark.createDataFrame([(i, c["method"], c["size"], c["overlap"]) for i, c in enumerate(cells)], "no int, method string, size int, overlap int")
    out = table.join(counts, "no", "left").join(means, "no", "left").fillna(0, ["num_chunks", "num_queries"]).fillna(0.0, ["ndcg", "std_ndcg"])
    return out.withColumn("num_docs", F.lit(docs.count())).select(F.lit(dataset).alias("dataset"), "method", "size", "overlap", "num_docs", "num_chunks", (F.col("num_chunks") / F.col("num_docs")).alias("expansion"), "num_queries", "ndcg", "std_ndcg", "no")


def evaluate_strategies(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, strategies: Sequence[dict], **options) -> DataFrame:
    """A row for each strategy, with no, its place in the list."""
    return evaluate_many(corpus, queries, qrels, strategies, **options)


def best_strategy(results: DataFrame) -> DataFrame:
    """The row of the highest mean; the first of equals."""
    return results.groupBy("dataset").agg(F.min_by(F.struct(*(F.col(c) for c in results.columns if c != "dataset")), F.struct(-F.col("ndcg"), "no")).alias("b")).select("dataset", "b.*")


def grid(methods: Sequence[str] = ("character", "recursive"), sizes: Sequence[int] = (500, 1000, 1500), ratios: Sequence[float] = (0.0, 0.1, 0.2)) -> list[dict]:
    return [{"method": m, "size": s, "overlap": int(s * r)} for m, s, r in product(methods, sizes, ratios)]


def grid_search(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, cells: Sequence[dict], docs: int = 500, **options) -> tuple[DataFrame | None, list[tuple[dict, str]]]:
    """(a row for each cell, cells that failed with their errors) over the first docs."""
    good, failed = [], []
    for cell in cells:
        try:
            check_method(cell["method"])
            good.append(cell)
        except ValueError as e:
            failed.append((cell, str(e)))
    return evaluate_many(head(corpus, docs), queries, qrels, good, **options) if good else None, failed


def size_sweep(docs: DataFrame, sizes: Sequence[int] = (500, 750, 1000, 1250, 1500, 1750, 2000), ratio: float = 0.2) -> DataFrame:
    """size, chunks, mean_chars of recursive chunks of several sizes, in one scan."""
    cells = [{"method": "recursive", "size": s, "overlap": int(s * ratio)} for s in sizes]
    each = chunk_configs(docs, cells).groupBy("no").agg(F.count("*").alias("chunks"), F.avg(F.length("text")).alias("mean_chars"))
    return each.select("chunks", "mean_chars", F.element_at(F.lit(list(sizes)), F.col("no") + 1).alias("size"))


def apply_best(corpora: dict[str, DataFrame], best: dict[str, dict]) -> dict[str, DataFrame]:
    """Every corpus chunked by its best configuration."""
    return {name: chunk_corpus(docs.select("id", "text"), **best[name]) for name, docs in corpora.items() if name in best}


def each_dataset(names: Sequence[str], work: Callable[[str], DataFrame]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(results, errors): one dataset's failure doesn't end the others."""
    done, failed = {}, {}
    for name in names:
        try:
            done[name] = work(name)
        except Exception as e:  # noqa: BLE001
            failed[name] = f"{type(e).__name__}: {e}"
    return done, failed
