"""End-to-end flows over several datasets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragstone.functions.text import title_sentence
from ragstone.operators.aggregate import to_documents
from ragstone.operators.dense import dense_documents, dense_topk
from ragstone.operators.encode import Encoder, HashingEncoder, encode
from ragstone.operators.hybrid import hybrid_search
from ragstone.operators.metrics import ndcg_hit, summary
from ragstone.operators.ranking import top_k
from ragstone.operators.rerank import rerank
from ragstone.operators.sampling import head
from ragstone.operators.splitters import STRATEGIES, chunk_corpus
from ragstone.operators.tuning import each_dataset
from ragstone.operators.windows import region_char_chunks, region_word_chunks
from ragstone.session import written
from ragstone.sources import readers, sinks


@dataclass
class Settings:
    """fixed values: k chunks, documents to rerank, documents to return, dense weight."""

    retrieve: int = 100
    rerank: int = 50
    final: int = 10
    alpha: float = 0.6
    chars: int = 2048
    aggregation: str = "max"


def dense_rerank(corpus: DataFrame, queries: DataFrame, settings: Settings | None = None, encoder: Encoder | None = None, model=None) -> DataFrame:
    """Whole documents: dense, then reranked."""
    s, e = settings or Settings(), encoder or HashingEncoder()
    docs = corpus.select("id", title_sentence(F.col("title"), F.col("text")).alias("text"))
    run = dense_topk(encode(queries, e), encode(docs, e), s.retrieve)
    return top_k(rerank(run, queries, corpus, model, s.rerank, s.chars), s.final)


def chunked_hybrid(corpus: DataFrame, queries: DataFrame, *, chunks: DataFrame | None = None, words: bool = False, size: int = 512, overlap: int = 50, settings: Settings | None = None, encoder: Encoder | None = None, model=None) -> DataFrame:
    """Chunks (given, or cut around tables by characters or words): hybrid search,
    chunk scores to documents, reranked."""
    s, e = settings or Settings(), encoder or HashingEncoder()
    if chunks is None:
        # cut once: for the vectors, for BM25's statistics and postings, and for the documents' names
        chunks = written(region_word_chunks(corpus, size, overlap) if words else region_char_chunks(corpus, size, overlap), "chunks")
    texts = chunks.select(F.col("chunk_id").alias("id"), "text")
    dense = dense_topk(encode(queries, e), encode(texts, e), 2 * s.retrieve)
    found = hybrid_search(queries, texts, dense, s.retrieve, s.alpha).withColumnRenamed("corpus_id", "chunk_id").join(chunks.select("chunk_id", "doc_id", "chunk_index"), "chunk_id")
    docs = to_documents(found, s.aggregation, s.rerank)
    return top_k(rerank(docs, queries, corpus, model, s.rerank, s.chars), s.final)


def chunks_against_whole(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, strategy: str = "balanced", k: int = 10, encoder: Encoder | None = None) -> DataFrame:
    """One row: ndcg and recall (hit variant) of whole documents and of chunks, and what
    chunks gain in per cent (null over a base of 0)."""
    e = encoder or HashingEncoder()
    q = encode(queries, e)
    base = dense_topk(q, encode(corpus.select("id", "text"), e), k)
    chunks = chunk_corpus(corpus.select("id", "text"), **STRATEGIES[strategy])
    found = dense_topk(q, encode(chunks.select(F.col("chunk_id").alias("id"), "text"), e), 5 * k).withColumnRenamed("corpus_id", "chunk_id").join(chunks.select("chunk_id", "doc_id", "chunk_index"), "chunk_id")
    one = ndcg_hit(base, qrels, k).agg(F.avg("ndcg").alias("base_ndcg"), F.avg("recall").alias("base_recall"))
    two = ndcg_hit(to_documents(found, "max", k), qrels, k).agg(F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall"))
    gain = lambda a, b: F.try_divide(F.col(a) - F.col(b), F.col(b)) * 100
    return one.join(F.broadcast(two)).select("*", gain("ndcg", "base_ndcg").alias("ndcg_gain"), gain("recall", "base_recall").alias("recall_gain"))


def production(datasets: dict[str, tuple], best: DataFrame, folder: str, *, k: int = 10, judged_queries: int = 50, least: int = 500, settings: Settings | None = None, encoder: Encoder | None = None, model=None) -> tuple[dict[str, DataFrame], dict[str, str], DataFrame | None]:
    """From a table of best configurations (dataset, method, size, overlap; tuning.best_strategy) to results.

    Every dataset (corpus, queries, judgments or None) that the table names is cut by its own configuration;
    its chunks are kept under folder and read from there, searched and reranked to documents, and the k
    best of each query are kept too.  With judgments, whole documents and chunks are compared
    over the first judged_queries queries (and the first least documents where there are no chunks).
    Returns (runs, errors of datasets that failed, a report row for each dataset); the mapping of datasets to configurations,
    the report and what failed are files beside the chunks."""
    spark, s, e = best.sparkSession, settings or Settings(), encoder or HashingEncoder()
    chosen = {r["dataset"]: r for r in best.select("dataset", "method", "size", "overlap").collect()}  # a row a dataset
    rows: list[tuple] = []

    def one(name: str) -> DataFrame:
        corpus, queries, qrels = datasets[name]
        how = chosen[name]
        cut = chunk_corpus(corpus.select("id", "text"), how["method"], how["size"], how["overlap"])
        path = sinks.save_chunks(cut.withColumn("doc_id", F.col("doc_id").cast("string")), f"{folder}/{name}_chunked.jsonl")
        chunks = readers.read_chunks(spark, path)
        docs = corpus.withColumn("id", F.col("id").cast("string"))
        asked = queries.withColumn("id", F.col("id").cast("string"))
        run = written(chunked_hybrid(docs, asked, chunks=chunks, settings=s, encoder=e, model=model), "production")
        sinks.save_results(None, run, folder, name, k)
        n_docs, n_chunks = docs.count(), chunks.count()
        gain: tuple = (None,) * 3
        if qrels is not None:
            own = qrels.select(F.col("query_id").cast("string").alias("query_id"), F.col("corpus_id").cast("string").alias("corpus_id"), "score")
            few = encode(head(asked, judged_queries), e)
            whole = dense_topk(few, encode(head(docs, least).select("id", "text"), e), k)
            found = dense_documents(few, encode(chunks.select(F.struct("chunk_id", "doc_id", "chunk_index").alias("id"), "text"), e).select("id.*", "embedding"), "max", k)
            base, now = (ndcg_hit(r, own, k).agg(F.coalesce(F.avg("ndcg"), F.lit(0.0))).first()[0] for r in (whole, found))
            gain = base, now, (now - base) / base * 100 if base else None
        rows.append((name, how["method"], how["size"], how["overlap"], n_docs, n_chunks, n_chunks / n_docs if n_docs else None, *gain))
        return run

    runs, failed = each_dataset([n for n in datasets if n in chosen], one)
    failed |= {n: "no configuration" for n in datasets if n not in chosen}
    table = spark.createDataFrame(rows, REPORT) if rows else None
    if table is not None:
        sinks.save_json(table.select("dataset", "method", "size", "overlap", "expansion", "ndcg"), f"{folder}/mapping.json")
        sinks.save_table(table, f"{folder}/report.csv")
    if failed:
        sinks.save_json(spark.createDataFrame(sorted(failed.items()), "dataset string, error string"), f"{folder}/failed.json")
    return runs, failed, table


#: of production(): ndcg of whole documents and of chunks, and the gain in per cent
REPORT = "dataset string, method string, size int, overlap int, num_docs long, num_chunks long, expansion double, base_ndcg double, ndcg double, gain double"


def over_datasets(datasets: dict[str, tuple], flow=chunked_hybrid, **options) -> tuple[dict[str, DataFrame], dict[str, str], DataFrame | None]:
    """(runs, errors, a summary row for each judged dataset) of datasets given as
    (corpus, queries, judgments or None)."""
    runs, failed = each_dataset([*datasets], lambda n: flow(*datasets[n][:2], **options))
    out = None
    for name, run in runs.items():
        if datasets[name][2] is not None:
            row = summary(run, datasets[name][2]).withColumn("dataset", F.lit(name))
            out = row if out is None else out.unionByName(row)
    return runs, failed, out
