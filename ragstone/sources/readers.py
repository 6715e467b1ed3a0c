"""Readers of corpora, queries, judgments and prepared chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone import schemas

#: fixed values: the judgment file of each dataset
QRELS_FILES = {
    "convfinqa": "ConvFinQA_qrels.tsv",
    "financebench": "FinanceBench_qrels.tsv",
    "finder": "FinDER_qrels.tsv",
    "finqa": "FinQA_qrels.tsv",
    "finqabench": "FinQABench_qrels.tsv",
    "multiheirtt": "MultiHeirtt_qrels.tsv",
    "tatqa": "TATQA_qrels.tsv",
}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def check_file(spark: SparkSession, path: str, extension: str) -> str:
    if not exists(spark, path):
        raise ValueError(f"{path} doesn't exist")
    if not path.endswith("." + extension):
        raise ValueError(f"{path} isn't a .{extension} file")
    return path


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """id, title, text of a JSON-lines corpus."""
    return spark.read.schema(schemas.CORPUS_FILE).json(path).select(F.col("_id").alias("id"), "title", "text")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """id, text of JSON-lines queries."""
    return spark.read.schema(schemas.QUERIES_FILE).json(path).select(F.col("_id").alias("id"), "text")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, corpus_id, score of tab-separated judgments with a header, whose names
    may have - for _.  A pair that comes twice keeps its higher judgment."""
    raw = spark.read.csv(path, sep="\t", header=True)
    named = raw.toDF(*(c.strip().replace("-", "_") for c in raw.columns))
    return named.groupBy(F.col("query_id").cast("string").alias("query_id"), F.col("corpus_id").cast("string").alias("corpus_id")).agg(F.max(F.col("score").cast("int")).alias("score"))


def read_qrels_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    return read_qrels(spark, path) if exists(spark, path) else None


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, doc_id, chunk_index, total_chunks, text of prepared chunks, flat or
    with their numbers in a metadata struct."""
    raw = spark.read.schema(schemas.CHUNKS_FILE).json(path)
    return raw.select(F.col("_id").alias("chunk_id"), F.coalesce("original_id", "metadata.original_id").alias("doc_id"), F.coalesce("chunk_index", "metadata.chunk_index").alias("chunk_index"), F.coalesce("total_chunks", "metadata.total_chunks").alias("total_chunks"), "text")


def read_prepared(spark: SparkSession, chunks: str, config: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(chunks, config), each None if its file is missing."""
    return (read_chunks(spark, chunks) if exists(spark, chunks) else None, spark.read.option("multiLine", True).json(config) if exists(spark, config) else None)


def readiness(spark: SparkSession, wanted: dict[str, dict], folder: str) -> DataFrame:
    """dataset, method, ndcg, ready: whether each dataset's prepared chunks are there."""
    rows = [(name, w.get("method"), float(w["ndcg"]) if w.get("ndcg") is not None else None, exists(spark, f"{folder}/{name}_chunked.jsonl")) for name, w in sorted(wanted.items())]
    return spark.createDataFrame(rows, "dataset string, method string, ndcg double, ready boolean")


class Loader:
    """Corpus and queries of a dataset, from files or from Parquet tables of a folder.

    folder/subset holds corpus.jsonl and queries.jsonl unless names are given; a
    prefix goes before the subset's name.  DataFrames are lazy and made once."""

    def __init__(self, spark: SparkSession, folder: str | None = None, subset: str | None = None, prefix: str | None = None, corpus_file: str = "corpus.jsonl", query_file: str = "queries.jsonl", tables: tuple[DataFrame, DataFrame] | None = None):
        if folder is None and tables is None:
            raise ValueError("a folder or tables must be given")
        self.spark, self.tables = spark, tables
        self.base = folder and "/".join(x for x in (folder.rstrip("/"), f"{prefix}_{subset}" if prefix and subset else subset) if x)
        self.corpus_file, self.query_file = corpus_file, query_file
        self._corpus: DataFrame | None = None
        self._queries: DataFrame | None = None

    def load_corpus(self) -> DataFrame:
        if self._corpus is None:
            self._corpus = self.tables[0] if self.tables else read_corpus(self.spark, check_file(self.spark, f"{self.base}/{self.corpus_file}", "jsonl"))
        return self._corpus

    def load_queries(self) -> DataFrame:
        if self._queries is None:
            self._queries = self.tables[1] if self.tables else read_queries(self.spark, check_file(self.spark, f"{self.base}/{self.query_file}", "jsonl"))
        return self._queries

    def load(self) -> tuple[DataFrame, DataFrame]:
        return self.load_corpus(), self.load_queries()


def load_dataset(spark: SparkSession, name: str, folder: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(corpus, queries, judgments or None) of a dataset by the usual file names."""
    corpus = read_corpus(spark, check_file(spark, f"{folder}/{name}_corpus.jsonl/corpus.jsonl", "jsonl"))
    queries = read_queries(spark, check_file(spark, f"{folder}/{name}_queries.jsonl/queries.jsonl", "jsonl"))
    return corpus, queries, read_qrels_if_there(spark, f"{folder}/{QRELS_FILES.get(name, name + '_qrels.tsv')}")
