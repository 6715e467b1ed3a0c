"""Writers of results.  Files appear under a folder of the given name, as Spark
writes them; one=True asks for a single part, written by one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragstone.operators.ranking import top_k


def submission_long(run: DataFrame, k: int = 10) -> DataFrame:
    """query_id, corpus_id, rank of the k best."""
    return top_k(run.select("query_id", "corpus_id", "score"), k).select("query_id", "corpus_id", "rank")


def submission_wide(run: DataFrame, k: int = 10) -> DataFrame:
    """query_id, corpus_ids: the k best, joined by spaces in order."""
    best = submission_long(run, k)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("corpus_id").cast("string").alias("id")))), lambda x: x["id"])
    return best.groupBy("query_id").agg(F.array_join(ids, " ").alias("corpus_ids"))


def first_id(wide: DataFrame) -> DataFrame:
    """A wide submission with only the first id of each row; blank stays blank."""
    return wide.withColumn("corpus_ids", F.regexp_extract(F.trim("corpus_ids"), r"^(\S+)", 1))


def _csv(df: DataFrame, path: str, one: bool) -> str:
    (df.coalesce(1) if one else df).write.mode("overwrite").csv(path, header=True)
    return path


def save_results(rerank_run: DataFrame | None, retrieve_run: DataFrame | None, output_dir: str | None, task: str, k: int = 10, one: bool = False) -> str | None:
    """The k best of the reranked run, or of the retrieved one, under output_dir/task."""
    run = rerank_run if rerank_run is not None else retrieve_run
    if output_dir is None or run is None:
        return None
    rows = submission_long(run, k).orderBy("query_id", "rank").select("query_id", "corpus_id")
    return _csv(rows, f"{output_dir}/{task}/results.csv", one)


def save_answers(answers: DataFrame | None, output_dir: str | None, task: str, one: bool = False) -> str | None:
    if output_dir is None or answers is None:
        return None
    path = f"{output_dir}/{task}/answers.jsonl"
    rows = answers.select("query_id", "answer")
    (rows.coalesce(1) if one else rows).write.mode("overwrite").json(path)
    return path


def save_submission(runs: list[DataFrame], path: str, k: int = 10, wide: bool = False, one: bool = False) -> str:
    """All datasets' runs together."""
    rows = [submission_wide(r, k) if wide else submission_long(r, k).select("query_id", "corpus_id") for r in runs]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return _csv(out, path, one)


def save_chunks(chunks: DataFrame, path: str, dataset: str | None = None, nested: bool = False) -> str:
    """Chunks as JSON lines, their numbers flat or in a metadata struct."""
    numbers = [F.col("doc_id").alias("original_id"), F.col("chunk_index"), F.col("total_chunks")]
    out = chunks.select(F.col("chunk_id").alias("_id"), "text", F.struct(*numbers).alias("metadata")) if nested else chunks.select(F.col("chunk_id").alias("_id"), *numbers, "text")
    if dataset:
        out.withColumn("dataset", F.lit(dataset)).write.mode("overwrite").partitionBy("dataset").json(path)
    else:
        out.write.mode("overwrite").json(path)
    return path


def save_table(df: DataFrame, path: str, one: bool = False) -> str:
    return _csv(df, path, one)


def save_json(df: DataFrame, path: str, one: bool = False) -> str:
    (df.coalesce(1) if one else df).write.mode("overwrite").json(path)
    return path


def report(title: str, df: DataFrame, rows: int = 100) -> str:
    """A small result table as text."""
    cols = df.columns
    lines = [title, "=" * len(title), " | ".join(cols)]
    for r in df.limit(rows).collect():
        lines.append(" | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r))
    return "\n".join(lines) + "\n"
