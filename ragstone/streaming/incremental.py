"""Rankings that grow with a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ragstone.operators.dense import dense_topk
from ragstone.operators.ranking import top_k


def follow_topk(vectors: DataFrame, queries: DataFrame, path: str, checkpoint: str, k: int = 10, score: str = "cos_sim") -> StreamingQuery:
    """Keeps the k best (query_id, corpus_id, score) for queries under path while
    vectors (id, embedding) stream in.  A batch is written as a version of its own, so
    a batch that comes again writes the same version from the one before; older versions
    are deleted."""
    spark = queries.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        run = dense_topk(queries, batch, k, score).select("query_id", "corpus_id", "score")
        if number:
            run = top_k(run.unionByName(spark.read.parquet(f"{path}/v={number - 1}")).dropDuplicates(["query_id", "corpus_id"]), k).drop("rank")
        run.write.mode("overwrite").parquet(f"{path}/v={number}")
        if number > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return vectors.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(queries: DataFrame, path: str, last: int) -> DataFrame:
    return queries.sparkSession.read.parquet(f"{path}/v={last}")
