"""Chunk scores reduced to documents in the task, against the same over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragstone.operators import aggregate, dense
from ragstone.operators.retrievers import ChunkedRetriever


def tables(spark, seed=1):
    r = random.Random(seed)

    def vector():
        return None if r.random() < 0.03 else [0.0] * 4 if r.random() < 0.03 else [float(r.randint(-2, 2)) for _ in range(4 if r.random() < 0.97 else 3)]

    sizes = [r.choice([1, 1, 2, 3, 9]) for _ in range(40)] + [70]
    chunks = [(f"c{d}_{i}", d, i, vector()) for d, n in enumerate(sizes) for i in range(n)]
    # some queries are chunks themselves, one is its document's only chunk
    single = sizes.index(1)
    asked = [*r.sample([(c, v) for c, _, _, v in chunks], 15), (f"c{single}_0", [1.0, 0.0, 0.0, 1.0]), *((f"q{i}", vector()) for i in range(20))]
    asked = list(dict(asked).items())
    return (spark.createDataFrame(asked, "id string, embedding array<double>"), spark.createDataFrame(chunks, "chunk_id string, doc_id long, chunk_index long, embedding array<double>").repartition(3))


@pytest.mark.parametrize("method", aggregate.METHODS)
@pytest.mark.parametrize(("block", "rows", "product", "k"), [(4096, 8192, 32 << 20, 5), (7, 30, 900, 3), (11, 10, 32 << 20, None)])
def test_documents_as_over_all_pairs(spark, monkeypatch, method, block, rows, product, k):
    monkeypatch.setattr(dense, "ROW_BLOCK", rows)
    monkeypatch.setattr(dense, "PRODUCT_BYTES", product)
    queries, chunks = tables(spark)
    pairs = dense.dense_topk(queries, chunks.select(F.col("chunk_id").alias("id"), "embedding"), None, block=block)
    pairs = pairs.select("query_id", F.col("corpus_id").alias("chunk_id"), "score").join(chunks.drop("embedding"), "chunk_id")
    want = aggregate.to_documents(pairs, method, k).join(pairs.groupBy("query_id", F.col("doc_id").alias("corpus_id")).agg(F.count("*").alias("n"), F.max_by("chunk_id", F.struct(F.round("score", 9), "chunk_id")).alias("c")), ["query_id", "corpus_id"])
    got = dense.dense_documents(queries, chunks, method, k, best=True, block=block)
    names = ["query_id", "rank", "corpus_id", F.round("score", 7)]
    assert sorted(map(tuple, got.select(*names, "num_chunks_matched", "chunk_id").collect())) == sorted(map(tuple, want.select(*names, "n", "c").collect()))
    assert sorted(map(tuple, dense.dense_documents(queries, chunks, method, k, block=block).select(*names).collect())) == sorted(map(tuple, want.select(*names).collect()))
    assert all(x["chunk_id"].endswith(f"_{x['best_chunk_index']}") for x in got.collect())


def test_few_rows_leave_a_task(spark):
    queries, chunks = tables(spark)
    plan = dense.dense_documents(queries, chunks, "max", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Aggregate" not in plan and plan.count("MapInArrow") == 1
    rows = []
    own = dense.Queries(pa.array(["a", "b"]), pa.array([[1.0, 0.0], [0.0, 1.0]]), "dot")
    state = dense._Documents(own, 2, "max", False)
    n = 5000
    r = np.random.default_rng(1)
    part = pa.RecordBatch.from_pydict({"doc_id": np.repeat(np.arange(n // 5), 5), "chunk_index": np.tile(np.arange(5), n // 5), "chunk_id": [str(i) for i in range(n)], "embedding": r.random((n, 2)).tolist()})
    rows += state.add(part)
    rows += state.rows()
    assert sum(x.num_rows for x in rows) == 4  # k for each query


def test_empty_and_unknown(spark):
    queries, chunks = tables(spark)
    assert dense.dense_documents(queries.limit(0), chunks).count() == 0 and dense.dense_documents(queries, chunks.limit(0)).count() == 0
    with pytest.raises(ValueError):
        dense.dense_documents(queries, chunks, "median")
    with pytest.raises(ValueError):
        dense.dense_documents(queries, chunks, score="nothing")


@pytest.mark.parametrize("how", ["max", "weighted_rank"])
def test_chunked_retriever_against_brute_force(spark, how):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(r.choices(words, k=r.choice([3, 60, 700])))) for i in range(25)]
    corpus = spark.createDataFrame(docs, "id long, text string").withColumn("title", F.lit(None).cast("string"))
    queries = spark.createDataFrame([(i, " ".join(r.choices(words, k=4))) for i in range(6)], "id long, text string")
    own = ChunkedRetriever(corpus, strategy="balanced", aggregation=how)
    chunks = own.chunks.collect()
    vectors = dict(zip([c["chunk_id"] for c in chunks], own.encoder.encode([c["text"] for c in chunks]), strict=True))
    got = {(x["query_id"], x["rank"]): x for x in own.retrieve(queries, 4).collect()}
    for q in queries.collect():
        v = np.array(own.encoder.encode([q["text"]])[0], np.float32)
        scores: dict = {}
        for c in chunks:
            w = np.array(vectors[c["chunk_id"]], np.float32).astype(float)
            scores.setdefault(c["doc_id"], []).append((float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), c["chunk_id"], c["chunk_index"], c["text"]))
        total = {}
        for d, s in scores.items():
            s.sort(key=lambda x: (round(x[0], 9), x[1]), reverse=True)
            w = [1 / (i + 1) for i in range(len(s))]
            total[d] = s[0][0] if how == "max" else sum(a * x[0] for a, x in zip(w, s, strict=True)) / sum(w)
        order = sorted(total, key=lambda d: (round(total[d], 6), d), reverse=True)[:4]
        for rank, d in enumerate(order, 1):
            x = got[q["id"], rank]
            assert abs(x["score"] - total[d]) < 1e-6 and x["num_chunks_matched"] == len(scores[x["corpus_id"]])
            assert (x["best_chunk_index"], x["best_chunk"]) == scores[x["corpus_id"]][0][2:]
