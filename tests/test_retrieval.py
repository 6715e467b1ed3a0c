"""Hand cases of scoring, aggregation, metrics and tasks."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from ragstone.functions import text, vectors
from ragstone.operators import aggregate, dense, generate, hybrid, lexical, metrics, rerank, sampling, tuning
from ragstone.plans import flows, tasks
from ragstone.sources import readers, sinks


def run_of(spark, scores, q="q1"):
    return spark.createDataFrame([(q, d, float(s)) for d, s in scores.items()], "query_id string, corpus_id string, score double")


def rels(spark, found, q="q1"):
    return spark.createDataFrame([(q, d, r) for d, r in found.items()], "query_id string, corpus_id string, score int")


def value(df, c="ndcg"):
    return df.collect()[0][c]


def test_metrics(spark):
    run = run_of(spark, {"d1": 0.9, "d2": 0.8, "d3": 0.7})
    two = rels(spark, {"d1": 1, "d3": 1})
    r = metrics.per_query(run, two, 3).collect()[0]
    assert [round(r[c], 6) for c in ("ndcg", "map", "recall", "precision")] == [0.919721, 0.833333, 1.0, 0.666667]
    three = rels(spark, {"d1": 1, "d3": 1, "d9": 1})
    r = metrics.per_query(run, three, 3).collect()[0]
    assert (round(r["ndcg"], 6), round(r["recall"], 6)) == (0.703918, 0.666667)
    graded = rels(spark, {"d1": 2, "d3": 1})
    assert round(value(metrics.ndcg_list(run, graded, 3)), 6) == 0.950234
    assert round(value(metrics.ndcg_list(run, graded, 3, exponential=True)), 6) == 0.96394
    assert value(metrics.ndcg_relevant_only(run, two, 3)) == 1.0
    twice = run_of(spark, {"d1": 0.9}).unionByName(run_of(spark, {"d1": 0.8}))
    one = rels(spark, {"d1": 1})
    assert round(value(metrics.ndcg_list(twice, one, 10, exponential=True, dedup=False)), 5) == 1.63093
    assert value(metrics.ndcg_list(twice, one, 10, exponential=True)) == 1.0
    assert metrics.evaluate(run, rels(spark, {"d1": 1}, "other"), (1,)).count() == 0


def test_aggregation(spark):
    rows = [("q", f"c{i}", "d", i, s) for i, s in enumerate((0.9, 0.6, 0.3))]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, doc_id string, chunk_index int, score double")
    want = {"max": 0.9, "mean": 0.6, "sum": 1.8, "first": 0.9, "weighted_rank": 0.709091, "weighted_position": 0.709091}
    assert {m: round(value(aggregate.to_documents(df, m), "score"), 6) for m in want} == want
    with pytest.raises(ValueError):
        aggregate.to_documents(df, "median")


def test_bm25(spark):
    docs = spark.createDataFrame([("1", "a b"), ("2", "a c"), ("3", "a a d")], "id string, text string")
    got = {r["corpus_id"]: r["score"] for r in lexical.bm25(spark.createDataFrame([("q", "a c")], "id string, text string"), docs).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {"1": -0.027615, "2": 0.518306, "3": -0.033809}


def test_fusion(spark):
    candidates = run_of(spark, {"1": 0.8, "2": 0.5, "3": 0.2})
    lex = run_of(spark, {"2": 4.0, "3": 1.0})
    got = hybrid.fused(candidates, lex, None).orderBy("rank").collect()
    assert [(r["corpus_id"], round(r["score"], 6)) for r in got] == [("2", 0.7), ("1", 0.6), ("3", 0.1)]
    same = run_of(spark, {"1": 0.5, "2": 0.5}).select(vectors.min_max(F.col("score"), "query_id").alias("s"))
    assert [r["s"] for r in same.collect()] == [1.0, 1.0]


def test_dense_matches_pairs_in_any_blocks(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding").where("id < 60")
    from ragstone.operators.ranking import top_k

    want = sorted((r["query_id"], r["corpus_id"], r["rank"]) for r in top_k(dense.score_pairs(v, v), 5).collect())
    for block in (7, 4096):
        assert sorted((r["query_id"], r["corpus_id"], r["rank"]) for r in dense.dense_topk(v, v, 5, block=block).collect()) == want
    assert dense.dense_topk(v, v, None).count() == 60 * 59
    assert dense.dense_topk(v.where("id = 0"), v, 3).count() == 3
    with pytest.raises(ValueError):
        dense.dense_topk(v, v, 3, "nothing")


def test_ties_and_zero_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0])], "id long, embedding array<float>")
    got = dense.dense_topk(v.where("id = 1"), v, 3).orderBy("rank").collect()
    assert [(r["corpus_id"], r["score"]) for r in got] == [(3, 1.0), (2, 1.0), (4, -1.0)]


@pytest.mark.parametrize(("question", "classes", "to"), [
    ("What is the total revenue in the balance sheet?", ["table_query", "specific_fact", "calculation"], "table-aware"), ("Explain the market position", ["contextual"], "large"),
    ("Explain the company's growth strategy", ["table_query", "contextual"], "table-aware"), ("Hello", ["general"], "medium"), (None, ["general"], "medium")])
def test_classes(spark, question, classes, to):
    c = text.query_classes(F.col("t"))
    r = spark.createDataFrame([(question,)], "t string").select(c.alias("c"), text.route(c).alias("r")).collect()[0]
    assert (r["c"], r["r"]) == (classes, to)


def test_text(spark):
    df = spark.createDataFrame([(" a ", "b"), (None, "b"), ("a", ""), ("", "")], "t string, x string")
    got = df.select(text.title_sentence(F.col("t"), F.col("x")).alias("s"), text.title_text(F.col("t"), F.col("x")).alias("p")).collect()
    assert [r["s"] for r in got] == ["a. b", "b", "a", ""] and [r["p"] for r in got] == ["a  b", "b", "a", ""]


@pytest.fixture
def small(spark):
    corpus = spark.createDataFrame([("d1", "Revenue", "revenue grew last year"), ("d2", "Debt", "debt fell"), ("d3", "", "weather report")], "id string, title string, text string")
    queries = spark.createDataFrame([("q1", "how did revenue grow"), ("q2", "debt")], "id string, text string")
    return corpus, queries


def test_task(spark, small, tmp_path):
    task = tasks.make_task(spark, "FinQA", tables=small)
    with pytest.raises(ValueError):
        task.rerank(tasks.CrossEncoderReranker())
    with pytest.raises(TypeError):
        task.retrieve(object())
    task.retrieve(tasks.HybridRetriever(), 3)
    task.rerank(tasks.CrossEncoderReranker(), k=2)
    assert {r["query_id"]: r["corpus_id"] for r in generate.best_documents(task.rerank_run).collect()} == {"q1": "d1", "q2": "d2"}
    assert task.generate(generate.EchoGenerator()).count() == 2
    own = task.generate(generate.EchoGenerator(500), prepare=lambda q, docs: [{"role": "user", "content": f"{q}|{len(docs)}"}]).collect()
    assert {r["answer"] for r in own} == {"how did revenue grow|2", "debt|2"}
    path = task.save_results(str(tmp_path), 2)
    assert spark.read.csv(path, header=True).columns == ["query_id", "corpus_id"] and task.save_results(None) is None
    qrels = spark.createDataFrame([("q1", "d1", 1), ("q2", "d2", 1)], "query_id string, corpus_id string, score int")
    assert {r["value"] for r in task.evaluate(qrels, ks=(1,)).collect()} == {1.0}
    assert tasks.BM25Retriever().retrieve(*small, 5).count() == 2


def test_metadata():
    m = tasks.metadata_of("TAT-QA")
    assert m.dataset == {"path": "local", "subset": "TATQA"} and not m.is_filled() and m.intext_citation == ""
    m.bibtex_citation = "@article{key2020, title={x}}"
    assert m.intext_citation == "\\cite{key2020}"
    for bad in ({"path": "x"}, {"subset": "x"}):
        with pytest.raises(ValueError):
            tasks.TaskMetadata(dataset=bad, name="n", description="d")
    for field, wrong in (("type", "x"), ("license", "x"), ("reference", "no url"), ("date", ("2020-01-01", "soon")), ("domains", ["x"])):
        with pytest.raises(ValueError):
            tasks.TaskMetadata(dataset={"path": "p", "subset": "s"}, name="n", description="d", **{field: wrong})


def test_files(spark, small, tmp_path):
    corpus, queries = small
    folder = f"{tmp_path}/set"
    import json
    import os

    os.makedirs(folder)
    for name, df in (("corpus", corpus), ("queries", queries)):
        with open(f"{folder}/{name}.jsonl", "w") as f:
            f.writelines(json.dumps({"_id": r["id"], **{c: r[c] for c in df.columns if c != "id"}}) + "\n" for r in df.collect())
    with open(f"{folder}/qrels.tsv", "w") as f:
        f.write("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td1\t2\n")
    got = readers.Loader(spark, str(tmp_path), "set").load()
    assert sorted(got[0].collect()) == sorted(corpus.collect()) and got[1].columns == ["id", "text"]
    assert [tuple(r) for r in readers.read_qrels(spark, f"{folder}/qrels.tsv").collect()] == [("q1", "d1", 2)]
    assert readers.read_qrels_if_there(spark, f"{folder}/none.tsv") is None
    for bad in (lambda: readers.Loader(spark), lambda: readers.check_file(spark, f"{folder}/qrels.tsv", "jsonl"), lambda: readers.check_file(spark, f"{folder}/x.jsonl", "jsonl")):
        with pytest.raises(ValueError):
            bad()
    from ragstone.operators.splitters import chunk_corpus

    chunks = chunk_corpus(corpus.select("id", "text"), "recursive", 10, 0)
    for nested in (False, True):
        path = sinks.save_chunks(chunks, f"{tmp_path}/chunks{nested}", nested=nested)
        assert readers.read_chunks(spark, path).count() == chunks.count()
    assert readers.read_prepared(spark, path, f"{folder}/none.json")[1] is None
    assert [r["ready"] for r in readers.readiness(spark, {"a": {"method": "m", "ndcg": 1}}, folder).collect()] == [False]
    assert "m | 1.0000" in sinks.report("t", spark.createDataFrame([("m", 1.0)], "a string, b double"))


def test_sampling_and_tuning(spark, small):
    corpus, queries = small
    qrels = spark.createDataFrame([("q1", "d1", 1), ("q2", "d2", 1)], "query_id string, corpus_id string, score int")
    assert {r["id"] for r in sampling.smart_sample(corpus, queries, qrels, 1).collect()} == {"d1", "d2"}
    results, failed = tuning.grid_search(corpus, queries, qrels, [*tuning.grid(["recursive"], [50], [0.0]), {"method": "nothing", "size": 5, "overlap": 0}])
    assert results.count() == 1 and len(failed) == 1
    best = tuning.best_strategy(tuning.evaluate_strategies(corpus, queries, qrels, [{"method": "recursive", "size": 50}, {"method": "no_chunking"}])).collect()
    assert len(best) == 1 and best[0]["ndcg"] > 0
    runs, errors, summary = flows.over_datasets({"a": (*small, qrels), "b": (None, None, None)})
    assert list(runs) == ["a"] and list(errors) == ["b"] and summary.count() == 1
    assert flows.dense_rerank(corpus, queries).count() > 0
    assert math.isclose(value(flows.chunks_against_whole(corpus, queries, qrels), "ndcg"), 1.0)


def test_rerank_model(spark, small):
    class Length:
        def predict(self, pairs):
            return [float(len(d)) for _, d in pairs]

    run = run_of(spark, {"d1": 0.1, "d2": 0.9, "d3": 0.8})
    got = rerank.rerank(run, small[1], small[0], Length(), k=2).orderBy("rank").collect()
    assert [r["corpus_id"] for r in got] == ["d3", "d2"]


def test_stream(spark, tmp_path):
    from ragstone.streaming.incremental import follow_topk, latest

    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(20)], "id long, embedding array<float>")
    v.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    q = follow_topk(stream, v.where("id < 3"), f"{tmp_path}/out", f"{tmp_path}/cp", 4)
    q.awaitTermination()
    last = max(int(p["batchId"]) for p in q.recentProgress)
    want = sorted((r["query_id"], r["corpus_id"]) for r in dense.dense_topk(v.where("id < 3"), v, 4).collect())
    assert sorted((r["query_id"], r["corpus_id"]) for r in latest(v, f"{tmp_path}/out", last).collect()) == want
