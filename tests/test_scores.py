"""All BM25 scores from the blocks of an index, against the join of candidates."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_inverted import corpus

from ragstone.operators import inverted, lexical
from ragstone.operators.ranking import top_k


def rows(df):
    return sorted((r["query_id"], r["corpus_id"], round(r["score"], 7)) for r in df.collect())


def pairs(queries, docs):
    return queries.select(F.col("id").alias("query_id")).join(docs.select(F.col("id").alias("corpus_id")))


def test_scores_are_those_of_the_join_and_no_posting_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(inverted, "SCORES", 100)
    for kind in ("long", "string"):
        queries, docs = corpus(spark, 11, kind=kind)
        found = lexical.bm25(queries, docs)
        assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        assert rows(found) == rows(lexical.bm25(queries, docs, candidates=pairs(queries, docs)))


def test_every_document_is_ranked_for_every_query(spark):
    queries, docs = corpus(spark, 12)
    found = lexical.bm25_topk(queries, docs, None)
    join = lexical.bm25(queries, docs, candidates=pairs(queries, docs))
    whole = pairs(queries, docs).join(join, ["query_id", "corpus_id"], "left").fillna(0.0, ["score"])
    assert rows(found) == rows(whole) and found.count() == queries.count() * docs.count()
    ranks = {(r["query_id"], r["corpus_id"]): r["rank"] for r in found.collect()}
    assert ranks == {(r["query_id"], r["corpus_id"]): r["rank"] for r in top_k(whole.withColumn("score", F.round("score", 9)), None).collect()}
    none = lexical.bm25_topk(queries, docs.limit(0), None)
    assert none.count() == 0


def test_a_run_and_its_judgments_search_once(spark, data, monkeypatch):
    from ragstone.plans import catalog

    made = []
    monkeypatch.setattr(catalog, "bm25_run", lambda s, d, k=10, f=catalog.bm25_run: made.append(1) or f(s, d, k))
    assert catalog.QUERIES["semi_judged"](spark, data).count() > 0
    assert len(made) == 1
