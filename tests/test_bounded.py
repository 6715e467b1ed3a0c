"""Work that is done once, or only where it can count, with the same results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ragstone.functions import text, treebank
from ragstone.operators import dense, splitters


def test_a_text_meets_each_class_pattern_once(spark):
    docs = spark.createDataFrame([("Compare revenue of the YEAR",), ("compare it\nby year",), ("Explain the exact Ratio",), ("hello",), (None,), ("What  is",)], "text string")
    routed = docs.select("text", text.query_classes(F.col("text")).alias("c"), text.route(text.query_classes(F.col("text"))).alias("s"))
    got = {r["text"]: (r["c"], r["s"]) for r in routed.collect()}
    assert got["Compare revenue of the YEAR"] == (["table_query"], "table-aware") and got["compare it\nby year"] == (["general"], "medium")
    assert got["Explain the exact Ratio"] == (["specific_fact", "contextual", "calculation"], "small")
    assert got["hello"] == got[None] == got["What  is"] == (["general"], "medium")
    plan = docs.select(text.route(text.query_classes(F.col("text"))).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("compare.*") == 1 and plan.count("lower(") == 1


def test_rules_for_quotes_and_two_words_run_only_where_they_can(spark):
    lines = ['He CANNOT say "no".', "Gonna, gotta; more'n that 'Tis so: don't ``go''", "D'ye wanna lemme?", "plain words here, 3.14 (x)", "''quoted'' they'LL", "", '"', "cannot"]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    x = F.col("x")
    plain = treebank._words(treebank._rewritten(F.concat(F.lit(" "), treebank._rewritten(x, treebank.RULES), F.lit(" ")), treebank.ENDINGS))
    assert all(r["a"] == r["b"] for r in df.select(treebank.treebank(x).alias("a"), plain.alias("b")).collect())
    plan = df.select(treebank.treebank(x).alias("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert "cannot" in plan
    assert all(any(m in w for m in treebank.TWO) for w in ("cannot", "d'ye", "gimme", "gonna", "gotta", "lemme", "more'n", "wanna", "'tis", "'twas"))
    assert len(treebank.TWO) == len(treebank.ENDINGS[treebank.CLOSED:])


def test_texts_are_cut_a_bounded_number_at_a_time(spark, tmp_path):
    seen = str(tmp_path)

    def encode(texts):
        import uuid

        open(f"{seen}/{len(texts)}-{uuid.uuid4().hex}", "w").close()
        return [[1.0, float(len(t))] for t in texts]

    docs = spark.range(3000).select("id", F.lit("one. two").alias("text")).coalesce(1)
    assert splitters.chunk_corpus(docs, "semantic", encode=encode).groupBy().agg(F.countDistinct("doc_id")).first()[0] == 3000
    import os

    assert max(int(f.split("-")[0]) for f in os.listdir(seen)) <= 2 * splitters.TEXTS


def test_weighted_rank_sorts_only_what_can_reach_the_edge(monkeypatch):
    r = np.random.default_rng(3)
    s = np.round(r.normal(size=(7, 60)), 2)
    start = np.array([0, 1, 6, 11, 13, 30])
    size = np.diff([*start, 60])
    by_id = np.concatenate([r.permutation(np.arange(a, a + n)) for a, n in zip(start, size, strict=True)])
    own = dense._Documents.__new__(dense._Documents)
    own.method = "weighted_rank"
    rank = np.empty(60, int)
    rank[by_id] = np.arange(60)
    want = np.array([[dense._one("weighted_rank", row[a: a + n], np.round(row[a: a + n], 9), rank[a: a + n]) for a, n in zip(start, size, strict=True)] for row in s])
    assert np.allclose(own._reduced(s, by_id, start, size, np.full(7, -np.inf)), want)
    edge = np.sort(want, axis=1)[:, -2]
    got = own._reduced(s, by_id, start, size, edge)
    keep = want >= edge[:, None]
    assert np.allclose(got[keep], want[keep]) and (np.where(keep, -np.inf, got) < np.maximum(edge[:, None], -np.inf)).all() and (got >= want - 1e-12).all()
