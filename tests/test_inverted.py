"""The inverted index against BM25 as a join, and the k best of blocks against sorting."""

from __future__ import annotations

import glob
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from ragstone.operators import blocks, inverted, lexical
from ragstone.operators.ranking import top_k


def rows(df):
    return sorted((r["query_id"], r["rank"], r["corpus_id"], round(r["score"], 7)) for r in df.collect())


def corpus(spark, seed, n=400, kind="long"):
    r = random.Random(seed)
    names = [f"w{i}" for i in range(60)]
    weights = [1000 / (i + 1) for i in range(60)]  # the first ones are in most documents
    name = (lambda i: i) if kind == "long" else (lambda i: f"d{i}é")
    docs = [(name(i), " ".join(r.choices(names, weights, k=r.randint(0, 40)))) for i in range(n)]
    docs += [(name(n + i), docs[7][1]) for i in range(30)] + [(name(n + 30), None), (name(n + 31), "  \n")]  # copies tie
    asked = [(i, " ".join(r.choices(names, weights, k=r.randint(1, 9)))) for i in range(50)] + [(50, ""), (51, None), (52, "unheard of"), (53, docs[7][1])]
    return spark.createDataFrame(asked, "id long, text string"), spark.createDataFrame(docs, f"id {kind}, text string").repartition(3)


@pytest.mark.parametrize(("kind", "tokens", "asked", "k"), [("long", 10**6, 4096, 10), ("long", 200, 4096, 3), ("string", 300, 7, 5), ("long", 150, 1, 1), ("long", 10**6, 20, 1000)])
def test_index_gives_what_the_join_gives(spark, monkeypatch, kind, tokens, asked, k):
    monkeypatch.setattr(inverted, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(inverted, "BLOCK_QUERIES", asked)
    queries, docs = corpus(spark, tokens + k, kind=kind)
    index = inverted.Index.build(docs)
    assert (index.blocks.count() > 5) == (tokens < 1000)
    assert rows(index.search(queries, k)) == rows(top_k(lexical.bm25(queries, docs), k))
    again = inverted.Index.open(spark, index.blocks.inputFiles()[0].rpartition("/")[0])
    assert rows(again.search(queries, k, k1=0.9, b=0.0)) == rows(top_k(lexical.bm25(queries, docs, k1=0.9, b=0.0), k))


def test_idf_of_all_terms(spark):
    _, docs = corpus(spark, 3)
    one = {(r["token"], r["df"], round(r["idf"], 9)) for r in inverted.Index.build(docs).inverse_frequencies().collect()}
    assert one == {(r["token"], r["df"], round(r["idf"], 9)) for r in lexical.inverse_frequencies(lexical.frequencies(docs)).collect()}


def test_terms_that_are_everywhere(spark):
    """With all idf at or below zero, documents rank by what they lose least."""
    docs = spark.createDataFrame([(i, "a b " * (i % 5 + 1)) for i in range(40)], "id long, text string")
    queries = spark.createDataFrame([(1, "a"), (2, "a b b")], "id long, text string")
    assert rows(lexical.bm25_topk(queries, docs, 7)) == rows(top_k(lexical.bm25(queries, docs), 7))


def test_empty_sides(spark):
    queries, docs = corpus(spark, 5)
    assert lexical.bm25_topk(queries.limit(0), docs, 3).count() == 0 and lexical.bm25_topk(queries, docs.limit(0), 3).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "id long, text string")
    assert lexical.bm25_topk(queries, blank, 3).count() == 0


def test_bounds_spare_work(spark, monkeypatch):
    """Documents whose bound is too low are never scored."""
    met = []
    plain = inverted._Search._must
    monkeypatch.setattr(inverted._Search, "_must", staticmethod(lambda *a: met.append(len(a[0])) or plain(*a)))
    queries, docs = corpus(spark, 8, 3000)
    blocks_, k = inverted.Index.build(docs).blocks.toArrow().to_batches(), 3
    weighed = {"query_ids": [0], "tokens": ["w0", "w1", "w50"], "sizes": [3], "weights": [0.01, 0.02, 5.0]}
    import pyarrow as pa

    own = inverted._Search({n: pa.scalar(v) for n, v in weighed.items()}, k)
    for batch in blocks_ * 2:
        for i in range(batch.num_rows):
            own.add({n: batch.column(n)[i] for n in batch.schema.names}, 1.5, 0.75, 20.0)
    assert met[0] == 3 and min(met) == 1  # first all terms, then the rare one only


def test_best_of_many_blocks():
    r = np.random.default_rng(4)
    for k in (1, 4, None):
        best, s = blocks.Best(6, k), r.integers(0, 9, (6, 200)) / 4
        s[2, ::3] = -np.inf
        ids = r.permutation(200)
        for at in range(0, 200, 17):
            part = s[:, at: at + 17]
            for low in (0, 2):
                best.add_matrix(part[low: low + 2 if low == 0 else None], ids[at: at + 17], lambda i, j, p=part, a=low: -p[i + a, j], first=low)
        i, name, score, more = best.cut()
        want = [(q, n, x) for q in range(6) for x, n in sorted(((x, n) for x, n in zip(s[q], ids, strict=True) if np.isfinite(x)), reverse=True)[:k]]
        got = [(a, b, c) for a, b, c in zip(i.tolist(), name.tolist(), score.tolist(), strict=True)]
        assert sorted(got) == sorted(want) and (more == -score).all()


def test_blocks_are_row_groups_of_their_own(spark, monkeypatch, tmp_path):
    """A task that writes or reads an index holds a block at a time, whatever the corpus."""
    monkeypatch.setattr(inverted, "BLOCK_TOKENS", 200)
    inverted.Index.build(corpus(spark, 3)[1], path=f"{tmp_path}/index")
    groups = [m.row_group(i).num_rows for f in glob.glob(f"{tmp_path}/index/*.parquet") for m in [pq.read_metadata(f)] for i in range(m.num_row_groups)]
    assert len(groups) > 20
    assert set(groups) == {1}
