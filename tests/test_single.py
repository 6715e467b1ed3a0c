"""Searches whose products are of single precision first, against all pairs in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragstone.operators import blocks, dense


def plain(q, c, k, score):
    """query: its k best, by the definition."""
    def sound(x):
        return x is not None and len(x) == 6 and not np.isnan(x).any() and (score == "dot" or np.linalg.norm(x) > 0)

    out = {}
    for i, a in q:
        found = []
        for j, b in c:
            if i != j:
                s = float(np.dot(a, b)) if sound(a) and sound(b) else -1.0
                found.append((round(s / (np.linalg.norm(a) * np.linalg.norm(b)) if s != -1.0 and score == "cos_sim" else s, 9), j))
        out[i] = sorted(found, reverse=True)[:k]
    return out


@pytest.mark.parametrize("score", ["cos_sim", "dot"])
@pytest.mark.parametrize("size", [1.0, 1e-6, 1e12])
def test_scores_nearer_than_single_precision_are_ranked(score, size, monkeypatch):
    r = np.random.default_rng(5)
    base = r.normal(size=(9, 6))
    m = np.concatenate([base[r.integers(0, 9, 300)] + r.normal(size=(300, 6)) * 1e-8, base, base]) * size
    rows = [(i, v) for i, v in enumerate(m)] + [(500, np.zeros(6)), (501, None), (502, np.full(6, np.nan)), (503, np.ones(2))]
    if size > 1:  # at the greatest scores nine places are all that a double has
        rows = [(i, None if v is None else np.round(v)) for i, v in rows]
    asked = [x for x in rows if x[0] % 7 == 0]
    monkeypatch.setattr(dense, "TILE", 256)
    monkeypatch.setattr(dense, "WIDE", 32)
    made = [pa.array([i for i, _ in part]) for part in (asked, rows)], [pa.array([None if v is None else v.tolist() for _, v in part], pa.list_(pa.float64())) for part in (asked, rows)]
    want = plain(asked, rows, 5, score)
    for block, part in ((dense.QUERY_BLOCK, 400), (4, 50), (4, 3)):
        own = dense._Vectors(dense.Queries(made[0][0], made[1][0], score, block=block), 5)
        for at in range(0, len(rows), part):
            assert [*own.add(pa.RecordBatch.from_arrays([made[0][1].slice(at, part), made[1][1].slice(at, part)], ["id", "embedding"]))] == []
        got: dict = {}
        for b in own.rows():
            for x in b.to_pylist():
                got.setdefault(x["query_id"], []).append((x["score"], x["corpus_id"]))
        for i, v in want.items():
            assert np.allclose([s for s, _ in got[i]], [s for s, _ in v], rtol=1e-12, atol=2e-9), i
            if size < 1e12 or score == "cos_sim":
                assert [j for _, j in got[i]] == [j for _, j in v] or len({round(s, 8) for s, _ in v}) < 5


def test_vectors_too_long_for_single_precision_are_met_in_double():
    ids, e = pa.array([0, 1, 2]), pa.array([[3e20, 0.0], [1e20, 1.0], [2e20, 0.0]])
    q = dense.Queries(ids, e, "dot")
    m, good = q.rows(e)
    assert q.near(m, good, np.arange(3), np.full(3, -np.inf), 1) is None
    own = dense._Vectors(q, 1)
    assert [*own.add(pa.RecordBatch.from_arrays([ids, e], ["id", "embedding"]))] == []
    assert [b.column("corpus_id").to_pylist() for b in own.rows()] == [[2, 0, 0]]


def test_small_blocks_go_to_the_tasks_together(spark, monkeypatch):
    seen = []
    rows = [(i, [float((i * 7 + j * j) % 11) for j in range(4)]) for i in range(120)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    plain_written = dense.written
    monkeypatch.setattr(dense, "written", lambda df, name, *more: seen.append((name, plain_written(df, name, *more))) or seen[-1][1])
    names = ["query_id", "corpus_id", "rank"]
    whole = sorted(map(tuple, dense.dense_topk(v, v, 4).select(*names).collect()))
    few = seen[0][1].count()
    seen.clear()
    assert sorted(map(tuple, dense.dense_topk(v, v, 4, block=5).select(*names).collect())) == whole
    assert [n for n, _ in seen] == ["query-blocks", "corpus-blocks"] and seen[0][1].count() == few <= 4
    monkeypatch.setattr(dense, "QUERY_BLOCK", 16)  # more blocks than one in the grid
    seen.clear()
    assert sorted(map(tuple, dense.dense_topk(v, v, 4).select(*names).collect())) == whole
    assert seen[0][1].count() >= 8


def test_each_block_of_queries_has_a_partition(spark):
    queries = spark.range(40, numPartitions=8).select(F.monotonically_increasing_id().alias("block"))
    pairs = blocks.paired(spark.range(1).select(F.col("id").alias("c")), queries, 40)
    sizes = [len(x) for x in pairs.rdd.glom().collect() if x]
    assert sizes == [1] * 40
