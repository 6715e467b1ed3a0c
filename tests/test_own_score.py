"""Blocks of vectors under a score of one's own against all pairs."""

from __future__ import annotations

import random

from ragstone.operators import dense
from ragstone.plans import catalog_more


def test_own_score_in_blocks(spark):
    r = random.Random(3)
    rows = [(i, [float(r.randint(0, 3)) for _ in range(6)]) for i in range(120)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    want = sorted((q, 1 + n, c, -s) for q, a in rows for n, (s, c) in enumerate(sorted(((sum(abs(x - y) for x, y in zip(a, b, strict=True)), c) for c, b in rows if c != q), key=lambda x: (x[0], -x[1]))[:4]))
    odd = v.union(spark.createDataFrame([(500, None), (501, [1.0]), (502, [float("nan")] * 6)], "id long, embedding array<float>"))
    for block in (None, 50):
        got = dense.dense_topk(v, odd, 4, catalog_more.city_block, block=block).collect()
        assert sorted((x["query_id"], x["rank"], x["corpus_id"], x["score"]) for x in got) == want
