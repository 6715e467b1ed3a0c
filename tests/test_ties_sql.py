"""SQL that ranks by sums, where documents tie but for the last bits of them."""

from __future__ import annotations

import random

import compare
import duckdb
import pandas as pd

from ragstone.plans import registry


def test_messages_take_the_first_by_rank(spark, tmp_path):
    r = random.Random(5)
    docs, asked = [], []
    for i in range(40):
        words = [f"w{i}x{j}" for j in range(9)]
        asked.append((i, " ".join(words)))
        for _ in range(3):  # the same counts, of other words: sums of the same parts in another order
            counts = r.sample(range(1, 10), 9)
            docs.append((len(docs), " ".join(" ".join([w] * n) for w, n in zip(words, counts, strict=True)), f"s{len(docs)}"))
    pd.DataFrame(docs, columns=["doc_id", "text", "source"]).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame(asked, columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert compare.differences(registry.QUERIES["messages_custom"](spark, str(tmp_path)), con, registry.ORACLE_SQL["messages_custom"]) == []
