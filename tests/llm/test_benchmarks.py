"""Decontamination against large benchmarks: chunks of windows, and the rows that they give."""

from __future__ import annotations

import glob
import random
import tracemalloc

import pyarrow.parquet as pq
import pytest

pytest.importorskip("ragstone.llm")

from ragstone.llm import decontaminate  # noqa: E402
from ragstone.llm.common import shared_dir  # noqa: E402


def test_query_with_a_chunk_for_each_few_items(spark, data, monkeypatch):
    whole = sorted(map(tuple, decontaminate.query(spark, data).collect()), key=repr)
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    bytes_ = bench.selectExpr("sum(octet_length(text))").first()[0]
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", bytes_ // 6)
    chunks = list(decontaminate.chunks_of(bench))
    assert 5 <= len(chunks) <= 8 and sorted({n for c in chunks for n in c["names"]}) == sorted(str(r["item_id"]) for r in bench.collect() if decontaminate.words_of((r["text"] or "").encode()))
    assert sorted(map(tuple, decontaminate.query(spark, data).collect()), key=repr) == whole


def test_only_documents_with_hits_are_stored(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 1)
    kept = []
    plain = decontaminate.written
    monkeypatch.setattr(decontaminate, "written", lambda df, name, *a: kept.append((name, (x := plain(df, name, *a)).count())) or x)
    docs = spark.createDataFrame([(i, f"filler {i} " + ("a b c d" if i % 10 == 0 else "")) for i in range(50)] + [(None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b"), (2, "C, d!"), (3, "nowhere to be seen"), (1, "b c")], "item_id long, text string")
    found = decontaminate.search_windows(decontaminate.build_index(docs, shared_dir(spark, "i")), bench).collect()
    assert kept == [("hits", 5), ("hits", 5), ("hits", 0), ("hits", 5)] and len(found) == 51
    assert {(x["n_hit"], tuple(x["items"])) for x in found} == {(4, ("1", "2")), (0, ())}


def test_windows_of_items(spark):
    r = random.Random(5)
    items = [(i % 9, " ".join(r.choices("abc", k=r.randint(0, 30)))) for i in range(60)]
    want: dict = {}
    for i, t in items:
        w = t.split()
        for k in range(max(len(w) - 12, bool(w))):
            want.setdefault(tuple(x.encode() for x in w[k: k + 13]), set()).add(str(i))
    chunk, = decontaminate.chunks_of(spark.createDataFrame(items, "item_id long, text string"))
    got = {}
    for k, (g, n) in enumerate(zip(chunk["grams"], chunk["sizes"], strict=True)):
        got[tuple(chunk["terms"][x] for x in g[:n])] = {chunk["names"][x] for x in chunk["owners"][chunk["starts"][k]: chunk["starts"][k + 1]]}
    assert got == want and list(decontaminate.chunks_of(spark.createDataFrame([(1, None), (2, " ,")], "item_id long, text string"))) == []


def test_memory_of_a_chunk():
    r = random.Random(6)
    names = [f"word{i}" for i in range(20_000)]

    class Rows:
        def select(self, *_):
            return self

        def toLocalIterator(self):
            return ((str(i), " ".join(r.choices(names, k=700))) for i in range(20_000))

    tracemalloc.start()
    chunk = next(decontaminate.chunks_of(Rows()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(chunk["grams"]) > 400_000 and peak < 200 << 20


def test_blocks_are_row_groups_of_their_own(spark, tmp_path):
    """A task that writes or reads an index holds a block at a time, whatever the corpus."""
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 5) for i in range(90)], "doc_id long, text string").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 3)  # each batch is a block at least
    decontaminate.build_index(docs, f"{tmp_path}/index")
    spark.conf.set(name, before)
    groups = [m.row_group(i).num_rows for f in glob.glob(f"{tmp_path}/index/*.parquet") for m in [pq.read_metadata(f)] for i in range(m.num_row_groups)]
    assert len(groups) > 20
    assert set(groups) == {1}
