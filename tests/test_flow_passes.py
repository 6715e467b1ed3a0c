"""chunked_hybrid works on a corpus once, and cuts as plain programs do."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ragstone.functions.text import strip
from ragstone.operators.windows import LEAST_CHARS, char_windows, region_char_chunks
from ragstone.plans.flows import chunked_hybrid


def test_a_corpus_is_cut_once(spark):
    passes = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        passes.add(1)
        return text

    rows = [(i, f"title {i}", f"word{i} word{i % 7} plain " * 60) for i in range(20)]
    corpus = spark.createDataFrame(rows, "id long, title string, text string").withColumn("text", seen.asNondeterministic()("text"))
    queries = spark.createDataFrame([(1, "word3 plain"), (2, "word5")], "id long, text string")
    assert chunked_hybrid(corpus, queries).count() == 20
    assert passes.value <= 2 * len(rows)  # once for the chunks, once for the rerank


def test_windows_of_long_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é𝄞 \n\t") for _ in range(n)) for n in (0, 1, 511, 512, 513, 974, 975, 7442, 7443, 7904, 7905, 30_000)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", char_windows(F.col("text")).alias("w")).collect()
    for r in got:
        t, want, i = texts[r["id"]], [], 0
        while True:
            want.append(t[i: i + 512].strip(" \t\n\r\f\v"))
            if i + 512 >= len(t):
                break
            i += 462
        assert r["w"] == ([t] if len(t) <= 512 else [x for x in want if len(x) >= LEAST_CHARS])


def test_strip_ends_at_the_end(spark):
    texts = [" \ta b\r\n\f\v ", "a  ", "\u0085 a", "", " ", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strip(F.col("t"))).collect()]
    assert got == [t if t is None else t.strip(" \t\n\r\f\v") for t in texts]


def test_tables_by_wide_gaps_and_tabs(spark):
    body = "plain text here\n" * 60
    texts = [f"{body}a   b   c\nd   e   f\n{body}", f"{body}a\tb\tc\nd\te\tf\n{body}", f"{body}|a|b|\n|c|d|\n{body}", f"{body}a   b\n\n\n\n{body}"]
    docs = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "id int, title string, text string")
    assert {r["doc_id"] for r in region_char_chunks(docs).where("is_table").collect()} == {0, 1, 2}
