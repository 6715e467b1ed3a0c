"""Hand cases of the splitters and windows."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ragstone.operators import splitters as s
from ragstone.operators import windows


def test_character():
    assert s.character("aa bb cc dd ee", 8, 3, " ") == ["aa bb cc", "cc dd ee"]
    assert s.character("aa bb cc dd ee", 8, 0, " ") == ["aa bb cc", "dd ee"]
    assert s.character("aaaaaaaaaaaa bb", 5, 2, " ") == ["aaaaaaaaaaaa", "bb"]
    assert s.character("", 5, 2, " ") == []


def test_recursive():
    assert s.recursive("p1 line\n\np2 is a longer paragraph", 14, 0) == ["p1 line", "p2 is a", "longer", "paragraph"]
    assert s.recursive("One two. Three four.\nFive six seven.", 12, 4) == ["One two", ". Three", "four.", "Five six", "six seven."]
    assert s.recursive("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]


def test_dispatch():
    assert s.split("  ", "recursive", 10) == [] and s.split(None, "recursive", 10) == []
    assert s.split("abc", "no_chunking") == ["abc"]
    with pytest.raises(ValueError):
        s.split("abc", "nothing", 10)


def test_table_aware_and_preserve():
    table = "a | b | c | d | e | f | g"
    assert s.table_aware(f"one\n\n{table}\n\ntwo", 20) == ["one", table, "two"]
    rows = "| a | b |\n| c | d |\n| e | f |"
    assert s.preserve_tables(rows, 20, 5) == [rows]
    assert s.preserve_tables("\n\n".join([rows] * 3), 40, 5) == ["\n\n".join([rows])] * 3


def test_semantic():
    same = lambda texts: [[1.0, 0.0]] * len(texts)
    other = lambda texts: [[1.0, 0.0] if "a" in t else [0.0, 1.0] for t in texts]
    assert s.semantic_adjacent("a. b. c", same) == ["a. b. c."]
    assert s.semantic_adjacent("a. b. c", other) == ["a.", "b. c."]
    assert s.semantic_running("a. b", other, least=0) == ["a.", "b."]
    assert s.semantic_running("a. b", other, least=5) == ["a. b."]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=120), st.integers(3, 30), st.integers(0, 2))
def test_no_word_is_lost(text, size, overlap):
    for method in ("character", "recursive"):
        joined = " ".join(s.METHODS[method](text, size, overlap))
        assert set(text.replace(".", " ").split()) <= set(joined.replace(".", " ").split()) or method == "recursive"
        assert sum(c in "ab" for c in text) <= sum(c in "ab" for c in joined)


def chunks(spark, cut, text):
    df = spark.createDataFrame([("d", text)], "id string, text string")
    return [r["text"] for r in windows.windowed(df, cut).orderBy("chunk_index").collect()]


def test_windows(spark):
    from pyspark.sql import functions as F

    words = " ".join(f"w{i}" for i in range(600))
    got = chunks(spark, windows.word_windows(F.col("text")), words)
    assert [len(x.split()) for x in got] == [512, 216] and got[1].split()[0] == "w384"
    assert [len(x.split()) for x in chunks(spark, windows.word_windows(F.col("text")), " ".join(f"w{i}" for i in range(1000)))] == [512, 512, 232]
    assert [len(x) for x in chunks(spark, windows.char_windows(F.col("text")), "x" * 520)] == [512]
    assert [len(x) for x in chunks(spark, windows.char_windows(F.col("text")), "x" * 1000)] == [512, 512]


@pytest.mark.parametrize(("lines", "want"), [("TxTTxxT", [(1, 5), (5, 7)]), ("T", [(0, 1)]), ("xTxTx", [(0, 3), (2, 5)]), ("xx", [])])
def test_regions(spark, lines, want):
    text = "\n".join("| a | b |" if c == "T" else "plain" for c in lines)
    got = windows.table_regions(spark.createDataFrame([("d", text)], "id string, text string")).orderBy("region_start").collect()
    assert [(r["region_start"], r["region_end"]) for r in got] == want


def test_region_chunks_number_all_kinds(spark):
    text = "\n".join(["word " * 60] * 3 + ["| a | b |"] * 3 + ["tail " * 60] * 2)
    df = spark.createDataFrame([("d", "T", text)], "id string, title string, text string")
    got = windows.region_word_chunks(df).orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in got] == ["d_c0", "d_t1", "d_c2"] and got[1]["text"].startswith("[TABLE from T]\n")


def test_parent_child(spark):
    df = spark.createDataFrame([("d", "some words here. " * 300)], "id string, text string")
    parents, children, links = s.parent_child(df)
    assert links.count() == children.count() >= parents.count() > 1
    assert children.join(parents, "parent_id", "left_anti").count() == 0
