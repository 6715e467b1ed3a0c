"""WARC archives: merge rounds, ids over the whole range of longs, times of captures."""

from __future__ import annotations

import datetime
import random

import pytest

pytest.importorskip("ragstone.llm")

from ragstone.llm import warc  # noqa: E402
from ragstone.llm.common import shared_dir  # noqa: E402

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def indexed(spark, pages, **how):
    return warc.merged_index(warc.sorted_runs(spark, warc.write_archives(pages, shared_dir(spark, "w"), **how)))


@pytest.mark.parametrize("fan", [2, 5])
def test_rounds_of_bounded_fan_in(spark, monkeypatch, fan):
    for name, value in (("RUN_ROWS", 30), ("RUN_BLOCK", 4), ("ROW_BYTES", 2000), ("ROWS_PER_FILE", 1), ("RANGE_ROWS", 200), ("FAN", fan)):
        monkeypatch.setattr(warc, name, value)
    r = random.Random(34)
    rows = [(i, f"http://h{r.randrange(3)}.example/{r.randrange(9)}", f"page {r.randrange(20)} " * r.randrange(40)) for i in range(700)] + [(None, "x", "y"), (3, "http://h1.example/1", "z")]
    path = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), shared_dir(spark, "w"))
    runs = warc.sorted_runs(spark, path)
    n, rounds = runs.select("run").distinct().count(), []
    plain = warc.merge_round
    monkeypatch.setattr(warc, "merge_round", lambda df, parts, last: rounds.append(df.groupBy("group").agg(warc.F.count_distinct("run").alias("n")).agg({"n": "max"}).first()[0]) or plain(df, parts, last))
    got = [(x["urlkey"].encode(), x["captured"], LOW if x["page_id"] is None else x["page_id"]) for x in warc.merged_index(runs).orderBy("rank").collect()]
    assert got == sorted(got) and sorted(x[2] for x in got) == sorted(LOW if i is None else i for i, _, _ in rows)
    assert n > 10 and len(rounds) > 2 and max(rounds[1:]) <= fan


def test_ids_over_the_whole_range(spark):
    ids = [LOW, -(1 << 62), -3, 0, 300_000_000_000, 10**13, 1 << 62, HIGH, None]
    same = "payload " * 20
    pages = spark.createDataFrame([(i, "http://a.example/", same) for i in ids], "page_id long, url string, html string")
    got = indexed(spark, pages).orderBy("rank").collect()
    assert [x["page_id"] for x in got] == [None, *sorted(i for i in ids if i is not None)]
    assert [(x["record_type"], x["refers_to"]) for x in got] == [("response" if x["page_id"] == LOW else "revisit", None if x["page_id"] == LOW else LOW) for x in got]
    assert {x["captured"] for x in got} == {warc.EPOCH}


def test_times_of_captures(spark):
    seconds = [0, -1, 1_700_000_000, 951_782_399, warc.TIMES[0], warc.TIMES[1], warc.TIMES[0] - 1, HIGH, LOW, None]
    want = [s if s is not None and warc.TIMES[0] <= s <= warc.TIMES[1] else warc.EPOCH for s in seconds]
    pages = spark.createDataFrame([(i, "u", "", s) for i, s in enumerate(seconds)], "page_id long, url string, html string, seen long")
    got = indexed(spark, pages, time="seen").orderBy("rank").collect()
    assert sorted((x["page_id"], x["captured"]) for x in got) == list(enumerate(want)) and [x["captured"] for x in got] == sorted(want)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stamps = spark.createDataFrame([(1, "u", "", datetime.datetime(2024, 11, 3, 5, 30, tzinfo=datetime.UTC)), (2, "u", "", datetime.datetime(2024, 11, 3, 6, 30, tzinfo=datetime.UTC))], "page_id long, url string, html string, seen timestamp")
        assert [x["captured"] for x in indexed(spark, stamps, time="seen").orderBy("rank").collect()] == [1730611800, 1730615400]
    finally:
        spark.conf.unset("spark.sql.session.timeZone")
