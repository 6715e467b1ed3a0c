"""Table regions and the chunkers around them against a plain reading of the lines."""

from __future__ import annotations

import random
import re

import pytest

from ragstone.operators import windows

LINES = ["a | b | c", "plain words here", "", "x\ty\tz", "1   2   3", "one | mark", "more plain text " * 9, "  "]


def is_table(line):
    return line.count("|") >= 2 or line.count("\t") >= 2 or len(re.findall(r"\s{3,}", line)) >= 2


def regions(lines):
    out, a = [], None
    for i, line in enumerate([*lines, None]):
        if line is not None and is_table(line):
            a = i if a is None else a
        elif a is not None:
            start = max(a - 1, 0)
            if line is None:
                out.append((start, len(lines)))
            elif i + 1 - start >= 3:
                out.append((start, i + 1))
            a = None
    return out


def parts(text):
    lines, at, out = text.split("\n"), 0, []
    for s, e in regions(lines):
        out += [(False, "\n".join(lines[at:s])), (True, "\n".join(lines[s:e]))]
        at = e
    out.append((False, "\n".join(lines[at:])))
    # regions may meet: what lies between two has no lines then
    return [(t, b) for t, b in out if t or b.strip(" \t\n\r\f\v")]


def char_pieces(text, size, overlap):
    if len(text) <= size:
        return [text]
    step = size - overlap
    return [x for i in range(-(-(len(text) - size) // step) + 1) if len(x := text[i * step: i * step + size].strip(" \t\n\r\f\v")) >= 100]


def word_pieces(text, size, overlap):
    w = [x for x in re.split("[ \t\n\r]+", text) if x]
    return [text] if len(w) <= size else [" ".join(w[i: i + size]) for i in range(0, len(w), size - overlap) if len(w) - i >= 50]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    some = ["\n".join(r.choice(LINES) for _ in range(r.randint(0, 30))) for _ in range(150)] + ["word " * 2000, "\n", "", LINES[0], "\n".join(LINES[:1] * 60)]
    return [*some, some[3], None]


def test_regions(spark, texts):
    docs = spark.createDataFrame([*enumerate(texts)], "id long, text string")
    found = windows.table_regions(docs)
    assert sorted(map(tuple, found.collect())) == [(i, *x) for i, t in enumerate(texts) if t is not None for x in regions(t.split("\n"))]
    assert windows.table_regions(docs.limit(0)).count() == 0


@pytest.mark.parametrize("preserve", [True, False])
def test_region_chunks(spark, texts, preserve):
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else f"t{i}", t) for i, t in enumerate(texts)], "id long, title string, text string")
    for words, df in ((False, windows.region_char_chunks(docs, 200, 20, preserve)), (True, windows.region_word_chunks(docs, 80, 20, preserve))):
        want = []
        for i, t in enumerate(texts):
            title, t = "" if i % 7 == 0 else f"t{i}", t or ""
            if words:
                cut = parts(t) if preserve and len(t) >= 500 else [(False, t)]
                each = [(x, p) for x, b in cut for p in ([f"[TABLE from {title}]\n{b}"] if x else [f"[{title}] {p}" for p in word_pieces(b, 80, 20)])]
            else:
                t = f"{title}\n{t}" if title else t
                cut = parts(t) if preserve else [(False, t)]
                each = [(False, t)] if len(t) < 300 else [(x, p) for x, b in cut for p in ([f"[TABLE]\n{b}"] if x else char_pieces(b, 200, 20))]
            want += [(i, n, p, x, f"{i}_{'t' if x else 'c'}{n}") for n, (x, p) in enumerate(each)]
        assert sorted(tuple(x) for x in df.select("doc_id", "chunk_index", "text", "is_table", "chunk_id").collect()) == want
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Python" not in plan
