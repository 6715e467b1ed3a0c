"""Operator 12: periodic runs of words, after Ellert and Fischer.

Words are letters of an alphabet that can only be compared; their ranks come from
sorting.  One scan from left to right keeps the chain of previous smaller suffixes of the
position it has reached.  A suffix that is smaller than those at the chain's
end closes them: the edge from such a position to the new one is the longest Lyndon
word there, and the length of their match (how far both suffixes agree) is known from
that comparison.  Matches are never counted anew where they are known:

* along the chain: where q is the chain's next position after p, and p and i match over
  m words, q and p over e: q and i match over the smaller, and only for m = e is more to be compared;
* across the text: while i lies in a stretch that repeats an earlier one d words back,
  p and i match as p - d and i - d do, which is stored; only behind the end of the
  stretch is more to be compared, and that moves its end.

A run whose length is at least twice its period holds edges as long as its period in
one of the two orders of the alphabet; where one starts a run, the run reaches as far to
the right as they match, and to the left by less than a period.  No suffix array,
no suffix tree, no hash of a stretch.

Words, not characters, so that lines and passages that repeat are runs too.  Each
document is one row's work; a worker holds the ranks of one text's words (8 bytes a
word), the chain, and an entry for each edge that matches.

Edge cases: null, empty and blank texts have no words and no runs, and collapse to
the empty text; long texts are searched whole; equal words are equal letters; rows that
repeat a doc_id each get their row; an empty table gives no rows; other columns are
ignored.  A null doc_id counts as the empty text where h is taken of it (query).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone.llm.common import slices, table, utf8_values

#: a run has at least LEAST words and POWER times its period
LEAST, POWER = 6, 4
_NONE = (-1, 0)


def ranks(words: list[bytes]) -> list[int]:
    """The rank of each word among the distinct ones, from 1."""
    rank = {w: i for i, w in enumerate(sorted(set(words)), 1)}
    return [rank[w] for w in words]


def _extension(w: list[int], a: int, b: int, m: int) -> int:
    """How many words match from a and from b > a on, where m are known to; w ends with a
    letter of its own."""
    n = len(w)
    while w[a + m] == w[b + m]:
        m += 1
        if not m & 63:  # long matches by slices that double
            step = 64
            while b + m + step < n and w[a + m: a + m + step] == w[b + m: b + m + step]:
                m += step
                step *= 2
    return m


def lyndon_matches(w: list[int]) -> dict[int, tuple[int, int]]:
    """start -> (end, match) of the longest Lyndon words w[start:end] whose suffix
    agrees with the suffix at end over match > 0 words.  w ends with 0, smaller than all others."""
    chain: list[int] = []
    below: dict[int, tuple[int, int]] = {}  # position -> (previous smaller suffix, match > 0)
    edges: dict[int, tuple[int, int]] = {}
    first = shift = reach = 0  # w[x] == w[x - shift] from first up to reach
    for i in range(len(w) - 1):
        c = w[i]
        match, before = 0, -1
        while chain:
            j = chain[-1]
            b = w[j]
            if b < c:
                match = 0
                break
            if b == c:
                along = below.get(before, (-1, 0))[1] if before >= 0 else match
                if match != along:
                    match = min(match, along)
                else:
                    if j >= first and i < reach:
                        x, y = j - shift, i - shift
                        was = below.get(y, _NONE)
                        if was[0] != x:
                            was = edges.get(x, _NONE)
                            if was[0] != y:
                                was = _NONE
                        match = max(match, min(was[1], reach - i))
                        exact = was[1] and i + was[1] < reach
                    else:
                        exact = False
                    if not exact:
                        match = _extension(w, j, i, match)
                if i + match > reach:
                    first, shift, reach = i, i - j, i + match
                if w[j + match] < w[i + match]:
                    below[i] = j, match
                    break
                edges[j] = i, match
            else:
                match = 0
            before = j
            chain.pop()
        chain.append(i)
    return edges


def runs_of(w: list[int], least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of w (letters from 1 on) with at least least letters and
    power (2 or more) times their period, by start, then period."""
    most = max(w, default=0) + 1
    found = set()
    for letters in ([*w, 0], [*(most - c for c in w), 0]):
        edges = lyndon_matches(letters)
        for start, (end, match) in edges.items():
            period = end - start
            if match <= (power - 2) * period:
                continue
            before = edges.get(start - period, (-1, 0))
            if before[0] == start and before[1] >= period:
                continue  # the root before it is the same run's
            left = 0
            while left < start and letters[start - left - 1] == letters[end - left - 1]:
                left += 1
            length = left + period + match
            if length >= least and length >= power * period:
                found.add((start - left, length, period))
    return sorted(found)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period: start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, *, least: int = LEAST, power: int = POWER, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """For every row of docs (doc_id, text): the number of words, the runs of at least least words and
    power times their period, by start and period, and the text without what repeats
    (words joined by single spaces).  rewrite(doc_id, words) may give other words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            sizes, found, texts = [], [], []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), utf8_values(batch.column("text")), strict=True):
                words = raw.split()
                if rewrite is not None:
                    words = rewrite(doc, words)
                runs = runs_of(ranks(words), least, power)
                sizes.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                texts.append(b" ".join(collapsed(words, runs)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(rows, SCHEMA)


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the contract: in a tenth of the documents, by the id's crc32, the rest of the
    text from some word on is made to repeat."""
    h = zlib.crc32(b"" if doc is None else str(doc).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a: a + p]
    return words[:a] + (root * ((n - a) // p + 1))[: n - a]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: runs of the words of all documents."""
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted)
    # of equal exponents the earlier in the order by start and period stays
    best = F.aggregate("runs", F.element_at("runs", 1), lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[k].alias(k) for k in ("start", "length", "period")),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
