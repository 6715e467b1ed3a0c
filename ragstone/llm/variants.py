"""Operator 13: spelling variants by a symmetric-delete join.

Words are counted first, so that a word is one row however often it occurs.  Every
word then emits itself and its distinct single deletions as keys; words that share a
key are compared, and those at an exact distance of one (a code point inserted,
deleted or replaced) are near.  Two words at distance one always share a key: the shorter
one itself, or what both are without the replaced code point.  A key of k
code points is shared by at most (k + 1) times the alphabet's size of words plus
itself, whatever the corpus.

A word's form is its most frequent near word, if that is FACTOR times as frequent at
least.  Frequencies grow along forms by that factor, so chains are short and end; roots are
found by joining every word's root with the root of that root until none changes, which
halves the chains each time.  Each step's table is written, so a lost executor
costs one step.

Edge cases: null and empty texts have no words; long texts are read whole; rows
that repeat a doc_id count each; a null doc_id counts as the empty text where the
crc32 is taken; of near words that are equally frequent the first in code-point order is
the form; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone.llm.common import slices, table, utf8_values, written

#: what a word is made of, its least code points and occurrences, and how much
#: more frequent a form is
LETTERS, SIZE, TIMES, FACTOR = r"[A-Za-zÀ-ÿ]", 7, 2, 10
_LOWER = {c: c + 32 for c in range(65, 91)}
#: distinct words that a task holds before it sends their counts on
MOST_WORDS = 200_000


def misspelt(doc: int | None, word: str) -> str:
    """The word as the contract reads it: one in 31 words of a document, by the crc32 of
    both, loses a code point."""
    h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, *, size: int = SIZE, times: int = TIMES, rewrite: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """word, n: how often each word of at least size code points occurs in docs (doc_id,
    text), if that is at least times.  rewrite(doc_id, word) may give another word, no longer."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def sent(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(f"{LETTERS}{{{size},}}").findall
        counts: Counter = Counter()
        for batch in slices(batches, "text", 2 << 20):
            for doc, raw in zip(batch.column("doc_id").to_pylist(), utf8_values(batch.column("text")), strict=True):
                found = Counter(find(raw.decode().translate(_LOWER)))
                if rewrite is None:
                    counts.update(found)
                    continue
                for word, n in found.items():
                    word = rewrite(doc, word)
                    if len(word) >= size:
                        counts[word] += n
            if len(counts) > MOST_WORDS:
                yield sent(counts)
                counts.clear()
        yield sent(counts)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, n_near_word: all ordered pairs of words (word, n; distinct) at distance one, with the
    second one's n."""
    at = F.sequence(F.lit(1), F.length("word"))
    shorter = F.transform(at, lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    keys = words.select("word", "n", F.explode(F.array_distinct(F.concat(F.array("word"), shorter))).alias("key"))
    other = keys.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "key")
    pairs = keys.join(other, "key").where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    return pairs.groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n of words (word, n)."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    chosen = -F.col("best.less") >= factor * F.col("n")
    return words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n"),
    )


def roots(linked: DataFrame) -> DataFrame:
    """word, root of linked (word, form): the last of each word's forms, if it has any."""
    now = written(linked.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n; distinct)."""
    linked = written(forms(words, factor), "forms")
    return linked.join(roots(linked), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: variants among the words of all documents."""
    words = written(word_counts(table(spark, sf_dir, "documents"), rewrite=misspelt), "words")
    return spelling_variants(words)
