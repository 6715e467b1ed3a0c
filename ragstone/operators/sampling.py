"""Repeatable samples: rows in the order of a hash of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragstone.session import written


def place(key: str = "id", seed: int = 42) -> Column:
    """The order of a sample; the same in any engine that has md5."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


#: places of hexadecimal digits that a count adds to a prefix, and rows that the driver may take
DIGITS, MOST_ROWS = 4, 10_000


def edge(rows: DataFrame, n: int, key: str = "id", seed: int = 42) -> tuple[str, object] | None:
    """(place, key) of the n-th row in the order of a sample; None if there are no more than n.

    Rows are counted by the first digits of their place, at most 16 ** DIGITS numbers; of
    those with the digits that the n-th falls on, the next digits are counted, until few
    enough rows are left to be looked at.  No row is sorted or moved."""
    rows = rows.select(F.coalesce(place(key, seed), F.lit("")).alias("place"), F.col(key).alias("key"))
    prefix, left = "", n
    while True:
        some = rows.where(F.col("place").startswith(prefix))
        count = dict(some.groupBy(F.substring("place", 1, len(prefix) + DIGITS).alias("p")).count().collect())
        if not prefix and sum(count.values()) <= n:
            return None
        for p in sorted(count):
            if count[p] >= left:
                break
            left -= count[p]
        here = rows.where(F.col("place").startswith(p) if p else F.col("place") == p)
        if not p or len(p) >= 32:  # copies of one key, or null keys
            return tuple(here.first())
        if count[p] <= MOST_ROWS:
            return tuple(here.orderBy("place", "key").take(left)[-1])
        prefix = p


def hash_sample(rows: DataFrame, n: int, key: str = "id", seed: int = 42) -> DataFrame:
    """The first n rows by hash of their id, as a filter; rows that repeat the last one's id
    all stay."""
    last = edge(rows, n, key, seed) if n > 0 else None
    if n <= 0:
        return rows.limit(0)
    if last is None:
        return rows
    at = F.coalesce(place(key, seed), F.lit(""))
    return rows.where((at < last[0]) | ((at == last[0]) & (F.col(key) <= F.lit(last[1]) if last[1] is not None else F.lit(True))))


def head(rows: DataFrame, n: int, key: str = "id") -> DataFrame:
    return rows.orderBy(key).limit(n)


def smart_sample(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, most: int = 3000, seed: int = 42) -> DataFrame:
    """Every document relevant to a query, and others by hash up to most in all; the
    relevant ones all stay even if they are more.  A column relevant tells them apart.
    The judgments are worked out once, and the others are a filter on the hash (edge())."""
    wanted = qrels.join(queries.select(F.col("id").alias("query_id")), "query_id", "left_semi").select(F.col("corpus_id").alias("id")).distinct()
    wanted = written(wanted, "relevant")
    relevant = corpus.join(wanted, "id", "left_semi").withColumn("relevant", F.lit(True))
    others = corpus.join(wanted, "id", "left_anti")
    room = max(most - relevant.count(), 0)
    return relevant.unionByName(hash_sample(others, room, "id", seed).withColumn("relevant", F.lit(False)))


def demo_document(corpus: DataFrame, among: int = 20, least: int = 2000, joined: int = 5) -> DataFrame:
    """One row, text: the first of the first documents that is long, else the first few together."""
    first = head(corpus, among).select("id", "text")
    long = first.where(F.length("text") > least).agg(F.min_by("text", "id").alias("long"))
    few = head(first, joined).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n\n").alias("few"))
    return long.join(F.broadcast(few)).select(F.coalesce("long", "few").alias("text"))
