"""BM25 (Okapi) top-k over an inverted index of document blocks, with upper bounds.

`Index.build` tokenises the corpus once.  Each task turns its documents into blocks of
about BLOCK_TOKENS tokens: a dictionary of the block's terms, and each term's postings (document,
count).  Blocks are a table, so an index can be kept and opened again; nothing but each
block's terms with their document counts is shuffled, for the statistics.

`Index.search` weighs the queries' terms, packs the queries into blocks and meets them with
the index (blocks.py).  In a block of documents every term has a greatest impact; the sum of
its terms' greatest impacts bounds what a query can score there.  A query that has its k
documents passes over a block whose bound doesn't reach the k-th of them, and elsewhere
takes candidates from the terms without which no document can reach it only (MaxScore); the
other terms are looked up for those candidates, as long as they may still get there.  So a
stop word's list is read for the documents that rarer words point to.  A task sends on k
rows of a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone.functions.text import words
from ragstone.operators.blocks import Best, cuts, paired
from ragstone.operators.ranking import PLACES, top_k
from ragstone.session import BLOCK_FILES, shared_path, written

K1, B, EPSILON = 1.5, 0.75, 0.25
BLOCK_TOKENS, BLOCK_DOCS = 1_000_000, 20_000
#: queries, and their terms, in a block of queries at most
BLOCK_QUERIES, BLOCK_TERMS = 4096, 500_000
#: scores of a batch that a task sends on, about
SCORES = 65_536


def _columns(kind: str) -> str:
    return f"ids array<{kind}>, lengths array<int>, terms array<string>, df array<int>, docs array<int>, tf array<int>"


def _block(ids: pa.Array, tokens: pa.ListArray) -> list[pa.Array]:
    """One row of an index: the postings of some documents."""
    n = len(ids)
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), lengths)
    key, tf = np.unique(key, return_counts=True)
    terms = len(coded.dictionary)

    def one(values, kind=None) -> pa.Array:
        values = values if isinstance(values, pa.Array) else pa.array(values, kind)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    df = np.bincount(key // n, minlength=terms) if n else np.zeros(0, np.int64)
    return [one(ids), one(lengths, pa.int32()), one(coded.dictionary), one(df, pa.int32()), one(key % max(n, 1), pa.int32()), one(tf, pa.int32())]


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int, rows: int) -> Iterator[pa.Table]:
    """The rows in tables whose list column has about most values; a longer single list stays
    whole."""
    parts: list[pa.RecordBatch] = []
    held = count = 0
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = cuts(sizes, most, rows)
        for a, b in zip(ends, ends[1:], strict=False):
            if a == b:
                continue
            n = int(sizes[a:b].sum())
            if parts and (held + n > most or count + b - a > rows):
                yield pa.Table.from_batches(parts)
                parts, held, count = [], 0, 0
            parts.append(batch.slice(a, b - a))
            held, count = held + n, count + b - a
    if parts:
        yield pa.Table.from_batches(parts)


@dataclass
class Index:
    """Blocks of a corpus, and its size."""

    blocks: DataFrame
    tokenize: Callable[[Column], Column]
    n: int
    length: int
    df: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, tokenize: Callable[[Column], Column] = words, path: str | None = None) -> Index:
        """The index of docs (id, text), stored under path."""
        spark, kind = docs.sparkSession, dict(docs.dtypes)["id"]
        path = path or shared_path(spark, "inverted")

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in gathered(batches, "tokens", BLOCK_TOKENS, BLOCK_DOCS):
                part = part.combine_chunks()
                yield pa.RecordBatch.from_arrays(_block(part.column("id").chunk(0), part.column("tokens").chunk(0)), ["ids", "lengths", "terms", "df", "docs", "tf"])

        docs.select("id", tokenize(F.col("text")).alias("tokens")).mapInArrow(rows, _columns(kind)).write.options(**BLOCK_FILES).parquet(path)
        return cls.open(spark, path, tokenize)

    @classmethod
    def open(cls, spark: SparkSession, path: str, tokenize: Callable[[Column], Column] = words) -> Index:
        """A stored index; tokenize must be the one it was built with."""
        blocks = spark.read.parquet(path)
        total = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
        n, length = blocks.agg(F.sum(F.size("ids")), F.sum(total)).first()
        return cls(blocks, tokenize, n or 0, length or 0)

    def inverse_frequencies(self, epsilon: float = EPSILON) -> DataFrame:
        """token, df, idf of all terms.  A negative idf is replaced by epsilon times the mean of
        all raw ones."""
        if self.df is None:
            self.df = written(self._frequencies(), "df")  # for the mean, and for the terms that are asked
        df = self.df
        raw = df.withColumn("raw", F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.agg(F.avg("raw")).first()[0]
        return raw.select("token", "df", F.when(F.col("raw") < 0, F.lit(None if mean is None else epsilon * mean)).otherwise(F.col("raw")).alias("idf"))

    def _frequencies(self) -> DataFrame:
        """token, df: in how many documents each term is."""
        each = self.blocks.select(F.explode(F.arrays_zip(F.col("terms").alias("token"), F.col("df").alias("df"))).alias("x"))
        return each.groupBy(F.col("x.token").alias("token")).agg(F.sum("x.df").alias("df"))

    def search(self, queries: DataFrame, k: int = 100, *, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
        """query_id, corpus_id, score, rank: the k best of each query (id, text) among the
        documents that share a token with it."""
        blocks, schema = self._asked(queries, epsilon)
        mean = self.length / self.n if self.length else 1.0

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, _Search] = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    one = {name: batch.column(name)[i] for name in batch.schema.names}
                    number = one["block"].as_py()
                    if number not in held:
                        held[number] = _Search(one, k)
                    held[number].add(one, k1, b, mean)
            for own in held.values():
                yield from own.rows()

        return top_k(paired(self.blocks, blocks, blocks.count()).mapInArrow(rows, schema), k)

    def scores(self, queries: DataFrame, *, every: bool = False, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
        """query_id, corpus_id, score of all documents that share a token with a query; with every
        of all documents, where the others score 0.  A document's postings are in one block, so
        a task sums its scores and no posting is shuffled."""
        blocks, schema = self._asked(queries, epsilon, every)
        mean = self.length / self.n if self.length else 1.0

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, _Search] = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    one = {name: batch.column(name)[i] for name in batch.schema.names}
                    number = one["block"].as_py()
                    if number not in held:
                        held[number] = _Search(one, 1)
                    yield from held[number].all(one, k1, b, mean, every)

        return paired(self.blocks, blocks, blocks.count()).mapInArrow(rows, schema)

    def _asked(self, queries: DataFrame, epsilon: float, every: bool = False) -> tuple[DataFrame, str]:
        """Blocks of queries with their terms' weights (with every also queries without any), stored,
        and the schema of scores."""
        kinds = dict(queries.dtypes)["id"], self.blocks.schema["ids"].dataType.elementType.simpleString()
        schema = f"query_id {kinds[0]}, corpus_id {kinds[1]}, score double"
        asked = queries.select(F.col("id").alias("query_id"), F.explode(self.tokenize(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
        weighed = asked.join(self.inverse_frequencies(epsilon), "token").select("query_id", "token", (F.col("times") * F.col("idf")).alias("weight"))
        lists = weighed.groupBy("query_id").agg(F.collect_list(F.struct("token", "weight")).alias("x")).select("query_id", F.col("x.token").alias("tokens"), F.col("x.weight").alias("weights"))

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in gathered(batches, "tokens", BLOCK_TERMS, BLOCK_QUERIES):
                part = part.combine_chunks()
                columns = part.column("query_id").chunk(0), pc.list_value_length(part.column("tokens").chunk(0)).cast(pa.int32()), part.column("tokens").chunk(0).flatten(), part.column("weights").chunk(0).flatten()
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], ["query_ids", "sizes", "tokens", "weights"])

        if every:
            lists = queries.select(F.col("id").alias("query_id")).distinct().join(lists, "query_id", "left").select("query_id", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in lists.dtypes[1:]))
        # few tasks make full blocks
        blocks = lists.coalesce(8).mapInArrow(packed, f"query_ids array<{kinds[0]}>, sizes array<int>, tokens array<string>, weights array<double>")
        blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()), "query-blocks", BLOCK_FILES)
        return blocks, schema


class _Search:
    """A block of queries on its way through the documents of a task."""

    def __init__(self, row: dict, k: int):
        self.k, self.names = k, row["query_ids"].values
        sizes = row["sizes"].values.to_numpy()
        self.ends = np.cumsum(sizes)
        terms = row["tokens"].values.dictionary_encode()
        self.terms, self.term = terms.dictionary, terms.indices.to_numpy(zero_copy_only=False)
        self.weight = row["weights"].values.to_numpy(zero_copy_only=False)
        self.best = Best(len(sizes), k)
        self.type = None

    def _lists(self, row: dict, k1: float, b: float, mean: float) -> tuple[np.ndarray, ...]:
        """The block's lists of the terms that are asked for, one after the other: documents,
        impacts, where each starts, and each term's list (-1: none)."""
        df = row["df"].values.to_numpy()
        lengths = row["lengths"].values.to_numpy()
        here = pc.index_in(self.terms, value_set=row["terms"].values)
        local = pc.fill_null(here, -1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(local >= 0)
        first, n = (np.cumsum(df) - df)[local[known]], df[local[known]].astype(np.int64)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        docs, tf = row["docs"].values.to_numpy()[at], row["tf"].values.to_numpy()[at]
        impact = tf * (k1 + 1) / (tf + (k1 * (1 - b + b * lengths / mean))[docs])
        slot = np.full(len(self.terms), -1)
        slot[known] = np.arange(len(known))
        return docs, impact, np.concatenate([[0], np.cumsum(n)]), slot

    def all(self, row: dict, k1: float, b: float, mean: float, every: bool) -> Iterator[pa.RecordBatch]:
        """The scores of one block of documents."""
        ids = row["ids"].values
        docs, impact, cut, slot = self._lists(row, k1, b, mean)
        slots, start, out, held = slot[self.term], 0, [], 0

        def batch() -> pa.RecordBatch:
            i, at, score = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([self.names.take(pa.array(i)), ids.take(pa.array(at)), pa.array(score)], ["query_id", "corpus_id", "score"])

        for q, end in enumerate(self.ends.tolist()):
            own, weight = slots[start:end], self.weight[start:end]
            start = end
            have = np.flatnonzero(own >= 0)
            found, score = np.arange(0), np.zeros(0)
            if len(have):
                found, score = self._must(np.arange(len(have)), own[have], weight[have], cut, docs, impact, len(ids))
            if every:
                whole = np.zeros(len(ids))
                whole[found] = score
                found, score = np.arange(len(ids)), whole
            if len(found):
                out.append((np.full(len(found), q), found, score))
                held += len(found)
            if held >= SCORES:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()

    def add(self, row: dict, k1: float, b: float, mean: float) -> None:
        """One block of documents."""
        ids = row["ids"].values
        self.type = ids.type
        names = np.array(ids.to_pylist())
        docs, impact, cut, slot = self._lists(row, k1, b, mean)
        if len(cut) == 1:
            return
        most, least = np.maximum.reduceat(impact, cut[:-1]), np.minimum.reduceat(impact, cut[:-1])
        edge, out = self.best.edge, []
        slots, start = slot[self.term], 0
        for q, end in enumerate(self.ends.tolist()):
            own, weight = slots[start:end], self.weight[start:end]
            start = end
            have = own >= 0
            if not have.any():
                continue
            own, weight = own[have], weight[have]
            bound = np.maximum(np.where(weight > 0, weight * most[own], weight * least[own]), 0)
            floor = edge[q] - 2 * 10.0**-PLACES  # rounding never hides a document
            if bound.sum() < floor:
                continue
            order = np.argsort(bound, kind="stable")
            rest = np.cumsum(bound[order])
            lazy = min(int(np.searchsorted(rest, floor)), len(rest) - 1)  # these terms together don't reach it
            found, score = self._must(order[lazy:], own, weight, cut, docs, impact, len(ids))
            for t in order[:lazy][::-1].tolist():
                keep = score + rest[lazy - 1] >= floor
                found, score, lazy = found[keep], score[keep], lazy - 1
                a, z = cut[own[t]], cut[own[t] + 1]
                place = np.minimum(np.searchsorted(docs[a:z], found), z - a - 1) + a
                score = score + np.where(docs[place] == found, weight[t] * impact[place], 0.0)
            r = np.round(score, PLACES)
            low = edge[q]
            if len(r) > self.k:
                low = max(low, np.partition(r, len(r) - self.k)[len(r) - self.k])
            keep = np.flatnonzero(r >= low)
            if len(keep):
                out.append((np.full(len(keep), q), names[found[keep]], score[keep]))
        if out:
            self.best.add(*(np.concatenate(x) for x in zip(*out, strict=True)))
            self.best.cut()

    @staticmethod
    def _must(some: np.ndarray, own: np.ndarray, weight: np.ndarray, cut: np.ndarray, docs: np.ndarray, impact: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of some terms and what these give them."""
        lists = [slice(cut[own[t]], cut[own[t] + 1]) for t in some.tolist()]
        if len(lists) == 1:
            return docs[lists[0]], weight[some[0]] * impact[lists[0]]
        at = np.concatenate([docs[x] for x in lists])
        part = np.concatenate([weight[t] * impact[x] for t, x in zip(some.tolist(), lists, strict=True)])
        score, seen = np.bincount(at, part, n), np.zeros(n, bool)
        seen[at] = True
        found = np.flatnonzero(seen)
        return found, score[found]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.best.parts:
            i, ids, s = self.best.cut()
            yield pa.RecordBatch.from_arrays([self.names.take(pa.array(i)), pa.array(ids, self.type), pa.array(s)], ["query_id", "corpus_id", "score"])
