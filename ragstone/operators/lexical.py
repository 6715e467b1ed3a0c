"""BM25 (Okapi) over an inverted index in tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragstone.functions.text import words
from ragstone.operators.blocks import Best, paired
from ragstone.operators.inverted import BLOCK_DOCS, BLOCK_QUERIES, BLOCK_TERMS, BLOCK_TOKENS, EPSILON, K1, B, Index, gathered
from ragstone.operators.ranking import PLACES, top_k
from ragstone.session import BLOCK_FILES, written


class Lexical(Protocol):
    """A lexical model fitted elsewhere: one score for each document it was fitted on."""

    def get_scores(self, tokens: list[str]) -> list[float]: ...


def frequencies(docs: DataFrame, tokenize: Callable[[Column], Column] = words) -> DataFrame:
    """token, df, length of docs (id, text): documents that hold the token and their
    lengths' sum.  The row without token has the number of documents and of all
    tokens.  One pass: a document gives its distinct tokens and that one row."""
    tokens = docs.select(tokenize(F.col("text")).alias("tokens"))
    marked = F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))
    return tokens.select(F.size("tokens").alias("length"), F.explode(marked).alias("token")).groupBy("token").agg(F.count("*").alias("df"), F.sum("length").alias("length"))


def postings(docs: DataFrame, tokenize: Callable[[Column], Column] = words, only: DataFrame | None = None) -> DataFrame:
    """id, token, tf, length of docs (id, text); only those tokens, if any are given."""
    tokens = docs.select("id", tokenize(F.col("text")).alias("tokens"))
    rows = tokens.select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("token"))
    if only is not None:
        rows = rows.join(only.select("token").distinct(), "token", "left_semi")
    return rows.groupBy("id", "token", "length").agg(F.count("*").alias("tf"))


def statistics(counted: DataFrame) -> DataFrame:
    """One row of frequencies(): n documents, mean_length."""
    return counted.where("token is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), (F.sum("length") / F.sum("df")).alias("mean_length"))


def inverse_frequencies(counted: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """token, df, idf of frequencies().  A negative idf is replaced by epsilon times the
    mean of all raw ones."""
    df = counted.where("token is not null").select("token", "df").join(F.broadcast(statistics(counted).select("n")))  # one row
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(queries: DataFrame, docs: DataFrame, *, tokenize: Callable[[Column], Column] = words, k1: float = K1, b: float = B, epsilon: float = EPSILON, candidates: DataFrame | None = None) -> DataFrame:
    """query_id, corpus_id, score of every pair that shares a token (others score 0), from an inverted
    index of the corpus (inverted.py), whose tasks sum the scores of their documents.

    candidates (query_id, corpus_id) restricts the pairs: only their documents are
    tokenised for postings, and only the pairs are summed, by a join.  Statistics are those of the
    whole corpus.  Only postings of the queries' tokens are made."""
    if candidates is None:
        return Index.build(docs, tokenize).scores(queries, k1=k1, b=b, epsilon=epsilon)
    counted = written(frequencies(docs, tokenize), "frequencies")  # for the sizes, for the mean, and for the terms that are asked
    asked = queries.select(F.col("id").alias("query_id"), F.explode(tokenize(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    idf = inverse_frequencies(counted, epsilon).join(asked.select("token").distinct(), "token", "left_semi")
    docs = docs.join(candidates.select(F.col("corpus_id").alias("id")).distinct(), "id", "left_semi")
    weighed = postings(docs, tokenize, asked).join(idf.select("token", "idf"), "token").join(F.broadcast(statistics(counted).select("mean_length")))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    parts = weighed.select("token", F.col("id").alias("corpus_id"), part.alias("part"))
    # a candidate pair meets its query's tokens, then the document's
    wanted = candidates.select("query_id", "corpus_id").distinct().join(asked, "query_id")
    pairs = wanted.join(parts, ["corpus_id", "token"])
    return pairs.groupBy("query_id", "corpus_id").agg(F.sum(F.col("part") * F.col("times")).alias("score"))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int | None = 100, *, tokenize: Callable[[Column], Column] = words, candidates: DataFrame | None = None, **options) -> DataFrame:
    """bm25() ranked, the k best of each query, from an inverted index of the corpus
    (inverted.py); with candidates from bm25(), which makes their pairs only.  With k None
    every document is ranked for every query, which is the whole product: those that
    share no token score 0."""
    if candidates is None:
        index = Index.build(docs, tokenize)
        return top_k(index.scores(queries, every=True, **options), None) if k is None else index.search(queries, k, **options)
    scores = bm25(queries, docs, tokenize=tokenize, candidates=candidates, **options)
    if k is None:
        every = queries.select(F.col("id").alias("query_id")).distinct().join(docs.select(F.col("id").alias("corpus_id")).distinct())
        scores = every.join(scores, ["query_id", "corpus_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return top_k(scores, k)


def model_topk(queries: DataFrame, ids: list, model: Lexical, k: int | None = 100, tokenize: Callable[[Column], Column] = words) -> DataFrame:
    """query_id, corpus_id, score, rank by an injected model: ids are the documents that
    it was fitted on, in its order.  Model and ids travel once to each task."""
    number = isinstance(ids[0], int) if len(ids) else True
    sent = queries.sparkSession.sparkContext.broadcast((np.array(ids), model))
    schema = f"query_id {dict(queries.dtypes)['id']}, corpus_id {'long' if number else 'string'}, score double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, own = sent.value
        for f in frames:
            for q, tokens in zip(f["query_id"], f["tokens"], strict=True):
                score = np.asarray(own.get_scores(list(tokens)), float)
                r = np.round(score, PLACES)
                edge = np.partition(r, len(r) - k)[len(r) - k] if k is not None and k < len(r) else -np.inf
                at = np.flatnonzero(r >= edge)
                yield pd.DataFrame({"query_id": q, "corpus_id": names[at], "score": score[at]})

    return top_k(queries.select(F.col("id").alias("query_id"), tokenize(F.col("text")).alias("tokens")).mapInPandas(run, schema), k)


def _token_blocks(rows: DataFrame, tokenize: Callable[[Column], Column], prefix: str, tokens: int, most: int) -> DataFrame:
    """rows (id, text) in blocks: one row with their ids, numbers of tokens, and tokens."""
    kind = dict(rows.dtypes)["id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, "tokens", tokens, most):
            part = part.combine_chunks()
            ids, lists = part.column("id").chunk(0), part.column("tokens").chunk(0)
            columns = ids, pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32()), lists.flatten()
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], [f"{prefix}ids", f"{prefix}sizes", f"{prefix}tokens"])

    return rows.select("id", tokenize(F.col("text")).alias("tokens")).mapInArrow(pack, f"{prefix}ids array<{kind}>, {prefix}sizes array<int>, {prefix}tokens array<string>")


def _lists(row: dict, prefix: str) -> list[list[str]]:
    words_, ends = row[f"{prefix}tokens"].values.to_pylist(), np.cumsum(row[f"{prefix}sizes"].values.to_numpy()).tolist()
    return [words_[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def shard_topk(queries: DataFrame, docs: DataFrame, fit: Callable[[list[list[str]]], Lexical], k: int = 100, tokenize: Callable[[Column], Column] = words, *, tokens: int = BLOCK_TOKENS, most: int = BLOCK_DOCS) -> DataFrame:
    """query_id, corpus_id, score, rank by a model that is fitted on shards of the corpus.

    A shard is at most so many documents (id, text) and about so many tokens; fit(token lists of its
    documents) gives its model, whose scores are theirs in order.  A task keeps the k best of
    each query; documents' ids stay with their shard.  What a model takes from its corpus (document
    frequencies, say) it takes from its shard."""
    kind = dict(docs.dtypes)["id"]
    schema = f"query_id {dict(queries.dtypes)['id']}, corpus_id {kind}, score double"
    asked = written(_token_blocks(queries.coalesce(8), tokenize, "query_", BLOCK_TERMS, BLOCK_QUERIES).withColumn("block", F.monotonically_increasing_id()), "query-blocks", BLOCK_FILES)
    n, shards = asked.count(), _token_blocks(docs, tokenize, "", tokens, most)
    if n > 1:
        shards = written(shards, "shards", BLOCK_FILES)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        type_ = None
        for batch in batches:
            for i in range(batch.num_rows):
                one = {name: batch.column(name)[i] for name in batch.schema.names}
                number = one["block"].as_py()
                if number not in held:
                    names = one["query_ids"].values
                    held[number] = names, _lists(one, "query_"), Best(len(names), k)
                _, own, best = held[number]
                type_ = one["ids"].values.type
                ids, model = np.array(one["ids"].values.to_pylist()), fit(_lists(one, ""))
                for q, some in enumerate(own):
                    best.add_matrix(np.asarray(model.get_scores(some), float)[None, :], ids, first=q)
        for names, _, best in held.values():
            if best.parts:
                q, ids, s = best.cut()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(ids, type_), pa.array(s)], ["query_id", "corpus_id", "score"])

    return top_k(paired(shards, asked, n).mapInArrow(rows, schema), k)
