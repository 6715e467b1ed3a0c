"""Operator 5: quality by importance resampling with hashed n-gram models.

Two bag-of-n-grams models over BUCKETS hashed features, one of target text
(documents labelled of good quality) and one of all raw text, give a document
the log weight  sum over its n-grams of log p_target - log p_raw.  Adding Gumbel
noise to the log weights and taking the k largest draws k documents without
replacement in proportion to their weights.

Features are tokens (runs of letters and digits, or of other marks) and pairs of
neighbours; a token that repeats its neighbour counts as one pair of its own,
whatever the token is.

Raw counts are those of all documents.  The target model is fitted on about
TARGET labelled documents, chosen by a hash of doc_id; k is the share of good
labels (two standard errors added, so that the draw doesn't run short of clean
documents) of the number of documents.  The k-th largest key is found by
counting keys in ranges (BINS numbers to the driver at a time), so nothing is
sorted or collected.  The noise is a function of doc_id.

Edge cases: null and empty texts have log weight 0; without labels every
document is taken; keys that tie with the k-th are taken too; rows that repeat a
doc_id share its noise and each get their row; a null doc_id is hashed as empty
text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone.llm.common import WordCache, bounded_sample, free_name, id_text, kept_rows, slices, table, utf8_values, written

BUCKETS = 1 << 14
TARGET = 20_000
BINS = 1024
SCALE = 1_000_000
#: least log ratio of the smoothed models in counts
SMOOTH = 1.0

_TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+")


def _word(word: bytes) -> bytes:
    return np.array([xxhash.xxh3_64_intdigest(t) >> 32 for t in _TOKENS.findall(word)], np.uint32).tobytes()


_WORDS = WordCache(_word)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds): the buckets of the n-grams of each text."""
    _WORDS.trim()
    raw = [b"".join(map(_WORDS.__getitem__, t.split())) for t in texts]
    n = np.array([len(r) // 4 for r in raw], np.int64)
    h = np.frombuffer(b"".join(raw), np.uint32)
    ends = np.cumsum(n)
    one = h & np.uint32(BUCKETS - 1)
    pair = (h[:-1] * np.uint32(0x9E3779B1) + h[1:]) * np.uint32(0x85EBCA6B) >> np.uint32(32 - 14)
    pair[h[:-1] == h[1:]] = 0
    both = np.empty(2 * len(h), np.uint32)
    both[0::2] = one
    both[1:-1:2] = pair
    # the last token of a text has no neighbour: its pair's place takes the token again
    last = ends[n > 0] - 1
    both[2 * last + 1] = one[last]
    return both, np.concatenate([[0], 2 * ends])


def counts(docs: DataFrame, target_ids: np.ndarray) -> np.ndarray:
    """Two rows of BUCKETS counts: target documents' n-grams and all documents'."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(target_ids))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        ids = sent.value
        for batch in slices(batches, "text", 1 << 20):
            got, bounds = features(utf8_values(batch.column("text")))
            total += np.bincount(got, minlength=BUCKETS)
            key = batch.column("doc_id").fill_null(-1).to_numpy()
            chosen = np.isin(key, ids) & ~batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            if chosen.any():
                target += np.bincount(got[np.repeat(chosen, np.diff(bounds))], minlength=BUCKETS)
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array(target[live]), pa.array(total[live])], ["bucket", "target", "raw"])

    summed = _slim(docs).mapInArrow(rows, "bucket int, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    out = np.zeros((2, BUCKETS))
    for r in summed.collect():  # BUCKETS rows at most
        out[:, r["bucket"]] = r["target"], r["raw"]
    return out


def ratios(found: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket."""
    p = (found + SMOOTH) / (found + SMOOTH).sum(axis=1, keepdims=True)
    return np.log(p[0]) - np.log(p[1])


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _weights(ratio: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """The log weight of each text, the same whatever texts stand beside it."""
    got, bounds = features(texts)
    value = np.append(ratio[got], 0.0)
    return np.where(np.diff(bounds) > 0, np.add.reduceat(value, bounds[:-1]), 0.0) if len(texts) else np.zeros(0)


def log_weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, log_weight for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            weight = _weights(sent.value, utf8_values(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weight)], ["doc_id", "log_weight"])

    return _slim(docs).mapInArrow(rows, "doc_id long, log_weight double")


def gumbel(seed: int):
    """Gumbel noise as a function of doc_id."""
    u = (F.pmod(F.xxhash64(id_text(), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def threshold(keys: DataFrame, k: int) -> int:
    """The k-th largest of the long column key, found by counting in ranges."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not n or k >= n:
        return low if n else 0
    above = 0
    while low < high:
        step = (high - low) // BINS + 1
        part = keys.where(F.col("key").between(low, high)).groupBy(F.floor((F.col("key") - low) / step).cast("long").alias("bin")).count()
        for b, m in sorted(((r[0], r[1]) for r in part.collect()), reverse=True):
            if above + m >= k:
                low, high = low + b * step, min(high, low + (b + 1) * step - 1)
                break
            above += m
    return low


class Draw:
    """What resampled() and accepted() share: the models, the weights and the k-th key."""

    def __init__(self, docs: DataFrame, labels: DataFrame, seed: int):
        rated = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        n, good = rated.agg(F.count("*"), F.sum((F.col("quality") == 1).cast("long"))).first()
        chosen = np.array([r[0] for r in bounded_sample(rated.where("quality = 1"), TARGET, seed).select("doc_id").collect()], np.int64)
        self.ratio = ratios(counts(docs, chosen)) if len(chosen) else np.zeros(BUCKETS)
        self.rows = written(log_weights(docs, self.ratio).withColumn("key", F.floor((F.col("log_weight") + gumbel(seed)) * SCALE).cast("long")), "weights")
        share = min(1.0, good / n + 2 * math.sqrt(good / n * (1 - good / n) / n)) if n else 1.0
        k = math.ceil(share * self.rows.count())
        self.least = threshold(self.rows, k) if k else 1 << 62


def resampled(docs: DataFrame, labels: DataFrame, *, seed: int = 5) -> DataFrame:
    """doc_id, log_weight, key (with noise, in millionths) and selected for every row
    of docs (doc_id, text); labels: doc_id, quality (1 is good)."""
    draw = Draw(docs, labels, seed)
    return draw.rows.withColumn("selected", F.col("key") >= draw.least)


def accepted(docs: DataFrame, labels: DataFrame, *, seed: int = 5) -> DataFrame:
    """The rows of docs that resampled() selects, with all their columns.  Weights are
    computed again beside the texts, so those aren't shuffled."""
    draw = Draw(docs, labels, seed)
    ratio, least, noise = docs.sparkSession.sparkContext.broadcast(draw.ratio), draw.least, free_name(docs, "noise")

    def keep(batch: pa.RecordBatch) -> np.ndarray:
        weight = _weights(ratio.value, utf8_values(batch.column("text")))
        return np.floor((weight + batch.column(noise).to_numpy()) * SCALE) >= least

    return kept_rows(docs.withColumn(noise, gumbel(seed)), keep).drop(noise)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents resampled towards those labelled good."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
