"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of a data folder."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows of long texts are read from files, and go to Python, at most so many at a
    time: a column of thousands of long texts is one huge array of the JVM's heap.
    Small shuffles end in few tasks and files, whatever the number of cores."""
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(name)) <= rows:
            spark.conf.set(name, rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only a local
    session without the setting (a test) gets a temporary folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ragstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: rows of numbers that a task writes at least, where there are more tasks than four a core
TASK_ROWS = 2_000_000


def written(df: DataFrame, name: str, rows: float | None = None, options: dict | None = None) -> DataFrame:
    """The rows of df, written to the shared folder and read again: later
    steps start from files, so a lost executor costs no earlier step.  rows, about how
    many rows of numbers the last step goes through, keeps small tables in few tasks
    and files: four for each core, more only if each has TASK_ROWS."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if rows is not None:
        df = df.coalesce(max(4 * spark.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS)))
    df.write.options(**options or {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base = f"_{base}"
    return base


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column holds about limit bytes at most
    (a longer single value stays whole)."""
    for batch in batches:
        col = batch.column(column)
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > limit or i - start >= 4096):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def utf8_values(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


class WordCache(dict):
    """Word -> value, computed when first met and kept while it fits.

    There are two generations: once this one holds about half of ``most`` bytes, ``trim()``
    makes it the old one and drops the one before; a word met again moves up, so what
    is frequent stays.  ``trim()`` also empties the caches of other operators, which
    a worker process may have served before: memory stays within one budget, whatever the
    vocabulary and the chain of operators.  Caches of one owner share it."""

    #: bytes that the caches of a worker process hold at most, by their own estimate
    BYTES = 192 << 20
    #: of an entry, besides its word and value
    ENTRY = 150
    _live: list[WordCache] = []

    def __init__(self, make=None, share: float = 1.0, owner: str | None = None):
        super().__init__()
        self.make, self.most, self.owner = make, int(share * self.BYTES), owner or object()
        self.old: dict = {}
        self.held = 0

    def keep(self, word, value):
        if len(word) <= 64:
            self[word] = value
            self.held += self.ENTRY + len(word) + getsizeof(value)
        return value

    def keep_all(self, values: dict) -> list:
        """Takes many words with bytes as values; returns those too long to be kept, which
        drop_words() should take out after use."""
        self.update(values)
        self.held += (self.ENTRY + 33) * len(values) + sum(map(len, values)) + sum(map(len, values.values()))
        return [w for w in values if len(w) > 64] if max(map(len, values), default=0) > 64 else []

    def drop_words(self, words: list) -> None:
        for w in words:
            self.pop(w, None)

    def __missing__(self, word):
        value = self.old.get(word)
        return self.keep(word, self.make(word) if value is None else value)

    def unknown(self, words) -> list:
        """Those of distinct words without a value; all others are in this generation
        afterwards."""
        new = [w for w in words if w not in self]
        if not self.old:
            return new
        values = list(map(self.old.get, new))
        found = {w: v for w, v in zip(new, values, strict=True) if v is not None}
        self.update(found)
        self.held += self.ENTRY * len(found) + sum(map(len, found)) + sum(map(getsizeof, found.values()))
        return [w for w, v in zip(new, values, strict=True) if v is None]

    def drop(self) -> None:
        self.clear()
        self.old, self.held = {}, 0

    def trim(self) -> None:
        live = WordCache._live
        for other in [c for c in live if c.owner != self.owner]:
            other.drop()
            live.remove(other)
        if not any(c is self for c in live):
            live.append(self)
        if 2 * self.held > self.most:
            self.old, self.held = dict(self), 0
            self.clear()


def id_text(column: str = "doc_id"):
    """An id as the text that hold-out remainders are taken of; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bounded_sample(df: DataFrame, most: int, seed: int) -> DataFrame:
    """About most rows of df (all, if it has fewer; never over twice as many), chosen
    by a hash of doc_id, for fitting a model."""
    n = df.count()
    if n <= most:
        return df
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 31)) < int((1 << 31) * most / n)
    return df.where(chosen).limit(2 * most)


def kept_rows(df: DataFrame, keep) -> DataFrame:
    """The rows of df for which keep(batch), an array of booleans, holds.  All columns
    stay, and no row is moved."""
    small_batches(df.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            yield batch.filter(pa.array(keep(batch), pa.bool_()))

    return df.mapInArrow(rows, df.schema)


#: bits of an id map, at most
MOST_BITS = 1 << 27


def id_map(ids: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A bit map of fixed size that holds the hashes of the ids, and its number of
    bits: a filter with false hits but no misses."""
    bits, n = 1 << 15, ids.count()
    while bits < MOST_BITS and bits < 16 * n:
        bits *= 2
    spot = id_spot(column, bits)
    pages = ids.where(F.col(column).isNotNull()).select(F.floor(spot / 32768).cast("int").alias("page"), (spot % 32768).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("map"))
    found = dict(pages.collect())  # bits / 8 bytes at most
    return np.frombuffer(b"".join(bytes(found.get(p, bytes(4096))) for p in range(bits // 32768)), np.uint8), bits


def id_spot(column: str, bits: int):
    return F.pmod(F.xxhash64(column), F.lit(bits))


def in_map(mask: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return (mask[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1 == 1
