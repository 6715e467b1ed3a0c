"""Encoders: the protocol, a deterministic offline one, and its run over a corpus."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import quote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone.functions.text import prompted, title_text


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


class HashingEncoder:
    """Signed counts of hashed words, scaled to length 1: no model, the same anywhere."""

    def __init__(self, width: int = 64):
        self.width = width

    def sums(self, texts: list[str]) -> list[list[float]]:
        """The counts; those of texts joined by white space are the sums of theirs."""
        out = []
        for t in texts:
            v = [0.0] * self.width
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.width] += 1.0 if h >> 31 else -1.0
            out.append(v)
        return out

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for v in self.sums(texts):
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out


#: the encoders that this process has made, by the names of their WorkerEncoders
_MADE: dict[str, Encoder] = {}


@dataclass
class WorkerEncoder:
    """An encoder that each worker process makes once, when it first needs it: only its name
    and the function that makes it (loads its weights, say) travel with a task."""

    name: str
    make: Callable[[], Encoder]

    def encode(self, texts: list[str]) -> list[list[float]]:
        own = _MADE.get(self.name)
        if own is None:
            own = _MADE[self.name] = self.make()
        return own.encode(texts)


@dataclass
class EncoderPair:
    """One model for queries and another for documents."""

    query: Encoder
    doc: Encoder


def pair_of(encoder: Encoder | EncoderPair | tuple) -> tuple[Encoder, Encoder]:
    """(query model, document model): the two of a pair, or one model twice."""
    both = (encoder.query, encoder.doc) if isinstance(encoder, EncoderPair) else encoder if isinstance(encoder, tuple) else (encoder, encoder)
    if len(both) != 2 or any(isinstance(e, str) or not callable(getattr(e, "encode", None)) for e in both):
        raise TypeError("an encoder, or a pair of them for queries and documents, must be given")
    return both


@dataclass
class EmbeddingStore:
    """Vectors by encoder and text, kept under a path: a text is encoded once, however many
    corpora, chunkings and runs hold it.

    A row of the store is the SHA-256 of a text and its vector, in a folder for each encoder's
    name.  New texts are those whose digest isn't there (an anti join); they are encoded,
    once each, and appended, and the rows then meet the store by their digest.  Two runs that
    add one text at a time leave two equal rows, of which one counts."""

    path: str

    def _folder(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/encoder={quote(name, safe='')}"

    def vectors(self, spark: SparkSession, name: str) -> DataFrame:
        """digest, embedding of all texts that the encoder of this name has seen."""
        schema = "digest string, embedding array<float>"
        try:
            return spark.read.schema(schema).parquet(self._folder(name)).dropDuplicates(["digest"])
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def encode(self, rows: DataFrame, encoder: Encoder, name: str, batch: int = 64) -> DataFrame:
        """encode() of rows (id, text) by way of the store; name stands for the encoder and its
        version."""
        spark = rows.sparkSession
        keyed = rows.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
        new = keyed.groupBy("digest").agg(F.first("text").alias("text")).join(self.vectors(spark, name).select("digest"), "digest", "left_anti")
        made = encode(new.select(F.col("digest").alias("id"), "text"), encoder, batch)
        made.withColumnRenamed("id", "digest").write.mode("append").parquet(self._folder(name))
        return keyed.select("id", "digest").join(self.vectors(spark, name), "digest").select("id", "embedding")


#: rows whose vectors a worker holds before it sends them on
ROWS = 1024


def encode(rows: DataFrame, encoder: Encoder, batch: int = 64) -> DataFrame:
    """id, embedding of rows (id, text).  The encoder travels once to each task (see
    WorkerEncoder for large ones); within a batch texts are taken by length, which models like."""
    schema = f"id {dict(rows.dtypes)['id']}, embedding array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (f.iloc[at: at + ROWS] for f in frames for at in range(0, len(f), ROWS)):
            order = f["text"].fillna("").str.len().sort_values(ascending=False).index
            made: dict = {}
            for at in range(0, len(order), batch):
                part = order[at: at + batch]
                made.update(zip(part, encoder.encode(f.loc[part, "text"].fillna("").tolist()), strict=True))
            yield pd.DataFrame({"id": f["id"], "embedding": [made[i] for i in f.index]})

    return rows.select("id", "text").mapInPandas(run, schema)


def encode_queries(queries: DataFrame, encoder: Encoder, prompt: str | None = None, batch: int = 16) -> DataFrame:
    return encode(queries.select("id", prompted(F.col("text"), prompt).alias("text")), encoder, batch)


def encode_corpus(corpus: DataFrame, encoder: Encoder, prompt: str | None = None, batch: int = 8) -> DataFrame:
    return encode(corpus.select("id", prompted(title_text(F.col("title"), F.col("text")), prompt).alias("text")), encoder, batch)
