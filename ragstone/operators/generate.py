"""Messages for a chat model, and answers by an injected client."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragstone.operators.ranking import PLACES

SYSTEM = "You are a helpful assistant."


class Generator(Protocol):
    def generate(self, messages: list[dict]) -> str: ...


class EchoGenerator:
    """Answers with the start of the last message (all of it for chars None); needs no network."""

    def __init__(self, chars: int | None = 80):
        self.chars = chars

    def generate(self, messages: list[dict]) -> str:
        return messages[-1]["content"][: self.chars] if messages else ""


class ChatGenerator:
    """Answers by a chat model.  connect makes the client, once in each task; it must have
    chat.completions.create(model, messages, ...), as the usual clients do.  Streamed
    answers are joined."""

    ARGUMENTS = ("temperature", "top_p", "stream", "max_tokens", "presence_penalty", "frequency_penalty")

    def __init__(self, connect: Callable[[], object], model: str, **arguments):
        unknown = sorted(set(arguments) - set(self.ARGUMENTS))
        if unknown:
            raise ValueError(f"unknown arguments {unknown}; there are {self.ARGUMENTS}")
        self.connect, self.model, self.arguments, self.client = connect, model, arguments, None

    def __getstate__(self):
        return self.__dict__ | {"client": None}

    def generate(self, messages: list[dict]) -> str:
        self.client = self.client or self.connect()
        answer = self.client.chat.completions.create(model=self.model, messages=messages, **self.arguments)
        if self.arguments.get("stream"):
            return "".join(part.choices[0].delta.content or "" for part in answer)
        return answer.choices[0].message.content or ""


def best_documents(run: DataFrame) -> DataFrame:
    """query_id, corpus_id of the highest score."""
    return run.groupBy("query_id").agg(F.max_by("corpus_id", F.struct(F.round("score", 9), "corpus_id")).alias("corpus_id"))


def default_messages(run: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, messages: a system message, and the best document with the question."""
    text = F.concat(F.lit("Document: "), F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")), F.lit("\nGenerate an answer to the question from the document.\nQuestion: "), F.col("q"))
    rows = best_documents(run).join(corpus.select(F.col("id").alias("corpus_id"), "title", "text"), "corpus_id").join(queries.select(F.col("id").alias("query_id"), F.col("text").alias("q")), "query_id")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return rows.select("query_id", F.array(message("system", F.lit(SYSTEM)), message("user", text)).alias("messages"))


def custom_messages(run: DataFrame, queries: DataFrame, corpus: DataFrame, prepare: Callable[[str, list[tuple[str, float]]], list[dict]]) -> DataFrame:
    """query_id, messages by prepare(question, [(document text, score), ...] best first, in
    the one order of scores: the last bits of a sum depend on partitioning)."""
    schema = "query_id string, messages array<struct<role:string,content:string>>"
    docs = corpus.select(F.col("id").alias("corpus_id"), F.concat_ws(" ", "title", "text").alias("d"))
    rows = run.join(docs, "corpus_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.round("score", PLACES).alias("place"), "corpus_id", "d", "score")), asc=False).alias("docs")).join(queries.select(F.col("id").alias("query_id"), F.col("text").alias("q")), "query_id")

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"query_id": f["query_id"].astype(str), "messages": [prepare(q, [(x["d"], x["score"]) for x in d]) for q, d in zip(f["q"], f["docs"], strict=True)]})

    return rows.mapInPandas(make, schema)


def generate(messages: DataFrame, client: Generator, parallel: int | None = None) -> DataFrame:
    """query_id, answer; parallel is the number of tasks that call at once."""
    rows = messages.repartition(parallel) if parallel else messages

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"query_id": f["query_id"], "answer": [client.generate([dict(m) if isinstance(m, dict) else m.asDict() for m in ms]) for ms in f["messages"]]})

    return rows.select("query_id", "messages").mapInPandas(call, f"query_id {dict(messages.dtypes)['query_id']}, answer string")
