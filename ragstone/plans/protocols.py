"""What a task asks of the parts that it is given."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Retrieval(Protocol):
    def retrieve(self, corpus: DataFrame, queries: DataFrame, k: int | None = 100) -> DataFrame:
        """query_id, corpus_id, score of the k best of corpus (id, title, text) for each of
        queries (id, text); of all with k None."""


@runtime_checkable
class Reranker(Protocol):
    def rerank(self, run: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 100) -> DataFrame:
        """query_id, corpus_id, score of the k best candidates of run, scored anew."""


@runtime_checkable
class Generation(Protocol):
    def generate(self, messages: list[dict]) -> str:
        """The answer to one query's messages (role, content)."""
