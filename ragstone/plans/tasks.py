"""Tasks: metadata, and the flow from loading to evaluation over one dataset."""

from __future__ import annotations

import datetime
import logging
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone.operators import generate as generation
from ragstone.operators import metrics, rerank
from ragstone.plans.protocols import Generation, Reranker, Retrieval
from ragstone.sources import sinks
from ragstone.sources.readers import Loader

log = logging.getLogger(__name__)

#: fixed values: what metadata may hold
SUBTYPES = ["Financial retrieval", "Question answering"]
DOMAINS = ["Report"]
TYPES = ["RAG"]
CATEGORIES = ["s2p"]
CREATION = ["found", "human-generated", "LM-generated and verified"]
ANNOTATORS = ["expert-annotated", "human-annotated", "derived", "LM-generated", "LM-generated and reviewed"]
LICENSES = ["not specified", "mit", "cc-by-2.0", "cc-by-3.0", "cc-by-4.0", "cc-by-sa-3.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "cc-by-nc-sa-3.0", "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0", "openrail", "openrail++", "odc-by", "afl-3.0", "apache-2.0", "cc-by-nd-2.1-jp", "cc0-1.0", "bsd-3-clause", "gpl-3.0", "cdla-sharing-1.0", "mpl-2.0"]


def _url(value: str) -> bool:
    u = urlparse(value)
    return bool(u.scheme and u.netloc)


@dataclass
class TaskMetadata:
    """What a task says of itself.  dataset must have a path and a subset."""

    dataset: dict
    name: str
    description: str
    type: str | None = None
    modalities: list[str] = field(default_factory=lambda: ["text"])
    category: str | None = None
    reference: str | None = None
    date: tuple[str, str] | None = None
    domains: list[str] | None = None
    task_subtypes: list[str] | None = None
    license: str | None = None
    annotations_creators: str | None = None
    dialect: list[str] | None = None
    sample_creation: str | None = None
    bibtex_citation: str | None = None

    def __post_init__(self):
        for key in ("path", "subset"):
            if key not in self.dataset:
                raise ValueError(f"the dataset's {key} must be given")
        for name, value, known in (("type", self.type, TYPES), ("category", self.category, CATEGORIES), ("annotations_creators", self.annotations_creators, ANNOTATORS), ("sample_creation", self.sample_creation, CREATION)):
            if value is not None and value not in known:
                raise ValueError(f"{name} can't be {value!r}")
        for name, values, known in (("modalities", self.modalities, ["text"]), ("domains", self.domains, DOMAINS), ("task_subtypes", self.task_subtypes, SUBTYPES)):
            if any(v not in known for v in values or ()):
                raise ValueError(f"{name} can't be {values!r}")
        if self.reference is not None and not _url(self.reference):
            raise ValueError(f"reference isn't a URL: {self.reference!r}")
        if self.license is not None and self.license not in LICENSES and not _url(self.license):
            raise ValueError(f"license can't be {self.license!r}")
        for day in self.date or ():
            datetime.date.fromisoformat(day)

    def is_filled(self) -> bool:
        return all(getattr(self, f.name) is not None for f in fields(self))

    @property
    def intext_citation(self) -> str:
        """A citation command with the entry's key, or an empty text."""
        key = re.search(r"\{([^,]*),", self.bibtex_citation or "")
        return f"\\cite{{{key[1].strip()}}}" if key else ""


class Task:
    """load, retrieve, rerank, generate, save and evaluate over one dataset.

    A retriever has retrieve(corpus, queries, k) and a reranker rerank(run, queries,
    corpus, k), both giving query_id, corpus_id, score; a generator has
    generate(messages)."""

    def __init__(self, spark: SparkSession, metadata: TaskMetadata, folder: str | None = None, tables: tuple[DataFrame, DataFrame] | None = None):
        self.spark, self.metadata = spark, metadata
        folder = folder or metadata.dataset.get("data_folder")
        self.corpus, self.queries = Loader(spark, folder, metadata.dataset["subset"], tables=tables).load()
        self.retrieve_run: DataFrame | None = None
        self.rerank_run: DataFrame | None = None
        self.answers: DataFrame | None = None

    @property
    def metadata_dict(self) -> dict:
        return {f.name: getattr(self.metadata, f.name) for f in fields(self.metadata)}

    def _best(self, given: DataFrame | None) -> DataFrame:
        run = given if given is not None else self.rerank_run if self.rerank_run is not None else self.retrieve_run
        if run is None:
            raise ValueError("there are neither reranked nor retrieved results")
        return run

    def retrieve(self, retriever, k: int | None = 100) -> DataFrame:
        if not isinstance(retriever, Retrieval):
            raise TypeError(f"{type(retriever).__name__} has no retrieve()")
        self.retrieve_run = retriever.retrieve(self.corpus, self.queries, k)
        return self.retrieve_run

    def rerank(self, reranker, run: DataFrame | None = None, k: int = 100) -> DataFrame:
        if not isinstance(reranker, Reranker):
            raise TypeError(f"{type(reranker).__name__} has no rerank()")
        run = run if run is not None else self.retrieve_run
        if run is None:
            raise ValueError("there is nothing to rerank")
        self.rerank_run = reranker.rerank(run, self.queries, self.corpus, k)
        return self.rerank_run

    def generate(self, generator, run: DataFrame | None = None, prepare: Callable | None = None) -> DataFrame:
        if not isinstance(generator, Generation):
            raise TypeError(f"{type(generator).__name__} has no generate()")
        run = self._best(run)
        if prepare is None:
            log.info("messages by default: the document of the highest score for each query")
            messages = generation.default_messages(run, self.queries, self.corpus)
        else:
            messages = generation.custom_messages(run, self.queries, self.corpus, prepare)
        self.answers = generation.generate(messages, generator)
        return self.answers

    def save_results(self, output_dir: str | None, k: int = 10) -> str | None:
        path = sinks.save_results(self.rerank_run, self.retrieve_run, output_dir, self.metadata.name, k)
        sinks.save_answers(self.answers, output_dir, self.metadata.name)
        return path

    def evaluate(self, qrels: DataFrame, run: DataFrame | None = None, ks: Sequence[int] = (1, 5, 10), ignore_identical_ids: bool = True) -> DataFrame:
        return metrics.evaluate(self._best(run), qrels, ks, ignore_identical_ids)


class BM25Retriever:
    def __init__(self, tokenize=None):
        self.options = {"tokenize": tokenize} if tokenize else {}

    def retrieve(self, corpus: DataFrame, queries: DataFrame, k: int | None = 100) -> DataFrame:
        from ragstone.functions.text import title_text
        from ragstone.operators.lexical import bm25_topk

        return bm25_topk(queries, corpus.select("id", title_text(F.col("title"), F.col("text")).alias("text")), k, **self.options)


class DenseRetriever:
    def __init__(self, encoder=None, score: str = "cos_sim", query_prompt: str | None = None, doc_prompt: str | None = None):
        from ragstone.functions.vectors import score_function
        from ragstone.operators.encode import HashingEncoder

        score_function(score)
        self.encoder, self.score, self.prompts = encoder or HashingEncoder(), score, (query_prompt, doc_prompt)

    def retrieve(self, corpus: DataFrame, queries: DataFrame, k: int | None = 100) -> DataFrame:
        from ragstone.operators.dense import dense_topk
        from ragstone.operators.encode import encode_corpus, encode_queries, pair_of

        by_query, by_doc = pair_of(self.encoder)
        return dense_topk(encode_queries(queries, by_query, self.prompts[0]), encode_corpus(corpus, by_doc, self.prompts[1]), k, self.score)


class HybridRetriever:
    def __init__(self, encoder=None, alpha: float = 0.6):
        self.dense, self.alpha = DenseRetriever(encoder), alpha

    def retrieve(self, corpus: DataFrame, queries: DataFrame, k: int = 100) -> DataFrame:
        from ragstone.functions.text import title_text
        from ragstone.operators.hybrid import hybrid_search

        docs = corpus.select("id", title_text(F.col("title"), F.col("text")).alias("text"))
        return hybrid_search(queries, docs, self.dense.retrieve(corpus, queries, 2 * k), k, self.alpha)


class CrossEncoderReranker:
    def __init__(self, model=None, chars: int | None = None):
        self.model, self.chars = model, chars

    def rerank(self, run: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 100) -> DataFrame:
        return rerank.rerank(run, queries, corpus, self.model, k, self.chars)


#: fixed values: name, subset, description, reference, license, annotators, creation
TASKS = {
    "FinDER": ("finder", "Retrieval over financial disclosures", None, None, "expert-annotated", "human-generated"),
    "FinQA": ("FinQA", "FinQA: A Dataset of Numerical Reasoning over Financial Data", "https://github.com/czyssrs/FinQA", "mit", "expert-annotated", "human-generated"),
    "ConvFinQA": ("ConvFinQA", "ConvFinQA: Exploring the Chain of Numerical Reasoning in Conversational Finance Question Answering", "https://github.com/czyssrs/ConvFinQA", "mit", "expert-annotated", "human-generated"),
    "TAT-QA": ("TATQA", "TAT-QA: A Question Answering Benchmark on a Hybrid of Tabular and Textual Content in Finance", "https://github.com/NExTplusplus/TAT-QA", "mit", "human-annotated", "human-generated"),
    "MultiHiertt": ("MultiHiertt", "MultiHiertt: Numerical Reasoning over Multi Hierarchical Tabular and Textual Data", "https://github.com/psunlpgroup/MultiHiertt", "mit", "expert-annotated", "human-generated"),
    "FinanceBench": ("FinanceBench", "FinanceBench: A New Benchmark for Financial Question Answering", "https://github.com/patronus-ai/financebench", None, "expert-annotated", "human-generated"),
    "FinQABench": ("FinQABench", "FinQABench: A New QA Benchmark for Finance applications", "https://huggingface.co/datasets/lighthouzai/finqabench", "apache-2.0", "LM-generated and reviewed", "LM-generated and verified"),
}


def metadata_of(name: str, path: str = "local") -> TaskMetadata:
    if name not in TASKS:
        raise ValueError(f"unknown task {name!r}; there are {sorted(TASKS)}")
    subset, description, reference, license_, annotators, creation = TASKS[name]
    return TaskMetadata(dataset={"path": path, "subset": subset}, name=name, description=description, type="RAG", category="s2p", reference=reference, domains=["Report"], task_subtypes=list(SUBTYPES), license=license_, annotations_creators=annotators, dialect=[], sample_creation=creation)


def make_task(spark: SparkSession, name: str, folder: str | None = None, tables: tuple[DataFrame, DataFrame] | None = None) -> Task:
    """One of the seven known tasks over a local folder or given tables."""
    return Task(spark, metadata_of(name), folder, tables)
