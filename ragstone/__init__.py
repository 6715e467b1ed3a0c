"""Retrieval analytics over Spark DataFrames."""

from __future__ import annotations

import importlib

#: what the package gives by name, and where it lies; loaded when first asked for
_EXPORTS = {
    "DenseRetriever": "plans.tasks", "BM25Retriever": "plans.tasks", "HybridRetriever": "plans.tasks", "CrossEncoderReranker": "plans.tasks", "Task": "plans.tasks", "TaskMetadata": "plans.tasks", "make_task": "plans.tasks",
    "HashingEncoder": "operators.encode", "EncoderPair": "operators.encode", "ChatGenerator": "operators.generate", "EchoGenerator": "operators.generate",
    "Retrieval": "plans.protocols", "Reranker": "plans.protocols", "Generation": "plans.protocols",
}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_EXPORTS[name]}"), name)


def __dir__() -> list[str]:
    return __all__
