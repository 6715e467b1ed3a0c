"""Operator 6: token counts by heap-and-linked-list byte-pair merging.

A text's count is its initial symbols less the merges: characters are linked in
a list, every adjacent pair whose join is a piece waits in a heap by rank, and
the pair of lowest rank (leftmost on ties) is merged until none is left.  A
character without a piece counts its UTF-8 bytes.  No ids are made.  Segments
(see pieces.py) merge apart, and each distinct one is merged once per worker
while it is kept.

Edge cases: null counts as empty, with no token; long texts are counted whole;
rows that repeat a doc_id each get their row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone.llm.common import WordCache, slices, table, utf8_values
from ragstone.llm.pieces import Pieces, parts

LIMIT = 4096


def merged(text: str, scores: dict[str, float]) -> tuple[int, list[str]]:
    """(merges, the symbols that remain) of one segment."""
    symbols = list(text)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        score = scores.get(symbols[i] + symbols[i + 1])
        if score is not None:
            heap.append((-score, i, i + 1, 2))
    heapify(heap)
    merges = 0
    while heap:
        _, left, right, size = heappop(heap)
        a, b = symbols[left], symbols[right]
        if not a or not b or len(a) + len(b) != size:
            continue  # one of the two was merged meanwhile
        merges += 1
        symbols[left], symbols[right] = a + b, ""
        nxt = after[left] = after[right]
        if nxt < n:
            before[nxt] = left
            score = scores.get(symbols[left] + symbols[nxt])
            if score is not None:
                heappush(heap, (-score, left, nxt, size + len(symbols[nxt])))
        prv = before[left]
        if prv >= 0:
            score = scores.get(symbols[prv] + symbols[left])
            if score is not None:
                heappush(heap, (-score, prv, left, size + len(symbols[prv])))
    return merges, [s for s in symbols if s]


#: texts that a normaliser, white-space folding or user-defined symbols would change
PROBES = ("", " a  b ", "\uff21\ufb01 \u00e9 e\u0301", "a\u00a0b\tc\n\nd", "<s> </s> <unk> <0x41>", "\u2581x \u65e5\u672c \U0001f600", "Don't 3.14%")


class Counter:
    """Token counts under one model.  A model that treats one of PROBES otherwise than
    merging does (it normalises texts, say) is refused."""

    def __init__(self, path: str):
        import sentencepiece

        self.pieces = Pieces(path)
        self.known = WordCache(self._segment)
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(self.count(t) != len(lib.encode(t)) for t in PROBES):
            raise ValueError(f"{path}: this model does more than merge the pairs of a text")

    def _segment(self, key: str) -> int:
        lines, text = parts(key)
        start = sum(1 if c in self.pieces.ids else len(c.encode()) for c in text)
        return lines + start - merged(text, self.pieces.scores)[0]

    def count(self, text: str) -> int:
        return sum(map(self.known.__getitem__, self.pieces.segments(text)))


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model: str, *, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(model) or _COUNTERS.setdefault(model, Counter(model))
        for batch in slices(batches, "text", 2 << 20):
            counter.known.trim()
            raw = utf8_values(batch.column("text"))
            n = [counter.count(t.decode()) for t in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents under piece_bpe_32k."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
