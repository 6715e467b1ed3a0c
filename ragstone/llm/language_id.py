"""Operator 9: language identification with string kernels.

The kernel of two texts is the number of n-grams of 1 to MAX_N characters that
occur in both, over the geometric mean of the numbers that each has (blended
spectrum, presence).  All n-grams count; they are told apart by a hash of SPOTS bits.
Landmarks, LANDMARKS training texts or PER_LANGUAGE of each language if that is more,
give the Nystrom map, and one-versus-rest kernel ridge regression, in which languages
weigh alike, is solved on it.
An n-gram adds to a text's kernel with a landmark only where the landmark has it, so
landmarks and solution fold into one matrix, a row for each n-gram of any landmark; a
batch of texts is scored by one product of its (sparse) presence matrix with it.

It is fitted on about SAMPLE labelled texts, an equal number of each language (all of
a language that has fewer, LEAST if that is more), chosen by a hash of doc_id among
rows that aren't held out.  Of a text longer than SAMPLE_CHARS characters it learns a
stretch of that length, whose place is a hash too; scoring takes whole texts.

Edge cases: text that is null or has no letter (Unicode category L) gives `und` with
score 0, and so does everything where no row can be learnt from; ties go to the
language first in the alphabet; rows that repeat a doc_id each get their row; a null
doc_id is hashed as empty text; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone.llm.common import id_text, slices, table, utf8_values

MAX_N = 4
LANDMARKS, PER_LANGUAGE = 192, 4
RIDGE = 1e-2
SAMPLE, LEAST, SAMPLE_CHARS = 3000, 40, 4000
SPOTS = 22
FOLDS = 5
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def grams(text: str) -> list[np.ndarray]:
    """A SPOTS-bit hash of every n-gram of the lower-cased text, an array for each n."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    h = np.zeros(len(c), np.uint32)
    out = []
    for n in range(1, MAX_N + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] + c[n - 1:]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x85EBCA6B) + np.uint32(n)) >> np.uint32(32 - SPOTS))
    return out


class Presence:
    """Which n-grams texts have: those of text i are spots[bounds[i]: bounds[i + 1]]."""

    _place = np.zeros(1 << SPOTS, np.int32)  # scratch of the process

    def __init__(self, texts: list[str]):
        each = [self._distinct(t) for t in texts]
        self.n = np.array([len(x) for x in each], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.n)])
        self.spots = np.concatenate(each) if each else np.zeros(0, np.uint32)

    @classmethod
    def _distinct(cls, text: str) -> np.ndarray:
        h = np.concatenate([np.zeros(0, np.uint32), *grams(text)])
        at = np.arange(len(h), dtype=np.int32)
        cls._place[h] = at  # one place of each n-gram stays
        return h[cls._place[h] == at]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The presence matrix times a matrix: for each text the sum of its n-grams' rows."""
        out, some = np.zeros((len(self.n), values.shape[1]), values.dtype), self.n > 0
        if some.any():
            out[some] = np.add.reduceat(values, self.bounds[:-1][some])
        return out


class Model:
    """columns: hash -> row of fold, the folded landmarks; row 0 for other n-grams."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        # landmarks: every language has its share, in turn
        seen: dict[str, int] = {}
        turn = [seen[g] for g in langs if not seen.update({g: seen.get(g, 0) + 1})]
        chosen = sorted(range(len(texts)), key=lambda i: (turn[i], i))[: max(LANDMARKS, PER_LANGUAGE * len(self.langs))]
        marks = Presence([texts[i] for i in chosen])
        by_spot = np.argsort(marks.spots, kind="stable")
        spots, owner = marks.spots[by_spot], np.repeat(np.arange(len(chosen)), marks.n)[by_spot]
        own, first = np.unique(spots, return_index=True)
        held = np.diff(np.append(first, len(spots)))
        self.columns = np.zeros(1 << SPOTS, np.int32)
        self.columns[own] = np.arange(1, len(own) + 1)
        k = np.zeros((len(texts), len(chosen)))
        for row, text in zip(k, texts, strict=True):
            x = Presence([text])
            c = self.columns[x.spots]
            c = c[c > 0] - 1
            n = held[c]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[c], n)
            row[:] = np.bincount(owner[at], minlength=len(chosen)) / np.sqrt(x.n[0] * marks.n)
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        # languages count alike, however many rows each has
        rows = len(langs) / len(self.langs) / (y > 0).sum(axis=0)
        weights = ridge(k, chosen, y, (y > 0) @ rows)
        each = (weights / np.sqrt(marks.n)[:, None]).astype(np.float32)[owner]
        self.fold = np.concatenate([np.zeros((1, len(self.langs)), np.float32), np.add.reduceat(each, first)])

    def scores(self, texts: list[str]) -> np.ndarray:
        x = Presence(texts)
        return x.sums(self.fold[self.columns[x.spots]]) / np.sqrt(np.maximum(x.n, 1))[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        score = self.scores(texts)
        best = score.argmax(axis=1)
        return [self.langs[i] for i in best], np.clip((score.max(axis=1) + 1) / 2, 0, 1).astype(float).tolist()


def ridge(k: np.ndarray, chosen: list[int], y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the landmarks for each class: kernel ridge regression on the Nystrom
    map of the kernel k (texts by landmarks, which are the texts chosen), a text's error
    weighted."""
    values, vectors = np.linalg.eigh(k[chosen])
    live = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, live] / np.sqrt(values[live])
    phi = k @ root
    own = phi.T * weight
    return root @ np.linalg.solve(own @ phi + RIDGE * len(k) * np.eye(phi.shape[1]), own @ y)


def fit(labelled: DataFrame) -> Model | None:
    """The model learnt from text, lang and doc_id of the rows; None without any."""
    usable = labelled.where("text is not null and text <> '' and lang is not null").select("doc_id", "text", "lang")
    number = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not number:
        return None
    most = max(SAMPLE // len(number), LEAST)
    part = F.element_at(F.create_map(*(F.lit(x) for lang, n in number.items() for x in (lang, min(1.0, most / n)))), F.col("lang"))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 31)) < part * (1 << 31))
    # a doc_id that many rows repeat is drawn once
    chosen = chosen.groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id")).agg(F.max(F.struct("text", "lang")).alias("x")).select("doc_id", "x.*")
    start = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))) + 1
    rows = chosen.select("doc_id", F.col("text").substr(start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"), "lang").collect()  # about max(SAMPLE, LEAST * languages) of them
    rows = sorted((r["doc_id"], r["text"], r["lang"]) for r in rows if _LETTER.search(r["text"]))
    return Model([t for _, t, _ in rows], [g for _, _, g in rows]) if rows else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, "text", 1 << 20):
            texts = [t.decode() for t in utf8_values(batch.column("text"))]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if model and _LETTER.search(t)]
            for at in range(0, len(known), 64):
                part = known[at: at + 64]
                for i, lang, score in zip(part, *model.predict([texts[i] for i in part]), strict=True):
                    langs[i], scores[i] = lang, score
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(rows, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents, learnt from those outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(id_text().cast("binary")), F.lit(FOLDS)) == 0
    found = identify(docs, fit(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
