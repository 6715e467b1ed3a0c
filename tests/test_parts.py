"""Injected parts, vectors of odd shapes, and splitters against plain versions."""

from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
import pytest

import ragstone
from ragstone.functions import text
from ragstone.operators import dense, encode, generate, lexical, splitters
from ragstone.plans import protocols


def test_exports():
    assert all(getattr(ragstone, name) for name in ragstone.__all__)
    with pytest.raises(AttributeError):
        ragstone.nothing  # noqa: B018
    assert isinstance(ragstone.BM25Retriever(), protocols.Retrieval) and not isinstance(object(), protocols.Reranker)


def test_encoder_pairs(spark):
    one, two = encode.HashingEncoder(8), encode.HashingEncoder(16)
    assert encode.pair_of(one) == (one, one) and encode.pair_of((one, two)) == encode.pair_of(encode.EncoderPair(one, two)) == (one, two)
    for wrong in ((one,), (one, None), "model"):
        with pytest.raises(TypeError):
            encode.pair_of(wrong)

    class Turned:
        def encode(self, texts):
            return [[-x for x in v] for v in one.encode(texts)]

    corpus = spark.createDataFrame([("a", "", "red fox"), ("b", "", "blue whale")], "id string, title string, text string")
    queries = spark.createDataFrame([("q", "red fox")], "id string, text string")
    best = lambda e: ragstone.DenseRetriever(e).retrieve(corpus, queries, 1).collect()[0]["corpus_id"]
    assert (best(one), best(encode.EncoderPair(one, Turned()))) == ("a", "b")


def _connect():
    def create(model, messages, stream=False, **arguments):
        said = f"{model} {len(messages)} {sorted(arguments.items())}"
        if stream:
            return [SimpleNamespace(choices=[SimpleNamespace(delta=SimpleNamespace(content=c))]) for c in (said[:3], None, said[3:])]
        return SimpleNamespace(choices=[SimpleNamespace(message=SimpleNamespace(content=said))])

    return SimpleNamespace(chat=SimpleNamespace(completions=SimpleNamespace(create=create)))


def test_chat_generator(spark):
    rows = spark.createDataFrame([("q", [{"role": "user", "content": "x"}])], "query_id string, messages array<struct<role:string,content:string>>")
    for more in ({}, {"stream": True}):
        client = generate.ChatGenerator(_connect, "m", temperature=0.5, max_tokens=9, **more)
        assert generate.generate(rows, client).collect()[0]["answer"] == "m 1 [('max_tokens', 9), ('temperature', 0.5)]"
    with pytest.raises(ValueError):
        generate.ChatGenerator(_connect, "m", seed=1)


def test_custom_messages_of_equal_scores(spark):
    # sums of the same parts in another order: the greater id is first, as in every ranking
    run = spark.createDataFrame([(1, "a", 0.1 + 0.2 + 0.3), (1, "b", 0.3 + 0.2 + 0.1), (2, "a", 0.5), (2, "b", 0.25)], "query_id long, corpus_id string, score double")
    queries = spark.createDataFrame([(1, "x"), (2, "y")], "id long, text string")
    corpus = spark.createDataFrame([("a", "A", "one"), ("b", "B", "two")], "id string, title string, text string")
    prepare = lambda q, docs: [{"role": q, "content": repr(docs)}]
    got = {r["query_id"]: r["messages"][0]["content"] for r in generate.custom_messages(run, queries, corpus, prepare).collect()}
    assert got == {"1": repr([("B two", 0.6), ("A one", 0.6000000000000001)]), "2": repr([("A one", 0.5), ("B two", 0.25)])}


class Reversed:
    def get_scores(self, tokens):
        return [float(len(tokens)), 3.0, 3.0, 0.0]


def test_lexical_model(spark):
    queries = spark.createDataFrame([("q1", "a b c d"), ("q2", "a")], "id string, text string")
    got = [(r["query_id"], r["corpus_id"], r["rank"]) for r in lexical.model_topk(queries, ["w", "x", "y", "z"], Reversed(), 2).orderBy("query_id", "rank").collect()]
    assert got == [("q1", "w", 1), ("q1", "y", 2), ("q2", "y", 1), ("q2", "x", 2)]
    assert lexical.model_topk(queries, ["w", "x", "y", "z"], Reversed(), None).count() == 8


def test_treebank_tokens(spark):
    row = spark.createDataFrame([("I don't think it's Bob's, they'll \u00fcber-run 3.5%",)], "t string").select(text.word_marks(__import__("pyspark").sql.functions.col("t")).alias("w")).collect()[0]
    assert row["w"] == ["i", "do", "n't", "think", "it", "'s", "bob", "'s", ",", "they", "'ll", "\u00fcber", "-", "run", "3", ".", "5", "%"]


@pytest.mark.parametrize("score", ["cos_sim", "dot"])
def test_odd_vectors(spark, score):
    """Null, ragged, zero and repeated vectors, ids on both sides, several blocks."""
    r = np.random.default_rng(5)
    rows = [(i, r.integers(-3, 4, 5).astype(float).tolist()) for i in range(40)]
    rows += [(40, None), (41, [1.0, 2.0]), (42, [0.0] * 5), (43, rows[3][1]), (44, [1.0, None, 2.0, 3.0, 4.0]), (45, [])]
    schema = "id long, embedding array<double>"
    corpus = spark.createDataFrame(rows, schema).repartition(3)

    def similar(a, b):
        good = lambda v: v is not None and len(v) == 5 and None not in v
        if not (good(a) and good(b)):
            return -1.0
        a, b = np.array(a), np.array(b)
        if score == "dot":
            return float(a @ b)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a @ b / n) if n else -1.0

    own = dict(rows)
    asked = [*rows[:20], *rows[40:]]
    for k, block in ((4, 7), (4, 4096), (None, 9)):
        got: dict = {}
        for x in dense.dense_topk(spark.createDataFrame(asked, schema), corpus, k, score, block).orderBy("rank").collect():
            got.setdefault(x["query_id"], []).append(x["corpus_id"])
        for q, v in asked:
            want = sorted((i for i in own if i != q), key=lambda i: (round(similar(v, own[i]), 9), i), reverse=True)
            assert got[q] == want[:k], (q, k)


def plain_packed(pieces, sep, size, overlap):
    out, held = [], []
    n = lambda: len(sep.join(held))
    for p in pieces:
        if held and n() + len(sep) + len(p) > size:
            out.append(sep.join(held).strip())
            while held and (n() > overlap or n() + len(sep) + len(p) > size):
                held = held[1:]
        held = [*held, p]
    return [x for x in [*out, sep.join(held).strip()] if x]


def test_packing():
    r = random.Random(3)
    for _ in range(300):
        sep = r.choice(["", " ", "\n\n"])
        pieces = ["x" * r.randint(1, 30) for _ in range(r.randint(0, 25))]
        size, overlap = r.randint(5, 60), r.randint(0, 30)
        assert splitters._packed(pieces, sep, size, overlap) == plain_packed(pieces, sep, size, overlap)
    assert len(splitters.recursive("\u5b57" * 200_000, 1000, 100)) > 200  # no separator at all


def test_semantic_chunks():
    vectors = {"a": [1, 0], "b": [1, 0.1], "c": [0, 1], "d": [0, 1]}
    assert splitters.semantic_adjacent("a. b. c. d", lambda s: [vectors[x] for x in s]) == ["a. b.", "c. d."]
    assert splitters.semantic_adjacent("a. b. c. d", lambda s: [vectors[x] for x in s], most=2) == ["a.", "b.", "c.", "d."]
    assert splitters.semantic_adjacent("whole", lambda s: []) == ["whole"]


def test_token_windows():
    public = pytest.importorskip("public_tokenizers")
    tokens = splitters.RankedTokens(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    t = "The quick brown fox, jumped over 12 lazy dogs. " * 20
    ids = tokens.encode(t)
    got = splitters.token_window(t, 32, 8, tokens)
    assert got[0] == tokens.decode(ids[:32]) and got[1] == tokens.decode(ids[24:56]) and got[-1].endswith("dogs. ") and all(len(tokens.encode(x)) <= 34 for x in got)
    for n in range(0, 60):
        w = [str(i) for i in range(n)]
        got = splitters.token_window(" ".join(w), 10, 3)
        want, at = [], 0
        while at < n:
            want.append(" ".join(w[at: at + 10]))
            if at + 10 >= n:
                break
            at += 7
        assert got == want, n
