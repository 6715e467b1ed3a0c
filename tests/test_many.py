"""Many configurations, stores, samples and flows against doing each thing by itself."""

from __future__ import annotations

import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragstone.functions import text
from ragstone.operators import dense, encode, lexical, retrievers, sampling, splitters, tuning
from ragstone.plans import flows
from ragstone.sources import readers


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    names = [f"w{i}" for i in range(50)]
    docs = [(i, None, ". ".join(" ".join(r.choices(names, k=r.randint(2, 9))) for _ in range(r.choice([1, 5, 60])))) for i in range(30)] + [(30, None, None), (31, None, " ")]
    asked = [(i, " ".join(r.choices(names, k=3)) + r.choice(["", " explain why", " what is the total", " compare the table"])) for i in range(12)]
    rel = [(q, r.randrange(30), r.choice([1, 1, 2])) for q in range(9) for _ in range(3)]
    return (spark.createDataFrame(docs, "id long, title string, text string"), spark.createDataFrame(asked, "id long, text string"), spark.createDataFrame(list({(q, d): (q, d, s) for q, d, s in rel}.values()), "query_id long, corpus_id long, score int"))


CELLS = [{"method": "character", "size": 60, "overlap": 10}, {"method": "recursive", "size": 100, "overlap": 20}, {"method": "recursive", "size": 100, "overlap": 0}, {"method": "no_chunking"}, {"method": "fixed", "size": 10**6}]


def plain(rows, names):
    return sorted((tuple(round(x, 7) if isinstance(x, float) else x for x in (r[n] for n in names)) for r in rows), key=repr)


def test_cells_at_once_as_one_by_one(spark, corpus):
    names = ["dataset", "method", "size", "overlap", "num_docs", "num_chunks", "expansion", "num_queries", "ndcg", "std_ndcg"]
    how = {"n_queries": 6, "most_docs": 25, "k": 5, "dataset": "d"}
    got = tuning.evaluate_many(*corpus, CELLS, **how)
    want = [r for c in CELLS for r in tuning.evaluate_config(*corpus, **c, **how).collect()]
    assert plain(got.collect(), names) == plain(want, names) and sorted(r["no"] for r in got.collect()) == list(range(len(CELLS)))
    plan = tuning.chunk_configs(corpus[0].select("id", "text"), CELLS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Union" not in plan  # one scan for all cells
    sizes = {r["size"]: (r["chunks"], round(r["mean_chars"], 6)) for r in tuning.size_sweep(corpus[0], (50, 200), 0.1).collect()}
    for s in (50, 200):
        one = tuning.chunk_corpus(corpus[0], "recursive", s, int(s * 0.1)).agg(F.count("*"), F.avg(F.length("text"))).first()
        assert sizes[s] == (one[0], round(one[1], 6))


def test_configurations_are_chunked_as_alone(spark, corpus):
    docs = corpus[0].select("id", "text")
    got = tuning.chunk_configs(docs, CELLS).collect()
    for i, c in enumerate(CELLS):
        want = [tuple(r) for r in tuning.chunk_corpus(docs, **c).collect()]
        assert sorted(tuple(r)[1:] for r in got if r["no"] == i) == sorted(want)
    with pytest.raises(ValueError):
        tuning.chunk_configs(docs, [{"method": "nothing"}])


def test_groups_are_ranked_apart(spark):
    r = random.Random(7)
    rows = [(i, r.choice("abc"), [float(r.randint(-3, 3)) for _ in range(3)]) for i in range(120)]
    c = spark.createDataFrame(rows, "id long, g string, embedding array<double>")
    q = c.where("id % 9 = 0")
    for block in (4096, 4):
        every = dense.dense_topk(q.drop("g"), c, 4, block=block, by="g")
        own = dense.dense_topk(q, c, 4, block=block, by="g")
        for g in "abc":
            names = ["query_id", "corpus_id", "rank"]
            assert plain(every.where(F.col("g") == g).collect(), names) == plain(dense.dense_topk(q, c.where(F.col("g") == g), 4).collect(), names)
            assert plain(own.where(F.col("g") == g).collect(), names) == plain(dense.dense_topk(q.where(F.col("g") == g), c.where(F.col("g") == g), 4).collect(), names)


class Counting(encode.HashingEncoder):
    """Writes down what it encodes."""

    def __init__(self, path):
        super().__init__(8)
        self.path = path

    def encode(self, texts):
        with open(self.path, "a") as f:
            f.writelines(json.dumps(t) + "\n" for t in texts)
        return super().encode(texts)


def test_store_encodes_a_text_once(spark, tmp_path):
    store, log = encode.EmbeddingStore(f"file://{tmp_path}/store"), f"{tmp_path}/log"
    own = Counting(log)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "c", None, "", "a b", "d\ne"] * 3)], "id long, text string")

    def check(df):
        got = {r["id"]: list(r["embedding"]) for r in store.encode(df, own, "own/v 1").collect()}
        assert got == {r["id"]: list(r["embedding"]) for r in encode.encode(df, encode.HashingEncoder(8)).collect()}

    def seen():
        with open(log) as f:
            return sorted(map(json.loads, f))

    check(rows)
    assert seen() == ["", "a b", "c", "d\ne"]
    check(rows)
    check(rows.limit(0))
    assert seen() == ["", "a b", "c", "d\ne"]  # a second run encodes nothing
    check(rows.unionByName(spark.createDataFrame([(100, "new")], rows.schema)))
    assert seen() == ["", "a b", "c", "d\ne", "new"] and store.vectors(spark, "other").count() == 0
    store.encode(rows, Counting(log), "other").count()
    assert len(seen()) == 9  # another encoder has vectors of its own


def test_grid_shares_the_store(spark, corpus, tmp_path):
    store, log = encode.EmbeddingStore(f"file://{tmp_path}/store"), f"{tmp_path}/log"
    how = {"n_queries": 6, "most_docs": 25, "encoder": Counting(log)}
    one = tuning.evaluate_many(*corpus, CELLS, store=(store, "c"), **how).collect()
    with open(log) as f:
        n = len(f.readlines())
    again = tuning.evaluate_many(*corpus, CELLS[:3], store=(store, "c"), **how).collect()
    with open(log) as f:
        assert len(f.readlines()) == n
    assert {r["no"]: r["ndcg"] for r in again} == {r["no"]: r["ndcg"] for r in one if r["no"] < 3}


def made_in_worker():
    made_in_worker.times = getattr(made_in_worker, "times", 0) + 1
    return encode.HashingEncoder(8)


def test_worker_makes_its_encoder_once(spark):
    own = encode.WorkerEncoder("test", made_in_worker)
    assert [own.encode(["a"]) for _ in range(3)] == [encode.HashingEncoder(8).encode(["a"])] * 3 and made_in_worker.times == 1
    rows = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string")
    made = encode.WorkerEncoder("wide", lambda: encode.HashingEncoder(8))
    assert encode.encode(rows, made).collect() == encode.encode(rows, encode.HashingEncoder(8)).collect()


@pytest.mark.parametrize(("digits", "most"), [(4, 10_000), (1, 3), (2, 1)])
def test_samples_by_a_counted_edge(spark, monkeypatch, digits, most):
    monkeypatch.setattr(sampling, "DIGITS", digits)
    monkeypatch.setattr(sampling, "MOST_ROWS", most)
    rows = spark.createDataFrame([(f"k{i}",) for i in range(90)], "id string").repartition(3)
    order = sorted((hashlib.md5(f"k{i}:42".encode()).hexdigest(), f"k{i}") for i in range(90))
    for n in (0, 1, 2, 17, 89, 90, 200):
        assert sorted(r["id"] for r in sampling.hash_sample(rows, n).collect()) == sorted(k for _, k in order[:n])
    twice = rows.unionByName(rows).unionByName(spark.createDataFrame([(None,)], rows.schema))
    assert sampling.hash_sample(twice, 5).count() in (5, 6) and sampling.hash_sample(twice, 1).collect()[0]["id"] is None
    plan = sampling.hash_sample(rows, 17)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "TakeOrdered" not in plan


def test_adaptive_retriever_against_brute_force(spark, corpus):
    docs, queries, _ = corpus
    own = retrievers.AdaptiveRetriever(docs)
    got: dict = {}
    for r in own.retrieve(queries, 3).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["strategy"], r["chunk_id"], r["text"]))
    for q in queries.collect():
        found = [n for n, p in text.QUERY_PATTERNS.items() if re.search("|".join(p), q["text"].lower())]
        name = next((to for n, to in text.ROUTES if n in found), "medium")
        how = own.SETS[name]
        chunks = [(f"{d['id']}_chunk_{i}", x) for d in docs.collect() for i, x in enumerate(splitters.split(d["text"], *how))]
        v, m = np.array(own.encoder.encode([q["text"]])[0], np.float32).astype(float), np.array(own.encoder.encode([x for _, x in chunks]), np.float32).astype(float)
        score = m @ v / np.maximum(np.linalg.norm(m, axis=1) * np.linalg.norm(v), 1e-30)
        order = sorted(range(len(chunks)), key=lambda i: (round(score[i], 9), chunks[i][0]), reverse=True)[:3]
        assert got[q["id"]] == [(name, *chunks[i]) for i in order]
    assert own.retrieve(queries.limit(0)).count() == 0


def cosine(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return a @ b / n if n else 0.0


def plain_running(t, enc, threshold, least, most):
    """One sentence after the other, the chunk so far encoded each time."""
    parts = t.split(". ")
    if len(parts) == 1:
        return [t]
    out, held = [], [parts[0]]
    for s in parts[1:]:
        n = sum(map(len, held))
        if n < least or (n + len(s) <= most and cosine(*enc([" ".join(held), s])) >= threshold):
            held.append(s)
        else:
            out.append(". ".join(held) + ".")
            held = [s]
    return [*out, ". ".join(held) + "."]


def plain_adjacent(t, enc, threshold, most):
    parts = t.split(". ")
    if len(parts) == 1:
        return parts
    groups = [[parts[0]]]
    room = most - len(parts[0])
    for a, b in zip(parts, parts[1:], strict=False):
        if cosine(*enc([a, b])) >= threshold and len(b) < room:
            groups[-1].append(b)
        else:
            groups.append([b])
            room = most
        room -= len(b)
    return [". ".join(g) + "." for g in groups]


def test_semantic_splitters_in_batches():
    r = random.Random(11)
    own, calls = encode.HashingEncoder(5), []
    texts = [". ".join(" ".join(r.choices("abcdef", k=r.randint(1, 4))) for _ in range(r.choice([1, 2, 5, 40]))) for _ in range(40)]

    def bare(some):
        """Not additive: no sums beside it."""
        calls.append(len(some))
        return own.encode(some)

    for threshold, least, most in ((0.31, 4, 30), (0.52, 0, 12), (-1.1, 0, 10**9), (0.23, 10, 60)):
        want = [plain_running(t, own.encode, threshold, least, most) for t in texts]
        assert splitters.running_all(texts, own.encode, threshold, least, most) == want
        assert splitters.running_all(texts, bare, threshold, least, most) == want
        assert splitters.adjacent_all(texts, own.encode, threshold, most) == [plain_adjacent(t, own.encode, threshold, most) for t in texts]
    calls.clear()
    splitters.running_all(texts, bare, 0.3, 0, 30)
    assert len(calls) <= 40  # a call for each sentence of the longest text
    calls.clear()
    splitters.adjacent_all(texts, bare, 0.3, 30)
    assert calls == [sum(len(t.split(". ")) for t in texts if ". " in t)]


class Shared:
    def __init__(self, docs):
        self.docs = docs

    def get_scores(self, tokens):
        return [sum(d.count(t) for t in set(tokens)) for d in self.docs]


@pytest.mark.parametrize(("tokens", "most", "asked"), [(10**6, 10**4, 4096), (300, 4, 4096), (300, 5, 3)])
def test_sharded_models(spark, corpus, monkeypatch, tokens, most, asked):
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", asked)
    docs, queries, _ = corpus
    got = lexical.shard_topk(queries, docs, Shared, 4, tokens=tokens, most=most)
    rows, want = [(d["id"], (d["text"] or "").lower().split()) for d in docs.collect()], []
    for q in queries.collect():
        w = set(q["text"].lower().split())
        order = sorted(((sum(d.count(t) for t in w), i) for i, d in rows), reverse=True)[:4]
        want += [(q["id"], i, float(s), k) for k, (s, i) in enumerate(order, 1)]
    assert sorted((r["query_id"], r["corpus_id"], r["score"], r["rank"]) for r in got.collect()) == sorted(want)
    assert lexical.shard_topk(queries, docs.limit(0), Shared, 4).count() == 0 and lexical.shard_topk(queries.limit(0), docs, Shared, 4).count() == 0


def test_production_flow(spark, corpus, tmp_path):
    docs, queries, qrels = corpus
    docs = docs.where("id < 30")
    results = tuning.evaluate_many(docs, queries, qrels, CELLS[:3], dataset="one")
    best = tuning.best_strategy(results).select("dataset", "method", "size", "overlap")
    best = best.unionByName(spark.createDataFrame([("two", "recursive", 80, 0), ("broken", "nothing", 5, 0)], "dataset string, method string, size int, overlap int"))
    sets = {"one": (docs, queries, qrels), "two": (docs, queries, None), "broken": (docs, queries, None), "unknown": (docs, queries, None)}
    runs, failed, report = flows.production(sets, best, f"{tmp_path}/out")
    rows = {r["dataset"]: r for r in report.collect()}
    assert sorted(runs) == sorted(rows) == ["one", "two"] and sorted(failed) == ["broken", "unknown"] and "nothing" in failed["broken"]
    how = {r["dataset"]: r for r in best.collect()}["one"]
    chunks = tuning.chunk_corpus(docs.select("id", "text"), how["method"], how["size"], how["overlap"])
    assert rows["one"]["num_chunks"] == chunks.count() == readers.read_chunks(spark, f"{tmp_path}/out/one_chunked.jsonl").count()
    assert rows["one"]["num_docs"] == 30 and abs(rows["one"]["expansion"] - chunks.count() / 30) < 1e-9
    assert abs(rows["one"]["gain"] - (rows["one"]["ndcg"] - rows["one"]["base_ndcg"]) / rows["one"]["base_ndcg"] * 100) < 1e-9 and rows["two"]["ndcg"] is None
    own = flows.chunked_hybrid(docs.withColumn("id", F.col("id").cast("string")), queries.withColumn("id", F.col("id").cast("string")), chunks=chunks.withColumn("doc_id", F.col("doc_id").cast("string")))
    names = ["query_id", "corpus_id", "rank"]
    assert plain(runs["one"].collect(), names) == plain(own.collect(), names)
    saved = spark.read.csv(f"{tmp_path}/out/one/results.csv", header=True)
    assert saved.count() == runs["one"].where("rank <= 10").count()
    assert {r["dataset"]: r["size"] for r in spark.read.json(f"{tmp_path}/out/mapping.json").collect()} == {"one": how["size"], "two": 80}
    assert readers.readiness(spark, {"one": {"method": how["method"], "ndcg": 1}}, f"{tmp_path}/out").collect()[0]["ready"]
    assert sorted(r["dataset"] for r in spark.read.json(f"{tmp_path}/out/failed.json").collect()) == ["broken", "unknown"]
