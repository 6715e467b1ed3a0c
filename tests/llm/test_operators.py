"""The training-data operators against brute force, SQL and round trips."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import math
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("ragstone.llm")

import public_tokenizers  # noqa: E402

import compare  # noqa: E402
from ragstone.llm import decontaminate, language_id, media, minhash, quality, queries, segmentation, token_counts, token_ids, toxicity, warc  # noqa: E402
from ragstone.llm.common import shared_dir  # noqa: E402
from ragstone.llm.pieces import parts  # noqa: E402

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  a  b ", " a", "a ", "\n\n a\n b \n", "▁a ▁", "x\0 \0y", "日本語 テスト.", "é é", "<|endoftext|>. <|STARTOFTEXT|>", "It's, don't!! 12,34", "a\u0085b c", "H̱. Σς.", "word " * 3000, "x" * 5000, "😀 — …"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int"


def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    rows = [(i, t, "en", "s", len(t), 0.5, 1) for i, t in enumerate(ODD)]
    rows += [(100, None, None, None, None, None, None), (None, "no id here at all", "en", "s", 17, 0.1, 2), rows[5], rows[5], (101, ODD[13], "en", "s", 1, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, data, name):
    assert compare.differences(queries.QUERIES[name](spark, data), compare.connect(data), queries.ORACLE_SQL[name]) == []


# 1


def test_packing():
    r = np.random.default_rng(1)
    for bits in (1, 5, 15, 16, 17, 32):
        ids = r.integers(0, 1 << bits, 1001).astype(np.uint32)
        packed = token_ids.pack(ids, bits)
        assert len(packed) == math.ceil(1001 * bits / 8) and (token_ids.unpack(packed, bits, 0, 1001) == ids).all()
        assert (token_ids.unpack(packed, bits, 333, 77) == ids[333:410]).all()


def test_token_ids(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    docs = odd_docs(spark)
    path = token_ids.write_shards(docs, shared_dir(spark, "t"), WORDS)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in token_ids.read_shards(spark, path, with_ids=True).collect()), key=lambda r: r[0])
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r))
    at = 0
    for (start, key, n, crc, ids), (want_key, text) in zip(got, rows, strict=True):
        want = [*lib.encode(text, add_special_tokens=False).ids, 1]
        assert (start, key, n, ids, crc) == (at, want_key, len(want), want, zlib.crc32(np.array(want, "<u4").tobytes()))
        at += n
    assert token_ids.read_shards(spark, token_ids.write_shards(empty_docs(spark), shared_dir(spark, "t"), WORDS)).count() == 0
    index = token_ids.block_index(spark, path)
    one = {(r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in token_ids.read_documents(spark, index, [13, 5, 404]).collect()}
    assert one == {(r[1], r[2], tuple(r[4])) for r in got if r[1] in (13, 5)} and token_ids.read_documents(spark, index, []).count() == 0
    own = token_ids.WordEncoder(WORDS)
    assert own.by_word and not token_ids.WordEncoder(public_tokenizers.path("byte_bpe_50k.json")).by_word
    r = random.Random(11)
    for most in (2000, 1 << 20):  # caches that overflow, and that don't
        own.words.most = most
        for _ in range(40):
            texts = ["".join(r.choice(["ab", "The", "é", "ß", ".", ",'s", "9", " ", "\n", "<|endoftext|>", "x" * 70, "日本", "--"]) for _ in range(r.randint(0, 40))) for _ in range(5)]
            assert [np.frombuffer(x, "<u4").tolist() for x in own.encode([t.encode() for t in texts])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_whole_slices_of_tokens():
    from tokenizers import Tokenizer

    lib, own, r = Tokenizer.from_file(WORDS), token_ids.WordEncoder(WORDS), random.Random(12)
    some = "The fox, the FOX. (fox) Été été; the\tfox", "", "É", "  fox  "
    ids = lambda texts: [np.frombuffer(x, "<u4").tolist() for x in own.encode([t.encode() for t in texts])]
    want = lambda texts: [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids(some) == want(some) and ids([]) == []
    # a word is kept once, whatever its case and the marks behind it
    assert set(own.words) == {b"the", b"fox", b",", b".", b"(fox", b")", "été".encode(), b";", "é".encode()}
    every = [chr(c) for c in range(0x100)] + ["ab"] * 40 + [" "] * 40 + ["'s", "<|endoftext|>", "<|ENDOFTEXT|>", "\u0301", "H\u0331", "\u0130", "\u212a", "\u00a0", "日"]
    for most in (2000, 1 << 20):
        own.words.most = most
        for below in (len(every), 0x100 + 80):  # with and without what isn't taken whole
            for _ in range(30):
                texts = ["".join(r.choices(every[:below], k=r.randint(0, 60))) for _ in range(r.randint(0, 9))]
                assert ids(texts) == want(texts)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i, None], "text": ["x" * i, None]}) for i in range(9)]
    got = list(token_ids.gathered(iter(batches), 40))
    assert len(got) > 1 and [k for ks, _ in got for k in ks] == [x for i in range(9) for x in (i, None)]
    assert b"".join(t for _, ts in got for t in ts) == b"x" * 36


# 2


def brute_windows(text, items, size=13):
    w = decontaminate.words_of((text or "").encode())
    hit, found = set(), set()
    for name, t in items:
        g = decontaminate.words_of((t or "").encode())
        n = min(size, len(g))
        for i in range(max(len(g) - size + 1, bool(g))):
            for j in range(len(w) - n + 1):
                if w[j: j + n] == g[i: i + n]:
                    hit.update(range(j, j + n))
                    found.add("" if name is None else str(name))
    return len(w), len(hit), len(found), decontaminate.digest([*found])


def test_decontamination(spark, monkeypatch):
    r = random.Random(2)
    texts = [" ".join(r.choice("Aa b c é 9") for _ in range(r.randint(0, 60))) for _ in range(40)]
    items = [(1, texts[3]), (2, "b. c"), (3, None), (None, texts[5][:40]), (4, "  ,, "), (2, "é é é"), (5, " ".join(["b"] * 13))]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[3]), (3, texts[3]), (77, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((d, *brute_windows(t, items)) for d, t in ((x["doc_id"], x["text"]) for x in docs.collect())), key=repr)
    for chunk in (1, 8 << 20):  # a chunk for each item, and all in one
        monkeypatch.setattr(decontaminate, "CHUNK_BYTES", chunk)
        index = decontaminate.build_index(docs, shared_dir(spark, "i"))
        found = decontaminate.contamination(decontaminate.search_windows(index, bench)).collect()
        assert sorted(((x["doc_id"], x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"]) for x in found), key=repr) == want
        assert all(x["contaminated"] == (x["n_hit"] > 0 and 20 * x["n_hit"] >= x["n_words"]) for x in found)
    assert decontaminate.contamination(decontaminate.search_windows(decontaminate.build_index(empty_docs(spark), shared_dir(spark, "i")), bench)).count() == 0
    assert decontaminate.contamination(decontaminate.search_windows(index, bench.limit(0))).where("n_hit > 0").count() == 0


def test_proximity_and_cutting(spark):
    docs = spark.createDataFrame([(1, "a x b x x c"), (2, "c a"), (3, "a b c"), (4, "a"), (5, "b c")], "doc_id long, text string")
    index = decontaminate.build_index(docs, shared_dir(spark, "i"))
    near = lambda span: sorted((r["doc_id"], r["position"]) for r in decontaminate.search_near(index, {"q": ["a", "b", "c"]}, span).collect())
    assert near(3) == [(3, 0)] and near(6) == [(1, 0), (3, 0)]
    assert decontaminate.cut_words("One, two; three four!", np.array([0, 1, 1, 0], bool)) == "One,  four!"
    passage = " ".join(f"w{i}" for i in range(20))
    long = " ".join(f"v{i}" for i in range(900))
    d = spark.createDataFrame([(1, passage, "en", 1), (2, f"{long} {passage} end", "en", 1), (3, "clean", "en", 5), (4, None, None, None)], "doc_id long, text string, lang string, n_chars long")
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in decontaminate.clean(d, spark.createDataFrame([(9, passage)], "item_id long, text string")).collect()}
    assert kept == {2: (f"{long}  end", len(long) + 5), 3: ("clean", 5), 4: (None, None)}


def test_cleaning_by_chunks(spark, monkeypatch):
    w = lambda c, n: [f"{c}{i}" for i in range(n)]
    a, b = w("a", 15), w("b", 15)
    over = [*a[-8:], *w("o", 8)]  # its first 8 words end a
    items = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(over))]
    texts = [
        " ".join([*w("v", 300), *a, *w("x", 100), *b, *w("y", 70)]),  # 3 % of each of two items
        " ".join([*w("v", 900), *a, *w("o", 8), "end"]),  # two passages that overlap
        " ".join([*w("v", 900), *b, "end"]), "clean", "", None,
    ]
    docs = spark.createDataFrame([*((i, t, len(t or "")) for i, t in enumerate(texts)), (2, texts[2], 0), (None, texts[0], 0)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    cut = " ".join(w("v", 900)) + "  end"
    want = sorted([(1, cut, len(cut)), (2, cut, len(cut)), (2, cut, len(cut)), (3, "clean", 5), (4, "", 0), (5, None, 0)], key=repr)
    for chunk in (1, 8 << 20):  # a chunk for each item, and all in one
        monkeypatch.setattr(decontaminate, "CHUNK_BYTES", chunk)
        got = decontaminate.clean(docs, bench)
        assert got.schema == docs.schema and sorted(map(tuple, got.collect()), key=repr) == want
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


# 3


def test_warc(spark):
    same = "payload é " * 20
    rows = [(5, "http://www.B.example/x#top", same), (3, "https://a.example/y?q=1", same), (9, None, same), (7, "http://b.example/x", "short"), (8, "http://b.example/x", "short"), (6, "bad\r\nurl", None), (None, "c", same), (3, "c", same), (1, "http://b.example/WARC/1.1\r\n\r\n", "\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = warc.write_archives(pages, shared_dir(spark, "w"))
    index = warc.merged_index(warc.sorted_runs(spark, path))
    got = index.orderBy("rank").collect()
    # every file is plain gzip, every record a member of its own
    whole = b"".join(gzip.decompress(bytes(r["content"])) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect())
    one = {r["page_id"]: bytes(r["record"]) for r in warc.fetch(spark, path, index, [5, 6, 404]).collect()}
    assert whole.count(b"WARC-Record-ID") == len(rows) and set(one) == {5, 6} and all(x in whole and warc.parse(x)[0]["warc-record-id"] == f"<urn:x-page:{k}>" for k, x in one.items())
    assert [r["rank"] for r in got] == list(range(len(rows)))
    keys = [(r["urlkey"].encode(), r["captured"], -1 if r["page_id"] is None else r["page_id"]) for r in got]
    assert keys == sorted(keys)
    want = sorted(((p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == same and p != 3 else "response", 3 if h == same and p != 3 else None) for p, _, h in rows), key=repr)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == want
    none = warc.merged_index(warc.sorted_runs(spark, warc.write_archives(pages.limit(0), shared_dir(spark, "w"))))
    assert none.count() == 0


def test_loser_tree():
    r = random.Random(3)
    for k in range(9):
        runs = [sorted(r.randint(0, 20) for _ in range(r.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs], lambda v: v)) == sorted(itertools.chain(*runs))
        blocks = sorted((x[i] - r.randint(0, 1), x[i: i + 3]) for x in runs for i in range(0, len(x), 3))
        assert list(warc.merged_blocks(iter(blocks), lambda v: v)) == sorted(itertools.chain(*runs))


def test_many_runs(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN_ROWS", 40)
    monkeypatch.setattr(warc, "RUN_BLOCK", 4)
    monkeypatch.setattr(warc, "ROW_BYTES", 3000)
    monkeypatch.setattr(warc, "ROWS_PER_FILE", 2)
    r = random.Random(33)
    rows = [(i, f"http://h{r.randrange(3)}.example/{r.randrange(9)}", f"page {r.randrange(20)} " * r.randrange(40)) for i in range(700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    path = warc.write_archives(pages, shared_dir(spark, "w"))
    runs = warc.sorted_runs(spark, path)
    got = [(x["urlkey"], x["captured"], x["page_id"]) for x in warc.merged_index(runs).orderBy("rank").collect()]
    assert runs.select("run").distinct().count() > 8 and got == sorted(got) and sorted(x[2] for x in got) == list(range(700))


# 4


def brute_groups(rows, size, per_cent):
    """Places in rows of each component; rows without words are one each."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(minhash._ASCII_LOWER).split()
        sets.append({tuple(w[i: i + size]) for i in range(max(len(w) - size + 1, bool(w)))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if min(len(sets[i]), len(sets[j])) * 100 >= per_cent * max(len(sets[i]), len(sets[j]), 1):
            same = len(sets[i] & sets[j])
            if 100 * same >= per_cent * (len(sets[i]) + len(sets[j]) - same):
                root[find(j)] = find(i)
    return [[j for j in range(len(rows)) if find(j) == i] for i in range(len(rows))]


def brute_components(rows, size, per_cent):
    out = []
    for group in filter(None, brute_groups(rows, size, per_cent)):
        low = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            w = (rows[j][1] or "").encode().translate(minhash._ASCII_LOWER).split()
            out.append((rows[j][0], len({tuple(w[i: i + size]) for i in range(max(len(w) - size + 1, bool(w)))}), low, rows[j][0] == low))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("size", "per_cent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, per_cent):
    r = random.Random(4)
    rows = []
    for g in range(6):  # groups around the threshold, chains, exact copies
        base = [f"g{g}w{i}" for i in range(r.choice([4, 30, 120]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                copy[r.randrange(len(copy))] = f"x{r.random()}"
            rows.append((len(rows), " ".join(copy).upper() if r.random() < 0.2 else " ".join(copy)))
            if r.random() < 0.3:
                base = copy
    rows += [(500, None), (501, ""), (502, "two words"), (503, "Two  words"), (None, rows[0][1]), (7, rows[7][1]), (504, " \n ")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_shingles int")
    got = minhash.near_duplicates(docs, size=size, per_cent=per_cent).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in got), key=repr) == brute_components(rows, size, per_cent)
    # a null doc_id, or another text under the same doc_id, is decided by its own text
    more = [*rows, (None, "nothing like it at all"), (None, "Nothing like it at all"), (60, rows[0][1]), (9, "quite another text")]
    kept = minhash.deduplicated(spark.createDataFrame([(*x, 1, "d") for x in more], "doc_id long, text string, SPOT int, digest string"), size=size, per_cent=per_cent)
    groups = brute_groups(more, size, per_cent)
    want = [min((more[i][0] for i in g if more[i][0] is not None), default=None) for g in groups if g]
    got = kept.collect()
    assert kept.columns == ["doc_id", "text", "SPOT", "digest"] and sorted((x["doc_id"] for x in got), key=repr) == sorted(want, key=repr)
    assert not {(60, rows[0][1])} & {(x["doc_id"], x["text"]) for x in got} and (9, "quite another text") in {(x["doc_id"], x["text"]) for x in got}
    assert minhash.deduplicated(docs.limit(0)).count() == 0
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_sketches_fill_and_agree():
    sets, bounds = minhash.shingle_sets([b"a", b"a b c d", b"", b"a b c d", " ".join(f"w{i}" for i in range(2000)).encode(), " ".join(f"w{i}" for i in range(1800)).encode()], 3)
    s = minhash.sketches(sets, bounds, 160)
    full = np.iinfo(np.uint64).max
    assert (s[[0, 1, 3, 4, 5]] != full).all() and (s[2] == full).all() and (s[1] == s[3]).all()
    assert abs((s[4] == s[5]).mean() - 0.9) < 0.1


def test_large_group(spark):
    """Thousands of near copies of one text, about half of them too far for any link, and
    a second text that shares a long passage with it."""
    r = random.Random(44)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for k in range(2400):
        copy = list(base) if k % 7 else [*base[:60], *(f"o{i}" for i in range(30))]
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 5, 6])):
            copy[r.randrange(len(copy))] = f"x{r.randrange(400)}"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs, size=3, per_cent=85).collect()}
    want = {i: min(g) for g in brute_groups(rows, 3, 85) for i in g}
    assert got == want and len(set(want.values())) > 300


# 5


def test_quality(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.resampled(docs, labels).toPandas()
    good = [r["doc_id"] for r in labels.where("quality = 1").collect()]
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    found = np.ones((2, quality.BUCKETS))
    for key, t in rows:
        f, _ = quality.features([t])
        np.add.at(found[1], f, 1)
        if key in good:
            np.add.at(found[0], f, 1)
    p = found / found.sum(axis=1, keepdims=True)
    ratio = np.log(p[0]) - np.log(p[1])
    want = {k: ratio[quality.features([t])[0]].sum() for k, t in rows}
    assert all(math.isclose(w, want[k], abs_tol=1e-6) for k, w in zip(got.doc_id, got.log_weight, strict=True))
    n = labels.count()
    share = len(good) / n
    k = math.ceil(min(1, share + 2 * math.sqrt(share * (1 - share) / n)) * len(rows))
    assert set(got.doc_id[got.selected]) == set(got.sort_values("key", ascending=False).doc_id[:k])
    assert {r["doc_id"] for r in quality.accepted(docs, labels).collect()} == set(got.doc_id[got.selected])
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    # with so few labels the two standard errors spare most bad documents; their weights are low all the same
    assert not set(good) - set(got.doc_id[got.selected])
    weight = got.set_index("doc_id").log_weight
    assert np.mean([weight[g] > weight[b] for g in good for b in bad]) > 0.95


def test_quality_edges(spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    assert quality.resampled(odd_docs(spark), labels.limit(0)).where("selected").count() == odd_docs(spark).count()
    assert quality.resampled(empty_docs(spark), labels).count() == 0 and quality.accepted(empty_docs(spark), labels).count() == 0
    keys = spark.createDataFrame([(k,) for k in (5, 5, 5, 1, 9, -3)], "key long")
    assert [quality.threshold(keys, k) for k in (1, 2, 4, 5, 6)] == [9, 5, 5, 1, -3]


# 6 and 8


def test_token_counts(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.token_counts(odd_docs(spark), PIECES).collect()
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(lib.encode(r["text"] or ""))) for r in odd_docs(spark).collect()), key=repr)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=repr) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    counter, r = token_counts.Counter(PIECES), random.Random(6)
    for _ in range(500):
        t = "".join(r.choice("ab \n▁\0é日 th e") for _ in range(r.randint(0, 30)))
        assert counter.count(t) == len(lib.encode(t)), t
    assert token_counts.token_counts(empty_docs(spark), PIECES).count() == 0


def test_segmentation(spark):
    own, r = segmentation.Lattice(PIECES), random.Random(8)

    def paths(text):
        into = own.arcs(text)

        def go(end):
            if end == 0:
                yield 0.0
            for i, s in into[end] if end else ():
                for rest in go(i):
                    yield rest + s

        return sorted(go(len(text)), reverse=True)[:4]

    for _ in range(150):
        t = "".join(r.choice("theanioe é\n日\0 ▁") for _ in range(r.randint(0, 11)))
        keys = own.pieces.segments(t)
        each = [[s + parts(k)[0] * own.unknown for s in paths(parts(k)[1])] for k in keys]
        ways = own.encode(t)
        assert [s for s, _ in ways] == sorted((sum(c) for c in itertools.product(*each)), reverse=True)[:4]
        assert len({i for _, i in ways}) == len(ways) and all(own.decode(i) == t.replace("▁", " ") for _, i in ways)
        assert all([s for s, _ in own.nbest(parts(k)[1], 4)] == paths(parts(k)[1]) for k in keys)
    got = {r["doc_id"]: r for r in segmentation.segmented(odd_docs(spark), PIECES).collect()}
    assert got[100]["n_pieces"] == 0 and got[100]["round_trip"] and got[13]["round_trip"] and not got[5]["round_trip"]
    assert segmentation.segmented(odd_docs(spark), PIECES).count() == odd_docs(spark).count() and segmentation.segmented(empty_docs(spark), PIECES).count() == 0


# 7


def test_gradients():
    net = toxicity.Net(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(1)
    x, rows, y = r.standard_normal((6, toxicity.WIDTH + toxicity.EXTRA)), r.integers(0, 6, (4, 5)), np.array([0.0, 1, 1, 0])
    live = np.arange(5)[None, :] < np.array([5, 3, 1, 4])[:, None]

    def loss():
        p = toxicity._sigmoid(net.pool(net.states(net.gates(x), rows, live)[0].astype(np.float64), live)[0])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g, dx = net.gradients(x, rows, live, y)
    for name in ("u0", "w1", "b0", "att", "ask", "out", "bias"):
        at = tuple(0 for _ in net.p[name].shape)
        keep, e = net.p[name][at], 1e-2
        net.p[name][at] = keep + e
        up = loss()
        net.p[name][at] = keep - e
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / (2 * e) - g[name][at]) < 2e-3, name
    assert dx.shape == x.shape


def test_toxicity(spark, data):
    assert toxicity.windows(0) == [0] and toxicity.windows(32) == [0]
    for n in range(1, 200):
        s = toxicity.windows(n)
        assert {i for a in s for i in range(a, min(a + toxicity.WINDOW, n))} == set(range(n))
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    bad = ["scoundrel", "villain", "wretch"]
    texts, labels = [], []
    for i in range(300):
        w = [word() for _ in range(r.randint(20, 120))]
        if i % 3 == 0:
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(bad)
        texts.append(" ".join(w).encode())
        labels.append(int(i % 3 == 0))
    net = toxicity.train(texts[:200], labels[:200])
    scores = toxicity.Scorer(net).score(texts[200:])
    assert np.mean((scores >= toxicity.CUT) == np.array(labels[200:])) > 0.95
    docs = odd_docs(spark)
    got = toxicity.scored(docs, net).collect()
    assert len(got) == docs.count() and all(0 <= x["score"] <= 1 for x in got) and len({x["score"] for x in got if x["doc_id"] in (0, 100)}) == 1
    assert toxicity.accepted(docs, None).count() == docs.count() and toxicity.scored(empty_docs(spark), net).count() == 0
    assert toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet").limit(0)) is None


def test_toxicity_learns_from_long_texts(spark, monkeypatch):
    assert toxicity.longest([5, 1, 9, 3], 18) == 9 and toxicity.longest([5, 1, 9, 3], 13) == 4 and toxicity.longest([], 9) == 1
    learnt = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: learnt.append(sorted(zip(map(len, texts), toxic, strict=True))))
    docs = spark.createDataFrame([(1, "bad " * 9000), (2, "good " * 3990), (3, "good " * 8000), (4, "fair"), (5, None), (6, "both")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (6, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 30_008)
    toxicity.fit(docs, labels)
    assert learnt == [[(0, 0), (4, 0), (4, 1), (19950, 0), (36000, 1), (40000, 0)], [(0, 0), (4, 0), (4, 1), (10000, 0), (10000, 0), (10000, 1)]]


def test_toxicity_held_out(spark):
    """The query over documents: held-out toxic documents score above clean ones."""
    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    got = [r for r in toxicity.query(spark, d).join(truth, "doc_id").collect() if r["held_out"]]
    bad, good = ([r["score"] for r in got if r["toxic"] == t] for t in (1, 0))
    assert len(bad) > 5 and np.mean([[(b > g) + 0.5 * (b == g) for g in good] for b in bad]) > 0.6  # 37 toxic documents to learn from
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in got)


# 9


def test_language(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = language_id.query(spark, data).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.9
    model = language_id.fit(docs)
    odd = {r["doc_id"]: r for r in language_id.identify(odd_docs(spark), model).collect()}
    assert odd[100]["lang_pred"] == odd[0]["lang_pred"] == "und" and odd[0]["score"] == 0 and odd[13]["lang_pred"] in model.langs
    assert {r["lang_pred"] for r in language_id.identify(odd_docs(spark), None).collect()} == {"und"}
    assert language_id.identify(empty_docs(spark), model).count() == 0 and language_id.fit(empty_docs(spark)) is None
    marks = spark.createDataFrame([(1, "½ ² ①"), (2, "12 _ !"), (3, "ª"), (4, "字"), (None, "é")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in language_id.identify(marks, model).collect()} == {1: True, 2: True, 3: False, 4: False, None: False}


def test_language_kernel():
    """Scores against kernels of sets of n-grams and a ridge regression written apart."""
    r = random.Random(9)
    words = {"x": ["the", "and", "of", "this"], "y": ["der", "und", "das", "über"], "z": ["el", "que", "año", "los"]}
    langs = [r.choice("xyzzz") for _ in range(260)]
    texts = [" ".join(r.choice(words[g]) for _ in range(r.randint(1, 12))).upper() for g in langs]
    model = language_id.Model(texts, langs)
    sets = [{t.lower()[i: i + n] for n in range(1, 5) for i in range(len(t) - n + 1)} for t in texts]
    turn = [langs[:i].count(g) for i, g in enumerate(langs)]
    marks = sorted(range(len(texts)), key=lambda i: (turn[i], i))[: language_id.LANDMARKS]
    k = np.array([[len(a & sets[j]) / math.sqrt(len(a) * len(sets[j])) for j in marks] for a in sets])
    y = np.array([[1.0 if g == h else -1.0 for h in "xyz"] for g in langs])
    c = k[marks]
    # in the span of the landmarks: least squares of k @ w with the landmarks' own kernel as the norm
    own = k.T * np.array([len(texts) / 3 / langs.count(g) for g in langs])
    w = np.linalg.lstsq(own @ k + language_id.RIDGE * len(texts) * c, own @ y, rcond=1e-10)[0]
    assert np.abs(model.scores(texts) - k @ w).max() < 1e-3, np.abs(model.scores(texts) - k @ w).max()


def test_language_learns_from_every_language(spark):
    rows = [(i, "the and of this " * 3, "en", 1) for i in range(6000)] + [(10_000 + i, "der und das über " * 2000, "de", 1) for i in range(5)] + [(None, "kein", None, 1)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int"))
    assert model.langs == ["de", "en"] and model.predict(["das und der"])[0] == ["de"]


# 10


def test_media(spark):
    class Slow(media.Image):
        def _dc_at_once(self, *a):
            return False

        _ac_first_at_once = _ac_more_at_once = _dc_at_once

    r = np.random.default_rng(10)
    for n in (1, 5, 6, 7, 61):
        payload = r.integers(0, 256, 64 * n).astype(np.uint8).tobytes()
        stored = media.encode(payload)
        image = media.decode(stored)
        assert media.payload_of(image) == payload and media.rgb(image).shape == (image.height, image.width, 3)
        fast, media.Image = media.Image, Slow
        try:
            bit_by_bit = media.decode(stored)
        finally:
            media.Image = fast
        assert all((a["coef"] == b["coef"]).all() for a, b in zip(image.parts, bit_by_bit.parts, strict=True))
    got = media.digests(media.to_media(odd_docs(spark))).collect()
    for x, t in zip(sorted(got, key=lambda x: (x["doc_id"] is None, x["doc_id"], x["n_bytes"])), sorted(((d["doc_id"], (d["text"] or "").encode()) for d in odd_docs(spark).collect()), key=lambda d: (d[0] is None, d[0], len(d[1]))), strict=True):
        full = t[1] + bytes(-len(t[1]) % 64 if t[1] else 64)
        assert (x["doc_id"], x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (t[0], len(t[1]), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert media.tensors(media.to_media(odd_docs(spark))).where("length(rgb) <> height * width * 3").count() == 0
    assert media.digests(media.to_media(empty_docs(spark))).count() == 0


def progressive(coef: np.ndarray, restart: int) -> bytes:
    """A grey progressive JPEG of blocks (rows, cols, 64 in zigzag order), written from the
    standard's description: its Huffman tables give symbol s the eight bits of s, AC scans
    have runs of zeros and of ended blocks, and every scan has restart markers."""
    blocks = coef.reshape(-1, 64)
    head = b"\xff\xd8" + b"\xff\xdb\0\x43\0" + b"\1" * 64
    head += b"\xff\xc2\0\x0b\x08" + struct.pack(">HH", 8 * coef.shape[0], 8 * coef.shape[1]) + b"\1\1\x11\0"
    for kind in (0x00, 0x10):
        head += b"\xff\xc4" + struct.pack(">H", 19 + 255) + bytes([kind, *[0] * 7, 255, *[0] * 8]) + bytes(range(255))
    head += b"\xff\xdd\0\4" + struct.pack(">H", restart)

    def bits(v, n):
        return [v >> k & 1 for k in range(n - 1, -1, -1)]

    def signed(v):
        n = abs(v).bit_length()
        return n, bits(v if v > 0 else v + (1 << n) - 1, n)

    def shifted(v, low):
        return int(v) >> low if v >= 0 else -(-int(v) >> low)

    def scan(first, last, high, low):
        out = b"\xff\xda\0\x08\1\1\0" + bytes([first, last, high << 4 | low])
        for number, at in enumerate(range(0, len(blocks), restart)):
            got, before, ended, waiting = [], 0, 0, []

            def flush():
                nonlocal ended, waiting
                if ended:
                    n = ended.bit_length() - 1
                    got.extend(bits(n << 4, 8) + bits(ended - (1 << n), n) + waiting)
                ended, waiting = 0, []

            for b in blocks[at: at + restart]:
                if first == 0:
                    if high:
                        got.append(int(b[0]) >> low & 1)
                    else:
                        n, v = signed((int(b[0]) >> low) - before)
                        got.extend(bits(n, 8) + v)
                        before = int(b[0]) >> low
                    continue
                run, more, mark = 0, [], first - 1  # more: correction bits since the last symbol, which ended at mark
                for k in range(first, last + 1):
                    v = shifted(b[k], low)
                    if high and abs(v) > 1:
                        more.append(abs(v) & 1)
                    elif not v:
                        run += 1
                    else:
                        flush()
                        while run > 15:
                            # sixteen zeros, with the corrections among them
                            zeros = taken = 0
                            while zeros < 16:
                                mark += 1
                                if high and abs(shifted(b[mark], low)) > 1:
                                    taken += 1
                                else:
                                    zeros += 1
                            got.extend(bits(0xF0, 8) + more[:taken])
                            more, run = more[taken:], run - 16
                        n, sign = signed(v)
                        got.extend(bits(run << 4 | n, 8) + sign + more)
                        run, more = 0, []
                    if v and not (high and abs(v) > 1):
                        mark = k
                if run or more:
                    ended, waiting = ended + 1, waiting + more
            flush()
            got += [1] * (-len(got) % 8)
            data = np.packbits(np.array(got, np.uint8)).tobytes().replace(b"\xff", b"\xff\0")
            out += (bytes([0xFF, 0xD0 + (number - 1) % 8]) if number else b"") + data
        return out

    scans = [(0, 0, 0, 1), (1, 5, 0, 2), (6, 63, 0, 2), (1, 63, 2, 1), (0, 0, 1, 0), (1, 63, 1, 0)]
    return head + b"".join(scan(*x) for x in scans) + b"\xff\xd9"


def test_foreign_progressive_files():
    r = np.random.default_rng(77)
    for restart, share in ((5, 0.05), (12, 0.2), (3, 0.6), (4, 0.0)):
        coef = np.where(r.random((3, 4, 64)) < share, r.integers(-60, 61, (3, 4, 64)), 0)
        coef[..., 0] = r.integers(-500, 500, (3, 4))
        assert (media.decode(progressive(coef, restart)).parts[0]["coef"] == coef).all()


def test_constant_image():
    """A grey image with one DC coefficient, written by hand, and its inverse transform."""
    image = media.Image()
    image.frame(bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0]))
    image.quant[0] = np.full(64, 2, np.float32)
    image.parts[0]["coef"][0, 0, 0] = 40
    assert (media.rgb(image) == 128 + 40 * 2 // 8).all()


# pipeline


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, data), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema == docs.schema
        kept[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert kept[name] == {x[0] for x in brute_components(rows, 5, 80) if x[3]}
        docs = out
    sizes = [len(k) for k in kept.values()]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0 and kept["segment"] == kept["decontaminate"]
    empty = docs
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, spark.read.parquet(f"{data}/documents.parquet").limit(0) if name == "quality" else empty, data)
    assert empty.count() == 0


def test_pipeline_run_over_odd_documents(spark, data, tmp_path):
    """run() over documents with nulls, repeats and empty texts: near_dedup and
    decontaminate against brute force over what the learnt stages keep."""
    import corpus_pipeline

    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60).collect()]
    rows += [(900 + i, t, "en", "s", len(t)) for i, t in enumerate(ODD)] + [(None, None, None, None, None), (950, None, None, None, None), (None, rows[0][1], "en", "s", 1), rows[3], rows[3], (951, rows[5][1], None, None, None)]
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(960, passage, "en", "s", 1), (961, " ".join(f"q{i}" for i in range(900)) + " " + passage, "en", "s", 1)]
    d = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{data}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for stage in (corpus_pipeline.keep_quality, corpus_pipeline.drop_toxic):
        docs = corpus_pipeline.written(stage(spark, docs, d), "s")
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = []
    for group in filter(None, brute_groups(left, 5, 80)):
        ids = [left[i][0] for i in group if left[i][0] is not None]
        text = next((left[i][1] for i in group if left[i][0] == min(ids, default=None)), left[group[0]][1])
        n, hit, _, _ = brute_windows(text, [(1, passage)])
        if not (hit and 20 * hit >= n):
            want.append((min(ids, default=None), len((text or "").encode()) - (len(passage) if hit else 0)))
    got = [(r["doc_id"], r["n_bytes"]) for r in corpus_pipeline.run(spark, d).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) > 20
