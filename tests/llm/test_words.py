"""Byte-level BPE, periodic runs and spelling variants against libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest

pytest.importorskip("ragstone.llm")

import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402

from ragstone.llm import byte_bpe, queries, runs, variants  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, runs int, word double, n_bytes string"
ODD = ["", " ", "\n \n", "  a  b ", "　 a \x1cb\x85 c", "\x1c  ", "It's, don't!! 12,34 I'LL", "日本語 テスト.", "é é ᠎", "<|endoftext|> <|x|>", "😀 — …", "x\0 \0y", "word " * 3000, "a" * 5000, "ab" * 5000, "日本語" * 30000 + "。" + "b9!" * 30000]


def odd_docs(spark):
    """Nulls in every column, odd, empty and long texts, repeated rows, clashing columns."""
    rows = [(i, t, "x", i, 0.5, "y") for i, t in enumerate(ODD)]
    rows += [(100, None, None, None, None, None), (None, "no id here at all", "x", 1, 0.1, "z"), rows[5], rows[5], (-7, ODD[12], "x", 1, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def whole(spark, data):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]


# 11


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def test_encoder_gives_the_librarys_ids(library):
    own, back, r = byte_bpe.made(byte_bpe.Encoder, RANKS), byte_bpe.made(byte_bpe.Decoder, RANKS), random.Random(1)
    assert byte_bpe.SPACE_CUTS == public_tokenizers.PATTERN
    some = ["a", "aa", "b", "A", " ", "  ", "\n", " \n", "\t", "　", "\x1c", "\x85", "'s", "'ll", "'", "é", "é", "日", "本語", "。", "😀", "9", "²", "_", "-", ".", "<|endoftext|>", "\0", "​", "the", "ing"]
    kept = own.pieces.most
    for most in (2000, kept):  # caches that overflow, and that don't
        own.pieces.most = most
        for below in (6, 12, len(some)):
            for _ in range(40):
                texts = ["".join(r.choices(some[:below], k=r.randint(0, 50))) for _ in range(9)]
                for t, ids in zip(texts, own.encode(texts), strict=True):
                    assert ids.tolist() == library.encode_ordinary(t) and back.raw(ids.tolist()) == t.encode()
                    assert own.starts(t.encode(), ids).tolist() == [a for a, _ in own.lib.encode(t, add_special_tokens=False).offsets]
    for t in ODD:
        assert own.encode([t])[0].tolist() == library.encode_ordinary(t)
    whole = byte_bpe.Encoder(RANKS, r"\S+|\s+")  # another pattern: whole texts
    other = tiktoken.Encoding("o", pat_str=r"\S+|\s+", mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    assert [x.tolist() for x in whole.encode(["a  b c's", ""])] == [other.encode_ordinary("a  b c's"), []]


def test_every_character_is_cut_as_the_library_does(library):
    own = byte_bpe.made(byte_bpe.Encoder, RANKS)
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000] + list(range(0x3100, 0x110000, 211))
    texts = [f"a{c}1{c} {c}{c} .{c}a  {c} b" for c in map(chr, points) if not "\ud800" <= c <= "\udfff"]
    for at in range(0, len(texts), 1000):
        part = texts[at: at + 1000]
        assert [x.tolist() for x in own.encode(part)] == [library.encode_ordinary(t) for t in part]


def test_decoder_holds_back_split_characters(library):
    back = byte_bpe.made(byte_bpe.Decoder, RANKS)
    text = "ab \U00012000 \u65e5 \u0e5b\U0001f9ff\u00e9"
    ids = library.encode_ordinary(text)
    parts = list(back.stream([i] for i in ids))
    assert "".join(parts) == text and "" in parts  # some tokens are parts of a character
    cut = parts.index("") + 1
    assert "".join(back.stream([ids[:cut]])).endswith("\ufffd") and "".join(back.stream([ids[:cut], ids[cut:]])) == text
    assert back.raw([None, 10**6, -1, ids[0]]) == "\ufffd\ufffd".encode() + back.raw(ids[:1])


def test_lists_are_decoded_as_single_ones():
    import pyarrow as pa

    back, r = byte_bpe.made(byte_bpe.Decoder, RANKS), random.Random(4)
    plain = [[r.randrange(50256) for _ in range(r.randint(0, 9))] for _ in range(50)]
    for lists in (plain, [], [[]], [None, *plain], [[None, 5], [7]], [[10**7], [-1, 3]]):
        for col in (pa.array(lists, pa.list_(pa.int32())), pa.array([[1], *lists], pa.list_(pa.int32())).slice(1)):
            assert back.raws(col).to_pylist() == [back.raw(x or []) for x in lists]


def bpe_row(library, doc, text):
    ids = library.encode_ordinary(text or "")
    return doc, len(ids), sha(",".join(map(str, ids))), sha((text or "").encode())


def test_byte_bpe_tables(spark, data, library, whole):
    docs = odd_docs(spark)
    found = byte_bpe.decoded(byte_bpe.encoded(docs, RANKS), RANKS).collect()
    got = sorted(((r["doc_id"], r["ids"], bytes(r["decoded"]), len(r["starts"])) for r in found), key=repr)
    want = [(r["doc_id"], library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in docs.collect()]
    assert got == sorted(((d, i, t, len(i)) for d, i, t in want), key=repr)
    empty = spark.createDataFrame([], SCHEMA)
    assert byte_bpe.decoded(byte_bpe.encoded(empty, RANKS), RANKS).count() == 0
    rows = queries.QUERIES["op11_byte_bpe"](spark, data).collect()
    assert sorted(tuple(r)[:4] for r in rows) == sorted(bpe_row(library, *d) for d in whole)


def test_byte_bpe_query_has_empty_texts(spark, library, tmp_path):
    docs = [(1, ""), (2, None), (3, "a b")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op11_byte_bpe"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:4], r["last_start"]) for r in rows) == [(bpe_row(library, *d), n) for d, n in zip(docs, [None, None, 1], strict=True)]


# 12


def brute_runs(w, least=runs.LEAST, power=runs.POWER):
    """By trying each period."""
    out = set()
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            root = w[i: i + q]
            if length >= max(least, power * q) and all(root != root[:d] * (q // d) for d in range(1, q) if q % d == 0):
                out.add((i, length, q))
            i = j + 1
    return sorted(out)


def test_runs_against_brute_force():
    r = random.Random(2)
    for _ in range(1500):
        w = [r.randint(1, r.choice([1, 2, 3, 5])) for _ in range(r.randint(0, 40))]
        while w and r.random() < 0.7:
            w += w[r.randrange(len(w)):][: r.randint(1, 9)] * r.randint(1, 6) + [r.randint(1, 3)] * r.randint(0, 1)
        for least, power in ((6, 4), (2, 2), (3, 3)):
            assert runs.runs_of(w, least, power) == brute_runs(w, least, power)


def families(n):
    """Words over which naive matching takes quadratic time."""
    fib = [[1], [1, 2]]
    while len(fib[-1]) < n:
        fib.append(fib[-1] + fib[-2])
    ruler = [(i & -i).bit_length() for i in range(1, n)]
    return [[1] * n, [1, 2] * (n // 2), fib[-1][:n], [1 + bin(i).count("1") % 2 for i in range(n)], ([1] * 300 + [2]) * (n // 301), ([2] + [1] * 300) * (n // 301), [1] * (n // 2) + [2] * (n // 2), ([1] * (n // 2 - 1) + [2]) * 2, ruler, (fib[-1][:3000] + [3]) * (n // 3001)]


def test_matching_is_linear(monkeypatch):
    met = []
    plain = runs._extension
    monkeypatch.setattr(runs, "_extension", lambda w, a, b, m: met.append(-m) or met.append((x := plain(w, a, b, m)) + 1) or x)
    for w in families(30_000):
        met.clear()
        runs.runs_of(w)
        assert sum(met) <= 8 * len(w)  # in both orders
    assert runs.runs_of([1] * 30_000) == [(0, 30_000, 1)] and runs.runs_of([1, 2] * 15_000) == [(0, 30_000, 2)]


def runs_row(doc, text):
    """The contract's row by brute force."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h, n = zlib.crc32(b"" if doc is None else str(doc).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    rank = {w: i for i, w in enumerate(sorted(set(words)), 1)}
    found = brute_runs([rank[w] for w in words])
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return doc, len(found), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))


def test_run_tables(spark, data, whole, monkeypatch):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = [(d, t) for d, t in whole if len(t or "") < 4000]  # brute force tries every period
    rows = {r["doc_id"]: tuple(r[k] for k in names) for r in queries.QUERIES["op12_periodic_runs"](spark, data).collect()}
    assert len(rows) == len(whole) and all(rows[d] == runs_row(d, t) for d, t in short) and len(short) > 150
    docs = odd_docs(spark)
    monkeypatch.setattr(runs, "table", lambda *_: docs)
    got = [tuple(r[k] for k in names) for r in runs.query(spark, data).collect()]
    assert sorted(got, key=repr) == sorted((runs_row(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    monkeypatch.setattr(runs, "table", lambda *_: spark.createDataFrame([], SCHEMA))
    assert runs.query(spark, data).count() == 0
    found = runs.periodic_runs(spark.createDataFrame([(1, "x  a b a b\na b a b y")], "doc_id long, text string")).collect()[0]
    assert [tuple(x) for x in found["runs"]] == [(1, 8, 2)] and found["collapsed"] == "x a b y"


# 13


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def brute_variants(counts, factor=variants.FACTOR):
    form = {}
    for w in counts:
        beside = [v for v in counts if near(w, v)]
        best = min(beside, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None, len(beside)
    out = []
    for w, (f, n) in form.items():
        root = w
        while form[root][0] is not None:
            root = form[root][0]
        out.append((w, f, root, counts[w], n, counts.get(f)))
    return sorted(out)


def test_variants_against_brute_force(spark):
    r = random.Random(3)
    counts = {"".join(r.choices("abé", k=r.randint(1, 6))): r.choice([1, 2, 10, 20, 100, 1000, 10**6]) for _ in range(300)} | {"😀a": 5, "a": 50, "": 3}
    words = spark.createDataFrame([*counts.items()], "word string, n long")
    got = [(x["word"], x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in variants.spelling_variants(words).collect()]
    assert sorted(got) == brute_variants(counts)
    chain = {"abcdefg"[:k]: 10**k for k in range(1, 8)}  # forms of forms of forms
    got = variants.spelling_variants(spark.createDataFrame([*chain.items()], "word string, n long")).collect()
    assert {x["root"] for x in got} == {"abcdefg"} and variants.spelling_variants(words.limit(0)).count() == 0


def brute_counts(docs):
    counts: Counter = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1:]
            if len(low) >= 7:
                counts[low] += 1
    return {w: n for w, n in counts.items() if n > 1}


def test_variant_tables(spark, data, whole, monkeypatch):
    got = [(x["word"], x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in queries.QUERIES["op13_spelling_variants"](spark, data).collect()]
    assert sorted(got) == brute_variants(brute_counts(whole)) and any(x[1] for x in got)
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(i, "ÀÉÎÕÜabc Straßen straßen ÆØÅæøå× x" * (i + 1)) for i in range(40)], "doc_id long, text string"), allowMissingColumns=True)
    monkeypatch.setattr(variants, "MOST_WORDS", 3)
    some = variants.word_counts(docs, rewrite=variants.misspelt).collect()
    assert {x["word"]: x["n"] for x in some} == brute_counts((x["doc_id"], x["text"]) for x in docs.collect())
    assert variants.word_counts(spark.createDataFrame([], SCHEMA)).count() == 0
