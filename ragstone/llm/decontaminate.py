"""Operator 2: benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: each block holds whole documents (about
BLOCK_WORDS words) and, for every term of theirs, the sorted list of its
positions.  Blocks are rows of a Parquet table, so a term that is frequent in
the whole corpus is never gathered anywhere.

    shard, block      key of the block
    doc_ids           its documents, in order
    lengths           words of each document
    terms, counts     distinct terms and the lengths of their posting lists
    postings          little-endian i32 positions by term, each list as a first
                      position and gaps; between two documents one position stays
                      unused, so no phrase can reach over a document's end

Phrase search: every phrase starts from the posting list of its rarest term in
the block, moved back by the term's offset in the phrase, and is intersected
with the lists of its other terms, from rare to frequent, each moved by its own
offset.  All phrases of a block take a step together in numpy.  Proximity
search works alike, with a reach in place of the fixed offset.

The phrases come to the tasks in chunks of at most CHUNK_BYTES of benchmark
text (about 100 MB of numbers on the driver), each read from its row iterator and broadcast. The
documents that a chunk hits, and only those, are stored before the next one is searched; more
chunks mean more passes over the index, not more memory.

Edge cases: null or word-free texts have no words (n_words 0, never
contaminated); items without words have no window; items that repeat an
item_id count once; a null item_id counts as an item named by the empty
string; rows that repeat a doc_id each get their row; empty tables give no
rows, or zero hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone.llm.common import free_name, shared_dir, slices, table, utf8_values, written

WINDOW = 13
BLOCK_WORDS = 2_000_000
CHUNK_BYTES = 4 << 20
CANDIDATES = 2_000_000
#: a document is contaminated if at least one word in SHARE is hit
SHARE = 20
#: bytes of a word stay (digits, lower-case letters, everything beyond ASCII), A-Z are lowered, others part words
TO_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

INDEX_SCHEMA = "shard int, block int, doc_ids array<long>, lengths array<int>, terms array<binary>, counts array<int>, postings binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


class _Numbers(dict):
    """Term -> number in order of appearance."""

    def __missing__(self, term):
        n = self[term] = len(self)
        return n


class Block:
    """Posting lists of some whole documents."""

    def __init__(self, lengths: np.ndarray, numbers: dict, counts: np.ndarray, positions: np.ndarray):
        self.lengths, self.numbers, self.counts, self.positions = lengths, numbers, counts, positions
        #: first position of each document; one position is free between two
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)]).astype(np.int64)
        self.lists = np.concatenate([[0], np.cumsum(counts)])
        self.reach = int(self.starts[-1]) + 1

    @classmethod
    def build(cls, docs: list[list[bytes]]) -> Block:
        numbers = _Numbers()
        lengths = np.array([len(d) for d in docs], np.int64)
        total = int(lengths.sum())
        ids = np.fromiter((n for d in docs for n in map(numbers.__getitem__, d)), np.int32, total)
        at = np.arange(total) + np.repeat(np.arange(len(docs)), lengths)
        order = np.argsort(ids, kind="stable")
        return cls(lengths, numbers, np.bincount(ids, minlength=len(numbers)), at[order])

    def gaps(self) -> bytes:
        gap = np.diff(self.positions, prepend=0)
        first = self.lists[:-1]
        gap[first] = self.positions[first]
        return gap.astype("<i4").tobytes()

    @classmethod
    def stored(cls, lengths, terms: list[bytes], counts, postings: bytes) -> Block:
        counts = np.asarray(counts, np.int64)
        gap = np.frombuffer(postings, "<i4").astype(np.int64)
        run = np.cumsum(gap)
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        before = run[first] - gap[first] if len(first) else first
        return cls(np.asarray(lengths, np.int64), dict(zip(terms, range(len(terms)), strict=True)), counts, run - np.repeat(before, counts))

    def phrases(self, grams: np.ndarray, sizes: np.ndarray, terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every occurrence.  grams: row per phrase, of numbers
        into terms, -1 beyond its size."""
        none = np.zeros(0, np.int64)
        own = np.array([self.numbers.get(t, -2) for t in terms] + [-1], np.int64)
        local = own[grams]
        live = np.flatnonzero((local != -2).all(axis=1) & (sizes > 0))
        if not len(live):
            return none, none
        local = local[live]
        often = np.where(local >= 0, self.counts[local], np.iinfo(np.int64).max)
        order = np.argsort(often, axis=1, kind="stable")
        local, often = np.take_along_axis(local, order, 1), np.take_along_axis(often, order, 1)
        keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.reach + self.positions
        cuts = np.searchsorted(np.cumsum(often[:, 0]), np.arange(CANDIDATES, int(often[:, 0].sum()) + CANDIDATES, CANDIDATES), side="left") + 1
        found, low = [], 0
        for high in np.unique(np.minimum(cuts, len(live))):
            n = often[low:high, 0]
            row = np.repeat(np.arange(low, high), n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = self.positions[self.lists[local[row, 0]] + within] - order[row, 0]
            for k in range(1, local.shape[1]):
                term = local[row, k]
                if not len(row) or (term < 0).all():
                    break
                want = term * self.reach + at + order[row, k]
                here = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                keep = (term < 0) | (keys[here] == want)
                row, at = row[keep], at[keep]
            found.append((live[row], at))
            low = high
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def near(self, terms: list[bytes], span: int) -> np.ndarray:
        """Positions from which span words hold all terms, each starting at one of them."""
        own = [self.numbers.get(t, -1) for t in set(terms)]
        if not own or min(own) < 0:
            return np.zeros(0, np.int64)
        own.sort(key=lambda t: self.counts[t])
        lists = [self.positions[self.lists[t]: self.lists[t + 1]] for t in own]
        at = np.unique(np.concatenate(lists))
        end = self.starts[np.searchsorted(self.starts, at, side="right")] - 1
        end = np.minimum(at + span, end)
        for p in lists:
            nxt = np.searchsorted(p, at)
            keep = (nxt < len(p)) & (p[np.minimum(nxt, len(p) - 1)] < end)
            at, end = at[keep], end[keep]
        return at

    def hits(self, chunk: dict) -> tuple[np.ndarray, list[set]]:
        """Mask over positions of words inside an occurrence, and each document's items."""
        phrase, at = self.phrases(chunk["grams"], chunk["sizes"], chunk["terms"])
        edge = np.zeros(self.reach + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + chunk["sizes"][phrase], -1)
        items: list[set] = [set() for _ in self.lengths]
        doc = np.searchsorted(self.starts, at, side="right") - 1
        names, owners, starts = chunk["names"], chunk["owners"], chunk["starts"]
        for d, p in np.unique(np.stack([doc, phrase], 1), axis=0).tolist():
            items[d].update(names[i] for i in owners[starts[p]: starts[p + 1]].tolist())
        return np.cumsum(edge) > 0, items


def chunks_of(benchmark: DataFrame) -> Iterator[dict]:
    """The windows of all items, in chunks of bounded size: distinct windows (grams: numbers into
    terms, -1 beyond their sizes), and of each the items (owners, from starts on: numbers into names)."""
    terms, names = _Numbers(), _Numbers()
    parts, owner, held = [], [], 0

    def made() -> dict:
        rows = np.concatenate(parts)
        grams, of = np.unique(rows.view([("", rows.dtype)] * WINDOW).ravel(), return_inverse=True)
        grams = grams.view(rows.dtype).reshape(-1, WINDOW)
        pairs = np.unique(of.astype(np.int64) * len(names) + np.repeat([n for n, _ in owner], [k for _, k in owner]))
        starts = np.searchsorted(pairs, np.arange(len(grams) + 1) * len(names))
        return {"terms": list(terms), "grams": grams, "sizes": (grams >= 0).sum(axis=1), "owners": (pairs % len(names)).astype(np.int32), "starts": starts, "names": list(names)}

    for r in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        w = np.array([terms[t] for t in words_of((r[1] or "").encode())], np.int32)
        if 0 < len(w) < WINDOW:
            w = np.concatenate([w, np.full(WINDOW - len(w), -1, np.int32)])
        if len(w):
            parts.append(np.lib.stride_tricks.sliding_window_view(w, WINDOW).copy())
            owner.append((names[r[0] or ""], len(parts[-1])))
        held += len((r[1] or "").encode())
        if held >= CHUNK_BYTES and parts:
            yield made()
            terms, names = _Numbers(), _Numbers()
            parts, owner, held = [], [], 0
    if parts:
        yield made()


def _doc_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches of about BLOCK_WORDS words and the words of their documents."""
    for batch in slices(batches, "text", 6 * BLOCK_WORDS):
        yield batch, [words_of(t) for t in utf8_values(batch.column("text"))]


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """Write the positional index of doc_id, text to path and return it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        for number, (batch, words) in enumerate(_doc_blocks(batches)):
            b = Block.build(words)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([number], pa.int32()), "doc_ids": pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id")),
                "lengths": pa.array([b.lengths.astype(np.int32)]), "terms": pa.array([list(b.numbers)], pa.list_(pa.binary())), "counts": pa.array([b.counts.astype(np.int32)]), "postings": [b.gaps()],
            })

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a row group is held whole by its writer and its reader, whatever its rows' size: one block each
    slim.mapInArrow(rows, INDEX_SCHEMA).write.options(**{"compression": "zstd", "parquet.block.row.count.limit": "1"}).parquet(path)
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i] for c in batch.schema.names}
            block = Block.stored(r["lengths"].values.to_numpy(), r["terms"].values.to_pylist(), r["counts"].values.to_numpy(), r["postings"].as_py())
            yield r, block


_HITS = "shard int, block int, pos int, hits binary, items array<string>"
_KEY = ["shard", "block", "pos"]


def _hit_rows(index: DataFrame, chunk: dict) -> DataFrame:
    """The documents that hold a window of one chunk."""
    sent = index.sparkSession.sparkContext.broadcast(chunk)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, b in _blocks(batches):
            mask, items = b.hits(sent.value)
            some = [i for i, x in enumerate(items) if x]
            bits = [np.packbits(mask[b.starts[i]: b.starts[i] + b.lengths[i]]).tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([
                pa.array([r["shard"].as_py()] * len(some), pa.int32()), pa.array([r["block"].as_py()] * len(some), pa.int32()), pa.array(some, pa.int32()),
                pa.array(bits, pa.binary()), pa.array([sorted(items[i]) for i in some], pa.list_(pa.string())),
            ], [*_KEY, "hits", "items"])

    return index.mapInArrow(rows, _HITS)


def search_windows(index: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per indexed document: shard, block, pos (its key), doc_id, n_words, n_hit,
    hits (bit mask of its words, null if none) and items (distinct item ids).

    Each chunk of the benchmark gives rows of the documents that it hits, which are stored
    before the next is made; a document's rows, one for each chunk at most, are united, and
    all documents, with their lengths from the index, join what hits them."""
    every = index.select("shard", "block", F.posexplode(F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("lengths").alias("n"))).alias("pos", "x"))
    every = every.select(*_KEY, F.col("x.doc_id").alias("doc_id"), F.col("x.n").cast("long").alias("n_words"))
    found = None
    for chunk in chunks_of(benchmark):
        rows = written(_hit_rows(index, chunk), "hits")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = index.sparkSession.createDataFrame([], _HITS)
    found = found.groupBy(*_KEY).agg(F.collect_list("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = [np.bitwise_or.reduce([np.frombuffer(h, np.uint8) for h in hs]) for hs in batch.column("hits").to_pylist()]
            n = [int(np.unpackbits(m).sum()) for m in masks]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEY), pa.array(n, pa.int64()), pa.array([m.tobytes() for m in masks], pa.binary()), batch.column("items")], [*_KEY, "n_hit", "hits", "items"])

    found = found.mapInArrow(united, "shard int, block int, pos int, n_hit long, hits binary, items array<string>")
    return every.join(found, _KEY, "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def search_near(index: DataFrame, queries: dict[str, list[str]], span: int) -> DataFrame:
    """Proximity matches: (query, doc_id, position) where span words from that word
    on hold all the query's terms, the word being one of them."""
    wanted = {q: [t.encode() for t in terms] for q, terms in queries.items()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, b in _blocks(batches):
            for q, terms in wanted.items():
                at = b.near(terms, span)
                doc = np.searchsorted(b.starts, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(at), pa.string()), r["doc_ids"].values.take(pa.array(doc)), pa.array(at - b.starts[doc])], ["query", "doc_id", "position"])

    return index.mapInArrow(rows, "query string, doc_id long, position long")


def contamination(found: DataFrame) -> DataFrame:
    """The digest of search_windows(): one row for each document."""
    ids = F.array_sort("items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"),
                        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; from the others that hold a passage, its
    words are cut out of the text (n_chars follows).  All columns stay.

    The words hit by all chunks of the benchmark are known before a text is judged
    and cut.  With one chunk, the posting lists of a block live only while its
    documents pass, so the texts are not shuffled; with more, the index is written
    and the masks are joined to the texts."""
    chunks = chunks_of(benchmark)
    chunk = next(chunks, None)
    if chunk is None:
        return docs
    if next(chunks, None) is not None:
        chunks.close()
        return _clean_by_index(docs, benchmark)
    sent = docs.sparkSession.sparkContext.broadcast(chunk)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _doc_blocks(batches):
            b = Block.build(words)
            mask, items = b.hits(sent.value)
            yield _cut(batch, {i: mask[b.starts[i]: b.starts[i] + b.lengths[i]] for i, x in enumerate(items) if x})

    return docs.mapInArrow(rows, docs.schema)


def _clean_by_index(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """clean() by search_windows(), which unites the masks of all chunks."""
    names, row, n, hits = docs.columns, free_name(docs, "row"), free_name(docs, "n"), free_name(docs, "hits")
    # ids of rows hold only once they are written
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    index = build_index(keyed.select(F.col(row).alias("doc_id"), "text"), shared_dir(docs.sparkSession, "postings"))
    found = search_windows(index, benchmark).where("n_hit > 0").select(F.col("doc_id").alias(row), F.col("n_words").alias(n), F.col("hits").alias(hits))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 6 * BLOCK_WORDS):
            hit = zip(batch.column(hits).to_pylist(), batch.column(n).to_pylist(), strict=True)
            masks = {i: np.unpackbits(np.frombuffer(h, np.uint8), count=k) for i, (h, k) in enumerate(hit) if h}
            yield _cut(batch.select(names), masks)

    return keyed.join(written(found, "hits"), row, "left").select(*names, n, hits).mapInArrow(rows, docs.schema)


def _cut(batch: pa.RecordBatch, masks: dict[int, np.ndarray]) -> pa.RecordBatch:
    """The batch without its contaminated rows, and without the masked words of the others."""
    keep, cut = np.ones(batch.num_rows, bool), {}
    for i, m in masks.items():
        keep[i] = SHARE * int(m.sum()) < len(m)
        if keep[i]:
            cut[i] = cut_words(batch.column("text")[i].as_py(), m)
    if cut:
        texts = batch.column("text").to_pylist()
        for i, t in cut.items():
            texts[i] = t
        cols = {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array(texts, batch.schema.field("text").type)}
        if "n_chars" in cols:
            n = cols["n_chars"].to_pylist()
            for i, t in cut.items():
                n[i] = len(t)
            cols["n_chars"] = pa.array(n, batch.schema.field("n_chars").type)
        batch = pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
    return batch.filter(pa.array(keep))


def cut_words(text: str, mask: np.ndarray) -> str:
    """text without the masked words and what stands between two of them."""
    raw = text.encode()
    flat = np.frombuffer(raw.translate(TO_WORDS), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[False], flat, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1), strict=True):
        out.append(raw[at: start[a]])
        at = end[b - 1]
    return b"".join([*out, raw[at:]]).decode()


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: windows of 13 words of all benchmark items against all documents."""
    index = build_index(table(spark, sf_dir, "documents"), shared_dir(spark, "postings"))
    return contamination(search_windows(index, table(spark, sf_dir, "benchmark")))


ORACLE_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM item, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
size AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT d.rid, d.n, d.i, win.item_id
  FROM (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
        FROM doc, size, unnest(range(1, len(w) - n + 2)) AS t(i)) d
  JOIN win ON win.g = d.g AND win.n = d.n),
hit AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM occ, unnest(range(0, n)) AS t(k) GROUP BY rid),
its AS (
  SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
