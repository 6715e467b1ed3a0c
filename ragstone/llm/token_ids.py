"""Operator 1: token ids in fixed-width bit-packed binary shards.

File format (all integers little-endian).  A shard file is a sequence of
blocks, each followed by one newline byte (the sink's record end, which the
reader skips by length):

    magic  4s  b"TIB1"
    bits   u32   width of an id: the least that holds vocab_size - 1
    shard  u32   number of the shard; shards ascend with doc_id
    block  u32   number of the block within its shard
    n_docs u32
    first  u64   ids of this shard before this block
    n_ids  u64
    then   n_docs bytes     1 if the document has no doc_id
           n_docs i64       doc_id
           n_docs + 1 u32   offsets of the documents, in ids, from the block's start
           packed           n_ids * bits bits, most significant bit first

Because ids have one width, id k of a block lies at bit k * bits: any
document, or any id, can be unpacked with numpy without reading the rest.

Rows are range-partitioned by doc_id and a hash of the text (so that a doc_id
which many rows repeat is dealt out too), the ascending order needs no single task, and the position of a shard is the sum of the totals of those before it
(one number for each shard goes to the driver, none for a document).

Edge cases: null text counts as empty (only the end id is stored); null
doc_ids come first and stay null; rows that repeat a doc_id are all kept,
ordered by a hash of the text and the text; an empty table writes no block and returns no row; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone.llm.common import WordCache, shared_dir, slices, utf8_values, written

HEADER = struct.Struct("<4sIIIIQQ")
BLOCK_IDS = 1 << 18
BLOCKS_PER_FILE = 16
END_ID = 1
#: text that is encoded at once: distinct words are looked up once in it
SLICE_BYTES = 4 << 20


def width(vocab_size: int) -> int:
    """Bits that hold every id below vocab_size."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in fixed-width big-endian bit fields."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8)).reshape(-1, 32)
    return np.packbits(wide[:, 32 - bits:]).tobytes()


def unpack(data, bits: int, start: int, count: int) -> np.ndarray:
    """Ids start .. start + count of a packed run, touching only their bytes."""
    if bits == 16:
        return np.frombuffer(data, ">u2", count, 2 * start).astype(np.uint32)
    low = start * bits
    part = np.frombuffer(data, np.uint8, (low + count * bits + 7) // 8 - low // 8, low // 8)
    field = np.unpackbits(part)[low % 8: low % 8 + count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits:] = field
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


class WordEncoder:
    """Ids of whole texts by a library tokenizer whose tokens never span ASCII
    white space: every distinct word is encoded once by the library and its ids
    are kept while they fit (common.WordCache), a text is the join of its words' ids.

    Words that differ only in ASCII case or in the ASCII marks after their last
    letter share the library's work: the tokenizer lowers case and cuts letters
    from marks itself.  Words of letters only go to the library many at a time,
    as one string; each then ends with the one token that ends a word.

    All this holds for tokenizer files that normalise and cut words as `_STEPS` says,
    which is checked; other files get whole texts."""

    #: the ASCII marks that may follow a word's last letter; an apostrophe joins
    #: contractions and isn't one of them
    MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 0x27)
    #: types of the normaliser's and the pre-tokeniser's steps
    _STEPS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]
    #: how it cuts: contractions, runs of letters, single numbers, runs of other marks
    _CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, by_word: bool | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.vocab_size = self.lib.get_vocab_size(with_added_tokens=True)
        self.by_word = self.cuts_words(json.loads(self.lib.to_str())) if by_word is None else by_word
        if not self.by_word:
            return
        # lower-case ASCII letters are what the normaliser leaves as they are
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.ends = np.zeros(self.vocab_size, bool)
        for token, i in self.lib.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith("</w>")
        self.special = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        #: words as they stand, and the words and marks that stand for others
        self.words = WordCache(owner=path)

    @classmethod
    def cuts_words(cls, file: dict) -> bool:
        """Whether a tokenizer file is of the kind that may be encoded word by word."""
        norm, pre, model = ((file.get(k) or {}) for k in ("normalizer", "pre_tokenizer", "model"))
        steps = [x["type"] for x in norm.get("normalizers", [])], [x["type"] for x in pre.get("pretokenizers", [])]
        if steps != cls._STEPS or model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("dropout"):
            return False
        cut, level = pre["pretokenizers"]
        white = norm["normalizers"][1]
        plain = (white["pattern"], white["content"]) == ({"Regex": r"\s+"}, " ") and not level["add_prefix_space"] and not level["use_regex"]
        return plain and cut["pattern"] == {"Regex": cls._CUT} and cut["behavior"] == "Removed" and cut["invert"] and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in file["added_tokens"])

    def _each(self, texts: list[bytes]) -> list[bytes]:
        encoded = self.lib.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in encoded]

    def _together(self, cores: list[bytes], lib) -> list[bytes]:
        """_each() of words of letters, as one string."""
        ids = np.array(lib.encode_batch_fast([b" ".join(cores).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(cores) or ends[-1] != len(ids):
            return self._each(cores)
        raw, cuts = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _low(self, w: bytes) -> bytes:
        """The word that has the same ids and stands for w.  Below U+0130 every character
        has one lower-case form, whatever stands beside it."""
        if b"<|" in w:
            return w
        if w.isascii():
            return w.lower()
        text = w.decode()
        return text.lower().encode() if max(text) < "\u0130" else w

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Puts the ids of new words, and of the words and marks that stand for them, into
        self.words; returns those that are too long to stay there."""
        ids = self.words
        plain = [w for w in new if w.isalpha() and w.islower()]  # ASCII letters that stand for themselves
        letters = [w for w in new if w.isalpha() and not w.islower()]
        low = [w.lower() for w in letters]
        other, whole, marked = [w for w in new if not w.isalpha()], [], []
        for w, core in zip(other, [w.rstrip(self.MARKS) for w in other], strict=True):
            n = len(core)
            if 0 < n < len(w) and core[-1:].isalpha() and b"<|" not in w:
                marked.append((w, core.lower() if core.isalpha() else self._low(core), w[n:]))
            else:
                whole.append((w, self._low(w)))
        asked = ids.unknown({*low, *(c for _, c in whole), *(x for _, *cm in marked for x in cm)}.difference(plain))
        wide, odd = [], []
        for c in asked:
            if c.isalpha():
                plain.append(c)
            else:
                text = c.decode()
                (odd if not text.isalpha() else plain if max(text) < "\u0130" else wide).append(c)
        got: dict[bytes, bytes] = {}
        for some, lib in ((plain, self.bare), (wide, self.lib)):
            for at in range(0, len(some), 1000):
                part = some[at: at + 1000]
                got.update(zip(part, self._together(part, lib), strict=True))
        for at in range(0, len(odd), 10_000):
            part = odd[at: at + 10_000]
            got.update(zip(part, self._each(part), strict=True))
        long = ids.keep_all(got)
        out = {w: ids[c] for w, c in zip(letters, low, strict=True)}
        out.update((w, ids[c]) for w, c in whole if w != c)
        out.update((w, ids[c] + ids[m]) for w, c, m in marked)
        return long + ids.keep_all(out)

    #: A-Z as a-z, white space as a space
    _LOWER = bytes(32 if bytes([b]).isspace() else ord(chr(b).lower()) if b < 128 else b for b in range(256))
    #: bytes that only characters from U+0100 on have
    _HIGH = bytes(range(0xC4, 256))
    _IS_LETTER = np.array([97 <= b <= 122 for b in range(256)])
    _IS_MARK = np.isin(np.arange(256), list(MARKS))

    def _pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, ends, last) of texts without special tokens whose characters lie below
        U+0100: lower-cased words and the marks behind their last letter, each with a
        space after it, where each ends, and how many there are up to each text's end.

        A run of letters always ends a piece of the tokenizer's own, so a cut behind it changes
        no token; below U+0100 nothing is composed, and case goes by single characters."""
        raw = np.frombuffer(bytearray(b" ".join([*texts, b""]).translate(self._LOWER)), np.uint8)
        letter = self._IS_LETTER[raw]
        at = np.flatnonzero(raw[:-1] == 0xC3) + 1
        if len(at):  # U+00C0 to U+00FF: letters but for the signs of times and division
            c = raw[at]
            raw[at[(c <= 0x9E) & (c != 0x97)]] += 0x20
            letter[at[(c != 0x97) & (c != 0xB7)]] = True
        cut = np.flatnonzero(letter[:-1] & self._IS_MARK[raw[1:]]) + 1
        last = np.cumsum([len(t) + 1 for t in texts])
        last += np.searchsorted(cut, last)
        raw = np.insert(raw, cut, 32)
        ends = np.flatnonzero(raw == 32) + 1
        return raw, ends, np.searchsorted(ends, last) + 1

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        """encode() of such texts, all at once: Python sees distinct words only."""
        raw, ends, last = self._pieces(texts)
        words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(raw)]).dictionary_encode()
        distinct = words.dictionary.buffers()[2].to_pybytes()[:-1].split(b" ")
        del raw, ends
        ids = list(map(self.words.get, distinct))
        missing = [w for w, x in zip(distinct, ids, strict=True) if x is None and w]
        new = self.words.unknown(missing) if missing else []
        long = self._learn(new) if new else []
        if missing or b"" in distinct:
            ids = [x if x is not None else self.words[w] if w else b"" for w, x in zip(distinct, ids, strict=True)]
        self.words.drop_words(long)
        coded = pa.array(ids, pa.large_binary()).take(words.indices)
        _, offsets, held = coded.buffers()
        cuts = np.frombuffer(offsets, np.int64)[last].tolist()
        return [held[a:b].to_pybytes() for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _words(self, texts: list[bytes]) -> list[bytes]:
        """encode() of any texts, by their words as they stand."""
        words = [t.split() for t in texts]
        new = self.words.unknown(set().union(*words))
        long = self._learn(new) if new else []
        coded = [b"".join(map(self.words.__getitem__, w)) for w in words]
        self.words.drop_words(long)
        return coded

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text as little-endian u32 bytes."""
        if not self.by_word:
            return self._each(texts)
        self.words.trim()
        simple = [b"<|" not in t and (t.isascii() or len(t.translate(None, self._HIGH)) == len(t)) for t in texts]
        some = iter(self._whole([t for t, x in zip(texts, simple, strict=True) if x]) if any(simple) else [])
        others = iter(self._words([t for t, x in zip(texts, simple, strict=True) if not x]) if not all(simple) else [])
        return [next(some if x else others) for x in simple]


_ENCODERS: dict[tuple[str, bool | None], WordEncoder] = {}


def encoder(path: str, by_word: bool | None) -> WordEncoder:
    """The worker's encoder for a tokenizer file, made once."""
    key = (path, by_word)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, by_word)
    return _ENCODERS[key]


def _block(bits: int, shard: int, number: int, first: int, docs: list, ids: list[np.ndarray]) -> bytes:
    sizes = np.array([len(x) for x in ids], np.uint32)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u4")
    flat = np.concatenate(ids)
    return b"".join([
        HEADER.pack(b"TIB1", bits, shard, number, len(docs), first, len(flat)),
        bytes(d is None for d in docs),
        np.array([d or 0 for d in docs], "<i8").tobytes(),
        offsets.tobytes(),
        pack(flat, bits),
    ])


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[bytes]]]:
    """(doc_ids, texts) of about limit bytes, from as many batches as that takes."""
    keys, texts, held = [], [], 0
    for batch in slices(batches, "text", limit):
        keys += batch.column("doc_id").to_pylist()
        texts += utf8_values(batch.column("text"))
        held += batch.column("text").nbytes
        if held >= limit:
            yield keys, texts
            keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def write_shards(docs: DataFrame, path: str, tokenizer: str, *, end_id: int | None = END_ID, by_word: bool | None = None) -> str:
    """Encode doc_id, text into bit-packed shard files under path, ascending by doc_id."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, by_word)
        bits = width(max(enc.vocab_size, (end_id or 0) + 1))
        shard, number, first, held = TaskContext.get().partitionId(), 0, 0, 0
        keys: list = []
        ids: list[np.ndarray] = []
        end = b"" if end_id is None else np.array([end_id], np.uint32).tobytes()
        for some, texts in gathered(batches, SLICE_BYTES):
            for key, raw in zip(some, enc.encode(texts), strict=True):
                keys.append(key)
                ids.append(np.frombuffer(raw + end, np.uint32))
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([_block(bits, shard, number, first, keys, ids)])], ["block"])
                    number, first, held, keys, ids = number + 1, first + held, 0, [], []
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([_block(bits, shard, number, first, keys, ids)])], ["block"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    made = ordered.mapInArrow(blocks, "block binary").select(F.col("block").cast("string").alias("value"))
    made.write.option("maxRecordsPerFile", BLOCKS_PER_FILE).option("compression", "none").text(path)
    return path


def blocks_of(content: bytes) -> Iterator[tuple]:
    """(shard, block, first, bits, doc_ids, offsets, packed) for each block of a file."""
    view, at = memoryview(content), 0
    while at < len(view):
        magic, bits, shard, number, n, first, n_ids = HEADER.unpack_from(view, at)
        if magic != b"TIB1":
            raise ValueError(f"no token block at byte {at}")
        at += HEADER.size
        missing = np.frombuffer(view, np.uint8, n, at)
        keys = np.frombuffer(view, "<i8", n, at + n)
        offsets = np.frombuffer(view, "<u4", n + 1, at + 9 * n)
        at += 13 * n + 4
        size = (n_ids * bits + 7) // 8
        yield shard, number, first, bits, pa.array(keys, mask=missing.astype(bool)), offsets.astype(np.int64), view[at: at + size]
        at += size + 1


def read_shards(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """One row for each stored document: doc_id, start, n_tokens, ids_crc32 (and
    ids), unpacked from the files.  start counts the ids of all documents before."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for shard, number, first, bits, keys, offsets, packed in blocks_of(content.as_py()):
                    ids = unpack(packed, bits, 0, int(offsets[-1]))
                    raw = memoryview(ids.tobytes())
                    cut = [raw[4 * a: 4 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                    n = len(keys)
                    cols = [keys, pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(first + offsets[:-1]), pa.array(np.diff(offsets)), pa.array([zlib.crc32(c) for c in cut], pa.int64())]
                    names = ["doc_id", "shard", "block", "at", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int64))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, shard int, block int, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    docs = written(files.mapInArrow(rows, schema), "token-rows")
    # one total for each shard, of which there are as many as partitions
    totals = docs.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    bases, before = [], 0
    for r in totals:
        bases.append((r["shard"], before))
        before += r["n"]
    base = spark.createDataFrame(bases, "shard int, base long")
    return docs.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard", "block", *["ids"] * with_ids)


def _block_ranges(view: memoryview) -> Iterator[tuple]:
    """(first byte, least doc_id, greatest doc_id) of each block of a file."""
    at = 0
    while at < len(view):
        _, bits, _, _, n, _, n_ids = HEADER.unpack_from(view, at)
        start = at + HEADER.size
        keys = np.frombuffer(view, "<i8", n, start + n)[np.frombuffer(view, np.uint8, n, start) == 0]
        yield at, int(keys.min()) if len(keys) else None, int(keys.max()) if len(keys) else None
        at = start + 13 * n + 4 + (n_ids * bits + 7) // 8 + 1


def _documents_at(view: memoryview, at: int, wanted: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(doc_ids, their ids) of the wanted documents of the block at a byte."""
    _, bits, _, _, n, _, _ = HEADER.unpack_from(view, at)
    at += HEADER.size
    keys, offsets = np.frombuffer(view, "<i8", n, at + n), np.frombuffer(view, "<u4", n + 1, at + 9 * n).astype(np.int64)
    own = np.flatnonzero(np.isin(keys, wanted) & (np.frombuffer(view, np.uint8, n, at) == 0))
    packed = view[at + 13 * n + 4:]
    return keys[own], [unpack(packed, bits, int(offsets[i]), int(offsets[i + 1] - offsets[i])).astype(np.int64) for i in own]


def block_index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each stored block: file, at (its first byte), low and high (the least
    and the greatest doc_id).  Ids and texts aren't unpacked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                at, low, high = zip(*_block_ranges(memoryview(content.as_buffer())), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(at)), *(pa.array(x, pa.int64()) for x in (at, low, high))], ["file", "at", "low", "high"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")
    return written(files.mapInArrow(rows, "file string, at long, low long, high long"), "token-blocks")


def read_documents(spark: SparkSession, index: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id, n_tokens, ids of the rows of a few documents: of the shard files only
    those that may hold one are read, and of their blocks only these documents' bits
    are unpacked.  index: block_index()."""
    wanted = sorted(set(doc_ids))
    names = "doc_id long, n_tokens long, ids array<long>"
    near = F.exists(F.array(*map(F.lit, wanted)).cast("array<long>"), lambda x: x.between(F.col("low"), F.col("high")))
    held = index.where(near).groupBy("file").agg(F.collect_list("at").alias("at")).collect() if wanted else []  # files of len(wanted) documents
    if not held:
        return spark.createDataFrame([], names)
    places = {r["file"]: sorted(r["at"]) for r in held}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for at in places[file]:
                    keys, ids = _documents_at(memoryview(content.as_buffer()), at, wanted)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "n_tokens", "ids"])

    return spark.read.format("binaryFile").load([*places]).select("path", "content").mapInArrow(rows, names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all of documents through word_bpe_49k, end id 1 after each document."""
    import public_tokenizers

    from ragstone.llm.common import table

    path = write_shards(table(spark, sf_dir, "documents"), shared_dir(spark, "token-shards"), public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
