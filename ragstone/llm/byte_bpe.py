"""Operator 11: byte-level BPE encoding and decoding with offsets.

A rank file (base64 of a token's bytes and its rank, a line a token) becomes a
tokenizer of the tokenizers library: every byte has a printable character of its
own (``byte_chars``), so tokens are strings and merges pairs of strings.  A rank
file merges any two neighbours whose join has a rank, so each token gives a merge
for every way to cut it in two tokens of lower rank.

Texts are cut before spaces that a visible character follows.  The pattern always
cuts there, whatever stands around it: its matches end before such a space, or
start with it.  So pieces may be encoded apart, and each distinct piece is encoded
once per worker while it is kept; new ones go to the library a thousand at a time, as one
string, which is cut between them again.  Other patterns get whole texts.

``encoded`` gives ids and the character at which each token starts; a token that
starts inside a character has that character's number, as in the library's own
offsets.  ``decoded`` reverses the byte table: the bytes are exact, the text puts
U+FFFD for bytes that are no character.  ``Decoder.stream`` decodes lists of ids one
after the other and holds back a character's first bytes until its last has come.

Edge cases: null counts as empty: no ids, which decode to the empty text; texts with
the name of a special token are ordinary text; long texts are encoded whole; rows that
repeat a doc_id each get their row; null ids and ids without a token decode to nothing
and U+FFFD; an empty table gives no rows; other columns are ignored.  Memory follows the slice
of 2 MB, or a single longer text.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone.llm.common import WordCache, slices, table, utf8_values

#: the only pattern for which cuts before spaces are known to be right
SPACE_CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: a space that ends no piece, and one that starts none
_CUT, _UNCUT = re.compile(r" (?=\S)"), re.compile(r" (?:\s|\Z)")
#: in pieces longer than LONG characters, where a run of letters ends at a mark
_INNER, LONG = re.compile("(?<=[A-Za-zぁ-ゖァ-ヺ一-龥가-힣])(?=[!-&(-/:-@\\[-`{-~、。！，])"), 1 << 16


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: visible Latin-1
    characters stand for themselves, the others follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Ids of whole texts under a rank file."""

    def __init__(self, path: str, pattern: str = SPACE_CUTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, chars = load_ranks(path), byte_chars()
        names = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.__getitem__):
            most = ranks[token]
            cuts = ((token[:k], token[k:]) for k in range(1, len(token)))
            merges += [(names[a], names[b]) for a, b in cuts if ranks.get(a, most) < most and ranks.get(b, most) < most]
        # a match that is a token itself needs no merges, as in the rank file's own library
        self.lib = Tokenizer(models.BPE(vocab={n: ranks[t] for t, n in names.items()}, merges=merges, ignore_merges=True))
        self.by_piece = pattern == SPACE_CUTS
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=self.by_piece)  # that is its own pattern
        self.lib.pre_tokenizer = level if self.by_piece else pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), level])
        self.pieces = WordCache(owner=(path, pattern))
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, r in ranks.items():
            self.sizes[r] = len(t)

    @staticmethod
    def keys(text: str) -> list[str]:
        """A text's pieces: those after the first without their leading space, the first
        with a space before it, so that the two kinds differ."""
        parts = _CUT.split(text) if _UNCUT.search(text) else text.split(" ")
        parts[0] = " " + parts[0]
        return parts

    def _together(self, texts: list[str], between: str) -> list[bytes]:
        """The ids of each text, from one string in which they stand side by side, or with a
        character between them that is a match of its own."""
        whole = between.join(texts)
        ids = np.array(self.lib.encode_batch_fast([whole], add_special_tokens=False)[0].ids, "<u4")
        end = np.cumsum([len(t) + len(between) for t in texts]) - len(between)
        start = np.concatenate([[0], end[:-1] + len(between)])
        if not whole.isascii():
            raw = np.frombuffer(whole.encode(), np.uint8)
            at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where each character starts
            start, end = at[start], at[end]
        token = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        low, high = (4 * np.searchsorted(token, x) for x in (start, end))
        coded = ids.tobytes()
        return [coded[a:z] for a, z in zip(low.tolist(), high.tolist(), strict=True)]

    def _learn(self, keys: list[str]) -> list[str]:
        """Puts the ids of new pieces into self.pieces; returns those too long to stay."""
        spaced, bare, other = [], [], []
        for k in keys:
            if len(k) > LONG:
                other.append(k)
            elif k[0] != " ":
                spaced.append(k)
            else:  # a single line end between visible characters is a match of its own
                (bare if k[1:].split() == [k[1:]] else other).append(k)
        got: dict[str, bytes] = {}
        for at in range(0, len(spaced), 1000):
            some = spaced[at: at + 1000]
            got.update(zip(some, self._together([" " + k for k in some], ""), strict=True))
        for at in range(0, len(bare), 1000):
            some = bare[at: at + 1000]
            got.update(zip(some, self._together([k[1:] for k in some], "\n"), strict=True))
        for k in other:
            text = k[1:] if k[0] == " " else " " + k
            some = self.lib.encode_batch_fast(_INNER.split(text) if len(text) > LONG else [text], add_special_tokens=False)
            got[k] = b"".join(array("I", e.ids).tobytes() for e in some)
        return self.pieces.keep_all(got)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.by_piece:
            return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        self.pieces.trim()
        keys = [self.keys(t) for t in texts]
        new = self.pieces.unknown(set().union(*keys))
        long = self._learn(new) if new else []
        coded = [np.frombuffer(b"".join(map(self.pieces.__getitem__, k)), "<u4") for k in keys]
        self.pieces.drop_words(long)
        return coded

    def starts(self, raw: bytes, ids: np.ndarray) -> np.ndarray:
        """The number of the character in which each token of a text starts."""
        sizes = self.sizes[ids]
        at = np.cumsum(sizes) - sizes
        if len(raw) == 0 or raw.isascii():
            return at
        char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
        return char[at]


class Decoder:
    """Bytes and text of ids."""

    UNKNOWN = "�".encode()

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.tokens = [self.UNKNOWN] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)

    def raw(self, ids: list[int]) -> bytes:
        try:
            if not ids or min(ids) >= 0:
                return b"".join(map(self.tokens.__getitem__, ids))
        except (IndexError, TypeError):
            pass
        n = len(self.tokens)
        return b"".join(self.tokens[i] if 0 <= i < n else self.UNKNOWN for i in ids if i is not None)

    def raws(self, lists: pa.ListArray) -> pa.Array:
        """raw() of each list."""
        ids = lists.flatten()
        if lists.null_count or ids.null_count or not len(ids):
            return pa.array([self.raw(x or []) for x in lists.to_pylist()], pa.binary())
        ids = ids.to_numpy()
        if ids.min() < 0 or ids.max() >= len(self.tokens):
            return pa.array([self.raw(x) for x in lists.to_pylist()], pa.binary())
        size = self.size[ids]
        end = np.cumsum(size)
        flat = self.flat[np.arange(end[-1]) + np.repeat(self.start[ids] - (end - size), size)]
        last = lists.offsets.to_numpy()
        cut = np.concatenate([[0], end])[last - last[0]]
        return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())

    def stream(self, parts: Iterable[list[int]]) -> Iterator[str]:
        """The text of each list of ids of one text; a character that is split between
        lists comes with the list of its last byte."""
        held = codecs.getincrementaldecoder("utf-8")(errors="replace")
        for ids in parts:
            yield held.decode(self.raw(ids))
        rest = held.decode(b"", final=True)
        if rest:
            yield rest


_MADE: dict[tuple, Encoder | Decoder] = {}


def made(kind: type, *args):
    """The worker's encoder or decoder of a file, made once."""
    return _MADE.get((kind, *args)) or _MADE.setdefault((kind, *args), kind(*args))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([*parts, np.zeros(0)]).astype(np.int32))


def encoded(docs: DataFrame, ranks: str, pattern: str = SPACE_CUTS) -> DataFrame:
    """doc_id, n_bytes, ids and starts (the character in which each token starts) for every
    row of docs (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = made(Encoder, ranks, pattern)
        for batch in slices(batches, "text", 2 << 20):
            raw = utf8_values(batch.column("text"))
            ids = own.encode([t.decode() for t in raw])
            starts = [own.starts(t, i) for t, i in zip(raw, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), _lists(ids), _lists(starts)], ["doc_id", "n_bytes", "ids", "starts"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(rows, "doc_id long, n_bytes long, ids array<int>, starts array<int>")


def decoded(coded: DataFrame, ranks: str) -> DataFrame:
    """The rows of coded with their ids' exact bytes (decoded) besides."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = made(Decoder, ranks)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, own.raws(batch.column("ids"))], [*batch.schema.names, "decoded"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(rows, f"{names}, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all documents under byte_bpe_multi_50k, encoded and decoded."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encoded(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return decoded(coded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_bytes",
        F.try_element_at("starts", F.lit(-1)).alias("last_start"),
    )
