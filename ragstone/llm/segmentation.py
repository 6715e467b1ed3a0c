"""Operator 8: SentencePiece N-best segmentation and decoding.

The pieces of a model span a lattice over a text; a path's score is the sum of
its pieces' scores.  Forward Viterbi gives every position the best score of a
path from the start.  Read from the end, that is the exact remaining score of a
partial path, so backward A* search takes whole paths off its agenda in order of
their scores: the first n are the n best.

A character that no piece covers is spelled in byte pieces, which together cost
UNKNOWN less than the model's least score; a piece may never stand beside a
cheaper spelling of itself, because bytes are used only there.

Segments (pieces.py) are independent, so a text's best path joins its segments'
best paths, and its n best replace at most n - 1 of them, those whose second
path costs least.  Each distinct segment is searched once per worker while it
is kept; new ones of one length go through the forward pass together, over a trie of the pieces.

Decoding joins the pieces' texts, bytes included, and drops the dummy space.

Edge cases: null counts as empty: no pieces, score 0, one (empty) segmentation,
which decodes to the empty text; a text that holds the space mark itself decodes
with spaces in its place, so its round trip is false; long texts are segmented
whole; the best of tied paths is the one whose last pieces are longer, and the other
tied ones follow as the agenda comes to them, those nearest to the text's start first;
rows that repeat a doc_id each get their row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone.llm.common import WordCache, slices, table, utf8_values
from ragstone.llm.pieces import Pieces, parts

N_BEST = 4
UNKNOWN = 10.0
#: segments of more characters are searched one by one
WIDE = 40


class Lattice:
    """Forward Viterbi and backward A* over the pieces of a model."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        # multiples of 2 ** -24, to which a model's 32-bit scores are rounded: sums are exact,
        # so that paths of the same pieces in another order tie exactly
        self.pieces.round_scores(1 << 24)
        ordinary = [s for s in self.pieces.scores.values() if s > -1e8]
        self.unknown = min(ordinary) - UNKNOWN
        self.best = WordCache(self._best, 0.85, path)
        self.lists = WordCache(self._list, 0.15, path)
        self.trie: tuple | None = None

    def arcs(self, text: str) -> list[list[tuple[int, float]]]:
        """For each end, the (start, score) of the arcs that reach it, short ones first."""
        scores, heads, n = self.pieces.scores, self.pieces.heads, len(text)
        into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            if text[i] not in scores:
                into[i + 1].append((i, self.unknown))
            for j in range(i + 1, n + 1):
                piece = text[i:j]
                score = scores.get(piece)
                if score is not None:
                    into[j].append((i, score))
                elif piece not in heads:
                    break
        for arcs in into:
            arcs.reverse()
        return into

    def forward(self, text: str) -> tuple[list[list[tuple[int, float]]], list[float]]:
        """The arcs and the best score of a path from the start to each position."""
        into = self.arcs(text)
        best = [0.0]
        for arcs in into[1:]:
            best.append(max(best[i] + s for i, s in arcs))
        return into, best

    def nbest(self, text: str, n: int) -> list[tuple[float, list[str]]]:
        """The n best paths as (score, pieces), best first.

        Of partial paths with equal totals the one that is nearest to the text's start goes
        first: it is completed before others are begun, so that ties, however many, cost no more
        than a path's length each."""
        into, best = self.forward(text)
        agenda: list[tuple] = [(-best[-1], len(text), 0, 0.0, None)]
        found, count = [], 0
        while agenda and len(found) < n:
            _, at, _, behind, path = heappop(agenda)
            if at == 0:
                cuts = []
                while path:
                    cuts.append(text[path[0]: path[1]])
                    path = path[2]
                found.append((behind, cuts))
                continue
            for start, score in into[at]:
                count += 1
                heappush(agenda, (-(best[start] + score + behind), start, count, behind + score, (start, at, path)))
        return found

    def ids(self, lines: int, cuts: list[str]) -> bytes:
        """Ids of a segment's pieces as little-endian u32 bytes."""
        own, raw = self.pieces.ids, self.pieces.bytes
        out = array("I", [raw[10]] * lines)
        for c in cuts:
            i = own.get(c)
            if i is None:
                out.extend(raw[b] for b in c.encode())
            else:
                out.append(i)
        return out.tobytes()

    def _best(self, key: str) -> tuple[bytes, float, float]:
        """(ids of the best path, its score, how much less the second path scores)."""
        lines, text = parts(key)
        heads, n, least = self.pieces.heads, len(text), float("-inf")
        first, second, back = [0.0] + [least] * n, [least] * (n + 1), [0] * (n + 1)
        for i in range(n):
            x, y = first[i], second[i]
            for j in range(i + 1, n + 1):
                score = heads.get(text[i:j], 1.0)
                if score is None:
                    if j > i + 1 or text[i] in self.pieces.ids:
                        continue
                    score = self.unknown
                elif score > 0.0:  # nothing starts so
                    if j > i + 1:
                        break
                    score = self.unknown
                one, total = first[j], x + score
                if total > one:  # of ties the earliest start stays, as in nbest()
                    first[j], back[j] = total, i
                    other = y + score
                    second[j] = one if one > other else other  # the second was no better than one
                elif total > second[j]:
                    second[j] = total
        cuts, end = [], len(text)
        while end:
            cuts.append(text[back[end]: end])
            end = back[end]
        cuts.reverse()
        return self.ids(lines, cuts), first[-1] + lines * self.unknown, first[-1] - second[-1]

    def _trie(self) -> tuple:
        """The heads of pieces as a trie: sorted keys (node and character) and the nodes they lead to, those
        from the root by character, and each node's score (minus infinity if it only starts
        a piece) and id."""
        heads = self.pieces.heads
        number = {"": 0} | {h: i for i, h in enumerate(heads, 1)}
        key = np.array([number[h[:-1]] << 21 | ord(h[-1]) for h in heads], np.int64)
        order = np.argsort(key)
        root = np.full(0x110000, -1, np.int32)
        for h in heads:
            if len(h) == 1:
                root[ord(h)] = number[h]
        score = np.array([-np.inf, *(-np.inf if x is None else x for x in heads.values())])
        ids = np.array([-1, *(self.pieces.ids.get(h, -1) for h in heads)])
        return key[order], (order + 1).astype(np.int32), root, score, ids

    def learn(self, keys: list[str]) -> None:
        """Puts _best() of new segments into the cache, many at a time: those of one length go through
        the positions together."""
        by_size: dict[int, list[tuple[str, int, str]]] = {}
        for key in keys:
            lines, text = parts(key)
            if 0 < len(text) <= WIDE and len(key) <= 64:
                by_size.setdefault(len(text), []).append((key, lines, text))
        for n, rows in by_size.items():
            for at in range(0, len(rows), 1 << 14):
                some = rows[at: at + (1 << 14)]
                for (key, _, _), value in zip(some, self._best_all(n, some), strict=True):
                    self.best.keep(key, value)

    def _best_all(self, n: int, rows: list[tuple[str, int, str]]) -> list[tuple[bytes, float, float]]:
        """_best() of segments with n characters each, given as (key, line ends, characters)."""
        if self.trie is None:
            self.trie = self._trie()
        keys, nodes, root, scores, ids = self.trie
        chars = np.frombuffer("".join(t for _, _, t in rows).encode("utf-32-le"), "<u4").reshape(-1, n).T.astype(np.int64)
        first, second = np.full((2, n + 1, len(rows)), -np.inf)
        first[0] = 0.0
        back, piece = np.zeros((n + 1, len(rows)), np.int32), np.full((n + 1, len(rows)), -1, np.int32)
        for i in range(n):
            live, node = np.arange(len(rows)), root[chars[i]]
            for j in range(i + 1, n + 1):
                if j > i + 1:
                    key = node.astype(np.int64) << 21 | chars[j - 1][live]
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    found = keys[at] == key
                    live, node = live[found], nodes[at[found]]
                    if not len(live):
                        break
                score, own = scores[node], ids[node]
                if j == i + 1:  # a character without a piece is spelled
                    spelled = (node < 0) | (own < 0)
                    score, own = np.where(spelled, self.unknown, score), np.where(spelled, -1, own)
                x, one, two = first[i][live], first[j][live], second[j][live]
                total = x + score
                better = total > one
                second[j][live] = np.where(better, np.maximum(one, second[i][live] + score), np.maximum(two, total))
                some = live[better]
                first[j][some], back[j][some], piece[j][some] = total[better], i, own[better]
                if j == i + 1:
                    live, node = live[node >= 0], node[node >= 0]
                    if not len(live):
                        break
        line = self.pieces.bytes[10]
        out = []
        for (_, lines, text), top, margin, b, p in zip(rows, first[n].tolist(), (first[n] - second[n]).tolist(), back.T.tolist(), piece.T.tolist(), strict=True):
            end, cuts = n, []
            while end and p[end] >= 0:
                cuts.append(p[end])
                end = b[end]
            if not end:
                cuts += [line] * lines
                cuts.reverse()
                coded = array("I", cuts).tobytes()
            else:  # characters that are spelled
                end, cuts = n, []
                while end:
                    cuts.append(text[b[end]: end])
                    end = b[end]
                cuts.reverse()
                coded = self.ids(lines, cuts)
            out.append((coded, top + lines * self.unknown, margin))
        return out

    def _list(self, key: str) -> tuple[list[tuple[float, bytes]], bool]:
        """The n best of a segment, and whether all of them decode to the same."""
        lines, text = parts(key)
        ways = [(s + lines * self.unknown, self.ids(lines, cuts)) for s, cuts in self.nbest(text, N_BEST)]
        return ways, len({self._raw(ids) for _, ids in ways}) == 1

    def encode(self, text: str, n: int = N_BEST) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text as (score, ids), best first."""
        return self.encode_checked(text, n)[0]

    def encode_checked(self, text: str, n: int = N_BEST, keys: list[str] | None = None) -> tuple[list[tuple[float, bytes]], bool]:
        """encode(), and whether all segmentations decode to what the best one does; keys may give
        the text's segments."""
        keys = self.pieces.segments(text) if keys is None else keys
        if not keys:
            return [(0.0, b"")], True
        coded, scores, margins = zip(*map(self.best.__getitem__, keys), strict=True)
        total, margins = sum(scores), np.array(margins)
        loose = np.flatnonzero(margins < np.inf)
        if len(loose) > n - 1:
            edge = np.partition(margins[loose], n - 2)[n - 2] if n > 1 else -1.0
            loose = loose[margins[loose] <= edge]
            loose = loose[np.argsort(margins[loose], kind="stable")][: n - 1]
        loose = np.sort(loose).tolist()
        lists = [self.lists[keys[i]] for i in loose]
        choices = [ways for ways, _ in lists]
        ways = sorted((sum(c[0][0] - c[k][0] for c, k in zip(choices, w, strict=True)), w) for w in product(*(range(len(c)) for c in choices)))[:n]
        # what stands between the loose segments is the same in every way
        kept = [b"".join(coded[a:b]) for a, b in zip([0, *(i + 1 for i in loose)], [*loose, len(coded)], strict=True)]
        out = []
        for less, w in ways:
            ids = [kept[0]]
            for c, k, rest in zip(choices, w, kept[1:], strict=True):
                ids += c[k][1], rest
            out.append((total - less, b"".join(ids)))
        # they differ in their loose segments only
        return out, all(same for _, same in lists)

    def _raw(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        """The text of ids."""
        return self._raw(ids).removeprefix(b" ").decode(errors="replace")

    def trim(self) -> None:
        self.best.trim()
        self.lists.trim()


_LATTICES: dict[str, Lattice] = {}


def lattice(model: str) -> Lattice:
    """The worker's lattice of a model file, made once."""
    return _LATTICES.get(model) or _LATTICES.setdefault(model, Lattice(model))


SCHEMA = "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, score double, n_segmentations int, margin double, nbest_crc32 long, round_trip boolean"


def segmented(docs: DataFrame, model: str, *, n: int = N_BEST) -> DataFrame:
    """For every row of docs (doc_id, text): the best segmentation's length, ids (as
    crc32) and score, how many of the n best there are, the last one's distance in
    score (margin), the crc32 of all of their ids, and whether they all decode to the
    text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model)
        for batch in slices(batches, "text", 2 << 20):
            own.trim()
            out = []
            raws = utf8_values(batch.column("text"))
            texts = [raw.decode() for raw in raws]
            keys = [own.pieces.segments(t) for t in texts]
            own.learn(own.best.unknown(set().union(*keys)))
            for raw, text, k in zip(raws, texts, keys, strict=True):
                ways, same = own.encode_checked(text, n, k)
                same = same and own.decode(ways[0][1]) == text
                crc = 0
                for _, ids in ways:
                    crc = zlib.crc32(ids, crc)
                out.append((len(raw), len(ways[0][1]) // 4, zlib.crc32(ways[0][1]), ways[0][0], len(ways), ways[0][0] - ways[-1][0], crc, same))
            cols = [*zip(*out, strict=True)]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(rows, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the four best segmentations of all documents under piece_bpe_32k."""
    import public_tokenizers

    return segmented(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
