"""Exact dense retrieval, of vectors and of documents that are made of chunks.

`score_pairs` states all pairs as an expression, for small inputs; a score of one's own for large ones is a
function of two matrices.  `dense_topk` and
`dense_documents` are the way for large sides: queries are packed into blocks (at most
QUERY_BLOCK vectors, fewer for a large k), a task multiplies its part of the corpus with a block, PRODUCT_BYTES of
scores at a time, and sends on k rows of each query.  A query's k-th score so far is
the edge that later products must reach (blocks.py).  One block of queries goes to the tasks as it is, and the
corpus isn't moved; more blocks meet the blocks of the stored corpus in a grid.

Where the k best vectors are asked, products are of single precision first: a tile that stays in a cache, and
only pairs within its error of the edge are multiplied again in double precision, which alone ranks.
A score of one's own that has a bound (Bounded) is found so too: products of single precision bound it from above, and only
pairs that may reach the edge are scored.

`dense_documents` has a document's chunks beside each other and reduces their scores to
the document's in the task, so neither pairs of query and chunk nor those of query
and document leave it, but for the k best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragstone.functions.vectors import score_function
from ragstone.operators.aggregate import METHODS
from ragstone.operators.blocks import Best, paired
from ragstone.operators.ranking import PLACES, top_k
from ragstone.session import BLOCK_FILES, written

#: queries of a block at most, and rows that a task keeps of them (k of each); vectors of a block of
#: the corpus, bytes of a product of two
QUERY_BLOCK, KEPT, ROW_BLOCK, PRODUCT_BYTES = 16384, 400_000, 8192, 32 << 20
#: products of single precision at a time, and vectors of the corpus in them; what a sum of n such products may be off by n times (twice a
#: rounding), as a part of the vectors' lengths; lengths up to which such products stay finite
TILE, WIDE, ROUNDING, LONGEST = 1 << 20, 2048, 2.0**-23, 1e15
#: pairs that are scored at once where they stand alone, and the share of a tile from which on all of it is; for each of the k best
#: of the first vectors, pairs that are scored to find an edge; tasks of a grid for each core
PAIRS, DENSE, LIKELY, WAVES = 1 << 10, 1 / 4, 5, 4
#: a score of one's own: the rows of two matrices with each other
Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Bounded(Protocol):
    """A score of one's own with an upper bound that is a product: score(a, b) <= terms(a, scale) @ terms(b, scale).T
    - least(scale), but for rounding, for any scale with positive numbers (one for each coordinate)."""

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray: ...

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Scores of the rows of a with those of b beside them, to the last bit those of a call; in single precision for such rows,
        as far off as such sums may be."""

    def scale(self, m: np.ndarray) -> np.ndarray: ...

    def terms(self, m: np.ndarray, scale: np.ndarray) -> np.ndarray: ...

    def least(self, scale: np.ndarray) -> float: ...


def score_pairs(queries: DataFrame, corpus: DataFrame, name: str = "cos_sim", more: dict | None = None) -> DataFrame:
    """query_id, corpus_id, score of all pairs of (id, embedding) with different ids."""
    f = score_function(name, more)
    q = queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("qe"))
    c = corpus.select(F.col("id").alias("corpus_id"), F.col("embedding").alias("ce"))
    return q.join(c, F.col("query_id") != F.col("corpus_id")).select("query_id", "corpus_id", f(F.col("qe"), F.col("ce")).alias("score"))


def _matrix(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of width numbers, which rows are such).  A row that is null, has another
    width or holds a null or NaN isn't; it is zeros."""
    n = len(col)
    size = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
    flat = col.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
    if (size == width).all():
        out = values.reshape(n, width)
    else:
        out = np.zeros((n, width))
        held = np.where(size > 0, size, 0)
        start = np.cumsum(held) - held
        fit = np.flatnonzero(size == width)
        out[fit] = values[start[fit][:, None] + np.arange(width)] if len(values) else 0
    good = (size == width) & ~np.isnan(out).any(axis=1)
    out[~good] = 0
    return out, good


def _unit(m: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.linalg.norm(m, axis=1)
    return m / np.where(n > 0, n, 1)[:, None], good & (n > 0)


def _packed(df: DataFrame, rows: int, whole: str | None = None) -> DataFrame:
    """df in blocks of at most so many rows, one row each with a list of every column; rows
    that are equal in the column whole, which stand together, aren't parted."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, rows, whole):
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in part.columns], part.schema.names)

    return df.mapInArrow(pack, ", ".join(f"{n} array<{t}>" for n, t in df.dtypes))


def gathered(batches: Iterator[pa.RecordBatch], rows: int, whole: str | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of at most so many; see _packed()."""
    held: list[pa.RecordBatch] = []
    count = 0

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if held and count + part.num_rows > rows:
                if whole is None:
                    yield joined(held)
                    held, count = [], 0
                else:
                    every = joined([*held, part])
                    names = every.column(whole)
                    other = pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)
                    cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
                    if cut:
                        yield every.slice(0, cut)
                    held, count = [every.slice(cut)], every.num_rows - cut
                    continue
            held.append(part)
            count += part.num_rows
    if held:
        yield joined(held)


class Queries:
    """A block of query vectors."""

    def __init__(self, ids: pa.Array, embeddings: pa.Array, score: str | Score, groups: pa.Array | None = None, block: int = QUERY_BLOCK):
        self.ids, self.embeddings, self.score, self.groups, self.block = ids, embeddings, score, groups, block
        size = pc.value_counts(pc.drop_null(pc.list_value_length(embeddings))).to_pylist()
        self.width = max(size, key=lambda x: (x["counts"], -x["values"]))["values"] if size else 1
        self.m, self.sound = _matrix(embeddings, self.width)
        if score == "cos_sim":
            self.m, self.sound = _unit(self.m, self.sound)
        self.order: np.ndarray | None = None
        self.single: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.ids)

    def of(self, group) -> Queries:
        """Those of one group; all, where queries have none."""
        if self.groups is None:
            return self
        at = pc.indices_nonzero(pc.equal(self.groups, group))
        return Queries(self.ids.take(at), self.embeddings.take(at), self.score, block=self.block)

    def same(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, key) of those that have the same id."""
        if self.order is None:
            own = np.array(self.ids.to_pylist())
            self.text = own.dtype.kind == "U" or keys.dtype.kind == "U"
            own = own.astype(str) if self.text else own
            self.order = np.argsort(own, kind="stable")
            self.sorted = own[self.order]
        keys = keys.astype(str) if self.text else keys
        low, high = (np.searchsorted(self.sorted, keys, side) for side in ("left", "right"))
        found = np.flatnonzero(high > low)
        each = (high - low)[found]
        at = np.repeat(low[found], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        return self.order[at], np.repeat(found, each)

    def products(self, embeddings: pa.Array, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first query, scores of the queries from there on with all vectors), minus infinity for
        pairs of one id."""
        m, good = self.rows(embeddings)
        q, c = self.same(keys)
        step = min(max(PRODUCT_BYTES // (8 * max(len(m), 1)), 1), self.block)
        for at in range(0, len(self.m), step):
            own = callable(self.score)
            s = self.score(self.m[at: at + step], m) if own else self.m[at: at + step] @ m.T
            s[~self.sound[at: at + step]] = -np.inf if own else -1
            s[:, ~good] = -np.inf if own else -1
            here = (q >= at) & (q < at + step)
            s[q[here] - at, c[here]] = -np.inf
            yield at, s

    def rows(self, embeddings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the corpus as products take them, and which of them are sound."""
        m, good = _matrix(embeddings, self.width)
        return _unit(m, good) if self.score == "cos_sim" else (m, good)

    def near(self, m: np.ndarray, good: np.ndarray, keys: np.ndarray, edge: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
        """(queries, vectors, scores) of all pairs whose score may reach the query's edge, without one so
        far that of the k best of these vectors; none of one id.  None if single precision won't do."""
        if self.single is None:
            self.length = np.linalg.norm(self.m, axis=1)
            self.single = self.m.astype(np.float32)
        length = float(np.linalg.norm(m, axis=1).max(initial=0.0))
        if not max(length, float(self.length.max(initial=0.0))) <= LONGEST:
            return None
        return self._near(m, good, keys, edge, k, (self.width + 4) * ROUNDING * length * self.length + 2 * 10.0**-PLACES)

    def _near(self, m: np.ndarray, good: np.ndarray, keys: np.ndarray, edge: np.ndarray, k: int, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        columns, n = m.astype(np.float32), len(m)
        q, c = self.same(keys)
        order = np.argsort(q, kind="stable")
        q, c = q[order], c[order]
        first = bool(np.isneginf(edge).any())  # an edge is found over all vectors, else tiles are wide in queries too
        width = n if first else min(n, WIDE)
        step = min(max(TILE // max(width, 1), 1), self.block)
        for at in range(0, len(self.m), step):
            to = min(at + step, len(self.m))
            a, z = np.searchsorted(q, (at, to))
            floor = edge[at:to] - off[at:to]
            for left in range(0, n, width):
                s = self.single[at:to] @ columns[left: left + width].T
                s[~self.sound[at:to]] = -1
                s[:, ~good[left: left + width]] = -1
                here = (c[a:z] >= left) & (c[a:z] < left + width)
                s[q[a:z][here] - at, c[a:z][here] - left] = -np.inf
                if first and k < n:
                    new = np.isneginf(floor)
                    floor[new] = np.partition(s[new], n - k, axis=1)[:, n - k] - 2 * off[at:to][new]
                low = np.nextafter(floor.astype(np.float32), np.float32(-np.inf))
                found = np.flatnonzero(s >= low[:, None])
                if first:
                    found = found[np.isfinite(s.ravel()[found])]
                i, j = np.divmod(found, s.shape[1])
                for some in range(0, len(i), TILE // 16):
                    x, y = i[some: some + TILE // 16] + at, j[some: some + TILE // 16] + left
                    value = np.einsum("ij,ij->i", self.m[x], m[y])
                    value[~(self.sound[x] & good[y])] = -1
                    yield x, y, value

    def reaching(self, m: np.ndarray, good: np.ndarray, keys: np.ndarray, edge: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
        """As near(), by the bound of a score of one's own.  None if single precision won't do."""
        fit, score = good & np.isfinite(m).all(axis=1), self.score
        if self.single is None:
            self.finite = self.sound & np.isfinite(self.m).all(axis=1)
            self.largest = float(np.abs(self.m[self.finite]).max(initial=0.0))
            if self.largest <= LONGEST:
                self.scale = score.scale(self.m[self.finite])
                self.single = score.terms(np.where(self.finite[:, None], self.m, 0), self.scale)
                self.length = np.linalg.norm(self.single, axis=1)
                self.short = np.where(self.finite[:, None], self.m, 0).astype(np.float32)
        largest = max(self.largest, float(np.abs(m[fit]).max(initial=0.0)))
        if not largest <= LONGEST or k >= len(m):
            return None
        columns = score.terms(np.where(fit[:, None], m, 0), self.scale)
        length = float(np.linalg.norm(columns, axis=1).max(initial=0.0))
        off = (columns.shape[1] + 4) * ROUNDING * length * self.length + 1e-14 * self.width * largest + 2 * 10.0**-PLACES
        sums = (self.width + 4) * ROUNDING * 2 * self.width * largest + 2 * 10.0**-PLACES
        return self._reaching(m, fit, columns, keys, edge, k, off - score.least(self.scale), sums)

    def _reaching(self, m: np.ndarray, fit: np.ndarray, columns: np.ndarray, keys: np.ndarray, edge: np.ndarray, k: int, off: np.ndarray, sums: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n, score, short = len(m), self.score, np.where(fit[:, None], m, 0).astype(np.float32)
        q, c = self.same(keys)
        order = np.argsort(q, kind="stable")
        q, c = q[order], c[order]
        first = bool(np.isneginf(edge[self.finite]).any())  # an edge is found over all vectors
        width = n if first else min(n, WIDE)
        step = min(max(TILE // max(width, 1), 1), self.block)
        room, all_fit = np.empty(step * width, np.float32), bool(fit.all())
        for at in range(0, len(self.m), step):
            to = min(at + step, len(self.m))
            a, z = np.searchsorted(q, (at, to))
            floor = np.where(self.finite[at:to], edge[at:to], np.inf)
            for left in range(0, n, width):
                right = min(left + width, n)
                here = (c[a:z] >= left) & (c[a:z] < right)
                own = q[a:z][here] - at, c[a:z][here] - left
                s = np.matmul(self.single[at:to], columns[left:right].T, out=room[: (to - at) * (right - left)].reshape(to - at, right - left))
                if not all_fit:
                    s[:, ~fit[left:right]] = -np.inf
                s[own] = -np.inf
                new = np.flatnonzero(np.isneginf(floor))
                if len(new):
                    floor[new] = self._edges(s[new], self.m[at + new], m, k)
                low = np.nextafter((floor - off[at:to]).astype(np.float32), np.float32(-np.inf))
                found = np.flatnonzero(s >= low[:, None])
                if len(found) > DENSE * s.size:
                    s = score(self.m[at:to], m[left:right])
                    s[:, ~fit[left:right]] = -np.inf
                    s[own] = -np.inf
                    i, j = np.nonzero((s >= (floor - 2 * 10.0**-PLACES)[:, None]) & np.isfinite(s))
                    yield i + at, j + left, s[i, j]
                    continue
                if not len(found):
                    continue
                i, j, kept = *np.divmod(found, right - left), []
                for some in range(0, len(i), PAIRS):
                    x, y = i[some: some + PAIRS], j[some: some + PAIRS]
                    value = score.pairs(self.short.take(x + at, axis=0), short.take(y + left, axis=0))
                    kept.append(np.flatnonzero((value >= floor[x] - sums) & np.isfinite(s[x, y])) + some)
                kept = np.concatenate(kept)
                for some in range(0, len(kept), PAIRS):
                    x, y = i[kept[some: some + PAIRS]], j[kept[some: some + PAIRS]]
                    yield x + at, y + left, score.pairs(self.m[x + at], m[y + left])

    def _edges(self, s: np.ndarray, own: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
        """For each of own, whose scores with all of m are bounded by s, what k of m score at least: the k-th of some with the highest bounds."""
        some = min(LIKELY * k, s.shape[1])
        best = np.argpartition(s, s.shape[1] - some, axis=1)[:, s.shape[1] - some:]
        value, step = np.empty(best.shape), max(PAIRS // some, 1)
        for at in range(0, len(s), step):
            i = best[at: at + step]
            value[at: at + step] = self.score.pairs(np.repeat(own[at: at + step], some, axis=0), m[i.ravel()]).reshape(i.shape)
        value[np.isneginf(np.take_along_axis(s, best, axis=1))] = -np.inf
        return np.round(np.partition(value, some - k, axis=1)[:, some - k], PLACES)


def _most(k: int | None) -> int:
    """Queries of a block."""
    return max(min(QUERY_BLOCK, KEPT // (k or 100)), 1)


def _queries(columns: list[pa.Array], score: str | Score, block: int) -> Queries:
    return Queries(*columns[:2], score, *columns[2:], block=block)


def _search(queries: DataFrame, corpus: DataFrame, score: str | Score, block: int | None, k: int | None, make: Callable[[Queries], object], schema: str, whole: str | None = None) -> DataFrame:
    """Every block of queries (id, embedding, and their group if there are groups) with all rows of the corpus, which come to
    make(block).add(rows) in batches; make(block).rows() gives what is left.  Smaller blocks, if any are asked
    for, are multiplied apart, but go to the tasks as many together as a block may hold, so that
    the corpus isn't read for each of them."""
    spark, most = corpus.sparkSession, max(_most(k), block or 1)
    block = block or most
    blocks = written(_packed(queries.coalesce(8), most), "query-blocks", BLOCK_FILES)
    n, asked_for = blocks.agg(F.count("*"), F.coalesce(F.sum(F.size("id")), F.lit(0))).first()
    if n == 0:
        return spark.createDataFrame([], schema)
    if n == 1 and asked_for <= block:
        row = blocks.toArrow()  # one block
        sent = spark.sparkContext.broadcast([row.column(c).chunk(0)[0].values for c in row.column_names])

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = make(_queries(sent.value, score, block))
            for part in gathered(batches, ROW_BLOCK, whole):
                yield from own.add(part)
            yield from own.rows()

        return corpus.mapInArrow(rows, schema)
    stored = written(_packed(corpus, ROW_BLOCK, whole), "corpus-blocks", BLOCK_FILES)
    if _bounded(score):  # the more vectors a task meets, the fewer may reach its edges: no more tasks than keep all cores busy
        stored = stored.coalesce(-(-WAVES * spark.sparkContext.defaultParallelism // n))
    names = stored.columns
    numbered = blocks.select(F.monotonically_increasing_id().alias("query_block"), *(F.col(c).alias(f"query_{c}") for c in blocks.columns))
    asked = numbered.columns[1:]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, object] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("query_block")[i].as_py()
                if number not in held:
                    held[number] = make(_queries([batch.column(c)[i].values for c in asked], score, block))
                yield from held[number].add(pa.RecordBatch.from_arrays([batch.column(c)[i].values for c in names], names))
        for own in held.values():
            yield from own.rows()

    return paired(stored, numbered, n, "query_block").mapInArrow(pairs, schema)


def _bounded(score: str | Score) -> bool:
    return callable(score) and hasattr(score, "terms")


def _keys(col: pa.Array) -> np.ndarray:
    return np.array(col.to_pylist())


class _Vectors:
    """The k best vectors of each query of a block."""

    def __init__(self, queries: Queries, k: int | None):
        self.queries, self.k, self.best, self.type = queries, k, Best(len(queries), k), None

    def add(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.type = part.column("id").type
        if self.k is not None and (not callable(self.queries.score) or _bounded(self.queries.score)) and self._near(part):
            return
        # parts may be wide: of the product a slice of the vectors at a time
        step = max(PRODUCT_BYTES // (8 * max(len(self.queries), 1)), 256)
        for at in range(0, part.num_rows, step):
            some = part.slice(at, step)
            keys = _keys(some.column("id"))
            for first, s in self.queries.products(some.column("embedding"), keys):
                self.best.add_matrix(s, keys, first=first)
            if self.k is None:
                yield from self.rows()
                self.best = Best(len(self.queries), None)

    def _near(self, part: pa.RecordBatch) -> bool:
        """Adds the rows by products of single precision, if these will do."""
        keys, best = _keys(part.column("id")), self.best
        m, good = self.queries.rows(part.column("embedding"))
        find = self.queries.reaching if callable(self.queries.score) else self.queries.near
        pairs = find(m, good, keys, best.edge, self.k)
        if pairs is None:
            return False
        for i, j, s in pairs:
            keep = np.round(s, PLACES) >= best.edge[i]
            best.add(i[keep], keys[j[keep]], s[keep])
        if best.parts and (np.isneginf(best.edge).any() or best.held > (1.2 if callable(self.queries.score) else 2) * self.k * best.n):
            best.cut()
        return True

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.best.parts:
            i, ids, s = self.best.cut()
            yield pa.RecordBatch.from_arrays([self.queries.ids.take(pa.array(i)), pa.array(ids, self.type), pa.array(s)], ["query_id", "corpus_id", "score"])


class _Groups:
    """The k best vectors of each query of a block in each group of the corpus."""

    def __init__(self, queries: Queries, k: int | None, by: str):
        self.queries, self.k, self.by, self.own, self.type = queries, k, by, {}, None

    def add(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        groups = part.column(self.by)
        self.type = groups.type
        for g in pc.unique(groups):
            if g.as_py() not in self.own:
                self.own[g.as_py()] = _Vectors(self.queries.of(g), self.k)
            own = self.own[g.as_py()]
            if len(own.queries):
                yield from self._named(g, own.add(part.filter(pc.equal(groups, g))))

    def _named(self, group: pa.Scalar, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([group.as_py()] * b.num_rows, self.type), *b.columns], [self.by, *b.schema.names])

    def rows(self) -> Iterator[pa.RecordBatch]:
        for g, own in self.own.items():
            yield from self._named(pa.scalar(g, self.type), own.rows())


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int | None = 100, score: str | Score = "cos_sim", block: int | None = None, by: str | None = None) -> DataFrame:
    """query_id, corpus_id, score, rank: the k best of the corpus (id, embedding) for
    each query (id, embedding), a row never for itself; k None ranks all.  A vector that
    is null, holds a null, or has another width than most queries of its block scores -1
    with everything, as a zero vector does by cosine.

    score may be a function: the scores of the rows of one matrix (queries) with those of another, a
    row for each query; vectors as named above have no score then, and aren't ranked.  With a bound (Bounded) most
    pairs needn't be scored.

    by names a column of the corpus, not null, of few values: each gives a ranking of its own, in
    one pass over all of them.  Queries that have the column too are ranked in their own
    group only."""
    if not callable(score) and score not in ("cos_sim", "dot"):
        return top_k(score_pairs(queries, corpus, score), k)
    schema = f"query_id {dict(queries.dtypes)['id']}, corpus_id {dict(corpus.dtypes)['id']}, score double"
    if by is None:
        return top_k(_search(queries.select("id", "embedding"), corpus.select("id", "embedding"), score, block, k, lambda q: _Vectors(q, k), schema), k)
    asked = queries.select("id", "embedding", *([by] if by in queries.columns else []))
    found = _search(asked, corpus.select("id", "embedding", by), score, block, k, lambda q: _Groups(q, k, by), f"`{by}` {dict(corpus.dtypes)[by]}, {schema}")
    return top_k(found, k, by=[by, "query_id"])


def _one(method: str, s: np.ndarray, r: np.ndarray, ids: np.ndarray) -> float:
    """A document's score from its chunks' (s, rounded r), in their order in the document."""
    if method == "first":
        return float(s[0])
    if method == "weighted_rank":
        s = s[np.lexsort((ids, r))[::-1]]
    if method.startswith("weighted"):
        w = 1 / np.arange(1, len(s) + 1)
        return float((s * w).sum() / w.sum())
    return float({"max": np.max, "mean": np.mean, "sum": np.sum}[method](s))


class _Documents:
    """The k best documents of each query of a block, from whole documents' chunks."""

    def __init__(self, queries: Queries, k: int | None, method: str, best: bool):
        self.queries, self.k, self.method, self.with_best = queries, k, method, best
        self.best, self.types = Best(len(queries), k), None

    def add(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        docs = part.column("doc_id")
        self.types = docs.type, part.column("chunk_index").type
        new = pc.not_equal(docs.slice(1), docs.slice(0, len(docs) - 1)).to_numpy(zero_copy_only=False)
        cut = np.concatenate([[0], np.flatnonzero(new) + 1, [len(docs)]]).astype(np.int64)
        # of the product some whole documents at a time
        step, low = max(PRODUCT_BYTES // (8 * max(len(self.queries), 1)), 256), 0
        while low < len(cut) - 1:
            high = max(int(np.searchsorted(cut, cut[low] + step, "right")) - 1, low + 1)
            self._add(part.slice(cut[low], cut[high] - cut[low]), cut[low: high + 1] - cut[low])
            low = high
        if self.k is None:
            yield from self.rows()
            self.best = Best(len(self.queries), None)

    def _add(self, part: pa.RecordBatch, cut: np.ndarray) -> None:
        start, size = cut[:-1], np.diff(cut)
        keys, place = _keys(part.column("chunk_id")), _keys(part.column("chunk_index"))
        names = _keys(part.column("doc_id").take(pa.array(start)))
        owner = np.repeat(np.arange(len(size)), size)
        by_id = np.lexsort((keys, owner))  # within each document by the chunks' ids, rising
        for first, s in self.queries.products(part.column("embedding"), keys):
            gone = np.argwhere(np.isneginf(s))
            with np.errstate(invalid="ignore"):  # where a chunk doesn't count
                d = self._reduced(s, by_id, start, size, self.best.edge[first: first + len(s)])
            n = np.broadcast_to(size, d.shape).copy() if len(gone) and self.with_best else np.broadcast_to(size, d.shape)
            for q, j in {(q, owner[c]) for q, c in gone.tolist()}:  # a chunk that doesn't count for a query
                at = np.arange(cut[j], cut[j + 1])
                at = at[np.isfinite(s[q, at])]
                d[q, j] = _one(self.method, s[q, at], np.round(s[q, at], PLACES), keys[at]) if len(at) else -np.inf
                if self.with_best:
                    n[q, j] = len(at)
            more = []
            if self.with_best:
                def found(i, j, s=s):
                    """The best chunk of each pair: highest score, then highest id."""
                    out = np.zeros(len(i), np.int64)
                    for doc in np.unique(j):
                        mine = np.flatnonzero(j == doc)
                        at = by_id[cut[doc]: cut[doc + 1]]
                        out[mine] = at[len(at) - 1 - np.argmax(np.round(s[np.ix_(i[mine], at[::-1])], PLACES), axis=1)]
                    return out

                more = [lambda i, j, n=n: n[i, j], lambda i, j: place[at] if len(at := found(i, j)) else place[:0], lambda i, j: keys[at] if len(at := found(i, j)) else keys[:0]]
            self.best.add_matrix(d, names, *more, first=first)

    def _reduced(self, s: np.ndarray, by_id: np.ndarray, start: np.ndarray, size: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Queries by documents.  Where chunks would have to be sorted, a document whose best chunk doesn't
        reach a query's edge has that chunk's score, which is no less than its own."""
        if self.method == "max":
            return np.maximum.reduceat(s, start, axis=1)
        if self.method == "first":
            return s[:, start]
        if self.method in ("mean", "sum"):
            total = np.add.reduceat(s, start, axis=1)
            return total / size if self.method == "mean" else total
        if self.method == "weighted_position":
            w = 1 / (np.arange(len(by_id)) - np.repeat(start, size) + 1)
            return np.add.reduceat(s * w, start, axis=1) / np.add.reduceat(w, start)
        out = np.maximum.reduceat(s, start, axis=1)
        i, j = np.nonzero(out >= (edge - 2 * 10.0**-PLACES)[:, None])
        for n in np.unique(size[j]):  # documents of one number of chunks are sorted at once
            mine = np.flatnonzero(size[j] == n)
            w = 1 / np.arange(1, n + 1)
            for some in np.array_split(mine, max(len(mine) * int(n) * 32 // PRODUCT_BYTES, 1)):
                q, doc = i[some], j[some]
                own = s[q[:, None], by_id[start[doc][:, None] + np.arange(n)[::-1]]]  # by id, falling
                order = np.argsort(-np.round(own, PLACES), axis=1, kind="stable")
                out[q, doc] = (np.take_along_axis(own, order, 1) * w).sum(axis=1) / w.sum()
        return out

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.best.parts:
            i, ids, s, *more = self.best.cut()
            types = [pa.int64(), self.types[1], pa.string()] if self.with_best else []
            cols = [pa.array(x, t) for x, t in zip(more, types, strict=True)]
            yield pa.RecordBatch.from_arrays([self.queries.ids.take(pa.array(i)), pa.array(ids, self.types[0]), pa.array(s), *cols], ["query_id", "corpus_id", "score", "num_chunks_matched", "best_chunk_index", "chunk_id"][: 3 + len(cols)])


def dense_documents(queries: DataFrame, chunks: DataFrame, method: str = "max", k: int | None = 100, score: str = "cos_sim", *, best: bool = False, block: int | None = None) -> DataFrame:
    """query_id, corpus_id (the document), score, rank: the k best documents of each query (id,
    embedding), each scored by its chunks (chunk_id string, doc_id, chunk_index, embedding) as
    aggregate.to_documents() does; a chunk of the query's own id doesn't count.  With best
    also num_chunks_matched, and best_chunk_index and chunk_id of the chunk that scores
    highest.  A document's chunks go to one task, so its vectors must fit there."""
    if method not in METHODS:
        raise ValueError(f"unknown aggregation {method!r}; there are {METHODS}")
    score_function(score)
    kinds = dict(chunks.dtypes)
    schema = f"query_id {dict(queries.dtypes)['id']}, corpus_id {kinds['doc_id']}, score double"
    if best:
        schema += f", num_chunks_matched long, best_chunk_index {kinds['chunk_index']}, chunk_id string"
    rows = chunks.select("doc_id", "chunk_index", F.col("chunk_id").cast("string").alias("chunk_id"), "embedding")
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "chunk_index", "chunk_id")
    return top_k(_search(queries.select("id", "embedding"), rows, score, block, k, lambda q: _Documents(q, k, method, best), schema, whole="doc_id"), k)
