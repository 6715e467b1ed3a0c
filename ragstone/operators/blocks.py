"""Two large sides met block by block, and the k best of many queries.

One side's rows are packed into blocks of bounded size, a row each, and every block of
the corpus side meets every block of the query side.  A single block of queries goes to the
tasks as it is; more of them make a grid, in which a task meets one
partition of the corpus with one block of queries.  Nothing passes through the driver but
counts, and a task holds one block of each side at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragstone.operators.ranking import PLACES


def paired(corpus: DataFrame, queries: DataFrame, n: int, key: str = "block") -> DataFrame:
    """Every block of corpus with every one of n blocks of queries (one row a block, at most
    some MB each, its number in the column key).  Both sides are tables: a grid reads the corpus once for each block of queries."""
    if n <= 1:
        return corpus.join(F.broadcast(queries))
    return corpus.crossJoin(queries.repartitionByRange(n, key))  # a partition for each block


def cuts(sizes: np.ndarray, most: int, rows: int) -> list[int]:
    """Where to cut rows of these sizes so that each part has about most, and at most so many rows."""
    at, held = [0], 0
    for i, n in enumerate(sizes.tolist()):
        if i > at[-1] and (held + n > most or i - at[-1] >= rows):
            at.append(i)
            held = 0
        held += n
    return [*at, len(sizes)]


class Best:
    """The k best (score rounded, then id, both falling) of each of n queries so far; k None
    keeps all.  `edge` holds the rounded score that a new one must reach, so later blocks
    sort out most of their scores by one comparison."""

    def __init__(self, n: int, k: int | None):
        self.n, self.k, self.parts, self.held = n, k, [], 0
        self.edge = np.full(n, -np.inf)

    def add(self, i: np.ndarray, ids: np.ndarray, s: np.ndarray, *more: np.ndarray) -> None:
        """Scores s of queries i with ids, and more of each."""
        if len(i):
            self.parts.append((i, ids, s, *more))
            self.held += len(i)
            if self.k is not None and self.held > max(4 * self.k * self.n, 1 << 16):
                self.cut()

    def add_matrix(self, s: np.ndarray, ids: np.ndarray, *more, first: int = 0) -> None:
        """Scores of the queries from first on (rows) with ids (columns), minus infinity for
        pairs that don't count; more(i, j) gives what else belongs to pairs of row and column."""
        low = self.edge[first: first + len(s)]
        new = ~np.isfinite(low)
        if self.k is not None and self.k < s.shape[1] and new.any():
            # no edge yet: that of these columns alone
            low = low.copy()
            part = np.round(s[new], PLACES)
            low[new] = np.partition(part, part.shape[1] - self.k, axis=1)[:, part.shape[1] - self.k]
        i, j = np.nonzero(s >= (low - 2 * 10.0**-PLACES)[:, None] if self.k is not None and np.isfinite(low).any() else np.isfinite(s))
        value = s[i, j]
        keep = np.isfinite(value) & (np.round(value, PLACES) >= low[i])
        i, j, value = i[keep], j[keep], value[keep]
        self.add(i + first, ids[j], value, *(m(i, j) for m in more))
        if self.k is not None and self.parts and ((new.any() and len(s) > 1) or self.held > 2 * self.k * max(self.n, 8)):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        """All that is left, by query and rank."""
        i, ids, s, *more = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        if self.k is not None:
            rank, r = np.unique(ids, return_inverse=True)[1], np.round(s, PLACES)
            order = np.lexsort((-rank, -r, i))
            i, r = i[order], r[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            last = place == self.k - 1
            self.edge[i[last]] = r[last]
            keep = place < self.k
            order, i = order[keep], i[keep]
            ids, s, more = ids[order], s[order], [m[order] for m in more]
        self.parts, self.held = [(i, ids, s, *more)], len(i)
        return i, ids, s, *more
