"""A score of one's own with a bound: few pairs are scored, and the ranking is that of all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from ragstone.functions.vectors import CityBlock
from ragstone.operators import dense


class Counted(CityBlock):
    def __init__(self):
        self.scored = 0

    def __call__(self, a, b):
        self.scored += len(a) * len(b)
        return super().__call__(a, b)

    def pairs(self, a, b):
        self.scored += len(a) if a.dtype == np.float64 else 0
        return super().pairs(a, b)


def batch(ids, m) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(m), pa.list_(pa.float64()))], ["id", "embedding"])


def search(score, ids, m, part, k, asked=None):
    q = dense.Queries(*batch(ids, m).columns, score, block=asked or dense.QUERY_BLOCK)
    own = dense._Vectors(q, k)
    for at in range(0, len(ids), part):
        assert list(own.add(batch(ids[at: at + part], m[at: at + part]))) == []
    return sorted((q, c, s) for out in own.rows() for q, c, s in zip(*(x.to_pylist() for x in out.columns), strict=True))


def plain(ids, m, k):
    out = []
    for i, row in zip(ids, m, strict=True):
        with np.errstate(all="ignore"):
            s = CityBlock()(row[None], m)[0]
        out += [(i, c, x) for x, c in sorted(((x, c) for x, c in zip(s.tolist(), ids, strict=True) if c != i and np.isfinite(x)), key=lambda p: (-round(p[0], 9), -p[1]))[:k]]
    return sorted(out)


def test_few_pairs_are_scored():
    m = np.random.default_rng(1).normal(size=(3000, 64))
    m /= np.linalg.norm(m, axis=1)[:, None]
    ids, score = list(range(3000)), Counted()
    assert search(score, ids, m, 1500, 10) == plain(ids, m, 10)
    assert score.scored < 0.1 * len(m) ** 2  # all of them before


def odd(kind: str) -> np.ndarray:
    r = np.random.default_rng(2)
    m = r.normal(size=(300, 9))
    if kind == "ties":
        m = r.integers(0, 3, (300, 9)).astype(float)
    if kind == "copies":
        m[100:] = m[:200]
    if kind == "constant":
        m[:, :4], m[7, 2] = 5.0, -1e6
    if kind == "equal":
        m[:] = 1.0
    if kind == "far":
        m *= 10.0 ** r.integers(-9, 9, (300, 1))
    if kind == "shifted":
        m += 1e9
    if kind == "huge":
        m[3] *= 1e300
    if kind == "not numbers":
        m[5, 1], m[6, 2], m[7] = np.nan, np.inf, -np.inf
    return m


@pytest.mark.parametrize("kind", ["ties", "copies", "constant", "equal", "far", "shifted", "huge", "not numbers"])
@pytest.mark.parametrize("part", [300, 70])
def test_odd_vectors_rank_as_all_pairs_do(kind, part, monkeypatch):
    monkeypatch.setattr(dense, "WIDE", 32)
    m, ids = odd(kind), list(range(300))
    for asked in (None, 41):
        assert search(CityBlock(), ids, m, part, 4, asked) == plain(ids, m, 4)
    assert search(CityBlock(), ids[:8], m[:8], 8, 10) == plain(ids[:8], m[:8], 10)  # fewer than k


@pytest.mark.parametrize("size", [0.01, 1.0, 50.0])
def test_bound(size):
    a, b = np.random.default_rng(3).standard_t(2, (2, 200, 12)) * size
    score, scale = CityBlock(), CityBlock().scale(a[:50])
    bound = score.terms(a, scale).astype(float) @ score.terms(b, scale).T.astype(float) - score.least(scale)
    assert (score(a, b) <= bound + 1e-4 * size).all()
    assert np.array_equal(score.pairs(a, b), np.diag(score(a, b)))
