"""Vector expressions over arrays, in double precision."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cos_sim(a: Column, b: Column) -> Column:
    """Cosine; a zero vector is similar to nothing (NaN counts as -1)."""
    c = dot(a, b) / (norm(a) * norm(b))
    return F.when(c.isNull() | F.isnan(c), F.lit(-1.0)).otherwise(c)


def normalized(v: Column) -> Column:
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


SCORE_FUNCTIONS: dict[str, Callable[[Column, Column], Column]] = {"cos_sim": cos_sim, "dot": dot}


def score_function(name: str, more: dict | None = None) -> Callable[[Column, Column], Column]:
    known = SCORE_FUNCTIONS | (more or {})
    if name not in known:
        raise ValueError(f"unknown score function {name!r}; there are {sorted(known)}")
    return known[name]


def min_max(score: Column, *by: str) -> Column:
    """Scores of each group from 0 to 1; all 1 if they are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.lit(1.0)).otherwise((score - low) / (high - low))


def _least(harmonics: tuple[tuple[int, float], ...]) -> float:
    """Below x + the sum of c * cos(k * x) from 0 to pi: its least value on a grid, less what the steps may miss (the curvature
    times their square by 8)."""
    x, step = np.linspace(0, np.pi, 4001, retstep=True)
    return float(np.min(x + sum(c * np.cos(k * x) for k, c in harmonics)) - sum(c * k * k for k, c in harmonics) * step**2 / 8 - 1e-12)


class CityBlock:
    """Minus the sum of the differences of two vectors, for rows of two matrices, with a bound (operators.dense.Bounded).

    |x| >= LEAST - the sum of c * cos(k * x) over HARMONICS (k, c) for every x, as it holds from 0 to pi and the
    right side is even and has the period 2 pi.  So it does at any scale, s * (...)(x / s), and the cosine of a
    difference is a product of the cosines and sines of both."""

    #: found by a search for the largest mean over pairs of normal coordinates; the bound holds with any others
    HARMONICS = ((1, 1.2850868), (3, 0.19962044))
    LEAST = _least(HARMONICS)
    #: a scale, as a part of the coordinate's standard deviation
    SCALE = 0.828
    #: numbers of a matrix that stay in a cache
    CACHED = 32768

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A coordinate at a time, for so many rows as stay in a cache."""
        out, columns, step = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T), max(self.CACHED // max(len(b), 1), 1)
        for at in range(0, len(a), step):
            rows, some = a[at: at + step], out[at: at + step]
            part = np.empty_like(some)
            for x, y in zip(rows.T, columns, strict=True):
                np.abs(np.subtract(x[:, None], y, out=part), out=part)
                some -= part
        return out

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In double precision added a coordinate at a time, as in a call; in single precision as it goes fastest."""
        d = a - b
        np.abs(d, out=d)
        if d.dtype == np.float32:
            return -(d @ np.ones(d.shape[1], np.float32))
        out = np.zeros(len(d))
        for column in np.ascontiguousarray(d.T):
            out -= column
        return out

    def scale(self, m: np.ndarray) -> np.ndarray:
        spread = m.std(axis=0) if len(m) else np.zeros(m.shape[1])
        mean = spread.mean() or 1.0
        return self.SCALE * np.maximum(spread, mean / 1000)

    def terms(self, m: np.ndarray, scale: np.ndarray) -> np.ndarray:
        out, width = np.empty((len(m), 2 * len(self.HARMONICS) * m.shape[1]), np.float32), m.shape[1]
        for i, (k, c) in enumerate(self.HARMONICS):
            x, size = m * (k / scale), np.sqrt(c * scale)
            out[:, 2 * i * width: (2 * i + 1) * width] = np.cos(x) * size
            out[:, (2 * i + 1) * width: (2 * i + 2) * width] = np.sin(x) * size
        return out

    def least(self, scale: np.ndarray) -> float:
        return float(self.LEAST * scale.sum())
