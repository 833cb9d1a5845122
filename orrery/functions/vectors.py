"""Distances as Columns and as NumPy blocks; vectors to and from text."""

from __future__ import annotations

import base64
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import InvalidArgument

SPACES = ("l2", "ip", "cosine")
#: Dimensions up to which a distance to a constant vector is written out term by term for code generation.
UNROLL = 128
MAX_DIMENSION = 16_000


def check_space(space: str) -> str:
    if space not in SPACES:
        raise InvalidArgument(f"unknown space: {space}")
    return space


def _terms(parts: list[Column]) -> Column:
    """A balanced sum, so that deep expressions stay shallow."""
    while len(parts) > 1:
        parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else F.lit(0.0)


def _fold(pairs: Column, term) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda total, p: total + term(p))


def distance_to(vector: Column, query: Sequence[float], space: str) -> Column:
    """DOUBLE distance of an ARRAY<FLOAT> column to a constant: squared l2, 1 - dot, or 1 - cosine (NaN for a zero vector)."""
    check_space(space)
    q = [float(np.float32(x)) for x in query]
    if len(q) <= UNROLL:
        e = [F.get(vector, F.lit(i)).cast("double") for i in range(len(q))]
        if space == "l2":
            return _terms([(x - F.lit(y)) * (x - F.lit(y)) for x, y in zip(e, q, strict=True)])
        dot, own = _terms([x * F.lit(y) for x, y in zip(e, q, strict=True)]), _terms([x * x for x in e])
    else:
        constant = F.array(*map(F.lit, q))
        pairs = F.zip_with(vector, constant, lambda x, y: F.struct(x.cast("double").alias("x"), y.alias("y")))
        if space == "l2":
            return _fold(pairs, lambda p: (p["x"] - p["y"]) * (p["x"] - p["y"]))
        dot, own = _fold(pairs, lambda p: p["x"] * p["y"]), _fold(pairs, lambda p: p["x"] * p["x"])
    if space == "ip":
        return F.lit(1.0) - dot
    length = F.sqrt(own) * F.lit(math.sqrt(sum(y * y for y in q)))
    return F.when(length == 0, F.lit(float("nan"))).otherwise(F.lit(1.0) - dot / length)


def block_distances(rows: np.ndarray, queries: np.ndarray, space: str) -> np.ndarray:
    """(queries, rows) distances in double precision."""
    rows, queries = rows.astype(np.float64), queries.astype(np.float64)
    if space == "l2":
        out = np.empty((len(queries), len(rows)))
        for i, q in enumerate(queries):
            d = rows - q
            out[i] = (d * d).sum(axis=1)
        return out
    dot = np.stack([(rows * q).sum(axis=1) for q in queries]) if len(queries) else np.empty((0, len(rows)))
    if space == "ip":
        return 1 - dot
    with np.errstate(divide="ignore", invalid="ignore"):
        length = np.sqrt((queries**2).sum(axis=1))[:, None] * np.sqrt((rows**2).sum(axis=1))[None, :]
        return np.where(length == 0, np.nan, 1 - dot / length)


def paired_distances(a: np.ndarray, b: np.ndarray, space: str) -> np.ndarray:
    """Distances of the paired rows of a and b in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    if space == "l2":
        return ((a - b) ** 2).sum(axis=1)
    dot = (a * b).sum(axis=1)
    if space == "ip":
        return 1 - dot
    length = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    return np.where(length == 0, np.nan, 1 - dot / np.where(length == 0, 1.0, length))


class Best:
    """The n best (distance, rowid) of each query over the rows seen so far; NaN comes last, equal distances go by rowid.

    A matrix product gives each distance up to a rounding slack; only pairs that may be among the n best
    are computed in full, so the result is that of paired_distances().
    """

    NONE = np.iinfo(np.int64).max

    def __init__(self, queries: np.ndarray, n: int, space: str):
        self.q, self.n, self.space = queries.astype(np.float64), n, space
        self.distance = np.full((len(queries), n), np.nan)
        self.rowid = np.full((len(queries), n), self.NONE)
        with np.errstate(over="ignore"):
            self.length = np.sqrt((self.q**2).sum(axis=1))

    def see(self, rowid: np.ndarray, vectors: np.ndarray, step: int = 4096) -> None:
        for at in range(0, len(rowid), step):
            self._see(rowid[at : at + step], vectors[at : at + step])

    def _see(self, rowid: np.ndarray, vectors: np.ndarray) -> None:
        if not self.n or not len(self.q):
            return
        x = vectors.astype(np.float64)
        with np.errstate(all="ignore"):
            length = np.sqrt((x * x).sum(axis=1))
            about = self.q @ x.T
            size = self.length[:, None] * length[None, :]
            if self.space == "l2":
                about = self.length[:, None] ** 2 + length[None, :] ** 2 - 2 * about
                slack = 1e-11 * (self.length[:, None] ** 2 + length[None, :] ** 2)
            else:
                about = 1 - (about if self.space == "ip" else np.where(size == 0, np.nan, about / size))
                slack = 1e-11 * (1 + size) if self.space == "ip" else np.full_like(about, 1e-11)
            worst = np.where(self.rowid[:, -1] == self.NONE, np.nan, self.distance[:, -1])
            # the n-th best upper bound of this block, or of what was seen before
            bound = np.partition(about + slack, self.n - 1, axis=1)[:, self.n - 1] if about.shape[1] >= self.n else np.full(len(self.q), np.nan)
            limit = np.fmin(bound, worst)
            i, j = np.nonzero(~(about - slack > limit[:, None]))
            for part in range(0, len(i), 200_000):
                self._push(i[part : part + 200_000], j[part : part + 200_000], rowid, x)

    def _push(self, i: np.ndarray, j: np.ndarray, rowid: np.ndarray, x: np.ndarray) -> None:
        touched = np.unique(i)
        d = np.concatenate([paired_distances(self.q[i], x[j], self.space), self.distance[touched].ravel()])
        r = np.concatenate([rowid[j], self.rowid[touched].ravel()])
        row = np.concatenate([i, np.repeat(touched, self.n)])
        order = np.lexsort((r, d, row))
        first = np.searchsorted(row[order], touched)
        take = order[(first[:, None] + np.arange(self.n)).ravel()]
        self.distance[touched], self.rowid[touched] = d[take].reshape(-1, self.n), r[take].reshape(-1, self.n)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the query, rowid, distance)."""
        q, place = np.nonzero(self.rowid != self.NONE)
        return q, self.rowid[q, place], self.distance[q, place]


def parse_vector(value) -> list[float]:
    """A vector as a list of numbers or as base64 of little-endian 32-bit floats, padded or not."""
    if isinstance(value, str):
        try:
            raw = base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
        except ValueError:
            raise InvalidArgument("invalid base64 embedding") from None
        if len(raw) % 4:
            raise InvalidArgument("invalid base64 embedding")
        return np.frombuffer(raw, dtype="<f4").tolist()
    if not isinstance(value, list) or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in value):
        raise InvalidArgument("embedding must be a list of numbers")
    return [float(np.float32(x)) for x in value]


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_base64(texts: pd.Series) -> pd.Series:
    """Column form of parse_vector for base64; null for null, and for text that is no vector."""

    def one(text):
        try:
            return None if text is None else np.array(parse_vector(text), dtype=np.float32)
        except InvalidArgument:
            return None

    return texts.map(one)


@F.pandas_udf(T.StringType())
def encode_base64(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, dtype="<f4").tobytes()).decode())
