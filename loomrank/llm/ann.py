"""Approximate nearest neighbours by cosine with randomly rotated one-bit codes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import search, usable

EPSILON = 3.0  # width of the error bound in its own unit
QUERIES_AT_ONCE = 64


def rotation(d: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


class Codes:
    """One-bit codes of unit vectors: packed signs of the rotated residual from a centre, and correction scalars."""

    def __init__(self, unit: np.ndarray):
        self.d = unit.shape[1]
        self.centre = unit.mean(axis=0)
        self.turn = rotation(self.d)
        residual = unit - self.centre
        self.norm = np.sqrt((residual * residual).sum(axis=1))
        turned = residual @ self.turn
        self.bits = np.packbits(turned > 0, axis=1)
        # inner product of the unit residual with its code vector, signs / sqrt(d)
        self.fit = np.abs(turned).sum(axis=1) / np.sqrt(self.d) / np.maximum(self.norm, 1e-30)
        self.fit = np.where(self.norm > 1e-12, self.fit, 1.0)
        self.error = np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit / np.sqrt(max(self.d - 1, 1))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products with the vectors, and how far off they may be, queries x rows."""
        signs = np.unpackbits(self.bits, axis=1, count=self.d).astype(np.float32) * 2 - 1
        residual = queries - self.centre
        length = np.sqrt((residual * residual).sum(axis=1))
        dot = (residual @ self.turn).astype(np.float32) @ signs.T / np.sqrt(self.d)
        # <u, q> = <u - c, q - c> + <u, c> + <c, q> - <c, c>, where <u, c> is stored as a scalar
        base = (self.centre @ queries.T)[:, None] - self.centre @ self.centre
        estimate = dot * (self.norm / self.fit).astype(np.float32) + base + self.with_centre
        return estimate, EPSILON * length[:, None] * (self.norm * self.error)[None, :] + 1e-5

    with_centre: np.ndarray | float = 0.0


def nearest(ids: np.ndarray, rows: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of one shard for each query: estimates choose k to be measured first, and then every vector whose bound reaches the k-th of them is measured exactly."""
    rows, queries = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) for x in (rows, queries))  # powers of two change no cosine, and no square overflows
    length, qlength = np.sqrt((rows * rows).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    unit = rows / length[:, None]
    codes = Codes(unit)
    codes.with_centre = unit @ codes.centre
    out_q, out_r, out_s = [], [], []
    for begin in range(0, len(queries), QUERIES_AT_ONCE):
        some = slice(begin, begin + QUERIES_AT_ONCE)
        estimate, off = codes.bounds(queries[some] / qlength[some, None])
        for i in range(estimate.shape[0]):
            q, at = queries[begin + i], begin + i
            own = slice(np.searchsorted(ids, qids[at], "left"), np.searchsorted(ids, qids[at], "right"))
            high = estimate[i] + off[i]
            high[own] = -np.inf
            mine = estimate[i].copy()
            mine[own] = -np.inf
            free = len(ids) - (own.stop - own.start)
            if not free:
                continue
            m = min(k, free)
            first = np.argpartition(-mine, m - 1)[:m]
            measure = lambda x: (rows[x] * q).sum(axis=1) / (length[x] * qlength[at])  # noqa: B023, E731
            theta = measure(first).min()
            chosen = np.flatnonzero(high >= theta)
            chosen = np.union1d(chosen, first)
            s = measure(chosen)
            order = np.lexsort((ids[chosen], -s))[:m]
            out_q.append(np.full(m, at))
            out_r.append(chosen[order])
            out_s.append(s[order])
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return cat(out_q, np.int64), cat(out_r, np.int64), cat(out_s, np.float64)


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query row's k nearest rows by cosine: query_id, rank, vec_id, score (exact, in doubles).

    is_query is a condition on the column `id`. Every row is indexed: each shard of about
    blocks.SHARD_ROWS rows has its own centre and codes. Vectors that are null, empty, zero, or hold
    a null or a number that isn't finite take no part, nor do rows without id; for repeated rows,
    lengths and shards see blocks.search. An empty table, or one without queries, gives no rows.
    """
    rows = usable(vectors, key, vector).where(F.exists("v", lambda x: x != 0))
    return search(rows, is_query, k, "double", lambda rid, r, qid, q: nearest(rid, r, qid, q, k))
