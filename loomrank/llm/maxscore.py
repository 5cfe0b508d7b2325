"""Exact top-k by inner product with MaxScore over dimensions as terms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import search, usable

BLOCK = 512


def top(ids: np.ndarray, scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k of `at` with highest scores, ties to the smaller id."""
    return at[np.lexsort((ids[at], -scores))][:k]


def maxscore(ids: np.ndarray, rows: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k rows of one shard for each query, exactly.

    A term is a dimension, its posting list the column of impacts, held by blocks of rows with the
    highest and lowest impact of each. A term adds at most max(q * highest, q * lowest); what all
    terms can add bounds a block. Terms in descending order of bound spread are split so that the
    non-essential ones together can't lift a row whose essential part is lowest past the threshold;
    essential columns are summed for the blocks in play, and the others are probed one by one for
    rows that can still reach the threshold. Rows that tie with it are kept.
    """
    n, d = rows.shape
    exact = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * d < 2.0**53
    if not exact:  # sums may pass what doubles hold: whole numbers of any size
        whole = np.frompyfunc(int, 1, 1)
        rows, queries = whole(rows), whole(queries)
    starts = np.arange(0, n, BLOCK)
    cols = np.ascontiguousarray(rows.T)
    high, low = np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts)
    size = np.diff(np.append(starts, n))
    out_q, out_r, out_s = [], [], []
    for i in range(len(queries)):
        q = queries[i]
        up, down = np.maximum(high * q, low * q), np.minimum(high * q, low * q)  # by block and term
        best = up.sum(axis=1)
        seen = np.argsort(-best.astype(np.float64), kind="stable")
        own = np.searchsorted(ids, qids[i], "left"), np.searchsorted(ids, qids[i], "right")
        theta, kept_at, kept_s = None, np.zeros(0, np.int64), np.zeros(0, rows.dtype)
        group = 1
        at_block = 0
        while at_block < len(seen):
            part = seen[at_block : at_block + group]
            at_block += group
            group = 16
            if theta is not None:
                part = part[best[part] >= theta]
                if not len(part):
                    if exact:
                        break  # blocks come in order of bound
                    continue  # in order of the bounds as doubles
            at = np.concatenate([np.arange(starts[b], starts[b] + size[b]) for b in part])
            most, least = up[part].max(axis=0), down[part].min(axis=0)
            terms = np.argsort(-(most - least).astype(np.float64), kind="stable")
            rest = np.append(np.cumsum(most[terms][::-1])[::-1], 0)  # what terms from j on can add
            essential = d
            if theta is not None:
                reach = np.cumsum(most[terms]) * 1  # what the first terms can add
                spread = np.append(np.cumsum((most - least)[terms][::-1])[::-1], 0)
                room = reach[-1] - theta  # a row may lose so much of the bound
                essential = max(1, int(np.searchsorted(-spread, -room, "left")))
                essential = min(d, essential)
            if theta is None:
                score = rows[at] @ q
            else:
                use = terms[:essential]
                score = rows[at][:, use] @ q[use] if essential > d // 2 else (cols[np.ix_(use, at)].T @ q[use])
                for j in range(essential, d):
                    live = score + rest[j] >= theta
                    if not live.all():
                        at, score = at[live], score[live]
                    if not len(at):
                        break
                    if len(at) < 64 or j + 1 == d:
                        left = terms[j:]
                        score = score + rows[at][:, left] @ q[left]
                        break
                    score = score + cols[terms[j], at] * q[terms[j]]
            other = (at < own[0]) | (at >= own[1])
            kept_at, kept_s = np.concatenate([kept_at, at[other]]), np.concatenate([kept_s, score[other]])
            if len(kept_at) > k:
                order = np.lexsort((ids[kept_at], -kept_s))[:k] if exact else np.array(sorted(range(len(kept_at)), key=lambda x: (-kept_s[x], ids[kept_at[x]]))[:k])
                kept_at, kept_s = kept_at[order], kept_s[order]
            if len(kept_at) == k:
                theta = kept_s.min()
        out_q.append(np.full(len(kept_at), i))
        out_r.append(kept_at)
        out_s.append(kept_s)
    if not exact:
        most = np.frompyfunc(lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1), 1, 1)
        out_s = [most(x) for x in out_s if len(x)]
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return cat(out_q, np.int64), cat(out_r, np.int64), cat(out_s, np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query row's k rows of highest integer inner product: query_id, rank, vec_id, score.

    Components become floor(256 * x) of x as double, -2^63 to 2^63 - 1 at most; scores are exact and
    shown as the nearest long where they pass it, within which ties go to the smaller id. is_query is a condition on the column `id`,
    the row's id as long. Vectors that are null, empty, or hold a null or a number that isn't finite
    take no part, nor do rows without id; see blocks.search for repeated rows, lengths and shards.
    An empty table, or one without queries, gives no rows. Extra columns are ignored.
    """
    rows = usable(vectors, key, vector).withColumn("v", F.transform("v", lambda x: F.floor(x * 256).cast("double")))
    return search(rows, is_query, k, "long", lambda rid, r, qid, q: maxscore(rid, r, qid, q, k))
