"""A stated query set against all rows, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARD_ROWS, QUERY_ROWS = 16384, 4096  # at most, of vectors of up to 128 components; fewer of longer ones


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, v) with an id and a vector of at least one component, all finite."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def search(rows: DataFrame, is_query: Column, k: int, score_type: str, find: Callable) -> DataFrame:
    """Each query's k best rows (query_id, rank, vec_id, score), ties to the smaller id.

    rows is (id, v). Rows are dealt by a hash of id and vector to shards, queries to blocks, of about
    SHARD_ROWS and QUERY_ROWS rows whatever the input's size; each pair of a shard and a block is one task,
    find(ids, matrix, query ids, query matrix) -> (query position, row position, score) arrays, its
    best k and perhaps more. The lists of the shards are then merged. Vectors of other lengths than
    a query's can't be compared with it and aren't its candidates; rows with the query's own id
    aren't either. A query row that is repeated is searched once. Rows equal in id and vector are
    candidates each; they are counted before the shuffle and more than k of them, which no list has
    room for, don't travel.
    """
    rows = rows.groupBy("id", "v").agg(F.count("*").alias("many")).select("id", "v", F.explode(F.sequence(F.lit(1), F.least(F.col("many"), F.lit(k).cast("long")).cast("int"))).alias("nth"))
    n = rows.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(F.size("v"))).first()
    wide = max(1, -(-(n[2] or 1) // 128))
    shards, blocks = max(1, -(-n[0] * wide // SHARD_ROWS)), max(1, -(-n[1] * wide // QUERY_ROWS))
    dealt = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")
    right = rows.select(dealt.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v", F.size("v").alias("d"))
    queries = rows.where("nth = 1").where(is_query)
    left = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int").alias("block"), "id", "v", F.size("v").alias("d"))
    kind = f"query_id long, vec_id long, score {score_type}"

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        for d in set(q["d"].to_pylist()):
            a, b = q.filter(pa.compute.equal(q["d"], d)), r.filter(pa.compute.equal(r["d"], d))
            if not len(b):
                continue
            a, b = a.sort_by("id"), b.sort_by("id")
            qid, rid = a["id"].to_numpy(), b["id"].to_numpy()
            i, j, s = find(rid, matrix(b["v"].combine_chunks()), qid, matrix(a["v"].combine_chunks()))
            out["query_id"].append(qid[i])
            out["vec_id"].append(rid[j])
            out["score"].append(s)
        types = [pa.int64(), pa.int64(), pa.int64() if score_type == "long" else pa.float64()]
        return pa.table({c: pa.array(np.concatenate(x) if x else [], t) for (c, x), t in zip(out.items(), types)})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, kind)
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
