"""BM25 index, scoring and retrieval, and vector similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.functions.numeric import dot
from loomrank.functions.text import tokens

from .ranking import by_query

K1, B = 1.5, 0.75
CELL = 16384  # vectors of a side that a task of top1_accuracy_in_blocks holds at most
# English function words that carry no weight.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]


def term_list(text: Column) -> Column:
    """Tokens without stop words; the same for documents and queries."""
    return F.filter(tokens(text), lambda t: ~t.isin(STOPWORDS))


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """K8: (term, key, tf, dl), counted map-side before the shuffle."""
    x = docs.select(F.col(key), term_list(text).alias("ts")).withColumn("dl", F.size("ts"))
    return x.select(key, "dl", F.explode("ts").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def document_stats(docs: DataFrame, text: Column) -> DataFrame:
    """K8: one row with the number of documents and their mean length."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(term_list(text))).alias("avgdl"))


def weighted_postings(index: DataFrame, stats: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """Impact of each posting: idf ln(1 + (N - df + 0.5) / (df + 0.5)) times the saturated term frequency."""
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    x = index.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return x.withColumn("impact", idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))


def query_terms(queries: DataFrame, text: Column) -> DataFrame:
    """(query_id, term, qtf): a term that a query repeats counts so often."""
    return queries.select("query_id", F.explode(term_list(text)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(terms: DataFrame, impacts: DataFrame, key: str, pairs: DataFrame | None = None) -> DataFrame:
    """Score of each (query, document) with a common term, of the given pairs only if any; the others of these score 0."""
    hits = terms.join(impacts.select("term", key, "impact"), "term")
    if pairs is not None:
        hits = hits.join(pairs.select("query_id", key), ["query_id", key], "left_semi")
    scored = hits.groupBy("query_id", key).agg(F.sum(F.col("impact") * F.col("qtf")).alias("bm25_score"))
    return scored if pairs is None else pairs.select("query_id", key).join(scored, ["query_id", key], "left").fillna(0.0, ["bm25_score"])


def bm25_top(terms: DataFrame, impacts: DataFrame, key: str, k: int) -> DataFrame:
    """The k best documents of each query, zero scores left out, ties by id."""
    x = bm25_scores(terms, impacts, key).where("bm25_score > 0")
    return x.withColumn("rank", F.row_number().over(by_query(F.round("bm25_score", 9).desc(), F.col(key)))).where(F.col("rank") <= k)


def pair_similarity(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Inner product of the stored vectors of each pair, null where one is missing."""
    x = pairs.join(queries.withColumnRenamed("embedding", "_q"), "query_id", "left").join(docs.withColumnRenamed("embedding", "_d"), "product_id", "left")
    return x.withColumn("similarity", dot(F.col("_q"), F.col("_d"))).drop("_q", "_d")


def top1_accuracy(images: DataFrame, texts: DataFrame, pool: int) -> DataFrame:
    """Share of images at least as near to their own text as to every other in a pool of stated size; a larger pool raises.

    The gate is defined on all pairs of a pool of a few hundred; the pool bounds them.
    """
    if images.limit(pool + 1).count() > pool or texts.limit(pool + 1).count() > pool:
        raise ValueError(f"the pool has more than {pool} rows")
    a, b = images.select(F.col("key").alias("ik"), F.col("embedding").alias("iv")), texts.select(F.col("key").alias("tk"), F.col("embedding").alias("tv"))
    x = a.crossJoin(F.broadcast(b)).withColumn("s", F.round(dot(F.col("iv"), F.col("tv")), 9))
    per = x.groupBy("ik").agg(F.max(F.when(F.col("ik") == F.col("tk"), F.col("s"))).alias("own"), F.max(F.when(F.col("ik") != F.col("tk"), F.col("s"))).alias("other"))
    return per.agg(F.avg(F.when(F.col("own") >= F.coalesce("other", "own"), 1.0).otherwise(0.0)).alias("top1"), F.count("*").alias("n"))


def top1_accuracy_in_blocks(images: DataFrame, texts: DataFrame, rows: int = 4096) -> DataFrame:
    """J19 without a pool: every image against every text, in products of `rows` images by `rows` texts.

    The work grows with the product of both sides. A task gets up to CELL rows of each, fewer where there would be too few tasks, so
    that a vector travels as seldom as memory allows; components that no text of a task has are left out, and the best are rounded
    instead of all. Vectors are of one length and finite; an image
    without one, or without its own text, counts as missed. Products are rounded to 9 digits.
    """
    many = [x.count() for x in (images, texts)]
    side = max(rows, min(CELL, int((many[0] * many[1] / (4 * images.sparkSession.sparkContext.defaultParallelism)) ** 0.5)))
    across, down = (max(1, -(-n // side)) for n in many)
    fine = F.col("embedding").isNotNull()
    dealt = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = images.where(fine).select(dealt(across).alias("i"), each(down).alias("t"), "key", F.col("embedding").cast("array<double>").alias("embedding"))
    b = texts.where(fine).select(each(across).alias("i"), dealt(down).alias("t"), "key", F.col("embedding").cast("array<double>").alias("embedding"))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        own, other = np.zeros(0), np.zeros(0)
        if len(x) and len(y):
            v, w = (z["embedding"].combine_chunks().flatten().to_numpy().reshape(len(z), -1) for z in (x, y))
            some = np.flatnonzero(w.any(axis=0))
            v, w = np.ascontiguousarray(v[:, some]), np.ascontiguousarray(w[:, some])
            mine, theirs = x["key"].to_numpy(), y["key"].to_numpy()
            order = np.argsort(theirs, kind="stable")
            w, theirs = w[order], theirs[order]
            own, other = np.full(len(x), -np.inf), np.full(len(x), -np.inf)
            for a in range(0, len(v), rows):
                for b in range(0, len(w), rows):
                    s, keys = v[a : a + rows] @ w[b : b + rows].T, theirs[b : b + rows]
                    first = keys.searchsorted(mine[a : a + rows])
                    count = keys.searchsorted(mine[a : a + rows], "right") - first
                    i = np.repeat(np.arange(len(s)), count)
                    j = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    np.maximum.at(own, a + i, s[i, j])
                    s[i, j] = -np.inf
                    other[a : a + rows] = np.maximum(other[a : a + rows], s.max(axis=1))
            own, other = np.round(own, 9), np.round(other, 9)
        at = x["key"] if len(own) else x["key"].slice(0, 0)
        return pa.table({"key": at, "own": pa.array(own, mask=np.isinf(own)), "other": pa.array(other, mask=np.isinf(other))})

    kind = f"key {images.schema['key'].dataType.simpleString()}, own double, other double"
    best = a.groupBy("i", "t").cogroup(b.groupBy("i", "t")).applyInArrow(run, kind).groupBy("key").agg(F.max("own").alias("own"), F.max("other").alias("other"))
    per = images.select("key").distinct().join(best, "key", "left")
    return per.agg(F.avg(F.when(F.col("own") >= F.coalesce("other", "own"), 1.0).otherwise(0.0)).alias("top1"), F.count("*").alias("n"))


def encoded(frame: DataFrame, text: str, encode, width: int) -> DataFrame:
    """Vectors by an injected batch encoder; a batch of wrong shape raises. The encoder is made once a task by encode()."""
    def run(batches: Iterator[pd.DataFrame]):
        model = encode()
        for batch in batches:
            v = np.asarray(model(batch[text].tolist()), float)
            if v.ndim != 2 or v.shape != (len(batch), width):
                raise ValueError(f"the encoder gave shape {v.shape}, not {(len(batch), width)}")
            yield batch.drop(columns=[text]).assign(embedding=list(v.astype(np.float32)))

    schema = ", ".join(f"`{n}` {t}" for n, t in frame.dtypes if n != text) + ", embedding array<float>"
    return frame.mapInPandas(run, schema)


def scored_pairs(frame: DataFrame, score, column: str = "score") -> DataFrame:
    """Scores by an injected pair scorer; score() makes it once a task, it maps (queries, texts) to numbers."""
    def run(batches: Iterator[pd.DataFrame]):
        model = score()
        for batch in batches:
            got = np.asarray(model(batch["query"].tolist(), batch["text"].tolist()), float)
            if got.shape != (len(batch),):
                raise ValueError("the scorer must give one number a pair")
            yield batch.assign(**{column: got})

    return frame.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in frame.dtypes) + f", {column} double")
