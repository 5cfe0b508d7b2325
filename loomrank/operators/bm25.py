"""BM25 over an index on disk: postings in blocks with their highest impact, so that only blocks that can matter are read."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomrank.functions.stemming import stem
from loomrank.session import spread, stored

from .ranking import by_query
from .retrieval import B, K1, term_list

BUCKETS, BLOCK, SHARD = 64, 128, 1 << 20
#: Scores are compared and shown after rounding to 9 digits; a block goes only if it is out of reach by more than that.
SLACK = 1e-8


@lru_cache(1 << 18)
def _stem(word: str) -> str:
    return stem(word)


@dataclass(frozen=True)
class Index:
    """Folders below `path`: `terms` (bucket, term, df), `blocks` (bucket, term, shard, block, top, postings) and `stats`, one row."""

    path: str
    key: str
    kind: str
    stemmed: bool

    def read(self, spark: SparkSession, part: str) -> DataFrame:
        schemas = {"terms": "term string, df long, bucket int", "blocks": f"term string, shard int, block int, top double, postings array<struct<key:{self.kind},sat:double>>, bucket int",
                   "stats": "n_docs long, avgdl double, keyed boolean, once boolean"}
        return spark.read.schema(schemas[part]).parquet(f"{self.path}/{part}")


def term_counts(frame: DataFrame, keys: list[str], text: Column, stemmed: bool) -> DataFrame:
    """(keys, term, tf, dl) of every row's terms.

    One function for documents and queries: a text is tokenised once and its terms are counted in its row, so nothing is
    shuffled; with stemmed a word is stemmed once in a Python worker while a bounded memo holds it. Rows of equal keys stay apart.
    """
    x = frame.select(*keys, term_list(text).alias("_ts"))

    def run(batches):
        for batch in batches:
            row, term, tf, dl = [], [], [], []
            for i, ts in enumerate(batch.column(len(keys)).to_pylist()):
                n = Counter(map(_stem, ts) if stemmed else ts)
                row += [i] * len(n)
                dl += [len(ts)] * len(n)
                term += n.keys()
                tf += n.values()
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(len(keys))), pa.array(term, pa.string()), pa.array(tf, pa.int64()), pa.array(dl, pa.int32())], names=[*keys, "term", "tf", "dl"])

    return x.mapInArrow(run, StructType([*(x.schema[k] for k in keys), *StructType.fromDDL("term string, tf long, dl int")]))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, key: str, text: Column, path: str, stemmed: bool = False, k1: float = K1, b: float = B, block: int = BLOCK) -> Index:
    """K8: writes the index of docs and returns it.

    The saturation tf / (tf + k1 (1 - b + b dl / mean)) of a posting doesn't depend on its term's
    frequency, so postings are put in order of it, `block` to a block, with the block's highest
    in a column of its own; df is kept once a term. A term's postings are dealt to shards of about SHARD
    documents, so a common term is sorted by many tasks. Files lie in BUCKETS folders by a hash of
    the term, sorted by term. A null key raises; ids are unique.
    """
    spark = docs.sparkSession
    index = Index(path, key, docs.schema[key].dataType.simpleString(), stemmed)
    docs = spread(docs.select(key, text.alias("_text")))
    ends = docs.select(key, F.size(term_list(F.col("_text"))).alias("dl"))
    per = ends.groupBy(key).agg(F.count("*").alias("n"), F.sum("dl").alias("dl"))
    per.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_docs"), (F.sum("dl") / F.sum("n")).alias("avgdl"), F.coalesce(F.bool_and(F.col(key).isNotNull()), F.lit(True)).alias("keyed"), (F.max("n") == 1).alias("once")).write.parquet(f"{path}/stats")
    stats = index.read(spark, "stats").first()
    if not stats.keyed or stats.once is False:
        raise ValueError(f"{key} must be given and unique")
    shards = max(1, -(-stats.n_docs // SHARD))
    x = term_counts(docs, [key], F.col("_text"), stemmed).select("term", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), F.col(key).alias("key"),
                                               (F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(stats.avgdl or 1.0))))).alias("sat"))
    # one shuffle: the window, the blocks and the folders all follow (bucket, shard, term)
    x = x.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", "shard")
    place = F.row_number().over(W.partitionBy("bucket", "shard", "term").orderBy(F.col("sat").desc(), "key"))
    x = x.withColumn("block", F.floor((place - 1) / block).cast("int"))
    x = x.groupBy("bucket", "shard", "term", "block").agg(F.max("sat").alias("top"), F.collect_list(F.struct("key", "sat")).alias("postings"))
    x.select("term", "shard", "block", "top", "postings", "bucket").write.partitionBy("bucket").parquet(f"{path}/blocks")
    sized = index.read(spark, "blocks").groupBy("bucket", "term").agg(F.sum(F.size("postings")).alias("df"))
    sized.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    return index


def weighted_terms(index: Index, queries: DataFrame, text: Column) -> tuple[DataFrame, list[int]]:
    """(query_id, bucket, term, weight), stored: the idf of each term of a query that the index knows, times how often the query has it; and the buckets of the queries' terms, the only ones that are read."""
    spark = queries.sparkSession
    terms = stored(term_counts(queries, ["query_id"], text, index.stemmed).groupBy("query_id", "term").agg(F.sum("tf").alias("qtf")).withColumn("bucket", _bucket(F.col("term"))))
    n = index.read(spark, "stats").first().n_docs
    buckets = [r.bucket for r in terms.select("bucket").distinct().collect()]
    x = terms.join(_pruned(index.read(spark, "terms"), buckets), ["bucket", "term"])
    return stored(x.select("query_id", "bucket", "term", (F.col("qtf") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("weight"))), buckets


def _pruned(files: DataFrame, buckets: list[int]) -> DataFrame:
    """Only the folders that the terms fall into, BUCKETS at most."""
    return files.where(F.col("bucket").isin(buckets))


def surviving_blocks(index: Index, terms: DataFrame, buckets: list[int], k: int) -> DataFrame:
    """(query_id, bucket, term, weight, shard, block) of the blocks that a document of the k best can stand in.

    The blocks of highest impact of each term alone give k documents of a score of at least
    t, the query's threshold. A posting of a document that scores t or more stands in a block whose
    bound, with the highest impacts of the query's other terms, reaches t as well; all others go.
    So every document of the k best keeps all its postings, and none of a document
    that ties with the last is lost.
    """
    spark = terms.sparkSession
    blocks = _pruned(index.read(spark, "blocks"), buckets)
    heads = terms.join(blocks.select("bucket", "term", "shard", "block", "top"), ["bucket", "term"]).withColumn("bound", F.col("weight") * F.col("top"))
    most = heads.groupBy("query_id", "term").agg(F.max("bound").alias("most"))
    reach = most.groupBy("query_id").agg(F.sum("most").alias("reach"))
    first = terms.join(blocks.where("block = 0").select("bucket", "term", F.explode("postings").alias("p")), ["bucket", "term"])
    least = first.groupBy("query_id", F.col("p.key").alias("key")).agg(F.sum(F.col("weight") * F.col("p.sat")).alias("s"))
    kth = least.withColumn("i", F.row_number().over(by_query(F.col("s").desc()))).where(F.col("i") == k).select("query_id", F.col("s").alias("least"))
    x = heads.join(most, ["query_id", "term"]).join(reach.join(kth, "query_id", "left"), "query_id")
    return x.where(F.col("least").isNull() | (F.col("bound") + F.col("reach") - F.col("most") >= F.col("least") - SLACK)).select("query_id", "bucket", "term", "weight", "shard", "block")


def top(index: Index, queries: DataFrame, text: Column, k: int) -> DataFrame:
    """The k best documents of each query (query_id, key, bm25_score, rank), zero scores left out, ties by id; a query that matches nothing has no row."""
    terms, buckets = weighted_terms(index, queries, text)
    blocks = _pruned(index.read(queries.sparkSession, "blocks"), buckets).select("bucket", "term", "shard", "block", "postings")
    hits = surviving_blocks(index, terms, buckets, k).join(blocks, ["bucket", "term", "shard", "block"]).select("query_id", "weight", F.explode("postings").alias("p"))
    found = hits.groupBy("query_id", F.col("p.key").alias(index.key)).agg(F.sum(F.col("weight") * F.col("p.sat")).alias("bm25_score")).where("bm25_score > 0")
    return found.withColumn("rank", F.row_number().over(by_query(F.round("bm25_score", 9).desc(), F.col(index.key)))).where(F.col("rank") <= k)


def of_pairs(index: Index, queries: DataFrame, text: Column, pairs: DataFrame) -> DataFrame:
    """The score of each given (query, document), 0 where they have no term in common."""
    terms, buckets = weighted_terms(index, queries, text)
    blocks = _pruned(index.read(queries.sparkSession, "blocks"), buckets)
    x = terms.join(blocks.select("bucket", "term", "postings"), ["bucket", "term"]).select("query_id", "weight", F.explode("postings").alias("p"))
    hits = x.select("query_id", F.col("p.key").alias(index.key), (F.col("weight") * F.col("p.sat")).alias("s")).join(pairs.select("query_id", index.key), ["query_id", index.key], "left_semi")
    scored = hits.groupBy("query_id", index.key).agg(F.sum("s").alias("bm25_score"))
    return pairs.select("query_id", index.key).join(scored, ["query_id", index.key], "left").fillna(0.0, ["bm25_score"])
