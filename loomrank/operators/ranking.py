"""Ranks, windows, splices and fusion (W and T rows) over long-form frames (query_id, product_id, ...).

Every window is partitioned by query, so one shuffle by query_id serves a whole chain of these.
Ties are broken by id wherever a rank is given. Missing scores are null and come last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomrank.functions.checks import holds
from loomrank.session import stored

RRF_K = 60
TOP = 10
#: Weights of the stage, cross-encoder and listwise orderings.
FUSION_WEIGHTS = (1.0, 1.0, 4.0)


def by_query(*order: Column):
    return W.partitionBy("query_id").orderBy(*order)


def rank_by(score: str, ascending: bool = False) -> Column:
    """Rank in the query by score, null last, ties by id."""
    s = F.col(score)
    return F.row_number().over(by_query(s.asc_nulls_last() if ascending else s.desc_nulls_last(), F.col("product_id").asc()))


def top_window(scores: DataFrame, k: int = TOP, score: str = "stage2_score") -> DataFrame:
    """stage2_rank, and whether it is in the top k."""
    if k <= 0:
        raise ValueError("k must be positive")
    return scores.withColumn("stage2_rank", rank_by(score)).withColumn("in_window", F.col("stage2_rank") <= k)


def splice(windows: DataFrame, position: str = "stage2_rank") -> DataFrame:
    """A score n - place over the window in order of `position`, then the tail by its own rank."""
    place = F.row_number().over(by_query(F.col("in_window").desc(), F.when(F.col("in_window"), F.col(position)).otherwise(F.col("stage2_rank")), F.col("product_id")))
    n = F.count("*").over(W.partitionBy("query_id"))
    return windows.withColumn("run_score", (n - place + 1).cast("double"))


def spliced_run(windows: DataFrame, ordering: DataFrame, partitions: int | None = None) -> DataFrame:
    """Splice with new positions (query_id, product_id, position); queries without an ordering keep their own.

    An ordering that names a query or document outside the windows, one twice, or not all of a
    window, raises when rows are read: sides meet in one full join, and each query is counted. With `partitions` all shuffles
    go to as many tasks, however few bytes a row has, so that what a task sorts is bounded.
    """
    key = ["query_id", "product_id"]
    deal = lambda x, *by: x.repartition(partitions, *by) if partitions else x
    windows, ordering = deal(windows, *key), deal(ordering, *key)
    x = deal(windows.withColumn("_here", F.lit(1)).join(ordering.select(*key, "position", F.lit(1).alias("_told")), key, "full"), *key)
    by = W.partitionBy("query_id")
    inside = F.coalesce(F.col("in_window"), F.lit(False))
    # a document told twice stands twice in the join, so its copies are counted in a window by document, of which the join has left the rows together
    x = x.withColumn("_copies", F.count("_told").over(W.partitionBy(*key)))
    x = deal(x, "query_id").withColumns({"_told_in": F.sum("_told").over(by), "_inside": F.count_if(inside).over(by), "_both": F.count_if(inside & F.col("_told").isNotNull()).over(by), "_most": F.max("_copies").over(by)})
    fine = F.col("_told_in").isNull() | ((F.col("_told_in") == F.col("_inside")) & (F.col("_both") == F.col("_inside")) & (F.col("_most") <= 1))
    moved = x.where(holds(fine, "an ordering must be a permutation of its query's window")).drop("_here", "_told", "_copies", "_told_in", "_inside", "_both", "_most")
    return splice(moved.withColumn("position", F.coalesce("position", "stage2_rank")), "position")


def reciprocal_rank_fusion(frame: DataFrame, ranks: list[str], weights=FUSION_WEIGHTS, k: int = RRF_K) -> DataFrame:
    """fused = sum of weight / (k + rank) in the order given, and the rank by it."""
    total = reduce(lambda a, b: a + b, [F.lit(float(w)) / (F.lit(float(k)) + F.col(r)) for r, w in zip(ranks, weights)])
    return frame.withColumn("fused", total).withColumn("fused_rank", rank_by("fused"))


def stage_orderings(frame: DataFrame) -> DataFrame:
    """T5: the three single-stage ranks."""
    return frame.withColumns({"stage_pos": rank_by("stage2_score"), "ce_pos": rank_by("ce_score"), "llm_pos": rank_by("llm_rank", ascending=True)})


def window_signals(window: DataFrame) -> DataFrame:
    """Place in the window and 1 / (60 + rank) of the listwise answer."""
    return window.withColumn("llm_rr", 1.0 / (RRF_K + F.col("llm_rank")))


def hybrid_target(frame: DataFrame, gain: str = "gain", teacher: str = "llm_rank") -> DataFrame:
    """Label, teacher and hybrid targets: n minus the place by gain, by the teacher, and by gain then teacher."""
    n = F.count("*").over(W.partitionBy("query_id"))
    place = lambda *o: F.row_number().over(by_query(*o, F.col("product_id")))
    return frame.withColumns({
        "target_labels": F.col(gain), "target_llm": (n - place(F.col(teacher).asc())).cast("double"),
        "target_hybrid": (n - place(F.col(gain).desc(), F.col(teacher).asc())).cast("double")})


def gain_permutation(frame: DataFrame) -> DataFrame:
    """Place by gain, ties by the place before."""
    return frame.withColumn("target_pos", F.row_number().over(by_query(F.col("gain").desc(), F.col("stage2_rank").asc())))


def margin(frame: DataFrame, score: str) -> DataFrame:
    """Best minus second best score of each query; 0 with one document."""
    top = F.sort_array(F.collect_list(score), asc=False)
    return frame.groupBy("query_id").agg(F.coalesce(F.get(top, F.lit(0)) - F.get(top, F.lit(1)), F.lit(0.0)).alias("margin"))


def run_lengths(frame: DataFrame, key: str, order: list[str], once: bool = False, partitions: int | None = None) -> DataFrame:
    """(run, key, n): lengths of runs of equal keys in the given order (gaps and islands), numbered from 1.

    Rows are ranged by the order into partitions, each of which finds its own runs; then only
    the first and last run of each partition meet, and those of equal keys that touch become one. A
    key of null is a key. With once, a key that stands in two runs raises when the rows are read: what trains
    on runs as groups would compare documents of different queries.
    """
    n = partitions or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = frame.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    names = [f"_o{i}" for i in range(len(order))]
    x = stored(x.repartitionByRange(n, *names).withColumn("_p", F.spark_partition_id()))
    w = W.partitionBy("_p").orderBy(*names)
    new = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col("_k").eqNullSafe(F.lag("_k").over(w))).cast("int"))
    runs = x.withColumn("_new", new).withColumn("_i", F.sum("_new").over(w)).groupBy("_p", "_i").agg(F.first("_k").alias("_k"), F.count("*").alias("n"))
    runs = stored(runs.withColumn("_last", F.max("_i").over(W.partitionBy("_p"))))
    # a partition gives two rows at most to the one window over all of them
    edge = (F.col("_i") == 1) | (F.col("_i") == F.col("_last"))
    across = W.orderBy("_p", "_i")
    touches = F.lag("_p").over(across).isNotNull() & (F.col("_p") != F.lag("_p").over(across)) & F.col("_k").eqNullSafe(F.lag("_k").over(across))
    edges = runs.where(edge).withColumn("_head", F.sum((~touches).cast("int")).over(across)).groupBy("_head").agg(F.min(F.struct("_p", "_i")).alias("at"), F.first("_k").alias("_k"), F.sum("n").alias("n"))
    out = runs.where(~edge).select(F.struct("_p", "_i").alias("at"), "_k", "n").unionByName(edges.select("at", "_k", "n"))
    # runs before a partition's are numbered by sums of counts, a row a partition
    per = out.groupBy(F.col("at._p").alias("_p")).agg(F.count("*").alias("c"))
    before = per.select("_p", (F.sum("c").over(W.orderBy("_p")) - F.col("c")).alias("before"))
    place = F.row_number().over(W.partitionBy("at._p").orderBy("at._i"))
    out = out.withColumn("_place", place).withColumn("_p", F.col("at._p")).join(F.broadcast(before), "_p")  # a row a partition
    out = out.select((F.col("before") + F.col("_place")).alias("run"), F.col("_k").alias(key), "n")
    if not once:
        return out
    twice = F.count("*").over(W.partitionBy(key))
    return out.withColumn("_c", twice).where(holds(F.col("_c") == 1, f"a {key} stands in two runs")).drop("_c")


def hash_sample(ids: DataFrame, n: int, seed: str, key: str = "query_id") -> DataFrame:
    """N distinct ids in order of a seeded hash, 0 for all; more than there are raises."""
    distinct = ids.select(key).distinct()
    if n == 0:
        return distinct
    if distinct.limit(n).count() < n:
        raise ValueError(f"fewer than {n} distinct {key}")
    return distinct.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


def batches(frame: DataFrame, size: int, seed: str, key: str = "product_id") -> DataFrame:
    """Number of the batch of each row in a seeded order inside its query."""
    shuffled = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return frame.withColumn("batch", F.floor((F.row_number().over(by_query(shuffled, F.col(key))) - 1) / size).cast("int"))


def sort_for_ranking(frame: DataFrame) -> DataFrame:
    """By query, then product; a range-partitioned sort."""
    return frame.orderBy("query_id", "product_id")


def position_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Place of each document in two orderings, and the move."""
    return before.withColumnRenamed("position", "pos_before").join(after.withColumnRenamed("position", "pos_after"), ["query_id", "product_id"]).withColumn("moved", F.col("pos_before") - F.col("pos_after"))
