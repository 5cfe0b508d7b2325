"""NDCG, random floor, arm tables and resampling (A5 to A7, G rows)."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomrank.functions.checks import checked
from loomrank.functions.numeric import dcg_term
from loomrank.functions.text import fold_of
from loomrank.session import stored

from .ranking import by_query, rank_by

RESAMPLES, ALPHA, SEED = 1000, 0.05, 13


def ndcg_per_query(frame: DataFrame, score: str = "run_score", gain: str = "gain") -> DataFrame:
    """A5: NDCG of the whole list of each query; 0 where no document has gain.

    An unscored document (null) takes a rank behind all scored ones; ties by id.
    """
    x = frame.select("query_id", F.col(gain).alias("g"), rank_by(score).alias("r"), F.row_number().over(by_query(F.col(gain).desc())).alias("i"))
    per = x.groupBy("query_id").agg(F.sum(dcg_term(F.col("g"), F.col("r"))).alias("dcg"), F.sum(dcg_term(F.col("g"), F.col("i"))).alias("idcg"), F.count("*").alias("n_docs"))
    return per.withColumn("ndcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0)))


def ndcg_per_arm(frame: DataFrame, scores: dict[str, str], gain: str = "gain") -> DataFrame:
    """A5 of several orderings of the same lists: (query_id, arm, ndcg), a row an arm; the rows are shuffled once for all arms."""
    w = frame.select("query_id", F.col(gain).alias("g"), *[rank_by(s).alias(f"_r{i}") for i, s in enumerate(scores.values())], F.row_number().over(by_query(F.col(gain).desc())).alias("_i"))
    per = w.groupBy("query_id").agg(F.sum(dcg_term(F.col("g"), F.col("_i"))).alias("idcg"), *[F.sum(dcg_term(F.col("g"), F.col(f"_r{i}"))).alias(f"_d{i}") for i in range(len(scores))])
    share = lambda i: F.when(F.col("idcg") > 0, F.col(f"_d{i}") / F.col("idcg")).otherwise(F.lit(0.0))
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), share(i).alias("ndcg")) for i, a in enumerate(scores)])
    return per.select("query_id", F.explode(arms).alias("_a")).select("query_id", "_a.arm", "_a.ndcg")


def mean_ndcg(per_query: DataFrame) -> DataFrame:
    """Every query weighs the same; no query at all raises."""
    x = per_query.agg(F.avg("ndcg").alias("mean_ndcg"), F.count("*").alias("n_queries"))
    return x.withColumn("mean_ndcg", checked(F.col("n_queries") > 0, F.col("mean_ndcg"), "no queries"))


def random_floor(frame: DataFrame, gain: str = "gain") -> DataFrame:
    """Expected NDCG of a random order, in closed form: mean gain times the sum of discounts over the ideal DCG."""
    x = frame.select("query_id", F.col(gain).alias("g"), F.row_number().over(by_query(F.col(gain).desc())).alias("i"))
    per = x.groupBy("query_id").agg(F.avg("g").alias("mean_gain"), F.sum(1.0 / F.log2(F.col("i") + 1)).alias("discounts"), F.sum(dcg_term(F.col("g"), F.col("i"))).alias("idcg"))
    return per.select("query_id", F.when(F.col("idcg") > 0, F.col("mean_gain") * F.col("discounts") / F.col("idcg")).otherwise(F.lit(0.0)).alias("floor"))


def random_runs(frame: DataFrame, trials: int = 100, seed: int = SEED, gain: str = "gain") -> DataFrame:
    """G1: mean NDCG of each of `trials` seeded random orders (trial, mean_ndcg).

    A query's judged documents come together once, as the list that every trial shuffles by a hash
    of (seed, trial, query, document); trials are summed map-side, so one shuffle moves the
    rows and another a number a trial.
    """
    told = F.struct(F.col("product_id").cast("string").alias("id"), F.col(gain).cast("double").alias("g"))
    per = frame.groupBy("query_id").agg(F.collect_list(told).alias("docs"))

    def run(batches):
        for batch in batches:
            docs, n = batch.column(1), batch.num_rows
            size = docs.value_lengths().to_numpy(zero_copy_only=False)
            row, flat = np.repeat(np.arange(n), size), docs.flatten()
            gains = flat.field("g").to_numpy(zero_copy_only=False)
            tails = [f"{q}:{i}".encode() for q, i in zip(batch.column(0).take(pa.array(row)).to_pylist(), flat.field("id").to_pylist())]
            begin = np.cumsum(size) - size
            share = 1 / np.log2(np.arange(len(row)) - begin[row] + 2)
            dcg = lambda order: np.bincount(row, gains[order] * share, n)  # noqa: B023, E731
            best = dcg(np.lexsort((-gains, row)))
            scale = np.divide(1.0, best, out=np.zeros(n), where=best > 0)
            means = []
            for t in range(trials):
                head = f"{seed}:{t}:".encode()
                key = np.frombuffer(b"".join([hashlib.md5(head + x).digest() for x in tails]), ">u8").astype(np.uint64).reshape(-1, 2)
                means.append(float(np.where(best > 0, dcg(np.lexsort((gains, key[:, 1], key[:, 0], row))) * scale, 0.0).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(range(trials), pa.int32()), pa.array(means, pa.float64()), pa.array([n] * trials, pa.int64())], names=["trial", "total", "n"])

    x = per.select(F.col("query_id").cast("string").alias("q"), "docs").mapInArrow(run, "trial int, total double, n long")
    return x.groupBy("trial").agg((F.sum("total") / F.sum("n")).alias("mean_ndcg"))


def floor_interval(runs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Mean of the trials and the floor-indexed percentiles ordered[int(q (n - 1))]."""
    ordered = F.array_sort(F.collect_list("mean_ndcg"))
    at = lambda q: F.get(F.col("o"), F.floor(F.lit(q) * (F.size("o") - 1)).cast("int"))
    return runs.agg(ordered.alias("o"), F.avg("mean_ndcg").alias("point")).select("point", at(alpha / 2).alias("low"), at(1 - alpha / 2).alias("high"))


def paired(a: DataFrame, b: DataFrame, value: str = "ndcg") -> DataFrame:
    """Per-query deltas of two arms; queries of one arm only raise."""
    x = a.select("query_id", F.col(value).alias("a")).join(b.select("query_id", F.col(value).alias("b")), "query_id", "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return x.select("query_id", "a", "b", checked(both, F.col("a") - F.col("b"), "the arms have different queries").alias("delta"))


#: Of one SHA-256 every 8 hex digits draw a weight.
_DRAWS = 8


def poisson_steps(most: int = 13) -> list[int]:
    """Where a 32-bit number passes to the next weight: 2^32 times the chances that a Poisson number of mean 1 is at most 0, 1, 2, ..."""
    total, term, out = 0.0, math.exp(-1), []
    for k in range(most):
        total += term
        out.append(int(total * 2**32))
        term /= k + 1
    return out


def replicates(frame: DataFrame, key: str, n: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Adds rep and w to every row: rep -1 with weight 1, the sample itself, and n replicates whose weights are Poisson numbers of mean 1, drawn by a hash of (seed, key).

    Rows of one key weigh the same in a replicate, whatever arm they belong to, so differences are
    paired. Rows of weight 0 are left out. Nothing is shuffled: sums by replicate are merged map-side.
    """
    blocks = F.sequence(F.lit(0), F.lit(-(-n // _DRAWS) - 1))
    x = frame.withColumn("_block", F.explode(blocks)).withColumn("_hex", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_block").cast("string"), F.lit(":"), F.col(key).cast("string")), 256))
    draws = F.array(*[F.struct((F.col("_block") * _DRAWS + i).alias("rep"), F.conv(F.substring("_hex", 8 * i + 1, 8), 16, 10).cast("long").alias("u")) for i in range(_DRAWS)])
    x = x.select(*frame.columns, F.explode(draws).alias("_d")).select(*frame.columns, F.col("_d.rep").alias("rep"), F.col("_d.u").alias("_u")).where(F.col("rep") < n)
    weight = sum((F.when(F.col("_u") >= step, 1).otherwise(0) for step in poisson_steps()), F.lit(0))
    drawn = x.withColumn("w", weight).drop("_u").where("w > 0")
    return drawn.unionByName(frame.withColumns({"rep": F.lit(-1), "w": F.lit(1)}))


def _interval(value: str, alpha: float) -> list:
    """The sample's own value and the percentiles of the replicates', between neighbours in proportion; n + 1 rows a group."""
    drawn = F.when(F.col("rep") >= 0, F.col(value))
    return [F.max(F.when(F.col("rep") < 0, F.col(value))).alias("point"), F.percentile(drawn, F.lit(alpha / 2)).alias("low"), F.percentile(drawn, F.lit(1 - alpha / 2)).alias("high")]


def bootstrap(per_query: DataFrame, value: str = "ndcg", arm: str | None = None, n: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(arm, point, low, high, n): mean of a value over queries with a percentile interval, per arm.

    A replicate weighs every query by a Poisson number, which is what drawing queries with
    replacement comes to for many queries; its mean is that of the weighted values. An arm's sums
    for a replicate are merged from partial ones, so no task holds an arm. Null values don't count.
    """
    x = per_query.select((F.col(arm) if arm else F.lit("all")).alias("arm"), F.col("query_id"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    runs = replicates(x, "query_id", n, seed).groupBy("arm", "rep").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"), F.count("*").alias("c"))
    return runs.groupBy("arm").agg(*_interval("m", alpha), F.max(F.when(F.col("rep") < 0, F.col("c"))).alias("n"))


def cluster_sums(values: DataFrame, cluster: str = "query_id", side: str = "present", value: str = "gain") -> DataFrame:
    """Sum and count of each side per cluster."""
    return values.groupBy(cluster).agg(*[f(F.when(c, F.col(value))).alias(n) for f, c, n in (
        (F.sum, F.col(side), "sum_in"), (F.count, F.col(side), "n_in"), (F.sum, ~F.col(side), "sum_out"), (F.count, ~F.col(side), "n_out"))])


def cluster_bootstrap(values: DataFrame, cluster: str = "query_id", side: str = "present", value: str = "gain", n: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(point, low, high): difference of the two sides' means, clusters weighed whole; replicates without one side are left out."""
    sums = cluster_sums(values, cluster, side, value).withColumnRenamed(cluster, "query_id")
    runs = replicates(sums, "query_id", n, seed).groupBy("rep").agg(*[F.sum(F.col("w") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("sum_in", "n_in", "sum_out", "n_out")])
    mean = lambda s: F.try_divide(F.col(f"sum_{s}"), F.col(f"n_{s}"))
    runs = runs.select("rep", (mean("in") - mean("out")).alias("delta"))
    return runs.agg(*_interval("delta", alpha))


def verdict(intervals: DataFrame) -> DataFrame:
    """Does the interval exclude 0, and in which direction."""
    return intervals.withColumn("verdict", F.when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").otherwise("not separable"))


def weight_sweep(frame: DataFrame, weights: list[float], text: str = "text_z", image: str = "image_z") -> DataFrame:
    """Mean NDCG of each weight of a blend; rows times weights, one shuffle by (query, weight)."""
    from loomrank.functions.numeric import blend, or_last

    x = frame.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    x = x.withColumn("s", or_last(blend(F.col(text), F.col(image), F.col("weight"))))
    w = W.partitionBy("query_id", "weight")
    x = x.select("query_id", "weight", "gain", F.row_number().over(w.orderBy(F.col("s").desc(), "product_id")).alias("r"), F.row_number().over(w.orderBy(F.col("gain").desc())).alias("i"))
    per = x.groupBy("query_id", "weight").agg(F.sum(dcg_term(F.col("gain"), F.col("r"))).alias("d"), F.sum(dcg_term(F.col("gain"), F.col("i"))).alias("m"))
    return per.groupBy("weight").agg(F.avg(F.when(F.col("m") > 0, F.col("d") / F.col("m")).otherwise(F.lit(0.0))).alias("mean_ndcg"))


def best_weight(sweep: DataFrame) -> DataFrame:
    """The best mean, ties to the lower weight."""
    return sweep.orderBy(F.col("mean_ndcg").desc(), "weight").limit(1)


def oracle_choice(per_arm: DataFrame, preference: list[str]) -> DataFrame:
    """Best arm of each query, ties to the arm listed first (query_id, arm, ndcg)."""
    seat = F.array_position(F.array(*[F.lit(a) for a in preference]), F.col("arm"))
    return per_arm.withColumn("_r", F.row_number().over(by_query(F.col("ndcg").desc(), seat))).where("_r = 1").drop("_r")


def selector_targets(per_arm: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Arm that a selector should learn: of the arms within `tolerance` of the query's best the one of best mean."""
    means = per_arm.groupBy("arm").agg(F.avg("ndcg").alias("_mean"))
    x = per_arm.join(F.broadcast(means), "arm")  # a row an arm
    x = x.withColumn("_tied", F.col("ndcg") >= F.max("ndcg").over(W.partitionBy("query_id")) - tolerance)
    return x.withColumn("_r", F.row_number().over(by_query(F.col("_tied").desc(), F.col("_mean").desc(), F.col("arm")))).where("_r = 1").select("query_id", "arm")


def presence_control(values: DataFrame) -> DataFrame:
    """Mean lifts of arms text, values, indicators and both: the naive lift, the part presence alone explains, and the rest."""
    return values.agg(
        F.avg(F.col("with_values") - F.col("text")).alias("naive"), F.avg(F.col("with_indicators") - F.col("text")).alias("artefact"),
        F.avg(F.col("with_values") - F.col("with_indicators")).alias("honest"))


def gate(comparisons: DataFrame) -> DataFrame:
    """Of the comparisons whose lower bound is above 0 the one of the largest lower bound."""
    return comparisons.where("low > 0").agg(F.max_by("arm", F.struct("low", "arm")).alias("arm"), F.max("low").alias("low"))


def query_parts(frame: DataFrame, parts: int, key: str = "query_id", seed: str = "parts/v1") -> DataFrame:
    """Adds part, from 0, dealt by a seeded hash of the query: the same for all its rows and in every run."""
    return frame.withColumn("part", fold_of(F.col(key), seed, parts))


def cross_fit(frame: DataFrame, parts: int, fit, predict, key: str = "query_id", seed: str = "parts/v1") -> DataFrame:
    """Every row scored by a model that never saw its query. fit(df) -> model, predict(model, df) -> df. One pair of jobs a part."""
    x, out = query_parts(frame, parts, key, seed), None
    for p in range(parts):
        scored = predict(fit(x.where(F.col("part") != p)), x.where(F.col("part") == p))
        out = scored if out is None else out.unionByName(scored)
    return out


def ndcg_and_floor(frame: DataFrame, score: str = "run_score", gain: str = "gain") -> DataFrame:
    """A5, G2 in one pass: (query_id, ndcg, floor, n_docs); the judgements are shuffled and ranked once."""
    x = frame.select("query_id", F.col(gain).alias("g"), rank_by(score).alias("r"), F.row_number().over(by_query(F.col(gain).desc())).alias("i"))
    per = x.groupBy("query_id").agg(F.sum(dcg_term(F.col("g"), F.col("r"))).alias("dcg"), F.sum(dcg_term(F.col("g"), F.col("i"))).alias("idcg"),
                                    F.avg("g").alias("mean_gain"), F.sum(1.0 / F.log2(F.col("i") + 1)).alias("discounts"), F.count("*").alias("n_docs"))
    share = lambda c: F.when(F.col("idcg") > 0, c / F.col("idcg")).otherwise(F.lit(0.0))
    return per.select("query_id", share(F.col("dcg")).alias("ndcg"), share(F.col("mean_gain") * F.col("discounts")).alias("floor"), "n_docs")


def report(frame: DataFrame, score: str, arm: str, n: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Two rows, of the arm and of its lift over the random floor: mean, interval, queries, and the mean floor. The lift is paired: both lie in a query's one row."""
    per = ndcg_and_floor(frame, score)
    both = per.select("query_id", "floor", F.explode(F.array(F.struct(F.lit(arm).alias("arm"), F.col("ndcg").alias("v")), F.struct(F.lit("lift").alias("arm"), (F.col("ndcg") - F.col("floor")).alias("v")))).alias("x"))
    both = stored(both.select("query_id", "floor", "x.arm", "x.v"))
    floor = both.where(F.col("arm") == "lift").agg(F.avg("floor").alias("floor"))
    return bootstrap(both, "v", "arm", n, alpha, seed).withColumn("floor", floor.scalar())
