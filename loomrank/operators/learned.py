"""Learned rankers (L1 to L5) as additive regression trees on pyspark.ml, and out-of-fold scoring."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomrank.session import scratch

from .ranking import rank_by

MISSING = -1e6  # trees of pyspark.ml take no null: an absent value is a number below all others


def assembled(frame: DataFrame, features: list[str]) -> DataFrame:
    """Rows with a vector of the features."""
    filled = frame.withColumns({f"_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(MISSING)) for c in features})
    return VectorAssembler(inputCols=[f"_{c}" for c in features], outputCol="features").transform(filled).drop(*[f"_{c}" for c in features])


def train_pointwise(frame: DataFrame, features: list[str], label: str = "gain", rounds: int = 20, depth: int = 4, seed: int = 13):
    """L1: gradient-boosted regression of the gain; returns a scorer of frames."""
    model = GBTRegressor(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth, seed=seed).fit(assembled(frame.withColumn(label, F.col(label).cast("double")), features))
    return lambda x, out="score": model.transform(assembled(x, features)).withColumnRenamed("prediction", out).drop("features")


def lambda_gradients(frame: DataFrame, score: str = "score", gain: str = "gain") -> DataFrame:
    """L1: each document's gradient: over pairs of its query with another gain, the change of NDCG by a swap times the chance of the wrong order.

    Pairs are a self-join by query, so lists must be bounded, as windows are.
    """
    x = frame.withColumn("_r", rank_by(score)).withColumn("_i", F.row_number().over(W.partitionBy("query_id").orderBy(F.col(gain).desc())))
    x = x.withColumn("_m", F.sum(F.col(gain) / F.log2(F.col("_i") + 1)).over(W.partitionBy("query_id")))
    a = x.select("query_id", "product_id", F.col(score).alias("s"), F.col(gain).alias("g"), F.col("_r").alias("r"), F.col("_m").alias("m"))
    b = x.select("query_id", F.col(score).alias("s2"), F.col(gain).alias("g2"), F.col("_r").alias("r2"))
    swap = F.abs((F.col("g") - F.col("g2")) * (1 / F.log2(F.col("r") + 1) - 1 / F.log2(F.col("r2") + 1))) / F.col("m")
    sign = F.signum(F.col("g") - F.col("g2"))
    pairs = a.join(b, "query_id").where("g <> g2").withColumn("l", sign * swap / (1 + F.exp(sign * (F.col("s") - F.col("s2")))))
    return pairs.groupBy("query_id", "product_id").agg(F.sum("l").alias("lambda"))


def train_lambdarank(frame: DataFrame, features: list[str], rounds: int = 10, depth: int = 4, rate: float = 0.3, seed: int = 13, checkpoint: bool = True):
    """L1: boosting on NDCG gradients, one tree a round; returns a scorer. With a checkpoint folder set, lineage is cut each round."""
    x = assembled(frame, features).select("query_id", "product_id", F.col("gain").cast("double").alias("gain"), "features").withColumn("score", F.lit(0.0))
    trees = []
    for t in range(rounds):
        target = x.join(lambda_gradients(x), ["query_id", "product_id"], "left").fillna(0.0, ["lambda"])
        tree = DecisionTreeRegressor(labelCol="lambda", featuresCol="features", predictionCol="step", maxDepth=depth, seed=seed + t).fit(target)
        trees.append(tree)
        x = tree.transform(x).withColumn("score", F.col("score") + rate * F.col("step")).drop("step")
        if checkpoint and x.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            x = x.checkpoint()

    def score(y: DataFrame, out: str = "score") -> DataFrame:
        y = assembled(y, features).withColumn(out, F.lit(0.0))
        for tree in trees:
            y = tree.transform(y).withColumn(out, F.col(out) + rate * F.col("step")).drop("step")
        return y.drop("features")

    return score


def train_selector(frame: DataFrame, features: list[str], arms: list[str], trees: int = 20, depth: int = 5, seed: int = 13):
    """A forest that predicts which arm serves a query best; returns a router of frames (column `arm`)."""
    seats = F.array(*[F.lit(a) for a in arms])
    x = assembled(frame.withColumn("label", (F.array_position(seats, F.col("arm")) - 1).cast("double")), features)
    path = scratch(frame.sparkSession)
    RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed).fit(x).save(path)
    # read back, as a fitted model's summary holds the session, which can't go to tasks once a frame was observed
    model = RandomForestClassificationModel.load(path)
    return lambda y: model.transform(assembled(y, features)).withColumn("arm", F.get(seats, F.col("prediction").cast("int"))).drop("features", "rawPrediction", "probability", "prediction")


def out_of_fold(frame: DataFrame, folds: list[int], train, reserved: tuple[int, ...] = ()) -> DataFrame:
    """Scores of each fold by a model of the others; reserved folds and fewer than two are refused."""
    if len(set(folds)) < 2 or set(folds) & set(reserved):
        raise ValueError("two folds at least, none of them reserved")
    out = None
    for f in folds:
        scored = train(frame.where(F.col("fold").isin([g for g in folds if g != f])))(frame.where(F.col("fold") == f)).withColumn("in_sample", F.lit(False))
        out = scored if out is None else out.unionByName(scored)
    return out


def truncated_pairs(tokens_query, tokens_doc, budget: int):
    """The document's tokens cut so that query and document fit the budget; the query is never cut."""
    return F.slice(tokens_doc, F.lit(1), F.greatest(F.lit(budget) - F.size(tokens_query), F.lit(0)))


def padded(c, width, left: bool = False, fill: int = 0):
    """Struct of ids padded to a width, and the mask."""
    more = F.array_repeat(F.lit(fill), F.greatest(width - F.size(c), F.lit(0)))
    ones, none = F.array_repeat(F.lit(1), F.size(c)), F.array_repeat(F.lit(0), F.greatest(width - F.size(c), F.lit(0)))
    return F.struct((F.concat(more, c) if left else F.concat(c, more)).alias("ids"), (F.concat(none, ones) if left else F.concat(ones, none)).alias("mask"))
