"""Boosted rankers with Newton leaves and early stopping (L1, M13), saved with a record that scoring must agree with (L2 to L4)."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.functions.numeric import expected_gain
from loomrank.session import stored

from .learned import assembled
from .metrics import ndcg_per_query

OBJECTIVES = ("lambdarank", "regression", "multiclass")
#: The settings of the coarse ranker and of the combiner.
RANKER = {"rate": 0.05, "depth": 6, "least_rows": 50, "rounds": 500, "patience": 50}
COMBINER = {"rate": 0.05, "depth": 4, "least_rows": 50, "rounds": 150, "patience": 150}
COMBINER_FEATURES = ("stage2_score", "stage2_rank", "ce_score", "llm_rank", "llm_rr")
CLASSES = 4
#: Rounds after which the scores so far are stored; between, a row is scored by as many trees anew.
CUT = 8
#: Pairs of documents that a task holds at once.
PAIRS = 1 << 20


def _pairs_met(row: np.ndarray, size: np.ndarray, s: np.ndarray, g: np.ndarray, share: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of first and second derivatives and the number of pairs of every document of lists of `size` that lie one after the other, PAIRS pairs or a list at once."""
    first, second, many = np.zeros(len(row)), np.zeros(len(row)), np.zeros(len(row), np.int64)
    n, from_ = size[row], (np.cumsum(size) - size)[row]
    total, begin = np.cumsum(n), 0
    while begin < len(row):
        stop = max(begin + 1, int(total.searchsorted((total[begin - 1] if begin else 0) + PAIRS, "right")))
        count = n[begin:stop]
        a = np.repeat(np.arange(begin, stop), count)
        b = np.arange(count.sum()) + np.repeat(from_[begin:stop] - (np.cumsum(count) - count), count)
        some = (g[a] != g[b]) & ~np.isnan(g[a]) & ~np.isnan(g[b])
        a, b = a[some], b[some]
        apart = g[a] - g[b]
        sign = np.sign(apart)
        swap = np.abs(apart * (share[a] - share[b])) / best[row[a]]
        with np.errstate(over="ignore"):  # of a pair far apart: the chance is 0
            wrong = 1 / (1 + np.exp(sign * (s[a] - s[b])))
        for out, each in ((first, sign * swap * wrong), (second, swap * wrong * (1 - wrong)), (many, None)):
            out[begin:stop] = np.bincount(a - begin, each, stop - begin)
        begin = stop
    return first, second, many


def _list_derivatives(ids: pa.Array, scores: pa.Array, gains: pa.Array) -> pa.Array:
    """Both derivatives of every document of each list, null where it has no pair."""
    size = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    s, g = (x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for x in (scores, gains))
    flat = ids.flatten()
    named = pc.rank(flat, "ascending", tiebreaker="dense").to_numpy()
    place = np.arange(len(row)) - (np.cumsum(size) - size)[row] + 2
    share = np.empty(len(row))
    share[np.lexsort((named, -s, row))] = 1 / np.log2(place)  # NaN, of a missing score, comes last
    best = np.bincount(row, np.nan_to_num(g[np.lexsort((-g, row))] / np.log2(place)), len(size))
    first, second, many = _pairs_met(row, size, s, g, share, best)
    both = pa.StructArray.from_arrays([pa.array(first), pa.array(second)], names=["g", "h"], mask=pa.array(many == 0))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), both)


def lambda_gradients(frame: DataFrame, score: str = "score", gain: str = "gain", keep: Sequence[str] = ()) -> DataFrame:
    """First and second derivative (query_id, product_id, g, h) of every document with a pair: over the documents of its query
    with another gain, the change d of NDCG by a swap times p, the chance of the wrong order, and times p (1 - p).

    A query's list travels to Arrow once and its pairs are met there in chunks, so the rows are shuffled once and nothing is
    joined; the work grows with the square of a list, and lists are judged windows. Other columns of the frame pass through with `keep`.
    """
    met = F.arrow_udf(_list_derivatives, "array<struct<g:double,h:double>>")
    told = F.struct("product_id", F.col(score).alias("s"), F.col(gain).alias("gain"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    x = frame.groupBy("query_id").agg(F.collect_list(told).alias("docs"))
    x = x.select("query_id", "docs", met("docs.product_id", "docs.s", "docs.gain").alias("sums"))
    x = x.select("query_id", F.explode(F.arrays_zip("docs", "sums")).alias("x")).where("x.sums IS NOT NULL")
    return x.select("query_id", "x.docs.product_id", *[F.col(f"x.docs.k{i}").alias(c) for i, c in enumerate(keep)], "x.sums.g", "x.sums.h")


def probabilities(scores: Sequence[Column]) -> Column:
    """Softmax of the classes' scores, shifted by the largest."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp(s - top) for s in scores]
    total = sum(parts[1:], parts[0])
    return F.array(*[p / total for p in parts])


@dataclass(frozen=True)
class Boosted:
    """Trees by round and class, the features they were trained on, and the round of the best validation; it carries no score of its own."""

    objective: str
    features: tuple[str, ...]
    settings: dict
    start: tuple[float, ...]
    trees: tuple[tuple[DecisionTreeRegressionModel, ...], ...]
    best_round: int
    history: tuple[float, ...] = field(default=())

    def raw(self, frame: DataFrame) -> DataFrame:
        """Columns _s0, _s1, ... of the classes' scores by the rounds up to the best."""
        x = assembled(frame, list(self.features)).withColumns({f"_s{k}": F.lit(s) for k, s in enumerate(self.start)})
        for trees in self.trees[: self.best_round]:
            x = _grown(x, trees, self.settings["rate"])
        return x.drop("features")

    def score(self, frame: DataFrame, out: str = "score") -> DataFrame:
        """L2: one score a row, higher is better; of classes the expected gain of their probabilities, which go to `probabilities`."""
        x, names = self.raw(frame), [f"_s{k}" for k in range(len(self.start))]
        if self.objective == "multiclass":
            x = x.withColumn("probabilities", probabilities([F.col(n) for n in names])).withColumn(out, expected_gain(F.col("probabilities")))
        else:
            x = x.withColumn(out, F.col("_s0"))
        return x.drop(*names)


def _grown(x: DataFrame, trees: Sequence[DecisionTreeRegressionModel], rate: float) -> DataFrame:
    for k, tree in enumerate(trees):
        x = tree.setPredictionCol("_step").transform(x).withColumn(f"_s{k}", F.col(f"_s{k}") + rate * F.col("_step")).drop("_step")
    return x


def _derivatives(x: DataFrame, objective: str, k: int, classes: int) -> DataFrame:
    """Rows of x with g and h of class k; without those that have none."""
    if objective == "lambdarank":
        return lambda_gradients(x.where("NOT _held"), "_s0", keep=["features"])
    if objective == "regression":
        return x.withColumns({"g": F.col("gain") - F.col("_s0"), "h": F.lit(1.0)})
    p = probabilities([F.col(f"_s{i}") for i in range(classes)])[k]
    return x.withColumn("_p", p).withColumns({"g": (F.col("label_code") == k).cast("double") - F.col("_p"), "h": F.col("_p") * (1 - F.col("_p"))}).drop("_p")


def _mean(rows: DataFrame, value: Column) -> float:
    """The mean of values of some tens at most, summed as decimals: the same whatever tasks hold the rows and whichever of them ends first.

    Sums of doubles differ in their last bits by that, and a round that orders the rows as the one before did could pass for a better one.
    """
    x = rows.select(value.cast("decimal(38,18)").alias("v")).agg(F.sum("v").alias("total"), F.count("v").alias("n")).first()
    return float(Fraction(x.total) / x.n)


def _validation(held: DataFrame, objective: str, classes: int) -> float:
    """NDCG, or the negative squared or logarithmic error: higher is better."""
    if objective == "lambdarank":
        return _mean(ndcg_per_query(held, "_s0"), F.col("ndcg"))
    if objective == "regression":
        error = (F.col("gain") - F.col("_s0")) ** 2
        scale = 2.0 ** math.frexp(held.agg(F.max(error)).first()[0])[1]
        return _mean(held, -error / scale) * scale
    p = F.get(probabilities([F.col(f"_s{i}") for i in range(classes)]), F.col("label_code"))
    return _mean(held, F.log(F.greatest(p, F.lit(1e-15))))


def train(frame: DataFrame, valid: DataFrame, features: Sequence[str], objective: str = "lambdarank", settings: Mapping | None = None, seed: int = 0, classes: int = CLASSES) -> Boosted:
    """L1: trees on first derivatives with Newton leaves; valid is for stopping and nothing else.

    A tree is fitted to g / h with weight h: a split's gain is then that of G^2 / H, and a leaf's value
    the sum of g over the sum of h of its rows. Rounds end after `patience` ones without a better
    validation (NDCG; squared error; logarithmic loss), and the best round is the last that
    scoring uses. The classes start from the logarithms of their shares, with a tree for each a round.

    Rows need query_id, product_id, gain and, for classes, label_code from 0. Gains are the data's own:
    a setting label_gain is refused, as are unknown settings and objectives, and an empty side. A null or
    NaN feature is a value below all others.
    """
    if objective not in OBJECTIVES:
        raise ValueError(f"{objective} isn't one of {OBJECTIVES}")
    if "label_gain" in (settings or {}):
        raise ValueError("label_gain isn't a setting: gains are the judgements' own, and others would measure another NDCG")
    if set(settings or {}) - set(RANKER):
        raise ValueError(f"unknown settings {sorted(set(settings) - set(RANKER))}")
    use, multi = RANKER | dict(settings or {}), objective == "multiclass"
    columns = ["query_id", "product_id", F.col("gain").cast("double").alias("gain"), *(["label_code"] if multi else []), "features"]
    x = assembled(frame, list(features)).select(*columns, F.lit(False).alias("_held")).unionByName(assembled(valid, list(features)).select(*columns, F.lit(True).alias("_held")))
    x = stored(x)
    count = {r["_held"]: r for r in x.groupBy("_held").agg(F.count("*").alias("n"), *([F.count_if(F.col("label_code") == k).alias(f"n{k}") for k in range(classes)] if multi else [])).collect()}
    if set(count) != {False, True}:
        raise ValueError("no rows to train on, or none to stop by")
    # a class that training doesn't have still needs a share above 0
    start = tuple(float(math.log(max(count[False][f"n{k}"], 0.5) / count[False].n)) for k in range(classes)) if multi else (0.0,)
    x = x.withColumns({f"_s{k}": F.lit(s) for k, s in enumerate(start)})
    grower = DecisionTreeRegressor(labelCol="_target", weightCol="h", featuresCol="features", predictionCol="_step", maxDepth=use["depth"], minInstancesPerNode=use["least_rows"], minInfoGain=0.0)
    trees, history = [], []
    for t in range(use["rounds"]):
        grown = []
        for k in range(len(start)):
            target = _derivatives(x.where("NOT _held"), objective, k, len(start)).where("h > 1e-12").select("features", "h", (F.col("g") / F.col("h")).alias("_target"))
            if objective == "lambdarank":  # the fit reads its rows several times, and pairs are met once a round
                target = target.persist()
            try:
                if target.isEmpty():
                    break
                grown.append(grower.setSeed(seed + t).fit(target))
            finally:
                target.unpersist()
        if len(grown) < len(start):
            break
        trees.append(tuple(grown))
        x = _grown(x, grown, use["rate"])
        if (t + 1) % CUT == 0:
            x = stored(x)
        history.append(_validation(x.where("_held"), objective, len(start)))
        if len(history) - 1 - max(range(len(history)), key=lambda i: (history[i], -i)) >= use["patience"]:
            break
    best = max(range(len(history)), key=lambda i: (history[i], -i)) + 1 if history else 0
    return Boosted(objective, tuple(features), use, start, tuple(trees), best, tuple(history))


# --- a frozen configuration --------------------------------------------------------------------


@dataclass(frozen=True)
class Frozen:
    """What a persisted model was trained as: scoring with any other is refused."""

    features: tuple[str, ...] = COMBINER_FEATURES
    objective: str = "lambdarank"
    settings: tuple[tuple[str, float], ...] = tuple(sorted(COMBINER.items()))
    fit_folds: tuple[int, ...] = (2, 3, 4)
    stop_fold: int = 1
    seed: int = 0

    def with_settings(self, **changed) -> Frozen:
        return replace(self, settings=tuple(sorted((dict(self.settings) | changed).items())))


def rows_of(frame: DataFrame, folds: Sequence[int]) -> DataFrame:
    """The rows of some folds; a fold that the frame doesn't have raises, as rows of the test split have none."""
    there = {r.fold for r in frame.select("fold").distinct().collect()}
    if set(folds) - there:
        raise ValueError(f"folds {sorted(set(folds) - there)} aren't in the frame")
    return frame.where(F.col("fold").isin(list(folds)))


def train_frozen(frame: DataFrame, config: Frozen) -> Boosted:
    """L3, L4: a model of the configuration's folds, stopped by its stop fold, which may not be one of them."""
    if config.stop_fold in config.fit_folds:
        raise ValueError("the fold that stops training may not be trained on")
    return train(rows_of(frame, config.fit_folds), rows_of(frame, [config.stop_fold]), config.features, config.objective, dict(config.settings), config.seed)


def _digest(trees: Sequence[Sequence[DecisionTreeRegressionModel]]) -> str:
    told = [tree.toDebugString.split("\n", 1)[1] for per in trees for tree in per]
    return hashlib.sha256("\n".join(told).encode()).hexdigest()


def save(spark: SparkSession, model: Boosted, config: Frozen, path: str) -> None:
    """K9: the best rounds' trees, and a record of the configuration, the start, the validations and a digest of the trees."""
    used = model.trees[: model.best_round]
    for t, per in enumerate(used):
        for k, tree in enumerate(per):
            tree.write().overwrite().save(f"{path}/trees/{t}-{k}")
    record = {"config": asdict(config), "start": model.start, "best_round": model.best_round, "history": model.history, "classes": len(model.start), "digest": _digest(used)}
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/record")


def load(spark: SparkSession, path: str, config: Frozen) -> tuple[Boosted, dict]:
    """The saved model and its record; another configuration than the record's, and trees that the record doesn't know, are refused."""
    record = json.loads(spark.read.text(f"{path}/record").first()[0])
    told, want = json.loads(json.dumps(record["config"])), json.loads(json.dumps(asdict(config)))
    other = sorted(c for c in want if told.get(c) != want[c])
    if other:
        raise ValueError(f"the model was trained with other {', '.join(other)}")
    trees = tuple(tuple(DecisionTreeRegressionModel.load(f"{path}/trees/{t}-{k}") for k in range(record["classes"])) for t in range(record["best_round"]))
    if _digest(trees) != record["digest"]:
        raise ValueError("the trees aren't those of the record")
    return Boosted(config.objective, tuple(config.features), RANKER | dict(config.settings), tuple(record["start"]), trees, record["best_round"], tuple(record["history"])), record


def score_frozen(spark: SparkSession, path: str, config: Frozen, frame: DataFrame, report_fold: int | None = None, out: str = "score") -> DataFrame:
    """L3: (query_id, product_id, score, in_sample) by a saved model; in_sample comes from the record's folds, never from an argument.

    Refused: another configuration, a frame without one of the features, and a report on a fold that was trained on or stopped by.
    """
    model, record = load(spark, path, config)
    lost = [c for c in config.features if c not in frame.columns]
    if lost:
        raise ValueError(f"the frame lacks {lost}")
    fitted = record["config"]["fit_folds"]
    if report_fold is not None and report_fold in (*fitted, record["config"]["stop_fold"]):
        raise ValueError(f"the model has seen fold {report_fold}")
    x = frame if report_fold is None else frame.where(F.col("fold") == report_fold)
    inside = F.col("fold").isin(fitted) if "fold" in frame.columns else F.lit(False)
    return model.score(x, out).select("query_id", "product_id", out, F.coalesce(inside, F.lit(False)).alias("in_sample"))
