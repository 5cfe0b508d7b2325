"""Window scorers trained by RankNet on CPU (L7): pairwise logistic gradients, summed over the cluster by treeAggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.functions.checks import holds
from loomrank.functions.text import fold_of
from loomrank.session import stored

from .ranking import by_query

#: Adam's usual constants.
RATE, DECAY, DECAY_2, TINY = 0.1, 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class Scorer:
    """Weights over standardised features: linear, or one layer of tanh units."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    hidden: int
    weights: np.ndarray
    losses: tuple[float, ...]

    def column(self) -> Column:
        """The score as an expression, so that scoring stays in the JVM; a missing feature counts as its mean."""
        z = [F.coalesce((F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) - m) / s, F.lit(0.0)) for f, m, s in zip(self.features, self.mean, self.scale)]
        total = lambda ws, xs: sum((float(w) * x for w, x in zip(ws, xs)), F.lit(0.0))
        if not self.hidden:
            return total(self.weights, z)
        inner, bias, outer = _layers(self.weights, len(z), self.hidden)
        return total(outer, [F.tanh(total(inner[:, j], z) + float(bias[j])) for j in range(self.hidden)])

    def orderings(self, windows: DataFrame) -> DataFrame:
        """(query_id, product_id, position): each window by its scores, ties by id."""
        x = windows.withColumn("_s", self.column())
        return x.select("query_id", "product_id", F.row_number().over(by_query(F.col("_s").desc(), F.col("product_id"))).alias("position"))


def _layers(w: np.ndarray, d: int, hidden: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return w[: d * hidden].reshape(d, hidden), w[d * hidden : d * hidden + hidden], w[d * hidden + hidden :]


def window_loss(x: np.ndarray, y: np.ndarray, w: np.ndarray, hidden: int) -> tuple[float, np.ndarray, int]:
    """Sum over the window's pairs of different targets of log(1 + exp(s_worse - s_better)), its gradient, and the pairs."""
    if hidden:
        inner, bias, outer = _layers(w, x.shape[1], hidden)
        units = np.tanh(x @ inner + bias)
        s = units @ outer
    else:
        s = x @ w
    better = y[:, None] > y[None, :]
    gap = s[None, :] - s[:, None]  # of worse over better, where better
    loss = float(np.logaddexp(0.0, gap[better]).sum())
    pull = np.where(better, 0.5 * (1 + np.tanh(gap / 2)), 0.0)
    ds = pull.sum(axis=0) - pull.sum(axis=1)
    if not hidden:
        return loss, x.T @ ds, int(better.sum())
    back = np.outer(ds, outer) * (1 - units**2)
    return loss, np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), units.T @ ds]), int(better.sum())


def train(windows: DataFrame, features: Sequence[str], target: str, hidden: int = 0, epochs: int = 30, rate: float = RATE, seed: int = 0) -> Scorer:
    """A scorer whose order of a window follows its targets, such as labels, a teacher's places or both.

    A step sums the loss and the gradient of all windows in their tasks and merges the sums in a
    tree, so what comes to the driver is a vector as long as the weights; steps follow Adam over the
    mean of all pairs. A window is one group of one task, as its pairs are compared; it is a query's
    top documents, not its list. Windows without two different targets teach nothing; none that do
    is an error. losses holds the mean loss before each step and after the last: ln 2 at first for a linear scorer.
    """
    have = windows.select("query_id", F.col(target).cast("double").alias("y"), *[F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, f in enumerate(features)])
    told = have.agg(*[g(f"x{i}").alias(f"{n}{i}") for i in range(len(features)) for n, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = tuple(told[f"m{i}"] or 0.0 for i in range(len(features)))
    scale = tuple(told[f"s{i}"] or 1.0 for i in range(len(features)))
    z = F.array(*[F.coalesce((F.col(f"x{i}") - mean[i]) / scale[i], F.lit(0.0)) for i in range(len(features))])
    grouped = stored(have.where("y IS NOT NULL").groupBy("query_id").agg(F.collect_list(F.struct("y", z.alias("x"))).alias("d")).where(F.size(F.array_distinct("d.y")) > 1))
    rows = grouped.select(F.col("d.x").alias("x"), F.col("d.y").alias("y")).rdd.map(lambda r: (np.array(r.x, float), np.array(r.y, float))).persist(StorageLevel.MEMORY_AND_DISK)
    size = len(features) * hidden + 2 * hidden if hidden else len(features)
    w = np.random.default_rng(seed).normal(0, 0.5, size) if hidden else np.zeros(size)
    first, second, losses = np.zeros(size), np.zeros(size), []

    def summed(w: np.ndarray) -> tuple[float, np.ndarray, int]:
        add = lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2])
        return rows.treeAggregate((0.0, np.zeros(size), 0), lambda a, r: add(a, window_loss(*r, w, hidden)), add)

    for t in range(1, epochs + 2):
        loss, gradient, pairs = summed(w)
        if not pairs:
            raise ValueError("no window has documents of different targets")
        losses.append(loss / pairs)
        if t > epochs:
            break
        g = gradient / pairs
        first, second = DECAY * first + (1 - DECAY) * g, DECAY_2 * second + (1 - DECAY_2) * g * g
        w = w - rate * (first / (1 - DECAY**t)) / (np.sqrt(second / (1 - DECAY_2**t)) + TINY)
    rows.unpersist()
    return Scorer(tuple(features), mean, scale, hidden, w, tuple(losses))


def halves(frame: DataFrame, salt: str = "halves/v1") -> DataFrame:
    """Adds half, 0 or 1, dealt by a salted hash of the query: the same for all its documents and in every run."""
    return frame.withColumn("half", fold_of(F.col("query_id"), salt, 2))


def cross_fit_orderings(windows: DataFrame, fit, dealt: DataFrame | None = None) -> DataFrame:
    """(query_id, product_id, position) of every window by a model that never saw its query: fit(windows) -> Scorer, once a half.

    dealt is (query_id, half); by default halves() deals. A window in neither half, or in both, raises when it is read.
    """
    if dealt is None:
        x = halves(windows)
    else:
        sides = dealt.groupBy("query_id").agg(F.count_distinct("half").alias("_n"), F.first("half").alias("half"))
        x = windows.join(sides, "query_id", "left").where(holds(F.coalesce(F.col("_n") == 1, F.lit(False)), "a window must be in one half")).drop("_n")
    x = stored(x)
    out = None
    for half in (0, 1):
        got = fit(x.where(F.col("half") != half).drop("half")).orderings(x.where(F.col("half") == half))
        out = got if out is None else out.unionByName(got)
    return out
