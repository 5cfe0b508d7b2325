"""Assertion operators (V rows). Those that judge rows are conditions in the plan and raise when rows are read; those that judge a whole frame raise ValueError."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomrank.functions.checks import holds
from loomrank.session import stored

from .relational import require

# The gates.
JOIN_COVERAGE, DENSE_SHIFT, FALLBACK, MALFORMED, LABEL_SHARE, REPRODUCTION = 0.88, 0.02, 0.005, 0.005, 0.001, 5e-4
BOOK_SHARE = (0.04, 0.09)


def unique(frame: DataFrame, *key: str) -> DataFrame:
    """V1: a condition in the plan; one shuffle by the key, which a pass that groups by it needs anyway."""
    x = frame.withColumn("_twice", F.count("*").over(W.partitionBy(*key)))
    return x.where(holds(F.col("_twice") == 1, f"{key} isn't unique")).drop("_twice")


def only_folds(frame: DataFrame, allowed: list[int]) -> DataFrame:
    """V2: a condition in the plan."""
    return frame.where(holds(F.coalesce(F.col("fold").isin(allowed), F.lit(False)), "rows of other folds"))


class Watch:
    """Checks of whole-frame shares that ride along with the one action over a frame: mark it, run the action, then check().

    Marks are observed metrics, so the rows are read once.
    """

    def __init__(self) -> None:
        self.marks: list[tuple] = []

    def _mark(self, frame: DataFrame, judge, *metrics) -> DataFrame:
        seen = Observation()
        self.marks.append((seen, judge))
        return frame.observe(seen, *metrics)

    def share_at_most(self, frame: DataFrame, condition, most: float, what: str) -> DataFrame:
        """V3, V4: a share of rows, such as fallbacks or malformed answers."""
        def judge(got):
            share = (got["bad"] or 0) / max(1, got["rows"])
            require(share <= most, f"{what}: {share:.4f} of the rows, at most {most}")

        return self._mark(frame, judge, F.count("*").alias("rows"), F.count(F.when(condition, 1)).alias("bad"))

    def not_empty(self, frame: DataFrame, what: str = "rows") -> DataFrame:
        """V14."""
        return self._mark(frame, lambda got: require(got["rows"] > 0, f"no {what}"), F.count("*").alias("rows"))

    def mean_shift(self, frame: DataFrame, a, b, low: float, high: float, what: str) -> DataFrame:
        """V7, V9: how far the mean of one column lies from that of another, such as a dense field before and after a change or a number and its reproduction."""
        def judge(got):
            shift = None if got["a"] is None or got["b"] is None else got["a"] - got["b"]
            require(shift is not None and low <= shift <= high, f"{what}: shifted by {shift}, not {low} to {high}")

        return self._mark(frame, judge, F.avg(a).alias("a"), F.avg(b).alias("b"))

    def check(self) -> None:
        """Raises for the first mark that fails; only after the action."""
        for seen, judge in self.marks:
            judge(seen.get)


def share_at_most(frame: DataFrame, condition, most: float, what: str) -> DataFrame:
    """V3, V4: stores the frame in one pass that also takes the share."""
    watch = Watch()
    out = stored(watch.share_at_most(frame, condition, most, what))
    watch.check()
    return out


def complete(frame: DataFrame, *columns: str) -> DataFrame:
    """V5: a condition in the plan."""
    for c in columns:
        frame = frame.where(holds(F.col(c).isNotNull(), f"missing values: {c}"))
    return frame


def value_between(frame: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """V6 to V9: every value of a report column lies in a band, such as coverage, shift or distance from a published number; a condition in the plan."""
    c = F.col(column)
    return frame.where(holds(F.coalesce((c >= low) & (c <= high), F.lit(False)), f"{column} outside {low}..{high}"))


def lossless(frame: DataFrame) -> DataFrame:
    """Every interval of a difference holds 0; a condition in the plan."""
    return frame.where(holds(F.coalesce((F.col("low") <= 0) & (F.col("high") >= 0), F.lit(False)), "an interval excludes 0"))


def final_only(split: str, final: bool) -> None:
    """V11."""
    require(split != "test" or final, "the test split is scored once, with final=True")


def final_rows(frame: DataFrame) -> DataFrame:
    """V11 on rows (split, final): one of the test split without final raises when it is read."""
    return frame.where(holds(F.coalesce((F.col("split") != "test") | F.col("final"), F.lit(False)), "the test split is scored once, with final=True"))


def complete_sets(frame: DataFrame, by: list[str], what: str, wanted: list[str], keep: bool = False) -> DataFrame:
    """Rows a group with the number of its rows and the values found, which must be those wanted, such as both precisions of a timed arm or all arms of an ablation.

    With keep a row a value and its number. Values are counted by group before any set is made; a group without the exact set raises when it is read.
    """
    x = frame.groupBy(*by, what).agg(F.count("*").alias("n"))
    y = x.groupBy(*by).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(what, F.col("n").alias("of")))).alias("_all"))
    y = y.withColumn("found", F.transform("_all", lambda r: r[what]))
    y = y.where(holds(F.col("found") == F.array(*[F.lit(w) for w in sorted(wanted)]), F.concat(F.lit(f"{what} is not {sorted(wanted)} but "), F.array_join("found", ","))))
    if keep:
        return y.select(*by, F.explode("_all").alias("_r")).select(F.col(f"_r.{what}").alias(what), F.col("_r.of").alias("n"))
    return y.drop("_all")


def same_provenance(cache: DataFrame, **expected: str) -> DataFrame:
    """Conditions in the plan."""
    for c, v in expected.items():
        cache = cache.where(holds(F.col(c).eqNullSafe(F.lit(v)), f"cache rows of another {c}"))
    return cache


def exactly(there, wanted, what: str) -> None:
    """A set of names is complete."""
    require(set(there) == set(wanted), f"{what}: {sorted(set(there) ^ set(wanted))}")


def not_empty(frame: DataFrame, what: str = "rows") -> DataFrame:
    """V14."""
    require(not frame.isEmpty(), f"no {what}")
    return frame


def disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """V16, U8."""
    require(a.select(key).intersect(b.select(key)).isEmpty(), f"a {key} stands on both sides")


def enough(frame: DataFrame, key: str, n: int) -> DataFrame:
    """V17."""
    require(frame.select(key).distinct().limit(n).count() >= n, f"fewer than {n} distinct {key}")
    return frame
