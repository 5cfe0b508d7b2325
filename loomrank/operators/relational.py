"""Filters, joins and set operations of the judgement pipeline (P, J and U rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomrank.functions.checks import holds
from loomrank.functions.numeric import CODES, GAINS, QRELS, mapped
from loomrank.functions.text import fold_of


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def conjunctive_filter(examples: DataFrame, locale: str, version: str, split: str) -> DataFrame:
    """One locale, small or large version, one split; a missing split column raises."""
    require("split" in examples.columns, "examples have no split column")
    return examples.where((F.col("product_locale") == locale) & (F.col(version) == 1) & (F.col("split") == split))


def label_columns(frame: DataFrame, label: str = "label") -> DataFrame:
    """Gain, qrel and label_code."""
    c = F.col(label)
    return frame.withColumns({"gain": mapped(c, GAINS), "qrel": mapped(c, QRELS), "label_code": mapped(c, CODES)})


def first_per_key(frame: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in the given order."""
    return frame.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def no_missing(left: DataFrame, right: DataFrame, key: list[str], message: str) -> DataFrame:
    """Left; a key that isn't in right raises when the row is read."""
    there = right.select(*key).distinct().withColumn("_there", F.lit(True))
    shown = F.concat(F.lit(f"{message}: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in key]))
    return left.join(there, key, "left").where(holds(F.coalesce("_there", F.lit(False)), shown)).drop("_there")


def guarded_left(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Left join that may not fan out: a key that stands twice in right raises when read. Keys are counted in the join's own shuffle."""
    counted = right.withColumn("_n", F.count("*").over(W.partitionBy(*key)))
    return left.join(counted.where(holds(F.col("_n") == 1, "the right side has a key twice")).drop("_n"), key, "left")


def covered_inner(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Inner join that must keep every row of left; one without a partner raises when read."""
    x = left.join(right.withColumn("_there", F.lit(True)), key, "left")
    return x.where(holds(F.coalesce("_there", F.lit(False)), "a row of the left side finds no partner")).drop("_there")


def enrich(products: DataFrame, corpus: DataFrame) -> DataFrame:
    """Products with the enrichment under prefix s_, whether it is there, and the description's source."""
    held = corpus.select("asin", *[F.col(c).alias(f"s_{c}") for c in corpus.columns if c != "asin"]).withColumn("has_enrichment", F.lit(True))
    x = products.join(held, products["product_id"] == held["asin"], "left").drop("asin")
    own, other = F.length("product_description") > 0, F.length("s_description") > 0
    return x.withColumns({
        "has_enrichment": F.coalesce("has_enrichment", F.lit(False)),
        "description": F.when(own, F.col("product_description")).when(other, F.col("s_description")),
        "description_source": F.when(own, "own").when(other, "scrape").otherwise("none")})


def with_fold(frame: DataFrame, test: Column | None = None) -> DataFrame:
    """The fold by query id; test rows have -1."""
    fold = fold_of(F.col("query_id"))
    return frame.withColumn("fold", F.when(test, F.lit(-1)).otherwise(fold) if test is not None else fold)


def folds(frame: DataFrame, which: list[int]) -> DataFrame:
    """Rows of some folds; a fold without rows raises."""
    x = frame.where(F.col("fold").isin(which))
    there = {r[0] for r in x.select("fold").distinct().collect()}  # a handful of folds
    require(there == set(which), f"folds {sorted(set(which) - there)} have no rows")
    return x


def train_validation(frame: DataFrame, val_fold: int) -> tuple[DataFrame, DataFrame]:
    """Split at the query boundary."""
    return frame.where(F.col("fold") != val_fold), frame.where(F.col("fold") == val_fold)


def combine_splits(by_split: dict[str, DataFrame]) -> DataFrame:
    """Splits with their name; the test split has fold -1."""
    out = None
    for name, frame in by_split.items():
        x = with_fold(frame, F.lit(name == "test")).withColumn("split", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, repeated ones counted."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def in_sample(frame: DataFrame, fitted: list[int]) -> DataFrame:
    """Was the row's fold fitted on?"""
    return frame.withColumn("in_sample", F.col("fold").isin(fitted))


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Distinct keys not done yet."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(done, key, "left_anti")


def mixed_pairs(window: DataFrame) -> DataFrame:
    """All pairs of one query's window with different gains, the better first by place. The window bounds the pairs."""
    a, b = (window.select("query_id", *[F.col(c).alias(f"{s}_{c}") for c in ("product_id", "position", "gain")]) for s in "ab")
    return a.join(b, "query_id").where("a_position < b_position AND a_gain <> b_gain")


def pairwise_accuracy(window: DataFrame, grades=tuple(GAINS.values())) -> DataFrame:
    """Share of the pairs of a query with different gains and places that stand in the right order, and their number.

    For each document the ones before it are counted by grade, running over one window, and so the
    pairs that it closes: no pair is made, and a list may be as long as it likes. A
    document without gain is in no pair; another grade raises when it is read.
    """
    before = W.partitionBy("query_id").orderBy("position").rangeBetween(W.unboundedPreceding, -1)
    fine = window.where(holds(F.col("gain").isNull() | F.col("gain").isin(*grades), "a gain that is no grade"))
    x = fine.withColumns({f"_n{i}": F.count(F.when(F.col("gain") == g, 1)).over(before) for i, g in enumerate(grades)})
    total = lambda fits: sum((F.when(fits(F.lit(g)), F.col(f"_n{i}")).otherwise(0) for i, g in enumerate(grades)), F.lit(0))
    pairs = x.agg(F.sum(total(lambda g: g > F.col("gain"))).alias("right"), F.sum(total(lambda g: g != F.col("gain"))).alias("n_pairs"))
    return pairs.select(F.try_divide(F.col("right"), F.col("n_pairs")).alias("accuracy"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))


def newly_over(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs (lower, higher label) that stand the wrong way after but not before."""
    wrong = lambda x: mixed_pairs(x).where("a_gain < b_gain").select("query_id", F.col("a_product_id").alias("over"), F.col("b_product_id").alias("under"))
    return wrong(after).exceptAll(wrong(before))


def query_texts(frame: DataFrame, texts: DataFrame) -> DataFrame:
    """Look-up of a query's text; Spark broadcasts the dimension where its size allows."""
    return frame.join(texts, "query_id", "left")


def vector_lookup(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """Stored vectors of keys with a presence flag; an unknown key has null."""
    return wanted.join(store, "key", "left").withColumn("found", F.col("embedding").isNotNull())


def assemble_signals(window: DataFrame, stage: DataFrame, ce: DataFrame, llm: DataFrame, labels: DataFrame) -> DataFrame:
    """Window with all signals; a gap in any raises when the rows are read."""
    key = ["query_id", "product_id"]
    x = window
    for part in (stage, ce, llm, labels):
        x = x.join(part, key, "left")
    need = [c for p in (stage, ce, llm, labels) for c in p.columns if c not in key]
    return x.where(holds(F.forall(F.array(*[F.col(c).isNotNull() for c in need]), lambda v: v), "a signal is missing"))


def selected(groups: dict[str, list[str]], names: list[str]) -> list[str]:
    """Columns of feature groups; an unknown group raises."""
    require(set(names) <= set(groups), f"unknown groups {sorted(set(names) - set(groups))}")
    return [c for n in names for c in groups[n]]


def no_leak(columns: list[str], forbidden: set[str]) -> None:
    """Label columns may not be features."""
    require(not forbidden & set(columns), f"leaking columns {sorted(forbidden & set(columns))}")
