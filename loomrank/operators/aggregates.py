"""Group aggregates of the analysis reports (A rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomrank.functions.checks import checked

P95_LEAST, P99_LEAST, SLO_MS = 100, 1000, 300.0  # fixed values: samples a tail needs, target latency


def value_shares(frame: DataFrame, column: str) -> DataFrame:
    """A2: rows and share of each value. The unpartitioned window is over one row a value."""
    x = frame.groupBy(column).agg(F.count("*").alias("n"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def invariants(judgements: DataFrame) -> DataFrame:
    """A1: rows, distinct queries and products, share of each label."""
    shares = [F.avg(F.when(F.col("label") == x, 1.0).otherwise(0.0)).alias(f"share_{x.lower()}") for x in ("E", "S", "C", "I")]
    return judgements.agg(F.count("*").alias("n_rows"), F.countDistinct("query_id").alias("n_queries"), F.countDistinct("product_id").alias("n_products"), *shares)


def join_coverage(ids: DataFrame, corpus: DataFrame, image: Column) -> DataFrame:
    """A3: requested ids, those in the corpus, those with an image."""
    held = corpus.groupBy("asin").agg(F.max(F.coalesce(image, F.lit(False))).alias("img"))
    x = ids.select("product_id").distinct().join(held, F.col("product_id") == F.col("asin"), "left")
    return x.agg(F.count("*").alias("requested"), F.count("asin").alias("matched"), F.count(F.when(F.col("img"), 1)).alias("with_image")).withColumns({
        "coverage": F.try_divide("matched", "requested"), "image_coverage": F.try_divide("with_image", "requested")})


def presence_bias(judgements: DataFrame, corpus: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Per field its share, the mean gain with and without it, and the shift; a field always or never there is left out."""
    flags = corpus.select("asin", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in fields.items()])
    x = judgements.join(flags, F.col("product_id") == F.col("asin"), "left")
    x = x.select("gain", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(F.col(n), F.lit(False)).alias("there")) for n in fields])).alias("f")).select("gain", "f.*")
    out = x.groupBy("field").agg(F.avg(F.col("there").cast("int")).alias("share"), F.avg(F.when(F.col("there"), F.col("gain"))).alias("gain_present"), F.avg(F.when(~F.col("there"), F.col("gain"))).alias("gain_absent"))
    return out.where("gain_present IS NOT NULL AND gain_absent IS NOT NULL").withColumn("shift", F.col("gain_present") - F.col("gain_absent"))


def smallest_mode(frame: DataFrame, key: str, value: str) -> DataFrame:
    """The commonest value of a group, ties to the smallest; null values don't count."""
    x = frame.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    return x.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("mode"))


def collapse_small(frame: DataFrame, value: str, least: int, other: str = "(other)") -> DataFrame:
    """A10: buckets of at least `least` rows, the rest as one, and their order: largest first, the rest last."""
    x = frame.groupBy(value).agg(F.count("*").alias("n"))
    x = x.groupBy(F.when(F.col("n") >= least, F.col(value)).otherwise(other).alias("bucket")).agg(F.sum("n").alias("n"))
    return x.withColumn("place", F.row_number().over(W.orderBy(F.col("bucket") == other, F.col("n").desc(), "bucket")))


def strata(c: Column, edges: list[float]) -> Column:
    """Index of the half-open stratum, the last one closed; null outside."""
    out, last = None, len(edges) - 2
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        test = (c >= a) & ((c <= b) if i == last else (c < b))
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return out


def stratum_means(frame: DataFrame, edges: list[float], x: str, y: str) -> DataFrame:
    """Mean and count per stratum; an empty one stays with null."""
    dim = frame.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("stratum"))
    got = frame.withColumn("stratum", strata(F.col(x), edges)).groupBy("stratum").agg(F.avg(y).alias("mean"), F.count("*").alias("n"))
    return dim.join(got, "stratum", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def outcome_profile(deltas: DataFrame, attribute: str, tolerance: float = 1e-9) -> DataFrame:
    """Better, worse and same queries, their mean delta and mean attribute."""
    kind = F.when(F.col("delta") > tolerance, "better").when(F.col("delta") < -tolerance, "worse").otherwise("same")
    return deltas.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.avg(attribute).alias("mean_attribute"))


def fit_normaliser(frame: DataFrame, value: str, *key: str) -> DataFrame:
    """Mean and population deviation over finite values, 1 where it is next to 0; none finite raises."""
    v = F.col(value).cast("double")
    v = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)
    x = frame.groupBy(*key).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"))
    return x.withColumns({"mean": checked(F.col("n") > 0, F.col("mean"), "no finite value"), "std": F.when(F.col("std") > 1e-12, F.col("std")).otherwise(1.0)})


def pass_counters(raw: DataFrame, locale: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows seen, dropped by reason, kept, and share of books among the kept, of all rows or of each group."""
    other, error = F.col("locale") != locale, F.col("type") == "error"
    kept = ~other & ~error
    return raw.groupBy(*by).agg(F.count("*").alias("seen"), F.count_if(other).alias("other_locale"), F.count_if(~other & error).alias("errors"), F.count_if(kept).alias("kept"),
                   F.try_divide(F.count_if(kept & (F.col("type") == "book")), F.count_if(kept)).alias("book_share"))


def percentiles(frame: DataFrame, value: str, *key: str) -> DataFrame:
    """Interpolated and nearest-rank percentiles."""
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{value}`)")
    return frame.groupBy(*key).agg(F.percentile(value, F.lit(0.5)).alias("p50_cont"), F.percentile(value, F.lit(0.95)).alias("p95_cont"), disc(0.5).alias("p50_disc"), disc(0.95).alias("p95_disc"))


def latency_profile(samples: DataFrame, value: str, *key: str) -> DataFrame:
    """Count, mean, median, and tails only where there are samples enough."""
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{value}`)")
    x = samples.groupBy(*key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), disc(0.5).alias("p50"), disc(0.95).alias("p95"), disc(0.99).alias("p99"))
    return x.withColumns({"p95": F.when(F.col("n") >= P95_LEAST, F.col("p95")), "p99": F.when(F.col("n") >= P99_LEAST, F.col("p99"))})


def usage_totals(records: DataFrame) -> DataFrame:
    """Calls, tokens, and tokens a call."""
    x = records.agg(F.count("*").alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"))
    return x.withColumns({"prompt_per_call": F.col("prompt") / F.greatest("calls", F.lit(1)), "completion_per_call": F.col("completion") / F.greatest("calls", F.lit(1))})


def selector_features(frame: DataFrame) -> DataFrame:
    """Six features of a query's window; 0 where there is one document or a constant score."""
    many = F.col("n_candidates") > 1
    ordered = F.sort_array(F.collect_list("ce_score"), asc=False)
    varied = lambda a, b: (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    corr = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    x = frame.withColumn("_nce", -F.col("ce_score")).groupBy("query_id").agg(
        F.count("*").alias("n_candidates"), (F.max("ce_score") - F.min("ce_score")).alias("ce_spread"), (F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))).alias("ce_top_margin"),
        (F.max("stage2_score") - F.min("stage2_score")).alias("stage2_score_spread"),
        F.when(varied("stage2_rank", "llm_rank"), corr("stage2_rank", "llm_rank")).alias("agree_stage2_llm"), F.when(varied("ce_score", "llm_rank"), corr("_nce", "llm_rank")).alias("agree_ce_llm"))
    return x.withColumns({c: F.coalesce(F.when(many, F.col(c)), F.lit(0.0)) for c in x.columns[2:]})


def best_arm(arms: DataFrame) -> DataFrame:
    """The arm of the highest NDCG, ties to the smaller name."""
    return arms.agg(F.min_by("arm", F.struct(-F.col("ndcg"), F.col("arm"))).alias("arm"), F.max("ndcg").alias("ndcg"))


def deployed_rung(rungs: DataFrame) -> DataFrame:
    """Of the lossless rungs the one of least p95, or mean where there is no p95."""
    key = F.coalesce("p95", "mean")
    return rungs.where("lossless").agg(F.min_by("rung", F.struct(key, F.col("rung"))).alias("rung"), F.min(key).alias("latency"))


def window_shift(frame: DataFrame, rank_a: str, rank_b: str, k: int) -> DataFrame:
    """Shares of queries with the same top document and the same top-k set under two orderings."""
    a, b = F.col(rank_a), F.col(rank_b)
    per = frame.groupBy("query_id").agg((F.max(F.when(a == 1, F.col("product_id"))) == F.max(F.when(b == 1, F.col("product_id")))).alias("top"), (F.count_if((a <= k) != (b <= k)) == 0).alias("same"))
    return per.agg(F.avg(F.col("top").cast("int")).alias("same_top"), F.avg(F.col("same").cast("int")).alias("same_set"), F.count("*").alias("n_queries"))


def routes(chosen: DataFrame, per_arm: DataFrame, default: str) -> DataFrame:
    """Share of queries routed to each arm, and how these do against the default arm."""
    x = chosen.join(per_arm, ["query_id", "arm"]).join(per_arm.where(F.col("arm") == default).select("query_id", F.col("ndcg").alias("base")), "query_id")
    n = F.sum("n").over(W.partitionBy())
    d = F.col("ndcg") - F.col("base")
    out = x.groupBy("arm").agg(F.count("*").alias("n"), F.count_if(d > 1e-9).alias("better"), F.count_if(d < -1e-9).alias("worse"))
    return out.withColumn("share", F.col("n") / n)


def non_null_shares(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows with a value, per column, in one pass."""
    x = frame.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in columns])
    return x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("share")) for c in columns])).alias("s")).select("s.*")


def listwise(frame: DataFrame, order: str = "stage2_rank") -> DataFrame:
    """Documents and labels of each query as lists in order."""
    x = frame.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(order, "product_id", "label"))).alias("d"))
    return x.select("query_id", F.col("d.product_id").alias("docs"), F.col("d.label").alias("labels"))


def vocabulary(frame: DataFrame, column: str) -> DataFrame:
    """Distinct values in order with their codes, over the whole table."""
    return frame.select(column).where(F.col(column).isNotNull()).distinct().withColumn("code", F.row_number().over(W.orderBy(column)) - 1)


def truncation_share(frame: DataFrame, length: Column, budget: int) -> DataFrame:
    """Share of rows longer than a budget."""
    return frame.agg(F.avg(F.when(length > budget, 1.0).otherwise(0.0)).alias("truncated"))


def rate_results(calls: DataFrame) -> DataFrame:
    """Per offered rate the achieved rate, share of errors, and p95 of successes from their scheduled time."""
    x = calls.groupBy("rate").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.max("seconds").alias("seconds"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN ok THEN finish_ms - scheduled_ms END)").alias("p95"))
    return x.select("rate", "n", F.try_divide("n_ok", "seconds").alias("achieved"), F.coalesce(F.try_divide(F.col("n") - F.col("n_ok"), F.col("n")), F.lit(0.0)).alias("errors"), "p95")


def max_rate_under(results: DataFrame, slo: float = SLO_MS, errors: float = 0.01) -> DataFrame:
    """Highest rate whose p95 and errors are within bounds."""
    return results.agg(F.max(F.when((F.col("p95") <= slo) & (F.col("errors") <= errors), F.col("rate"))).alias("max_rate"))
