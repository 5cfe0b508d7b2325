"""Judgements, products, enrichment and signals derived from the star-schema tables, as DataFrames and as the same CTEs for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.operators.ranking import rank_by, top_window
from loomrank.operators.relational import enrich, label_columns, with_fold
from loomrank.session import stored, table

METALS = ("ring", "widget", "bolt", "small red", "blue gear")


#: Lines that a task groups and sorts, several hundred bytes each in memory.
TASK_ROWS = 1 << 19


def tasks(spark: SparkSession, d: str) -> int:
    """To how many tasks lines are dealt: TASK_ROWS to each, whatever the input's size, and a task a core at least.

    Left to their compressed bytes, adaptive execution puts millions of them into one task, whose sorts outgrow its memory and spill.
    """
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, d, "lineitem").count() // TASK_ROWS))


def judgements(spark: SparkSession, d: str) -> DataFrame:
    """One row a (customer, part): label from the flags of its lines, scores from price, quantity and ship date.

    What a line tells is computed before it travels, and lines are dealt by customer, so the grouping and every window by query
    that follows need no shuffle of their own.
    """
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("query_id"))
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    code = F.when((flag == "A") & (status == "F"), 3).when(flag == "R", 2).when((flag == "N") & (status == "F"), 1).otherwise(0)
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", code.cast("byte").alias("c"), F.col("l_extendedprice").alias("price"), (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("net"), "l_shipdate")
    x = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).drop("l_orderkey", "o_orderkey").repartition(tasks(spark, d), "query_id").groupBy("query_id", "l_partkey").agg(
        F.max("c").cast("int").alias("c"), F.max("price").alias("stage2_score"), F.max("net").alias("ce_score"), F.min("l_shipdate").alias("day"))
    x = x.withColumn("product_id", F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).select("query_id", "product_id", "c", "stage2_score", "ce_score", "day")
    x = x.withColumn("label", F.element_at(F.array(*[F.lit(v) for v in "ICSE"]), F.col("c") + 1)).drop("c")
    words = F.element_at(F.array(*[F.lit(w) for w in METALS]), (F.col("query_id") % len(METALS) + 1).cast("int"))
    return label_columns(x).withColumn("query", F.concat(words, F.lit(" brand "), (F.col("query_id") % 10).cast("string")))


def signals(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """The top-k window of each query with the rank of a listwise answer."""
    w = top_window(judgements(spark, d), k).where("in_window")
    return w.withColumn("llm_rank", F.row_number().over(_by_day()))


def _by_day():
    from pyspark.sql import Window as W

    return W.partitionBy("query_id").orderBy("day", "product_id")


def products(spark: SparkSession, d: str) -> DataFrame:
    """Product text; every seventh brand, fifth color and third description is missing."""
    p = table(spark, d, "part")
    gap = lambda n, c: F.when(F.col("p_partkey") % n != 0, c)
    return p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("product_id"), F.col("p_name").alias("product_title"),
                    gap(3, F.concat_ws(" ", F.lit("A"), F.lower("p_type"), "p_name")).alias("product_description"), F.concat_ws(", ", "p_type", "p_brand").alias("product_bullet_point"),
                    gap(7, F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("product_brand"), gap(5, F.split("p_name", " ")[0]).alias("product_color"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Enrichment of nine parts in ten."""
    p = table(spark, d, "part").where("p_partkey % 10 <> 9")
    gap = lambda n, c: F.when(F.col("p_partkey") % n != 0, c)
    return p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("asin"), F.lower("p_type").alias("template"), gap(4, F.concat(F.lit("About "), F.col("p_name"))).alias("description"),
                    F.when(F.col("p_partkey") % 6 != 0, F.array("p_type", F.lower("p_name"))).otherwise(F.array().cast("array<string>")).alias("category"),
                    gap(8, F.concat(F.lit('{"Size":"'), F.col("p_size").cast("string"), F.lit('","Brand":"'), F.col("p_brand"), F.lit('"}'))).alias("attrs_json"),
                    F.when(F.col("p_partkey") % 11 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"kind":"'), F.col("p_type"), F.lit('"}'))).alias("info_json"),
                    gap(4, F.col("p_size") / 10.0).cast("double").alias("stars"), gap(3, F.col("p_size").cast("double")).alias("ratings"), F.col("p_retailprice").alias("price"),
                    gap(2, F.col("p_partkey") % 3 == 0).alias("price_multi"), gap(5, F.col("p_partkey").cast("double")).alias("bsr_rank"), (F.col("p_size") % 4).cast("double").alias("n_reviews"),
                    gap(9, F.concat(F.lit("https://x/images/W/abc/images/I/"), F.col("p_partkey").cast("string"), F.lit(".jpg"))).alias("image_url"))


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return enrich(products(spark, d), corpus(spark, d))


def folded(spark: SparkSession, d: str) -> DataFrame:
    return with_fold(judgements(spark, d))


def arms(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, arm, ndcg) of the window under its three orderings, in one pass over the judgements; stored, as most callers read it more than once."""
    from loomrank.operators.metrics import ndcg_per_arm

    s = signals(spark, d).withColumn("llm_score", -F.col("llm_rank").cast("double"))
    return stored(ndcg_per_arm(s, {"stage2": "stage2_score", "ce": "ce_score", "llm": "llm_score"}))


def windows(spark: SparkSession, d: str) -> DataFrame:
    """signals() as rankers train on them, with their folds, stored once: each round, fold and score reads these rows, and neither the lines behind them nor their hash again."""
    return stored(with_fold(signals(spark, d)).select("query_id", "product_id", "stage2_score", "stage2_rank", "ce_score", "llm_rank", "label", "label_code", "gain", "fold"))


def ranked(frame: DataFrame, score: str, name: str = "rank") -> DataFrame:
    return frame.withColumn(name, rank_by(score))


J = """j0 AS (SELECT o_custkey AS query_id, 'P' || l_partkey AS product_id,
    max(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 3 WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 1 ELSE 0 END) AS label_code,
    max(l_extendedprice) AS stage2_score, max(l_quantity * (1 - l_discount)) AS ce_score, min(l_shipdate) AS day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
j AS (SELECT *, ['I', 'C', 'S', 'E'][label_code + 1] AS label, [0.0::DOUBLE, 0.01, 0.1, 1.0][label_code + 1] AS gain, [0, 1, 10, 100][label_code + 1] AS qrel,
    ['ring', 'widget', 'bolt', 'small red', 'blue gear'][(query_id % 5 + 1)::INT] || ' brand ' || (query_id % 10) AS query FROM j0)"""
S = J + """,
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage2_score DESC, product_id) AS stage2_rank FROM j),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY day, product_id) AS llm_rank FROM w WHERE stage2_rank <= 10)"""
P = """p AS (SELECT 'P' || p_partkey AS product_id, p_name AS product_title, CASE WHEN p_partkey % 3 <> 0 THEN 'A ' || lower(p_type) || ' ' || p_name END AS product_description,
    p_type || ', ' || p_brand AS product_bullet_point, CASE WHEN p_partkey % 7 <> 0 THEN replace(p_brand, '#', ' ') END AS product_brand, CASE WHEN p_partkey % 5 <> 0 THEN split_part(p_name, ' ', 1) END AS product_color FROM part),
c AS (SELECT 'P' || p_partkey AS asin, lower(p_type) AS s_template, CASE WHEN p_partkey % 4 <> 0 THEN 'About ' || p_name END AS s_description,
    CASE WHEN p_partkey % 6 <> 0 THEN [p_type, lower(p_name)] ELSE [] END AS s_category,
    CASE WHEN p_partkey % 8 <> 0 THEN '{"Size":"' || p_size || '","Brand":"' || p_brand || '"}' END AS s_attrs_json, CASE WHEN p_partkey % 11 = 0 THEN '{broken' ELSE '{"kind":"' || p_type || '"}' END AS s_info_json,
    CASE WHEN p_partkey % 4 <> 0 THEN p_size / 10.0::DOUBLE END AS s_stars, CASE WHEN p_partkey % 3 <> 0 THEN p_size::DOUBLE END AS s_ratings, p_retailprice AS s_price,
    CASE WHEN p_partkey % 2 <> 0 THEN p_partkey % 3 = 0 END AS s_price_multi, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey::DOUBLE END AS s_bsr_rank, (p_size % 4)::DOUBLE AS s_n_reviews,
    CASE WHEN p_partkey % 9 <> 0 THEN 'https://x/images/W/abc/images/I/' || p_partkey || '.jpg' END AS s_image_url FROM part WHERE p_partkey % 10 <> 9),
e AS (SELECT p.*, c.* EXCLUDE (asin), asin IS NOT NULL AS has_enrichment,
    CASE WHEN length(product_description) > 0 THEN product_description WHEN length(s_description) > 0 THEN s_description END AS description,
    CASE WHEN length(product_description) > 0 THEN 'own' WHEN length(s_description) > 0 THEN 'scrape' ELSE 'none' END AS description_source FROM p LEFT JOIN c ON product_id = asin)"""


def ndcg_sql(source: str, score: str, name: str, where: str = "") -> str:
    """CTEs `name`_r and `name` (query_id, dcg, idcg, n_docs, ndcg)."""
    return f"""{name}_r AS (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC NULLS LAST, product_id) AS r, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS i FROM {source} {where}),
{name} AS (SELECT query_id, dcg, idcg, n_docs, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg FROM
  (SELECT query_id, sum(gain / log2(r + 1)) AS dcg, sum(gain / log2(i + 1)) AS idcg, count(*) AS n_docs FROM {name}_r GROUP BY query_id))"""


ARMS = S + ",\n" + ndcg_sql("s", "stage2_score", "n1") + ",\n" + ndcg_sql("s", "ce_score", "n2") + ",\n" + ndcg_sql("(SELECT *, -llm_rank::DOUBLE AS llm_score FROM s)", "llm_score", "n3") + """,
arms AS (SELECT query_id, 'stage2' AS arm, ndcg FROM n1 UNION ALL SELECT query_id, 'ce', ndcg FROM n2 UNION ALL SELECT query_id, 'llm', ndcg FROM n3)"""
