"""Sinks (K rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.functions.checks import holds
from loomrank.operators.guards import disjoint, unique
from loomrank.operators.ranking import rank_by


def parquet(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Zstd Parquet; Spark's committer leaves nothing of a failed job."""
    frame.write.mode(mode).option("compression", "zstd").parquet(path)


def trec_lines(run: DataFrame, tag: str, score: str = "score") -> DataFrame:
    """K4, W11: "qid Q0 doc rank score tag", ranked by score, ties by id, with the whole number's digits."""
    x = run.withColumn("rank", rank_by(score))
    return x.select("query_id", "rank", F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("Q0"), "product_id", F.col("rank").cast("string"), F.col(score).cast("string"), F.lit(tag)).alias("value"))


def qrel_lines(qrels: DataFrame) -> DataFrame:
    """K5: "qid 0 doc relevance"."""
    return qrels.select("query_id", "product_id", F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("0"), "product_id", F.col("qrel").cast("string")).alias("value"))


def trec(lines: DataFrame, path: str, order: str = "rank") -> None:
    lines.orderBy("query_id", order).select("value").write.text(path)


def frozen_folds(folds: DataFrame, path: str) -> str:
    """K3: one CSV file in order of query_id, the same bytes each time, and beside it a sidecar with their SHA-256, which is returned."""
    from .readers import digest

    spark = folds.sparkSession
    folds.select("query_id", "fold").orderBy("query_id").coalesce(1).write.csv(path, header=True)
    told = digest(spark, f"{path}/*.csv")
    spark.createDataFrame([(f"{told}  {path.rstrip('/').rsplit('/', 1)[-1]}",)], "value string").coalesce(1).write.text(f"{path.rstrip('/')}.sha256")
    return told


def model_record(spark: SparkSession, path: str, model: str, max_tokens: int) -> None:
    """The encoder and token budget that a store is written with."""
    spark.createDataFrame([(model, max_tokens)], "model string, max_tokens int").coalesce(1).write.mode("overwrite").json(f"{path}/model_record")


def append_vectors(new: DataFrame, path: str, stored: DataFrame | None, width: int) -> None:
    """K7: appends (key, embedding); wrong widths, keys that stand twice or are stored already, and line breaks in keys raise, and leave nothing of the new rows."""
    fine = (F.size("embedding") == width) & F.col("key").isNotNull() & ~F.col("key").cast("string").contains("\n")
    new = unique(new, "key").where(holds(F.coalesce(fine, F.lit(False)), "a vector of another width or a key that can't be stored"))
    if stored is not None:
        disjoint(new, stored, "key")
    new.write.mode("append").parquet(path)


def bm25_index(postings: DataFrame, stats: DataFrame, documents: DataFrame, path: str) -> None:
    """K8: postings by term, so that a query's terms prune files, statistics, and the ids of all documents (the first column), those without terms included."""
    postings.repartition("term").sortWithinPartitions("term").write.option("compression", "zstd").parquet(f"{path}/postings")
    stats.write.parquet(f"{path}/stats")
    documents.select(F.col(documents.columns[0]).alias("doc")).write.parquet(f"{path}/documents")


def cache(entries: DataFrame, path: str) -> None:
    """Appends answers; each batch commits as a whole."""
    entries.write.mode("append").json(path)


def report(frame: DataFrame, path: str) -> None:
    """K6: rows as JSON documents."""
    frame.write.json(path)


def markdown_rows(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a Markdown table."""
    return frame.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |")).alias("line"))
