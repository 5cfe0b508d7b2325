"""Scans (S rows). Paths go through Spark's readers only, so any store that Spark reads will do."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrank.functions.checks import holds
from loomrank.functions.nested import json_map, sorted_json
from loomrank.functions.text import first_text, image_url, parse_price, parse_rank, parse_ratings, parse_stars

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in (
    "asin", "locale", "type", "error", "template", "title", "subtitle", "author", "description", "desc", "image", "img", "stars", "ratings", "price", "attrs", "attr", "info")]
    + [T.StructField("bullets", T.ArrayType(T.StringType())), T.StructField("category", T.ArrayType(T.StringType())),
       T.StructField("reviews", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, hint: str = "") -> DataFrame:
    """A Parquet scan, of some columns only if named; a missing path raises with a hint at what writes it."""
    try:
        x = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{path} isn't there{'; ' + hint if hint else ''}") from e
        raise
    return x.select(*columns) if columns else x


def json_lines(spark: SparkSession, path: str, schema: T.StructType = RECORD, partitions: int | None = None) -> DataFrame:
    """JSON objects, one a line, plain or zstd; blank lines are skipped, a line that isn't whole raises when read.

    Spark raises for a truncated frame, which it reads as one partition: repartition spreads the
    parse. A last line cut by truncation can't parse and raises as well.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    lines = lines.repartition(partitions) if partitions else lines
    x = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    whole = F.try_parse_json("value").isNotNull()
    return x.where(holds(whole, F.concat(F.lit("broken line: "), F.substring("value", 1, 80)))).select("r.*")


def normalise(records: DataFrame, with_reviews: bool = False) -> DataFrame:
    """Scrape records, whose products and books spell keys differently, as 20 columns; an error row raises."""
    x = records.where(holds(~F.col("type").eqNullSafe(F.lit("error")), F.concat(F.lit("error row: "), F.coalesce("asin", F.lit("?")))))
    price, rank = parse_price(F.col("price")), parse_rank(json_map(F.col("info"))["Best Sellers Rank"])
    mapping = lambda *c: F.coalesce(*[sorted_json(json_map(F.col(k))) for k in c])
    empty = F.array().cast("array<string>")
    return x.select(
        "asin", "type", *[first_text(F.col(c)).alias(c) for c in ("template", "title", "subtitle", "author")], first_text(F.col("description"), F.col("desc")).alias("description"),
        F.coalesce("bullets", empty).alias("bullets"), image_url(F.col("image"), F.col("img")).alias("image_url"), F.coalesce("category", empty).alias("category"),
        mapping("attrs", "attr").alias("attrs_json"), mapping("info").alias("info_json"), parse_stars(F.col("stars")).alias("stars"), parse_ratings(F.col("ratings")).alias("ratings"),
        price["price"].alias("price"), price["multi"].alias("price_multi"), rank["rank"].alias("bsr_rank"), rank["category"].alias("bsr_category"),
        F.coalesce(F.size("reviews"), F.lit(0)).alias("n_reviews"), (F.when(F.size("reviews") > 0, F.to_json("reviews")) if with_reviews else F.lit(None).cast("string")).alias("reviews_json"))


def corpus(spark: SparkSession, path: str, locale: str) -> DataFrame:
    """The ETL pass: read, keep one locale, drop error rows, normalise."""
    raw = json_lines(spark, path)
    return normalise(raw.where((F.col("locale") == locale) & (F.coalesce("type", F.lit("")) != "error")))


def parse_trec(lines: DataFrame) -> DataFrame:
    """TREC run lines; one without six fields or with a score that is no number raises and shows the line."""
    f = F.split(F.trim(F.col("value")), r"\s+")
    score = F.get(f, F.lit(4)).try_cast("double")
    x = lines.where("trim(value) <> ''").where(holds((F.size(f) == 6) & score.isNotNull(), F.concat(F.lit("not a run line: "), F.col("value"))))
    return x.select(F.get(f, F.lit(0)).alias("query_id"), F.get(f, F.lit(2)).alias("product_id"), score.alias("score"), F.get(f, F.lit(5)).alias("tag"))


def trec_run(spark: SparkSession, path: str) -> DataFrame:
    return parse_trec(spark.read.text(path))


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a small file's bytes, read through Spark; files of more than 64 MB in all raise."""
    files = spark.read.format("binaryFile").load(path)
    if (files.agg(F.sum("length")).first()[0] or 0) > 64 << 20:
        raise ValueError(f"{path} is too large for a digest on the driver")
    rows = files.orderBy("path").select("content").collect()
    return hashlib.sha256(b"".join(bytes(r[0]) for r in rows)).hexdigest()


def check_model_record(spark: SparkSession, path: str, model: str, max_tokens: int | None = None) -> None:
    """The encoder and token budget that wrote a store must be those that read or resume it; a store without a record raises."""
    try:
        told = spark.read.schema("model string, max_tokens int").json(f"{path}/model_record").first()
    except AnalysisException as e:
        raise ValueError(f"{path} has no record of its encoder") from e
    if told["model"] != model:
        raise ValueError(f"{path} was written by {told['model']}, not {model}")
    if max_tokens is not None and told["max_tokens"] != max_tokens:
        raise ValueError(f"{path} was written with {told['max_tokens']} tokens, not {max_tokens}")


def frozen_folds(spark: SparkSession, path: str, expected: str | None = None) -> DataFrame:
    """A CSV of folds whose bytes have the expected SHA-256, by default that of the sidecar beside it."""
    if expected is None:
        expected = spark.read.text(f"{path.rstrip('/')}.sha256").first()[0].split()[0]
        path = f"{path}/*.csv"
    if digest(spark, path) != expected:
        raise ValueError(f"{path} isn't the frozen file")
    return spark.read.schema("query_id long, fold int").csv(path, header=True)


def vectors(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Stored vectors (key, embedding); another width raises when read."""
    x = spark.read.parquet(path)
    return x.where(holds(F.size("embedding") == width, f"vectors aren't {width} wide"))


def bm25_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Postings and statistics; documents and statistics must agree."""
    postings, stats = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats")
    told = spark.read.parquet(f"{path}/documents").count()
    if told != stats.first()["n_docs"] or postings.select("doc").distinct().join(spark.read.parquet(f"{path}/documents"), "doc", "left_anti").limit(1).count():
        raise ValueError("the index has other documents than its statistics")
    return postings, stats


def answer_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached permutations; entries that aren't lists are skipped, an unreadable or missing file is an empty cache."""
    schema = "window_key string, permutation array<int>, model string, prompt_fp string, k int"
    try:
        return spark.read.schema(schema).json(path).where("window_key IS NOT NULL AND permutation IS NOT NULL")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def results(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Committed result documents; a required name that is missing raises."""
    x = spark.read.option("multiLine", True).json(path)
    lost = set(required) - {r[0] for r in x.select("name").distinct().collect()}
    if lost:
        raise ValueError(f"results are missing: {sorted(lost)}")
    return x


def fetched(urls: DataFrame, opener, decode, retries: int = 3, wait=None, least_side: int = 16) -> DataFrame:
    """Fetches (url) by an injected opener() -> get(url) -> (status, bytes); 429 and 5xx are tried again with growing waits.

    Success means decoded, with sides of `least_side` at least: decode(bytes) -> (width, height).
    Failures are rows too. Concurrency is that of the partitions.
    """
    import pandas as pd

    def one(get, url: str) -> tuple[str, int]:
        status = 0
        for attempt in range(retries):
            status, body = get(url)
            if status == 200:
                try:
                    return ("ok" if min(decode(body)) >= least_side else "small"), status
                except ValueError:
                    return "undecodable", status
            if status != 429 and status < 500:
                break
            if wait:
                wait(2**attempt)
        return "failed", status

    def run(batches):
        get = opener()
        for batch in batches:
            got = [one(get, u) for u in batch["url"]]
            yield pd.DataFrame({"url": batch["url"], "outcome": [g[0] for g in got], "status": [g[1] for g in got]})

    return urls.select("url").mapInPandas(run, "url string, outcome string, status int")
