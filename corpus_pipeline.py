"""From documents to token ids in five stages; part of the subpackage llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.llm import bpe, langid, linededup, minhash, mix
from loomrank.llm.common import merged, release, row_key, written
from loomrank.shipping import ship

#: Documents whose language is less certain go.
LEAST_SCORE = 0.5
#: A line of as many words, as many as a passage has, goes where it repeats alone.
ALONE = 50
#: The struct that carries columns past an operator.
ROW = "loomrank_row"


def _carried(docs: DataFrame, *named: str) -> DataFrame:
    """The named columns, and all others in one struct, so that no operator's own column meets one of the same name."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in named]
    return docs.select(*named, (F.struct(*rest) if rest else F.lit(None)).alias(ROW))


def _restored(df: DataFrame, columns: list[str], *named: str, **new: Column) -> DataFrame:
    """The columns of documents again, with new values for some."""
    return df.select(*[new.get(c, F.col(c) if c in named else F.col(f"{ROW}.`{c}`")).alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without text or letters, and those whose likeliest language has a probability under LEAST_SCORE."""
    ship(spark)
    told = langid.identify(_carried(docs, "text"), langid.train(docs))
    return _restored(told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE)), docs.columns, "text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines and later repeated single lines of ALONE words, and documents that have lost all their words by it; n_chars follows the text."""
    ship(spark)
    got = linededup.dedup_lines(_carried(docs, "doc_id", "text"), counts=True, alone=ALONE)
    got = got.where("n_removed = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return _restored(got, docs.columns, "doc_id", "text", n_chars=F.length("text").cast("long"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, 0.8): that of the smallest (id, hash of text), a null id first.

    Of rows equal in id and text one stays. Documents without words are near copies of nothing.
    """
    ship(spark)
    near = minhash.near_duplicates(docs.select("doc_id", "text"))
    first = near.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("id", "th")).alias("first")).select("first.id", "first.th")
    keep = first.union(near.where("root IS NULL").select("id", "th")).withColumnsRenamed({"id": "loomrank_id", "th": "loomrank_th"})
    mine = _carried(docs, "doc_id", "text").withColumn("loomrank_own_th", row_key("text"))
    kept = mine.join(merged(keep), F.col("doc_id").cast("long").eqNullSafe(F.col("loomrank_id")) & (F.col("loomrank_own_th") == F.col("loomrank_th")), "left_semi")
    return _restored(kept.dropDuplicates(["doc_id", "loomrank_own_th"]), docs.columns, "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the mixture to the sources' weights says."""
    words = mix.word_count(F.col("text")).alias("words")
    rows = docs.select("doc_id", "source", words, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))
    return _restored(mix.emit(mix.mix(rows, F.col("words"))), docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    ship(spark)
    got = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.default_path(), check="round_trips")
    return got.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids", "round_trips")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("minhash_dedup", minhash_dedup), ("mix_sources", mix_sources), ("tokenize", tokenize)]

#: Not expressible in SQL: the classifier and the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
