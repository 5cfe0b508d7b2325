"""Mixing sources to target weights by systematic sampling (native: DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 64
OFFSET_BITS = 20


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Adds target to rows (no_source, source, source_size), one row a source.

    Sources by code point, null last, weigh `weights` in turn and share the sum of all sizes; no
    target passes cap times its source's size and the excess goes to the others by weight. With
    sources in order of cap / weight the capped ones are a prefix, so one pass finds the level of
    the rest. The input is one row a source, so the unpartitioned window is over a small table.
    """
    by = W.orderBy("no_source", "source")
    x = sizes.withColumn("seat", F.row_number().over(by))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("seat") - 1) % len(weights) + 1).cast("int"))
    x = x.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * cap)
    order = W.orderBy(F.col("most") / F.col("weight"), "seat")
    x = x.withColumns({
        "total": F.sum("source_size").over(W.partitionBy()),
        "before": F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
        "turn": F.row_number().over(order),
    })
    x = x.withColumn("level", (F.col("total") - F.col("before")).cast("double") / F.col("rest"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("turn", "level"))
    x = x.withColumn("level", F.min(fits).over(W.partitionBy())["level"])
    return x.withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))).select("no_source", "source", "source_size", "target")


def mix(docs: DataFrame, size: Column, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: str = "mix-1", key: str = "doc_id", source: str = "source", salts: int = SALTS) -> DataFrame:
    """Adds mix_size, mix_source_size, mix_target and mix_copies to every row of docs.

    Within a source, documents stand in order of (bits of size, salt of key, size, key). With r =
    target / source size expected copies each, their prefix sum is r * rank; one offset u drawn
    for the source is added and a document is emitted once for each integer that u + r * rank
    crosses in its step. As similar sizes stand together, the words taken come near the target.
    A document is never taken more than `cap` times. Draws hash the seed, so reruns agree.

    The rank is found without gathering a source in one task: rows are counted by cell (source,
    bits of size, salt), the counts of a source (some thousand rows at most) are prefix-summed,
    and a window numbers rows inside a cell.

    Nulls: a null source is a source of its own, last; a null size counts 0; a null key ranks
    first. A source of size 0 has target 0 and none of its documents is taken. Repeated rows are
    separate documents. An empty table gives an empty one. Other columns pass through; columns
    named mix_* are replaced.
    """
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 4), 16, 10).cast("int")
    cell = ["mix_no_source", "mix_source", "mix_bits", "mix_salt"]
    x = docs.withColumn("mix_size", F.coalesce(size, F.lit(0)).cast("long")).withColumns({
        "mix_no_source": F.col(source).isNull(),
        "mix_source": F.coalesce(F.col(source), F.lit("")),
        "mix_bits": F.length(F.bin("mix_size")),
        "mix_salt": hashed % salts,
    })
    counted = x.groupBy(*cell).agg(F.count("*").alias("mix_n"), F.sum("mix_size").alias("mix_words"))
    per = counted.groupBy(F.col("mix_no_source").alias("no_source"), F.col("mix_source").alias("source")).agg(F.sum("mix_words").alias("source_size"))
    per = targets(per, weights, cap).withColumnsRenamed({"no_source": "mix_no_source", "source": "mix_source", "source_size": "mix_source_size", "target": "mix_target"})
    before = F.coalesce(F.sum("mix_n").over(W.partitionBy("mix_no_source", "mix_source").orderBy("mix_bits", "mix_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = counted.withColumn("mix_before", before).drop("mix_n", "mix_words").join(per, ["mix_no_source", "mix_source"])
    x = x.withColumn("mix_rank", F.row_number().over(W.partitionBy(*cell).orderBy("mix_size", key)))
    x = x.join(cells, cell)
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.when(F.col("mix_no_source"), "null:").otherwise("source:"), F.col("mix_source")))
    u = F.conv(F.substring(draw, 1, OFFSET_BITS // 4), 16, 10).cast("double") / (1 << OFFSET_BITS)
    r = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    rank = (F.col("mix_before") + F.col("mix_rank")).cast("double")
    copies = F.floor(r * rank + u) - F.floor(r * (rank - 1) + u)
    x = x.withColumn("mix_copies", F.least(copies, F.lit(cap)).cast("int"))
    return x.drop("mix_rank", "mix_before", *cell)


def emit(mixed: DataFrame) -> DataFrame:
    """The mixture itself: each row as often as it is taken, without the mix_* columns."""
    names = [c for c in mixed.columns if not c.startswith("mix_")]
    return mixed.where("mix_copies > 0").select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_nth")).drop("mix_nth")


def mix_sql(table: str = "documents", seed: str = "mix-1") -> str:
    """The same taken rows in DuckDB SQL."""
    return f"""
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {table}),
s AS (SELECT no_source, src, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
a AS (SELECT *, row_number() OVER (ORDER BY no_source, src) AS seat FROM s),
b AS (SELECT *, [5, 2, 1][((seat - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS most FROM a),
c AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
        coalesce(sum(most) OVER (ORDER BY most / weight, seat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior,
        (sum(weight) OVER (ORDER BY most / weight, seat ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest,
        row_number() OVER (ORDER BY most / weight, seat) AS turn FROM b),
e AS (SELECT *, (total - prior)::DOUBLE / rest AS lev FROM c),
f AS (SELECT *, first_value(lev) OVER (ORDER BY (lev * weight <= most) DESC, turn) AS level FROM e),
t AS (SELECT no_source, src, source_size, least(most::DOUBLE, level * weight) AS target FROM f),
r AS (SELECT d.*, source_size, target, row_number() OVER (PARTITION BY no_source, src ORDER BY length(bin(size)),
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4))::BIGINT % {SALTS}, size, doc_id)::DOUBLE AS rk,
        CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio,
        ('0x' || substr(md5('{seed}:' || CASE WHEN no_source THEN 'null:' ELSE 'source:' END || src), 1, {OFFSET_BITS // 4}))::BIGINT::DOUBLE / {1 << OFFSET_BITS} AS u
      FROM d JOIN t USING (no_source, src))
SELECT doc_id, size, source_size, target,
       (size * least(floor(ratio * rk + u) - floor(ratio * (rk - 1) + u), 3))::BIGINT AS taken FROM r
"""
