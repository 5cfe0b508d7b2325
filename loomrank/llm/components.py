"""Connected components by label propagation with pointer jumping, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merged, release, written


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): root is the smallest vertex reachable.

    Each round takes the least label among neighbours and then the label of that label, so rounds
    grow with the logarithm of the longest path. Labels are cut off in the shared folder each
    round. A vertex with very many links is only ever met by joins whose partitions Spark can
    split, and by minima that are taken before the shuffle.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(merged(labels.withColumnRenamed("v", "b")), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        hooked = written(labels.join(merged(near), "v").select("v", "root", F.least("root", "near").alias("to")))
        jump = hooked.select(F.col("v").alias("to"), F.col("to").alias("further"))
        moved = written(hooked.join(merged(jump), "to").select("v", F.least("to", "further").alias("root"), (F.least("to", "further") != F.col("root")).alias("moved")))
        release(hooked)
        done = moved.where("moved").isEmpty()
        release(labels)
        labels = moved
        if done:
            release(both)
            out = labels.select("v", "root")
            out._scratch = labels._scratch  # for release()
            return out
