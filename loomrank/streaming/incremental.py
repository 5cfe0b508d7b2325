"""Incremental forms of the batch passes (R rows); their result equals the batch pass over the same rows."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.operators.relational import pending

#: State of keys lives in RocksDB on the executors' disks, with changelogs in the checkpoint.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def available_now(source: DataFrame, path: str, checkpoint: str, transform) -> None:
    """One pass over what is there now, exactly once across restarts; state is the file list in the checkpoint."""
    transform(source).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def keyed_batches(source: DataFrame, path: str, checkpoint: str, key: str, work) -> None:
    """Each non-null key is worked on once, in the batch that brings it first, and its result appended.

    Which keys are done is keyed state in the checkpoint, so a batch looks up its own keys only and
    neither reads the sink nor lists it. A batch replaces the folder of its checkpoint and number
    (`seen` in the sink), so one that is repeated after a crash leaves its rows once. A new checkpoint over a
    sink that is there looks at it in its first batch only, for the keys that others have done.
    """
    spark, mine = source.sparkSession, hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def one(batch: DataFrame, number: int) -> None:
        todo = batch
        if number == 0:
            todo = pending(batch, _done_by_others(batch, path, key, mine), key)
        work(todo).write.mode("overwrite").parquet(f"{path}/seen={mine}-{number}")

    old = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        todo = source.select(key).where(F.col(key).isNotNull()).dropDuplicates([key])
        todo.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _done_by_others(batch: DataFrame, path: str, key: str, mine: str) -> DataFrame:
    try:
        return batch.sparkSession.read.parquet(path).where(~F.col("seen").startswith(mine)).select(key)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return batch.sparkSession.createDataFrame([], batch.select(key).schema)
