"""Session defaults shared by tests, bench and the entry module."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .shipping import ship


def build_session(cpus: int = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings every operator is tested under."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loomrank")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """A table of the data folder; Python workers get the package along with the first one."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder; a cluster must name one.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    there = sc._jsc.sc().getCheckpointDir()
    if not told and there.isDefined():
        told = there.get()
    if not told:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomrank-"))
        told = sc._jsc.sc().getCheckpointDir().get()
    return f"{told.rstrip('/')}/loomrank-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage: df written as Parquet in the shared folder and read back."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(frame: DataFrame) -> DataFrame:
    """The rows over as many tasks as there are cores, where their scan has fewer, as that of a small table has; a large one is left as it is."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= cores else frame.repartition(cores)
