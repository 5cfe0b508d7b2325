"""Scratch tables in the shared folder, and vectorised hashing of words over Arrow text buffers."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; a cluster must name one.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get().rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomrank-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: df written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomrank-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def widened(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of df with more columns, given by DDL type."""
    return T.StructType([*df.schema.fields, *(T.StructField(c, T.DataType.fromDDL(kind)) for c, kind in columns.items())])


def row_key(text: str):
    """Hash of a text that, with its id, names a document; rows equal in both are one document."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def merged(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the corpus: a sorted merge at every size, whose partitions Spark can split where a key is hot, and never a broadcast."""
    return df.hint("merge")


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(df: DataFrame) -> None:
    """Deletes what written() wrote; only for tables that nothing lazy reads any more."""
    spark, path = df.sparkSession, df._scratch
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def pieces(batch: pa.RecordBatch, column: int, most: int = 1 << 20):
    """Cuts a batch into runs of rows with about `most` bytes of text each; a longer text stands alone."""
    at = value_lengths(batch.column(column))
    begin, total = 0, 0
    for i, n in enumerate(at):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def value_lengths(arr: pa.Array) -> np.ndarray:
    return np.diff(text_bytes(arr)[1])


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets; null reads as empty."""
    arr = arr.fill_null("") if arr.null_count else arr
    if pa.types.is_large_string(arr.type):
        kind = np.int64
    elif pa.types.is_string(arr.type) or pa.types.is_binary(arr.type):
        kind = np.int32
    else:
        return text_bytes(arr.cast(pa.string()))
    _, off, data = arr.buffers()
    if len(arr) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(off, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BASE = U64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019))
_LOWER = BYTE.copy()
_LOWER[65:91] = BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse for i < n."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        n_new = max(n, 1 << 16)
        for key, b in (("up", BASE), ("down", _INVERSE)):
            x = np.full(n_new, b, U64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """n + 1 prefix sums of table[byte] * BASE^i modulo 2^64."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * up[: len(data)], dtype=U64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[begin:end], equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    return mix64((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: begin and end byte, 64-bit hash, and n + 1 word offsets of the texts.

    With lower, A to Z hash as a to z.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U64), np.zeros(len(off), np.int64)
    solid = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[off[off <= n]] = True  # a text begins here, or all end
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:n]
    b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return b, e, span_hash(prefix_hash(data, _LOWER if lower else BYTE), b, e), np.searchsorted(b, off)


def shingles(h: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a text, in order, and the texts' n + 1 offsets into them.

    A text of 1 to k - 1 words gives its whole sequence as one; a text without words gives none.
    """
    n = np.diff(woff)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    soff = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    at = np.arange(soff[-1]) - np.repeat(soff[:-1] - woff[:-1], count)
    size = np.repeat(np.minimum(n, k), count)
    x = size.astype(U64) * U64(0xA0761D6478BD642F)
    padded = np.concatenate([h, np.zeros(k, U64)])
    for j in range(k):
        x = x + np.where(size > j, mix64(padded[at + j] + U64((j + 1) * 0xE7037ED1A0B428DB & (1 << 64) - 1)), U64(0))
    return mix64(x), soff
