"""What several operators share: tables, the cluster's shared folder, words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the ASCII white space \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where that is unset, one of our own in local mode, and an error on a cluster, as executors wouldn't see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    sc = spark.sparkContext
    if not base:
        base = sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
            base = tempfile.mkdtemp(prefix="barnacle-")
            sc.setCheckpointDir(base)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders that this driver has written.
_made: list[str] = []


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    _made.append(f"{shared_dir(spark)}/barnacle/{uuid.uuid4().hex}")
    return _made[-1]


def remove(spark: SparkSession, made: str) -> None:
    """Delete one of these folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made.remove(made)


def clear(spark: SparkSession) -> None:
    """Delete the folders of intermediate tables: call it once no result that reads them is needed."""
    while _made:
        remove(spark, _made[-1])


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder, at a new path or the one given, and read again."""
    path = path or fresh_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def least_hashed(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of df with the least hashes of a key of type long, or all if there are fewer: the same rows however df is partitioned.

    Rows that are far beyond the n-th go before the sort, so what tasks send to the driver doesn't grow with their number.
    """
    total, h = df.count(), F.xxhash64(key)
    if total > 2 * n:
        # twice as many as are wanted in expectation, and some more where that is few
        near = df.where(h < F.lit(int(-(2**63) + 2**64 * min(1.0, (2 * n + 100) / total)) if total > 2 * n + 100 else 2**63 - 1))
        df = near if near.count() >= n else df
    return df.orderBy(h, key).limit(n)


def heavy_keys(df: DataFrame, keys: list[str], total: int, most: int = 2000, least: int = 500) -> DataFrame | None:
    """keys and parts of those keys of df that have more than a share 1 / most of total rows, and more than `least`: into how many parts to split
    them. None if there are none.

    Not more than `most` keys can have such a share, so the result may be broadcast whatever the size of df.
    """
    size = max(least, -(-total // most))
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > size)
    found = cut(counts.select(*keys, F.ceil(F.col("n") / size).cast("int").alias("parts")))
    return None if found.isEmpty() else found


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], heavy: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """many joined with one on keys; the rows of a heavy key go to several tasks by a hash of column by, and the row of one to each of them."""
    if heavy is None:
        return many.join(one, keys, how)
    heavy = F.broadcast(heavy)  # bounded, see heavy_keys()
    part = F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("int")
    left = many.join(heavy, keys, "left").withColumn("part_of_key", part).drop("parts")
    right = one.join(heavy, keys, "left").withColumn("part_of_key", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, [*keys, "part_of_key"], how).drop("part_of_key")


def release() -> None:
    """Give the memory that this process has freed back to the system; Arrow and the C library else keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def lean(partition: Callable) -> Callable:
    """partition, a function for mapInArrow, with release() at its end: Spark keeps Python workers for later stages, beside whose joins and sorts
    the memory that a task has freed would count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from partition(batches)
        finally:
            release()

    return run


#: Bytes of a batch that goes to a Python worker after bounded().
SMALL = 2_000_000


def bounded(spark: SparkSession) -> None:
    """Settings of the session that bound what an executor holds outside its heap; results don't depend on them.

    Batches for Python workers have SMALL bytes at most, or one row: the executor holds one several times for each task, and the worker once more, and
    the session's limits are 64 MB and 10,000 rows by default. Parquet's parallel reads go, unless the session has a setting for them, for the threads that make them keep buffers as
    large as the column chunks that they read.
    """
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= SMALL:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SMALL))
    if spark.conf.get("parquet.hadoop.vectored.io.enabled", None) is None:
        spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() takes just the white space that WORD excludes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
