"""Lineage cuts and size-checked broadcasts shared by the operators."""

from __future__ import annotations

import gc
import time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.functions.kept import BATCH_BYTES, bounded, cut, ensure_checkpoint_dir  # noqa: F401

#: Rows of at most a few bytes each that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


def cut_by(df: DataFrame, partitions: int, column: str) -> DataFrame:
    """``cut`` of ``df`` in partitions by the hash of a column, which Spark knows of later, so that groups and joins by it don't shuffle the
    rows again. (A plan that adapts itself would forget; the session's setting is put back.)"""
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(partitions, column))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffles(spark: SparkSession) -> int:
    """How many shuffles the driver knows of; their files are on the executors' disks."""
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def forget(spark: SparkSession, known: int = 0, seconds: float = 10) -> None:
    """Have the driver notice which shuffles it no longer refers to: their files stay until then. It cleans up after its garbage collection in
    its own time, so this waits until it knows of ``known`` shuffles at most, or for some seconds if others are in use."""
    end = time.time() + seconds
    while True:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)  # what is freed may hold on to more
        if shuffles(spark) <= known or time.time() > end:
            return


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; otherwise as it is, for a shuffled join.

    ``df`` must be cheap to count (a checkpointed table of ids)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sampled(docs: DataFrame, chosen: DataFrame, keys: list[str], limit: int) -> pa.Table:
    """(keys, text, and the other columns of ``chosen``) for fitting, in order of ``keys``: of each row of ``chosen`` (keys, a number ``place``
    and others; a bounded number of rows) one text that ``docs`` has for its keys, the shortest, of equally long ones that of least hash.

    Texts are taken in order of ``place`` as long as they have ``limit`` bytes together; a text that doesn't fit is left out whole. First only
    lengths are fetched. Null texts don't count."""
    chosen = F.broadcast(chosen)
    texts = docs.select(*keys, "text").where("text IS NOT NULL")
    size = F.min(F.struct(F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("hash"))).alias("size")
    known = texts.join(chosen.select(*keys, "place"), keys).groupBy(*keys, "place").agg(size).toArrow().sort_by("place")
    fits, left = [], limit
    for i, s in enumerate(known["size"].to_pylist()):
        if s["bytes"] <= left:
            left -= s["bytes"]
            fits.append(i)
    known = known.take(pa.array(fits, pa.int64()))
    hashes = pa.array([s["hash"] for s in known["size"].to_pylist()], pa.int64())
    wanted = F.broadcast(docs.sparkSession.createDataFrame(known.select(keys).append_column("hash", hashes), docs.select(*keys, F.lit(0).cast("bigint").alias("hash")).schema))
    found = texts.withColumn("hash", F.xxhash64("text")).join(wanted, [*keys, "hash"]).dropDuplicates(keys).drop("hash")
    return found.join(chosen.drop("place"), keys).toArrow().sort_by([(k, "ascending") for k in keys])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
