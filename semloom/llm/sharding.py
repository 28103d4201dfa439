"""Fixed-capacity shards of indivisible groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .bins import BalancedTree
from .packing import placed, ranked

SHARD_BYTES = 64 << 20
#: Binary digits of a group's size that count; beyond them it is rounded up, by less than a part in 32,768.
DIGITS = 16


def shard_documents(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, group_id, group_bytes, shard_id) for each row of ``docs`` (doc_id, text).

    A group is all documents of one text: copies must not be split over shards. Its size is the bytes of its texts, exact up to 64 KB
    and rounded up to DIGITS binary digits beyond (so no shard exceeds ``shard_bytes``); group_id is its smallest doc_id. Groups are packed
    best-fit decreasing over the whole table, the tightest shard found in a balanced tree of remaining capacities; the driver sees only the
    count of groups of each size: at most 2^15 numbers for each doubling of the size.

    A group larger than ``shard_bytes`` gets a shard of its own, numbered after the others. Null texts count as empty, each
    doc_id a group of its own; empty texts are one group. Repeated rows stay together. An empty table gives no rows. Columns but
    doc_id and text are not looked at.
    """
    key = F.when(F.col("text").isNull(), F.concat(F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).otherwise(F.md5("text"))
    rows = storage.cut(storage.bounded(docs).select("doc_id", key.alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes")))
    rounded = F.expr("shiftleft(shiftright(group_bytes + shiftleft(1L, more) - 1, more), more)")
    groups = storage.cut(
        rows.groupBy("key")
        .agg(F.min("doc_id").alias("group_id"), F.sum("bytes").alias("group_bytes"))
        .withColumn("more", F.greatest(F.lit(0), F.length(F.bin("group_bytes")) - DIGITS))
        .withColumn("units", F.when(F.col("group_bytes") > shard_bytes, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(shard_bytes), rounded))).cast("bigint"))
        .drop("more")
    )
    counts = {r["units"]: r["count"] for r in groups.where("units > 0").groupBy("units").count().collect()}
    order = ranked(groups, "units", ["key"])
    shards, n = placed(order.where("units > 0"), "units", counts, shard_bytes, BalancedTree)
    own = order.where("units = 0").select("key", "group_id", "group_bytes", (F.col("rank") + n).alias("shard_id"))
    of = shards.select("key", "group_id", "group_bytes", F.col("bin").alias("shard_id")).unionByName(own)
    return rows.join(of, "key").select("doc_id", "group_id", "group_bytes", "shard_id")
