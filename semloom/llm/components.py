"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b: bigint) with the smallest node connected to it, roots included.

    Edges with a null or both ends equal are left out. Steps needed: about the square of the logarithm of the longest path; each
    is two shuffles of the edges, and its result is checkpointed."""
    by = Window.partitionBy("u")
    now = storage.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        large = both.withColumn("m", F.least("u", F.min("v").over(by))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.withColumn("m", F.min("v").over(by))
        star = least.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = storage.cut(star.distinct())
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            break
        now = after
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classed(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` (node, ...) with ``root``, the same for all nodes that ``edges`` connect."""
    return rows.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))


def report(rows: DataFrame, links: DataFrame, name: str, degree: DataFrame | None = None) -> DataFrame:
    """(``name``, class_id, n_links) of ids in classes of two or more, of ``rows`` (``name``, node) and ``links`` (a, b) between nodes.

    All nodes of an id belong together. class_id is the smallest id of a class; n_links counts the links of an id's nodes and the
    other ids that share them. ``degree`` (node, degree) has the numbers of links if ``links`` are only some, which connect the same."""
    each = rows.select(name, "node").distinct()
    nodes = each.groupBy(name).agg(F.min("node").alias("a"), F.max("node").alias("b"))
    several = each.join(nodes.where("a <> b").select(name, "a"), name).where("node <> a").select("a", F.col("node").alias("b"))
    if degree is None:
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    copies = each.groupBy("node").agg((F.count("*") - 1).alias("copies"))
    counted = each.join(copies, "node").join(degree, "node", "left").withColumn("links", F.col("copies") + F.coalesce("degree", F.lit(0)))
    one = storage.cut(classed(counted, links.union(several)).groupBy("root", name).agg(F.sum("links").alias("n_links")))
    classes = one.groupBy("root").agg(F.min(name).alias("class_id"), F.count("*").alias("many")).where("many > 1")
    return one.join(classes, "root").select(name, "class_id", "n_links")
