"""The fact table and its changes: each takes a table and gives the table after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.operators.ranking import DEFAULT_TRUST, rated

SCHEMA = "fact_id bigint, content string, trust double, created_at timestamp, updated_at timestamp"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def documents(facts: DataFrame) -> DataFrame:
    """(id, text) of the facts with content, in order."""
    return facts.where("content IS NOT NULL").select(F.col("fact_id").alias("id"), F.col("content").alias("text")).orderBy("id")


def fact_ids(facts: DataFrame) -> DataFrame:
    return facts.select("fact_id").orderBy("fact_id")


def added(facts: DataFrame, rows: DataFrame, highest: int) -> DataFrame:
    """With ``rows`` (fact_id above ``highest``, content, trust)."""
    if rows.where(F.col("fact_id") <= highest).limit(1).count():
        raise ValueError("ids are never used again")
    now = F.current_timestamp()
    return facts.unionByName(rows.select("fact_id", "content", F.coalesce(F.col("trust").cast("double"), F.lit(DEFAULT_TRUST)).alias("trust"), now.alias("created_at"), now.alias("updated_at")))


def removed(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the facts of ``ids`` (fact_id); unknown ones change nothing."""
    return facts.join(ids.select("fact_id"), "fact_id", "left_anti")


def with_trust_set(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """With the trust of ``changes`` (fact_id, new_trust), one row an id; unknown ids change nothing."""
    joined = facts.join(changes.select("fact_id", "new_trust"), "fact_id", "left")
    hit = F.col("new_trust").isNotNull()
    return joined.withColumn("trust", F.coalesce("new_trust", "trust")).withColumn("updated_at", F.when(hit, F.current_timestamp()).otherwise(F.col("updated_at"))).select(*facts.columns)


def with_feedback(facts: DataFrame, feedback: DataFrame) -> DataFrame:
    """With ``feedback`` (fact_id, at, feedback) applied in the order of ``at``: a fold within each fact, as its bounds make order matter."""
    steps = feedback.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("at", "feedback"))).alias("steps"))
    start = F.coalesce(F.col("trust"), F.lit(DEFAULT_TRUST))
    folded = F.aggregate("steps", start, lambda t, s: rated(t, s["feedback"]))
    changed = facts.join(steps, "fact_id").select("fact_id", folded.alias("new_trust"))
    return with_trust_set(facts, changed)


def first_of_text(facts: DataFrame, text: str) -> int | None:
    """The smallest id of the facts with exactly this content."""
    return facts.where(F.col("content") == text).agg(F.min("fact_id")).collect()[0][0]
