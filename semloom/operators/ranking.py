"""Fusing ranked lists, and trust."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RRF_K = 60
DEFAULT_TRUST, HELPFUL, UNHELPFUL = 0.5, 0.05, -0.10


def fuse(ranked: DataFrame, k: int = RRF_K, by: Iterable[str] = ()) -> DataFrame:
    """(by, id, score, list, rank): reciprocal-rank fusion of (by, list, rank, id), ranks and lists from 0.

    An id gets 1 / (k + rank + 1) for each place it has, also for two in one list. ``list`` and ``rank`` are its first place: ids of
    equal score keep the order in which they came up, the first list first."""
    first = F.min(F.struct("list", "rank")).alias("first")
    fused = ranked.groupBy(*by, "id").agg(F.sum(F.lit(1.0) / (F.col("rank") + k + 1)).alias("score"), first)
    return fused.select(*by, "id", "score", "first.list", "first.rank")


def fused_order() -> list[Column]:
    return [F.desc("score"), F.asc("list"), F.asc("rank")]


def fuse_lists(lists: list[list[int]], k: int = RRF_K) -> list[tuple[int, float]]:
    """``fuse`` of short lists on the driver."""
    score: dict[int, float] = {}
    for one in lists:
        for place, item in enumerate(one, start=k + 1):
            score[item] = score.get(item, 0.0) + 1.0 / place
    return sorted(score.items(), key=lambda x: -x[1])


def with_trust(rows: DataFrame, facts: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with the trust of their facts; 0.5 where there is none."""
    trust = facts.select(F.col("fact_id").alias(key), "trust")
    return rows.join(trust, key, "left").withColumn("trust", F.coalesce("trust", F.lit(DEFAULT_TRUST)))


def rated(trust: Column, feedback: Column) -> Column:
    """Trust after one piece of feedback: "helpful" raises it up to 1, anything else lowers it down to 0."""
    helpful = F.coalesce(feedback == "helpful", F.lit(False))
    return F.when(helpful, F.least(F.lit(1.0), trust + HELPFUL)).otherwise(F.greatest(F.lit(0.0), trust + UNHELPFUL))
