"""An acceptance gate for a trained model: pairs that must be close, pairs that mustn't, queries that must find a document."""

from __future__ import annotations

from pyspark.sql import DataFrame

from semloom.operators import encoding, training


def probe(model: training.Model, query: str, docs: DataFrame, top_k: int = 10, weights: DataFrame | None = None) -> DataFrame:
    """(id, score, rank) of the ``docs`` (id, text) nearest to the query, without a threshold; nothing for a query of unknown words."""
    weights = encoding.idf(docs) if weights is None else weights
    query_vector = encoding.encode_query(query, model.vectors, weights, model.settings.dim)
    return encoding.nearest(encoding.encode_all(docs, model.vectors, model.settings.dim, weights), query_vector, top_k)


def verify(model: training.Model, docs: DataFrame, checks: dict) -> list[str]:
    """What fails of ``checks``: semantic_pairs [a, b, floor], noise_pairs [a, b, ceiling], probe_tests {query, must_find, top_k}."""
    failed = []
    for a, b, floor in checks.get("semantic_pairs", []):
        if not (got := training.word_cosine(model, a, b)) > floor:
            failed.append(f"{a} ~ {b}: {got:.4f}, not over {floor}")
    for a, b, ceiling in checks.get("noise_pairs", []):
        if not (got := training.word_cosine(model, a, b)) < ceiling:
            failed.append(f"{a} ~ {b}: {got:.4f}, not under {ceiling}")
    for t in checks.get("probe_tests", []):
        if t["must_find"] not in [r["id"] for r in probe(model, t["query"], docs, t.get("top_k", 20)).collect()]:
            failed.append(f"{t['query']!r} doesn't find {t['must_find']}")
    return failed
