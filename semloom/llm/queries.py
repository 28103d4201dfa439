"""The queries of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import embedding_dedup, fingerprint, language_id, lm_scoring, near_dedup, packing, quality, sampling, sharding, token_count
from .storage import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": lambda s, d: lm_scoring.score_documents(table(s, d, "documents"), F.col("doc_id") % 20 == 0),
        "op2_language_id": lambda s, d: language_id.identify_languages(table(s, d, "documents")),
        "op3_best_fit_packing": lambda s, d: packing.pack_documents(table(s, d, "documents")),
        "op4_fingerprints": lambda s, d: fingerprint.fingerprint_documents(table(s, d, "documents")),
        "op5_sharding": lambda s, d: sharding.shard_documents(table(s, d, "documents")),
        "op6_quality_classifier": lambda s, d: quality.classify_documents(table(s, d, "documents"), table(s, d, "labels")),
        "op7_sampled_segmentations": lambda s, d: sampling.sample_segmentations(table(s, d, "documents")),
        "op8_minhash_near_dedup": lambda s, d: near_dedup.near_duplicates(table(s, d, "documents")),
        "op9_token_counts": lambda s, d: token_count.count_tokens(table(s, d, "documents")),
        "op10_embedding_near_dedup": lambda s, d: embedding_dedup.near_duplicate_vectors(table(s, d, "embeddings")),
        "pipeline": corpus_pipeline.run,
        # what SQL can say of some of them
        "fingerprint_paragraphs": lambda s, d: fingerprint.fingerprint_documents(table(s, d, "documents")).select("doc_id", "n_paragraphs"),
        "shard_groups": lambda s, d: sharding.shard_documents(table(s, d, "documents")).select("doc_id", "group_id", "group_bytes"),
        "minhash_classes": lambda s, d: near_dedup.near_duplicates(table(s, d, "documents")).select("doc_id", "class_id"),
    }


#: Exact Jaccard similarity of all pairs that share a shingle, and the classes that the links make.
_CLASSES = """WITH RECURSIVE split AS (
    SELECT doc_id, text, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split),
size AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE c >= 0.55 * (x.n + y.n - c)
    UNION SELECT a.doc_id, b.doc_id FROM split a JOIN split b ON a.text = b.text AND a.doc_id < b.doc_id WHERE len(a.w) = 0),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT a AS doc_id, a AS other FROM ways UNION SELECT reached.doc_id, ways.b FROM reached JOIN ways ON reached.other = ways.a)
SELECT doc_id, min(other) AS class_id FROM reached GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "fingerprint_paragraphs": "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS BIGINT) AS n_paragraphs FROM documents",
        "shard_groups": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS group_id, CAST(sum(strlen(text)) OVER (PARTITION BY text) AS BIGINT) AS group_bytes FROM documents",
        "minhash_classes": _CLASSES,
    }
