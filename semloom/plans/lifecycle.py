"""Fingerprints, and what to do with a stored model when an engine opens."""

from __future__ import annotations

import hashlib
import json
from typing import NamedTuple

from semloom.functions.text import WORD_PATTERN

ENCODER_VERSION = "idf-v1"
#: Messages from which a first build starts by itself and source or coverage checks apply.
ENOUGH_MESSAGES = 100
SOURCE = "state_db"
LEAKED_WORDS = 200
LABEL = "Building memory vectors"


def fingerprint(window: int = 3, dim: int = 2048, stemmer=None, regex: str = WORD_PATTERN) -> str:
    """Of what makes a model's words and sums: the word rule, a stemmer, dimension and window; not of how documents are weighted."""
    parts = {"dim": int(dim), "regex": regex, "stemmer": getattr(stemmer, "__name__", str(stemmer)), "window": int(window)}
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:16]


class Verdict(NamedTuple):
    state: str  # cold, damaged, stale, healed or current
    serve: bool
    rebuild: bool
    notice: str | None = None


DAMAGED = "The stored vectors look damaged or incomplete; they are being built again, and until then search is by words only."
REENCODED = "The encoder has changed: fact vectors are being encoded again."


def judge(meta: dict, words: int | None, vectors: int | None, width: int | None, highest: int, dim: int, window: int) -> Verdict:
    """On a stored model: ``words`` and ``vectors`` are row counts, ``width`` the vectors' dimension (None if there are none)."""
    if not words or vectors is None:
        return Verdict("cold", False, False)
    stored, last = int(meta.get("dim") or 0), int(meta.get("last_seen_id") or 0)
    whole = bool(stored) and width == stored == dim and vectors == words
    source = meta.get("corpus_source")
    strange = source is not None and source != SOURCE and highest > ENOUGH_MESSAGES
    stub = bool(last) and highest > ENOUGH_MESSAGES and last < highest * 0.1
    reset = bool(last) and highest > 0 and highest * 10 < last
    if not whole or strange or stub or reset:
        return Verdict("damaged", False, True, DAMAGED)
    same_print = meta.get("tokenizer_fingerprint") == fingerprint(dim=dim, window=window)
    same_inputs = (meta.get("regex"), meta.get("stemmer"), meta.get("dim"), meta.get("window")) == (WORD_PATTERN, None, dim, window)
    if same_print:
        return Verdict("current", True, False)
    return Verdict("healed", True, False) if same_inputs else Verdict("stale", True, True)


def builds_by_itself(verdict: Verdict, highest: int) -> bool:
    """Whether a build starts at opening: a needed one always does, a first one only if the corpus is large enough."""
    return verdict.rebuild or (not verdict.serve and highest > ENOUGH_MESSAGES)


def cache_is_current(meta: dict, facts: int, vectors: int | None, width: int | None, dim: int) -> bool:
    return bool(facts) and vectors == facts and width == dim and meta.get("encoder_version") == ENCODER_VERSION


def progress_bar(done: int, total: int, label: str = LABEL) -> str:
    if total <= 0:
        return ""
    percent = int(min(100, done / total * 100))
    full = percent // 10
    return f"{label}: [{'█' * full:░<10}] {percent}% ({done}/{total})"
