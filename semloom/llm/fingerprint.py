"""Homomorphic multiset hash of documents: order-independent, updated by adding and subtracting.

Each paragraph is expanded to LANES 16-bit numbers by an extendable-output hash (SHAKE128); a document's fingerprint is their
sum modulo 2**16 in each lane. Adding or removing a paragraph adds or subtracts its vector, so nothing else is read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_text import to_string
from .storage import bounded

LANES = 1024
_BYTES = 2 * LANES
_STEP = 2048  # paragraphs summed at a time: 4 MB
SCHEMA = "doc_id bigint, n_paragraphs bigint, fingerprint binary, digest string"


def paragraphs(text: str) -> list[str]:
    """Lines without the white space around them; blank ones don't count."""
    return [p for line in text.split("\n") if (p := line.strip())]


def fingerprint(parts: Iterable[str], start: bytes | None = None) -> bytes:
    """The sum of the paragraphs' vectors, added to ``start``."""
    total = np.zeros(LANES, np.uint16) if start is None else np.frombuffer(start, "<u2").copy()
    pending: list[bytes] = []
    for p in parts:
        pending.append(hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(_BYTES))
        if len(pending) == _STEP:
            total += np.frombuffer(b"".join(pending), "<u2").reshape(-1, LANES).sum(0, dtype=np.uint16)
            pending = []
    if pending:
        total += np.frombuffer(b"".join(pending), "<u2").reshape(-1, LANES).sum(0, dtype=np.uint16)
    return total.astype("<u2").tobytes()


def insert(value: bytes, *parts: str) -> bytes:
    return fingerprint(parts, value)


def delete(value: bytes, *parts: str) -> bytes:
    return combine(value, fingerprint(parts), -1)


def combine(a: bytes, b: bytes, sign: int = 1) -> bytes:
    x, y = np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2")
    return (x + y if sign > 0 else x - y).astype("<u2").tobytes()


def digest(value: bytes) -> str:
    return hashlib.blake2b(value, digest_size=16).hexdigest()


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            texts = part.column(1)
            found = [paragraphs(t) for t in to_string(texts).to_pylist()]
            values = [fingerprint(p) if ok else None for p, ok in zip(found, texts.is_valid().to_pylist())]
            yield pa.record_batch(
                [
                    part.column(0).cast(pa.int64()),
                    pa.array([len(p) if v is not None else None for p, v in zip(found, values)], pa.int64()),
                    pa.array(values, pa.binary()),
                    pa.array([v and digest(v) for v in values], pa.string()),
                ],
                names=["doc_id", "n_paragraphs", "fingerprint", "digest"],
            )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, fingerprint, digest) for each row of ``docs`` (doc_id, text), without a shuffle.

    ``fingerprint`` has LANES little-endian 16-bit numbers; ``digest`` is a short hash of it, equal exactly for equal multisets
    of paragraphs. Null text: null in all but doc_id. Empty or blank text: no paragraphs, the zero vector. Repeated rows and a
    null doc_id: a row each, as they stand. An empty table gives no rows. Columns but doc_id and text are not looked at.
    """
    return bounded(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_batches, SCHEMA)


def _added(width: int):
    """Sums of the fingerprints (the last column) of equal keys (the others), of as many keys at a time as ``_STEP``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        schema = None

        def found() -> pa.RecordBatch:
            columns = list(zip(*total)) if width else []
            values = pa.array([v.astype("<u2").tobytes() for v in total.values()], pa.binary())
            return pa.record_batch([*(pa.array(c, schema.field(i).type) for i, c in enumerate(columns)), values], names=schema.names)

        for batch in batches:
            schema = batch.schema
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:width]))) if width else [()] * batch.num_rows
            for key, v in zip(keys, batch.column(width).to_pylist()):
                if key not in total:
                    if len(total) >= _STEP:
                        yield found()
                        total.clear()
                    total[key] = np.zeros(LANES, np.uint16)
                if v is not None:
                    total[key] += np.frombuffer(v, "<u2")
        if total:
            yield found()

    return run


def sum_fingerprints(prints: DataFrame, keys: list[str], column: str = "fingerprint") -> DataFrame:
    """(keys, fingerprint): of each group of rows of ``prints`` by ``keys`` the fingerprint of all their paragraphs, from ``column``.

    Each task adds up what it has of a group before one row of it is shuffled, so no task holds a group's vectors. Keys must be hashable
    (no lists or maps); a null is a key. Null fingerprints add nothing; a group of them gives the zero vector. Repeated rows count as often
    as they come. No rows: none, without ``keys`` too. Other columns are not looked at.
    """
    rows = bounded(prints).select(*keys, F.col(column).alias("fingerprint"))
    parts = rows.mapInArrow(_added(len(keys)), rows.schema)
    parts = parts.repartition(*keys) if keys else parts.repartition(1)
    # a partition has few rows a group, one of each task; its keys come in order, so each is whole before the next
    return parts.sortWithinPartitions(*keys).mapInArrow(_ordered(len(keys)), rows.schema) if keys else parts.mapInArrow(_added(0), rows.schema)


def _ordered(width: int):
    """``_added`` where equal keys follow each other: gives each key once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, schema = None, None, None
        for batch in batches:
            schema = batch.schema
            done: list[tuple] = []
            for k, v in zip(zip(*(c.to_pylist() for c in batch.columns[:width])), batch.column(width).to_pylist()):
                if total is None or k != key:
                    if total is not None:
                        done.append((*key, total.astype("<u2").tobytes()))
                    key, total = k, np.zeros(LANES, np.uint16)
                total += np.frombuffer(v, "<u2")
            if done:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], names=schema.names)
        if total is not None:
            yield pa.record_batch([pa.array([c], f.type) for c, f in zip((*key, total.astype("<u2").tobytes()), schema)], names=schema.names)

    return run
