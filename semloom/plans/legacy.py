"""Taking over a model kept as a numpy matrix and a JSON file of its vocabulary."""

from __future__ import annotations

import json
import os
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa

from semloom.operators.training import Model, Settings

if TYPE_CHECKING:
    from semloom.plans.engine import Engine


def read_model(engine: Engine, vocabulary_file: str, matrix_file: str) -> Model:
    """The model of such files: row i of the matrix is the i-th word's vector; counts may cover more words than those."""
    with open(vocabulary_file, encoding="utf-8") as f:
        kept = json.load(f)
    matrix = np.load(matrix_file).astype(np.float32)
    words, counts = kept["vocab"], kept.get("counts", {})
    if matrix.shape != (len(words), kept["dim"]):
        raise ValueError(f"{len(words)} words of dimension {kept['dim']} don't fit a matrix of {matrix.shape}")
    number = {w: i for i, w in enumerate(words)}
    every = [*words, *(w for w in counts if w not in number)]
    vocabulary = pa.table({"word": every, "count": [counts.get(w, 0) for w in every], "idx": pa.array([number.get(w) for w in every], pa.int64())})
    vectors = pa.table({"word": words, "memory": pa.array(list(matrix), pa.list_(pa.float32()))})
    settings = Settings(kept["dim"], kept["window"], kept.get("min_count", 2))
    seen = int(kept.get("consumed_sentences") or 0)
    make = engine.spark.createDataFrame
    return Model(make(vocabulary, "word string, count bigint, idx bigint"), make(vectors, "word string, memory array<float>"), settings, lambda: seen)


def take_over(engine: Engine, vocabulary_file: str, matrix_file: str, last_seen_id: int = 0) -> bool:
    """Store such a model, once: not if the engine's store has one already."""
    if engine.store.read("vocabulary") is not None:
        return False
    engine._commit_model(read_model(engine, vocabulary_file, matrix_file), last_seen_id)
    return True


#: Files that an earlier kind of store kept beside its database: the model's words, the rows of encoded facts, and the last message seen.
VOCABULARY, FACTS, UPDATED, MATRIX, ENCODED = "vocabulary.json", "fact_ids.json", "last_update.json", "memory.npy", "fact_vectors.npy"


def fold_in(engine: Engine, folder: str) -> bool:
    """Take over all that such a folder has, when the engine is opened: the model, the mark of the last message, the encoded facts' vectors.

    Only into a store that has neither a model nor settings. The JSON files are removed afterwards, so it happens once; the matrices
    stay. Vectors of facts are taken if there is one for each id; ids that aren't facts do no harm."""
    at = lambda name: os.path.join(folder, name)
    manifest = engine.store.manifest()
    if not os.path.exists(at(VOCABULARY)) or not os.path.exists(at(MATRIX)) or "vocabulary" in manifest["tables"] or "dim" in manifest["meta"]:
        return False
    known = [n for n in (UPDATED, FACTS) if os.path.exists(at(n))]
    kept = {}
    for n in known:
        with open(at(n), encoding="utf-8") as f:
            kept[n] = json.load(f)
    last = kept.get(UPDATED, 0)
    last = int((last.get("last_seen_id") or 0) if isinstance(last, dict) else last or 0)
    take_over(engine, at(VOCABULARY), at(MATRIX), last)
    if FACTS in kept and os.path.exists(at(ENCODED)):
        matrix = np.load(at(ENCODED)).astype(np.float32)
        ids = kept[FACTS]["ids"] if isinstance(kept[FACTS], dict) else kept[FACTS]
        if len(ids) == len(matrix):
            rows = pa.table({"id": pa.array(ids, pa.int64()), "vector": pa.array(list(matrix), pa.list_(pa.float32()))})
            engine.store.commit({"fact_vectors": engine.spark.createDataFrame(rows, "id bigint, vector array<float>")})
    for n in (VOCABULARY, *known):
        os.remove(at(n))
    return True
