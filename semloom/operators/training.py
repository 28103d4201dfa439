"""Word vectors from co-occurrence, as a table plan.

A word's memory starts as its identity vector and absorbs, sentence by sentence, the identity vectors of its neighbours. It never depends
on another word's memory, so the words are independent ordered folds: everything before the fold is joins and windows, and the fold
streams over rows sorted by word and place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semloom.functions.vectors import identities, identity

PLACE = ["source", "doc_seq", "sentence"]
#: Rows whose neighbours are added up at a time.
ROWS = 1 << 13


class Settings(NamedTuple):
    dim: int = 2048
    window: int = 3
    min_count: int = 2


class Model(NamedTuple):
    """vocabulary: (word, count, idx), idx null below the threshold; vectors: (word, memory) of the words with an idx; both are plans."""

    vocabulary: DataFrame
    vectors: DataFrame
    settings: Settings
    counted: Callable[[], int]

    @property
    def sentences(self) -> int:
        """How many the model was trained on; counted when first asked for."""
        return self.counted()


def occurrences(sentences: DataFrame) -> DataFrame:
    """(source, doc_seq, sentence, position, word) of tokenized sentences."""
    return sentences.select(*PLACE, F.posexplode("words").alias("position", "word"))


def thresholds(tokens: DataFrame, min_count: int, prior: DataFrame | None = None) -> DataFrame:
    """(word, total, from_*): how often each word comes, with ``prior`` (word, count), and the sentence from which it counts, null if none.

    That is the sentence of the min_count-th occurrence: all of a sentence's occurrences count at once. The ranking keeps at most
    min_count rows of a word before the shuffle, so frequent words are no hot partitions."""
    by = Window.partitionBy("word").orderBy(*PLACE, "position")
    kth = tokens.withColumn("n", F.row_number().over(by)).where(F.col("n") <= max(1, min_count))
    starts = [F.col(c).alias(f"from_{c}") for c in PLACE]
    counts = tokens.groupBy("word").agg(F.count("*").alias("new"))
    if prior is None:
        reached = kth.where(F.col("n") == max(1, min_count)).select("word", *starts)
        return counts.join(reached, "word", "left").withColumnRenamed("new", "total")
    before = prior.select("word", F.col("count").alias("before"))
    need = F.greatest(F.lit(1), F.lit(min_count) - F.coalesce("before", F.lit(0)))
    reached = kth.join(before, "word", "left").where(F.col("n") == need).select("word", *starts)
    return counts.join(before, "word", "left").join(reached, "word", "left").withColumn("total", F.col("new") + F.coalesce("before", F.lit(0))).drop("new", "before")


def eligible(tokens: DataFrame, limits: DataFrame) -> DataFrame:
    """The tokens at or after their word's threshold."""
    here, start = F.struct(*PLACE), F.struct(*[F.col(f"from_{c}").alias(c) for c in PLACE])
    return tokens.join(limits.where("from_sentence IS NOT NULL").select("word", *[f"from_{c}" for c in PLACE]), "word").where(here >= start).select(*PLACE, "position", "word")


def contexts(tokens: DataFrame, window: int) -> DataFrame:
    """Each eligible token with its neighbours up to ``window`` places away, in order: (place, position, word, neighbours).

    Places are counted among the sentence's eligible tokens. One sort by sentence serves both windows."""
    by = Window.partitionBy(*PLACE).orderBy("position")
    before = F.collect_list("word").over(by.rowsBetween(-window, -1))
    after = F.collect_list("word").over(by.rowsBetween(1, window))
    return tokens.withColumn("neighbours", F.concat(before, after))


def cooccurrences(tokens: DataFrame, window: int) -> DataFrame:
    """(word, neighbour, n): how often each word has each neighbour."""
    return contexts(tokens, window).select("word", F.explode("neighbours").alias("neighbour")).groupBy("word", "neighbour").agg(F.count("*").alias("n"))


def indexed(limits: DataFrame, tokens: DataFrame, first: int = 0, buckets: int = 1024) -> DataFrame:
    """(word, idx) of the words of ``limits`` by the place where they first counted, from ``first`` on.

    Ranks are taken within ranges of doc_seq and added up from the ranges' counts, so no task sorts the whole vocabulary."""
    starts = eligible(tokens, limits).groupBy("word").agg(F.min(F.struct(*PLACE, "position")).alias("at")).select("word", "at.*")
    width = starts.agg((F.coalesce(F.max("doc_seq"), F.lit(0)) / buckets + 1).alias("width"))
    placed = starts.crossJoin(F.broadcast(width)).withColumn("range", F.floor(F.col("doc_seq") / F.col("width"))).drop("width")
    counts = placed.groupBy("source", "range").count()
    so_far = Window.orderBy("source", "range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("count").over(so_far), F.lit(0))).drop("count")
    by = Window.partitionBy("source", "range").orderBy("doc_seq", "sentence", "position")
    return placed.withColumn("n", F.row_number().over(by)).join(F.broadcast(offsets), ["source", "range"]).select("word", (F.col("n") - 1 + F.col("offset") + first).cast("bigint").alias("idx"))


def _totals(neighbours: pa.ListArray, dim: int) -> np.ndarray:
    """The sum of each row's neighbours' identity vectors, added in their order: one neighbour of every row at a time."""
    size = pc.fill_null(pc.list_value_length(neighbours), 0).to_numpy()
    coded = neighbours.flatten().dictionary_encode()
    known = identities(coded.dictionary.to_pylist(), dim)
    codes, first = coded.indices.to_numpy(), np.cumsum(size) - size
    out = np.zeros((len(size), dim), np.float32)
    for k in range(size.max(initial=0)):
        rows = np.flatnonzero(size > k)
        out[rows] += known[codes[first[rows] + k]]
    return out


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Which rows differ from the one before in any of some columns; the first does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        codes = c.dictionary_encode("encode").indices.to_numpy() if pa.types.is_string(c.type) else pc.fill_null(c, -1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _fold(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, place, memory = None, None, None
        words: list[str] = []
        memories: list[np.ndarray] = []

        def settle():
            square = memory.dot(memory)
            if square > 0:
                np.divide(memory, np.sqrt(square), out=memory)

        def made() -> pa.RecordBatch:
            flat = np.concatenate(memories) if memories else np.zeros(0, np.float32)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * dim), pa.array(flat))
            out = pa.record_batch([pa.array(words, pa.string()), vectors], names=["word", "memory"])
            words.clear()
            memories.clear()
            return out

        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                column = batch.column
                n = batch.num_rows
                totals = _totals(column("neighbours"), dim)
                new_word = _starts([column("word")])
                first = np.flatnonzero(new_word | _starts([column(c) for c in PLACE]))
                is_step = column("neighbours").is_valid().to_numpy(zero_copy_only=False)
                for a, b, fresh in zip(first.tolist(), [*first[1:].tolist(), n], new_word[first].tolist()):
                    if fresh:
                        w = column("word")[a].as_py()
                        if w != word:
                            if word is not None:
                                if place is not None:
                                    settle()
                                words.append(word)
                                memories.append(memory)
                            word, place = w, None
                            prior = column("prior")[a]
                            memory = np.array(prior.values, np.float32) if prior.is_valid else identity(w, dim).copy()
                    if not is_step[a]:
                        continue
                    if a == 0:  # the batch before may have ended within this sentence
                        here = tuple(column(c)[0].as_py() for c in PLACE)
                        if place is not None and here != place:
                            settle()
                    elif place is not None:
                        settle()
                    place = ()
                    for i in range(a, b):
                        memory += totals[i]
                if is_step[n - 1]:
                    place = tuple(column(c)[n - 1].as_py() for c in PLACE)
                if len(words) >= 256:
                    yield made()
        if word is not None:
            if place is not None:
                settle()
            words.append(word)
            memories.append(memory)
        if words:
            yield made()

    return run


def fold(rows: DataFrame, dim: int, prior: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """(word, memory) from ``contexts``; a word of ``prior`` (word, memory) goes on from there and is kept even without rows."""
    columns = ["word", *PLACE, "position", "neighbours"]
    steps = rows.select(*columns, F.lit(None).cast("array<float>").alias("prior"))
    if prior is not None:
        none = {"source": "string", "doc_seq": "bigint", "sentence": "int", "position": "int", "neighbours": "array<string>"}
        steps = steps.unionByName(prior.select("word", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.col("memory").alias("prior")))
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an explicit number: the fold is heavy for its bytes, so partitions aren't to be merged by size
    ordered = steps.repartition(n, "word").sortWithinPartitions("word", *[F.col(c).asc_nulls_first() for c in [*PLACE, "position"]])
    return ordered.mapInArrow(_fold(dim), "word string, memory array<float>")


def train(sentences: DataFrame, settings: Settings = Settings(), prior: Model | None = None) -> Model:
    """Train on tokenized sentences, or go on from ``prior`` with later ones; in parts or at once, the result is the same.

    All counts are kept, also of words below the threshold."""
    tokens = occurrences(sentences)
    old = prior.vocabulary if prior else None
    limits = thresholds(tokens, settings.min_count, old)
    live = eligible(tokens, limits)
    vectors = fold(contexts(live, settings.window), settings.dim, prior.vectors if prior else None)
    if prior is None:
        vocabulary = limits.join(indexed(limits, tokens), "word", "left").select("word", F.col("total").alias("count"), "idx")
        return Model(vocabulary, vectors, settings, cache(sentences.count))
    size = old.where("idx IS NOT NULL").count()
    fresh = limits.join(old.where("idx IS NOT NULL").select("word"), "word", "left_anti")
    numbers = indexed(fresh, tokens, size)
    now = limits.select("word", "total").join(old, "word", "full").join(numbers.withColumnRenamed("idx", "new"), "word", "left")
    vocabulary = now.select("word", F.coalesce("total", "count").alias("count"), F.coalesce("idx", "new").alias("idx"))
    return Model(vocabulary, vectors, settings, cache(lambda: prior.sentences + sentences.count()))


def word_cosine(model: Model, a: str, b: str) -> float:
    """0 if either has no vector."""
    from semloom.functions.vectors import cosine_of

    got = {r["word"]: np.array(r["memory"], np.float32) for r in model.vectors.where(F.col("word").isin(a, b)).collect()}
    return cosine_of(got[a], got[b]) if a in got and b in got else 0.0
