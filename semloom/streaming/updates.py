"""Taking in new messages as a stream of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from semloom.plans.engine import Engine
from semloom.sources import corpus


def absorb_batches(engine: Engine, messages: DataFrame, checkpoint: str):
    """Start a streaming query that trains on each micro-batch of ``messages`` (a stream of the messages table) that is there now.

    Training depends on the order of messages, so there is no streaming state: each batch is ordered by id and absorbed as one update, and
    ids at or below the stored mark are left out, which makes a repeated batch harmless. A batch must not hold ids below a former
    batch's highest."""

    def absorb(batch: DataFrame, _: int) -> None:
        last = int(engine.store.get_meta("last_seen_id", 0) or 0)
        highest = corpus.highest_id(batch)
        if highest > last and engine.model() is not None:
            engine.absorb(corpus.split_texts(corpus.session_texts(batch, last, highest)), highest)

    return messages.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_files(spark, path: str, since: float) -> dict[str, float]:
    """The corpus files of a folder changed after ``since``, with when (seconds); the .txt or .jsonl ones before the .md ones."""
    out = {}
    for f in corpus._listed(spark, path, (".txt", ".jsonl", ".md")):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        changed = fs.getFileStatus(at).getModificationTime() / 1000
        if changed > since:
            out[f] = changed
    return out


def absorb_files(engine: Engine, path: str) -> int:
    """Take in the files of a folder that changed since the last time, each in whole; the number of sentences."""
    found = changed_files(engine.spark, path, float(engine.store.get_meta("files_until", 0.0) or 0.0))
    kind = (".jsonl",) if engine.config.format == "chat-jsonl" else (".txt", ".md")
    found = {f: t for f, t in found.items() if f.endswith(kind)}
    if not found or engine.model() is None:
        return 0
    files = corpus._whole(engine.spark, list(found))
    texts = corpus.chat_rows(files) if engine.config.format == "chat-jsonl" else files
    n = engine.absorb(corpus.split_texts(texts), int(engine.store.get_meta("last_seen_id", 0) or 0))
    engine.store.set_meta("files_until", max(found.values()))
    return n
