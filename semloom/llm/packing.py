"""Best-fit packing of documents into training sequences of a fixed token capacity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytes_text as bt
from . import storage
from .bins import Run, SegmentTree, best_fit_decreasing
from .unigram import MODEL

CAPACITY = 2048
#: Rows of one size are ranked in this many independent buckets, so that a frequent size is no hot partition.
BUCKETS = 256


def _tokens(path: str):
    """Batches of (doc_id, text) to (doc_id, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            texts = bt.to_string(batch.column(1))
            for i, j, _, _ in bt.steps(texts):
                found = sp.encode(texts.slice(i, j - i).to_pylist(), num_threads=1)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array([len(x) + 1 if x else 0 for x in found], pa.int64())], names=["doc_id", "tokens"])

    return run


def ranked(rows: DataFrame, size: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ``rank``: 0, 1, ... within each value of ``size``, by hash bucket of ``order`` and then ``order``.

    A window over (size, bucket) ranks within the bucket; the buckets' counts, a small table, give what comes before it."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(size).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(size, "bucket").count().select(size, "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(size, "bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return (
        rows.withColumn("within", F.row_number().over(within) - 1)
        .join(starts, [size, "bucket"])
        .withColumn("rank", F.col("within") + F.col("before"))
        .drop("bucket", "within", "before")
    )


def placed(items: DataFrame, size: str, counts: dict[int, int], capacity: int, tree: type) -> tuple[DataFrame, int]:
    """``items`` (with ``size`` and ``rank``) with ``bin`` and ``offset``, and the number of bins.

    Each item finds its run among those of its size by binary search, so a size with many runs costs no more."""
    runs, bins = best_fit_decreasing(counts, capacity, tree)
    table = np.array(runs, np.int64).reshape(-1, len(Run._fields))
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    sent = items.sparkSession.sparkContext.broadcast(table)  # a few runs for each of a bounded number of sizes

    def find(sizes: pa.Array, ranks: pa.Array) -> pa.Array:
        own, rank = (np.asarray(x).astype(np.int64) for x in (sizes, ranks))
        each = np.unique(sent.value[:, 0])
        key = lambda s, r: np.searchsorted(each, s).astype(np.uint64) << np.uint64(44) | r.astype(np.uint64)
        of = sent.value[np.searchsorted(key(sent.value[:, 0], sent.value[:, 1]), key(own, rank), "right") - 1]
        within = rank - of[:, 1]
        return pa.StructArray.from_arrays([pa.array(of[:, 3] + within // of[:, 4]), pa.array(of[:, 5] + within % of[:, 4] * own)], ["bin", "offset"])

    found = items.withColumn("place", F.arrow_udf(find, "bin bigint, offset bigint")(F.col(size), F.col("rank")))
    return found.withColumn("bin", F.col("place.bin")).withColumn("offset", F.col("place.offset")).drop("place", "rank"), bins


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str = MODEL) -> DataFrame:
    """(doc_id, part, n_parts, size, bin_id, bin_offset): where each piece of each document of ``docs`` (doc_id, text) goes.

    A document's size is the number of its tokens, as the SentencePiece model at ``path`` encodes its whole text, and one for the end of
    the document. A larger one than ``capacity`` is cut between tokens into full pieces and a rest, so nothing is lost, no piece spans
    two bins and no bin has more than ``capacity`` tokens. Pieces are packed by best-fit decreasing over the whole table: a segment tree
    over remaining capacities finds the tightest open bin in logarithmic time. Only the count of pieces of each size, at most
    ``capacity`` numbers, reaches the driver.

    Null or empty text: one row of size 0 with null bin_id and bin_offset. Blanks are tokens too. A null doc_id is packed like any
    other. Repeated rows are packed once each. Pieces of one size are interchangeable; they are taken by hash of (doc_id, part). An empty
    table gives no rows. Columns but doc_id and text are not looked at.
    """
    sized = storage.bounded(docs).select("doc_id", "text").mapInArrow(_tokens(path), docs.select("doc_id", F.lit(0).cast("bigint").alias("tokens")).schema)
    parts = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    pieces = storage.cut(
        sized.withColumn("n_parts", parts)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
        .select("doc_id", "part", "n_parts", F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("part").cast("bigint") * capacity).alias("size"))
    )
    counts = {r["size"]: r["count"] for r in pieces.where("size > 0").groupBy("size").count().collect()}
    bins, _ = placed(ranked(pieces.where("size > 0"), "size", ["doc_id", "part"]), "size", counts, capacity, SegmentTree)
    columns = ["doc_id", "part", "n_parts", "size", F.col("bin").alias("bin_id"), F.col("offset").alias("bin_offset")]
    none = F.lit(None).cast("bigint")
    return bins.select(*columns).unionByName(pieces.where("size = 0").withColumn("bin", none).withColumn("offset", none).select(*columns))
