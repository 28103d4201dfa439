import hashlib

import numpy as np
import pyarrow as pa
import pytest

from semloom.functions import vectors as V
from semloom.operators import training
from semloom.plans import acceptance, demo
from semloom.sources import corpus
from pyspark.sql import functions as F


def sequential(sentences, dim, window, min_count):
    """The plain loop."""
    memory, counts, order = {}, {}, []
    for words in sentences:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        live = [w for w in words if counts[w] >= min_count]
        for i, w in enumerate(live):
            if w not in memory:
                memory[w] = V.identity(w, dim).copy()
                order.append(w)
        for i, w in enumerate(live):
            total = np.zeros(dim, np.float32)
            for j in range(max(0, i - window), min(len(live), i + window + 1)):
                if j != i:
                    total += V.identity(live[j], dim)
            memory[w] += total
        for w in set(live):
            n = np.linalg.norm(memory[w])
            if n > 0:
                memory[w] /= n
    return memory, counts, order


def frame(spark, sentences, start=0):
    return spark.createDataFrame([("", start + i, 0, s) for i, s in enumerate(sentences)], "source string, doc_seq bigint, sentence int, words array<string>")


def same(model, memory, counts, order):
    vocabulary = model.vocabulary.collect()
    assert {r["word"]: r["count"] for r in vocabulary} == counts
    assert [r["word"] for r in sorted((r for r in vocabulary if r["idx"] is not None), key=lambda r: r["idx"])] == order
    assert sorted(r["idx"] for r in vocabulary if r["idx"] is not None) == list(range(len(order)))
    got = {r["word"]: np.array(r["memory"], np.float32) for r in model.vectors.collect()}
    assert got.keys() == memory.keys()
    assert max(np.abs(got[w] - memory[w]).max() for w in got) == 0


@pytest.fixture(scope="module")
def sentences():
    rng = np.random.default_rng(4)
    return [[f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(1, 9)) % 40] for _ in range(120)]


@pytest.mark.parametrize("min_count", [1, 2, 4])
def test_equals_the_loop(spark, sentences, min_count):
    model = training.train(frame(spark, sentences), training.Settings(32, 2, min_count))
    same(model, *sequential(sentences, 32, 2, min_count))
    assert model.sentences == len(sentences)


def test_in_parts_equals_at_once(spark, sentences):
    settings = training.Settings(16, 3, 3)
    first = training.train(frame(spark, sentences[:50]), settings)
    second = training.train(frame(spark, sentences[50:], 50), settings, first)
    same(second, *sequential(sentences, 16, 3, 3))


def test_identity_numbers(spark):
    df = spark.createDataFrame([("the",), ("réunion",), ("<NUM>",)], "w string")
    for r in df.select("w", V.identity_numbers_of(F.col("w"), 40).alias("n")).collect():
        assert r["n"] == V.identity_numbers(r["w"], 40).tolist()
        assert abs(np.linalg.norm(V.identity(r["w"], 40)) - 1) < 1e-6


def test_demo_bridge(spark, tmp_path):
    chat, docs_file = demo.write(str(tmp_path))
    model = training.train(corpus.read_corpus(spark, chat, "chat-jsonl"), training.Settings(512, 3, 2))
    model = model._replace(vectors=model.vectors.cache())
    docs = corpus.documents_file(spark, docs_file)
    checks = {"semantic_pairs": [["shown", "dismissal", 0.2]], "noise_pairs": [["shown", "loaf", 0.15]], "probe_tests": [{"query": "shown door", "must_find": 7, "top_k": 1}]}
    assert acceptance.verify(model, docs, checks) == []
    assert acceptance.verify(model, docs, {"semantic_pairs": [["shown", "nowhere", 0.2]]}) != []
    assert acceptance.probe(model, "qqq zzz", docs).count() == 0


def test_digest_of_identity_numbers(spark):
    words = ["the", "réunion", "<NUM>", "0"]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string").select("w", V.identity_digest_of(F.col("w"), 2048).alias("d"))
    want = {w: hashlib.md5(" ".join(map(str, V.identity_numbers(w, 2048).tolist())).encode()).hexdigest() for w in words} | {None: None}
    assert {r["w"]: r["d"] for r in df.collect()} == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "conv(" not in plan  # 2048 conversions of a word in interpreted lambdas took four fifths of the time


def test_totals_are_added_in_order():
    rng = np.random.default_rng(1)
    rows = [[f"w{x}" for x in rng.integers(0, 9, n)] for n in (0, 1, 6, 3, 6)] + [None]
    got = training._totals(pa.array(rows, pa.list_(pa.string())), 16)
    for t, row in zip(got, rows):
        total = np.zeros(16, np.float32)
        for w in row or []:
            total += V.identity(w, 16)
        assert (t == total).all()


def test_the_fold_goes_on_over_batches(spark, sentences):
    memory, _, _ = sequential(sentences, 8, 2, 1)
    rows = training.contexts(training.occurrences(frame(spark, sentences)), 2).withColumn("prior", F.lit(None).cast("array<float>"))
    table = rows.orderBy("word", *training.PLACE, "position").toArrow().combine_chunks()
    for size in (1, 7, 10_000):
        got = pa.Table.from_batches(training._fold(8)(iter(table.to_batches(max_chunksize=size))))
        assert {w: v for w, v in zip(got["word"].to_pylist(), got["memory"].to_pylist())} == {w: v.tolist() for w, v in memory.items()}


def test_identities_made_together():
    words = [f"w{i}" for i in range(300)] + ["réunion", "w3"]
    V._made.clear()
    together = V.identities(words, 40)
    V._made.clear()
    assert (together == np.array([V.identity(w, 40) for w in words])).all() and (V.identities(words, 40) == together).all()
    assert V.identities([], 40).shape == (0, 40)
