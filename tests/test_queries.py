import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from semloom.operators import encoding, lexical, ranking, training
from semloom.plans import queries as plans

from .llm.conftest import prose as common


def prose(rng, n):
    """Frequent words, and as many rare ones."""
    return " ".join([common(rng, n), *(f"rare{rng.randrange(90)}" for _ in range(n))])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d, rng = str(tmp_path_factory.mktemp("tables")), random.Random(4)
    docs = [(i, prose(rng, rng.choice((4, 12, 40, 300))), "s") for i in range(40)] + [(40, "", "s")]
    asked = [(i, prose(rng, n) + more) for i, (n, more) in enumerate([(3, ""), (8, " the the"), (20, " zzz"), (0, "zzz")])]
    made = {
        "documents": (docs, "doc_id bigint, text string, source string"),
        "benchmark": (asked, "item_id bigint, text string"),
        "labels": ([(i, i % 2, i % 3 // 2) for i in range(20)], "doc_id bigint, quality int, toxic int"),
        "conversations": ([(i // 5, i % 5, "user", prose(rng, 12)) for i in range(60)], "conv_id bigint, turn bigint, role string, text string"),
        "embeddings": ([(i + 3, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(60)], "vec_id bigint, embedding array<float>, label int"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d, docs, asked


def bm25(docs, asked):
    """For each item the ids of the best 20 documents, by the formula over plain lists."""
    split = {i: lexical.query_terms(t) for i, t, _ in docs}
    average = sum(map(len, split.values())) / len(split)
    out = {}
    for item, text in asked:
        score = {}
        for term in lexical.query_terms(text):
            n = sum(term in w for w in split.values())
            weight = math.log((len(split) - n + 0.5) / (n + 0.5))
            for i, w in split.items():
                if tf := w.count(term):
                    score[i] = score.get(i, 0) - (weight if weight > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
        out[item] = sorted((round(s, 12), i) for i, s in score.items())[:20]
    return out


def test_bm25_of_many_texts(spark, tables):
    d, docs, asked = tables
    index = plans._index(spark, d)
    got = {}
    for r in lexical.search_any(index, spark.createDataFrame(asked, "item bigint, text string")).orderBy("item", "rank").collect():
        got.setdefault(r["item"], []).append((round(r["score"], 12), r["id"]))
    assert got == {k: v for k, v in bm25(docs, asked).items() if v}
    one = lexical.search(index, " OR ".join(lexical.query_terms(asked[0][1]))).orderBy("rank").collect()
    assert [r["id"] for r in one] == [i for _, i in got[0]]


def test_fused_search_equals_brute_force(spark, tables):
    d, docs, asked = tables
    model = training.train(plans.sentences(spark, d), training.Settings(plans.DIM))
    table = plans.docs(spark, d)
    vectors = {r["id"]: np.array(r["vector"], float) for r in encoding.encode_all(table, model.vectors, plans.DIM).collect()}
    weights, by_words = encoding.idf(table), bm25(docs, asked)
    trust = {r["fact_id"]: r["trust"] for r in plans.facts(spark, d).collect()}
    got = {(r["item"], r["place"]): (r["fact_id"], r["score"]) for r in plans.fused_search(spark, d).collect()}
    for item, text in asked:
        q = encoding.encode_query(text, model.vectors, weights, plans.DIM)
        near = [] if q is None else sorted((-float(v @ q.astype(float)), i) for i, v in vectors.items() if v @ q > 0.01)[:20]
        want = ranking.fuse_lists([[i for _, i in by_words[item]], [i for _, i in near]])[:5]
        mine = [got.pop((item, k)) for k in range(len(want))]
        assert [i for i, _ in mine] == [i for i, _ in want]
        assert [s for _, s in mine] == pytest.approx([s * trust[i] for i, s in want])
    assert not got


def test_every_vector_is_a_query(spark, tables):
    d = tables[0]
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    got = {(r["item"], r["rank"]): (r["id"], r["score"]) for r in plans.queries()["nearest_vectors_of_all"](spark, d).collect()}
    for item, q in x.items():
        want = sorted((-cosine(q, v), i) for i, v in x.items() if cosine(q, v) > 0.01)[:20]
        assert [got.pop((item, k)) for k in range(len(want))] == [(i, pytest.approx(-s, abs=1e-4)) for s, i in want]
    assert not got


def test_search_of_texts_equals_that_of_an_index(spark, tables, monkeypatch):
    d, docs, asked = tables
    copies = [(100 + i, t, s) for i, t, s in docs]  # equal scores: the smaller id first, whatever the task
    table = spark.createDataFrame([(i, t) for i, t, _ in docs + copies], "id bigint, text string").repartition(3)
    texts = spark.createDataFrame(asked, "item bigint, text string")
    got = {}
    for r in lexical.search_texts(table, texts).orderBy("item", "rank").collect():
        got.setdefault(r["item"], []).append((round(r["score"], 12), r["id"]))
    assert got == {k: v for k, v in bm25(docs + copies, asked).items() if v}
    assert lexical.search_texts(table.limit(0), texts).count() == 0 and lexical.search_texts(table, texts.limit(0)).count() == 0
    monkeypatch.setattr(lexical, "SENT", 1)
    assert lexical.search_texts(table, texts).count() == sum(map(len, got.values()))


def test_fused_search_trains_once(spark, tables, monkeypatch):
    folds, fold = [], training.fold
    monkeypatch.setattr(training, "fold", lambda *a: folds.append(spark.sparkContext.accumulator(0)) or fold(*a).where(counting(folds[-1])(F.col("word"))))
    counting = lambda n: F.udf(lambda w: n.add(1) or True, "boolean").asNondeterministic()
    plans.fused_search(spark, tables[0]).collect()
    words = training.train(plans.sentences(spark, tables[0])).vocabulary.where("idx IS NOT NULL").count()
    assert [a.value for a in folds[:1]] == [words]  # it was three times as many
