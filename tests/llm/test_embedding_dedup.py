from collections import defaultdict

import numpy as np
import pytest

from semloom.llm import embedding_dedup as ed


def groups(ids, x, threshold):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    parent = {i: i for i in ids}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in zip(*np.nonzero(x @ x.T >= threshold)):
        u, v = root(ids[a]), root(ids[b])
        if u != v:
            parent[max(u, v)] = min(u, v)
    out = defaultdict(list)
    for i in parent:
        out[root(i)].append(i)
    return {tuple(sorted(v)) for v in out.values() if len(v) > 1}


def found(df):
    classes = defaultdict(list)
    for r in df.collect():
        assert r["n_links"] > 0
        classes[r["class_id"]].append(r["vec_id"])
    assert all(k == min(v) and len(set(v)) == len(v) > 1 for k, v in classes.items())
    return {tuple(sorted(v)) for v in classes.values()}


@pytest.mark.parametrize("dim,threshold,block", [(64, 0.9, 8192), (64, 0.8, 50), (20, 0.9, 8192)])
def test_recall_against_all_pairs(spark, monkeypatch, dim, threshold, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(1500, dim))
    for g in range(60):  # groups of 2 to 40, some equal, some just within or outside
        base = x[g]
        for _ in range(rng.integers(1, 40 if g < 6 else 3)):
            noise = rng.normal(size=dim)
            x = np.r_[x, [base + noise * rng.choice([0, 0.1, 0.25, 0.45])]]
    ids = rng.permutation(len(x)).tolist()
    want = groups(ids, x.astype(np.float32).astype(float), threshold)
    got = found(ed.near_duplicate_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x.astype(np.float32))], "vec_id bigint, embedding array<float>"), threshold))
    pairs = lambda g: {(a, b) for v in g for a in v for b in v if a < b}
    assert len(want) > 20 and len(pairs(got) & pairs(want)) >= 0.98 * len(pairs(want)) and not pairs(got) - pairs(want)


def test_looked_up_distances():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 16)).astype(np.float32)
    coarse, books = x[:7], rng.normal(size=(ed.SUBSPACES, 256, 2)).astype(np.float32)
    lists, codes, missed = ed.encode(x, coarse, books)
    assert (lists == ((x[:, None] - coarse[None]) ** 2).sum(2).argmin(1)).all()
    back = coarse[lists] + np.stack([books[m][codes[:, m]] for m in range(ed.SUBSPACES)], 1).reshape(len(x), -1)
    assert np.allclose(missed, np.linalg.norm(x - back, axis=1), atol=1e-3)


@pytest.mark.parametrize("dim,block", [(64, 8192), (64, 40), (20, 8192)])
def test_every_link_counts(spark, monkeypatch, dim, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    rng = np.random.default_rng(dim + block)
    angle = rng.permutation(300) * 2 * np.pi / 300
    circle = np.zeros((300, dim))  # all differences point at borders
    circle[:, 3], circle[:, 11] = np.cos(angle), np.sin(angle)
    x = np.r_[circle, rng.normal(size=(400, dim))]
    x = np.r_[x, x[300:340] + 0.2 * rng.normal(size=(40, dim))].astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosines = unit @ unit.T
    assert (abs(cosines - 0.9) > 1e-9).all()
    want = {i: int(n) for i, n in enumerate((cosines >= 0.9).sum(1) - 1) if n}
    got = ed.near_duplicate_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == want and len(got) == len(want)


def test_links_at_the_threshold(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [9.0, 3.0, 3.0, 1.0]), (3, [-9.0, 3.0, 3.0, 1.001]), (4, [-1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, ed.near_duplicate_vectors(df).collect())) == [(1, 1, 1), (2, 1, 1)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 0.0]), (7, [inf, 1.0, 0.0]), (8, [1.0, None, 0.0]),
        (9, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (10, [0.0, 1.0, 0.0]), (10, [0.0, 1.0, 0.0]), (11, [0.99, 0.05, 0.0]), (12, [-1.0, 0.0, 0.0]),
    ]
    clashing = [r + (0, 0, 0, 0) for r in rows]
    df = spark.createDataFrame(clashing, "vec_id bigint, embedding array<float>, list int, x int, id int, label int")
    assert found(ed.near_duplicate_vectors(df)) == {(1, 2, 11)}
    assert ed.near_duplicate_vectors(df.limit(0)).count() == 0 and ed.near_duplicate_vectors(df.where("vec_id = 3")).count() == 0
    assert ed.near_duplicate_vectors(df.where("vec_id = 10")).count() == 0
