import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from semloom.llm import bytes_text as bt
from semloom.llm import quality

from .conftest import CLASHING, odd_rows, prose

SF = "/root/testdata/sf0.1"


def test_statistics_of_single_texts():
    name = quality.STATISTICS.index
    x = quality.statistics(pa.array(["Abc abc DEF 12!\nabc", "", "éÉ ##", "a a a b"], pa.large_string()), np.sort(bt.hash_words(["b", "def"])))
    assert x[0, name("log_words")] == pytest.approx(np.log1p(5)) and x[0, name("distinct_words")] == pytest.approx(3 / 5) and x[0, name("top_word")] == pytest.approx(3 / 5)
    assert x[0, name("capital_word")] == pytest.approx(1 / 5) and x[0, name("repeated_word")] == pytest.approx(1 / 5) and x[0, name("words_per_line")] == 2.5
    assert not x[1].any() and x[2, name("symbol")] == pytest.approx(2 / 7) and x[2, name("log_words")] == pytest.approx(np.log1p(1))
    assert x[3, name("repeated_word")] == pytest.approx(0.5) and x[3, name("toxic_words")] == 1 and x[0, name("toxic_words")] == 1


def by_hand(text, lexicon):
    """The statistics of a text in the order of their names, in plain Python. lexicon: words and beginnings."""
    raw = text.encode()
    lines = [x for x in raw.split(b"\n") if x]
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
    low = [w.lower() for w in words]
    n, size = max(1, len(words)), max(1, len(raw))
    share = lambda chars: sum(c in chars for c in raw) / size
    count = Counter(low)
    named = b".,;:!?#$%&*|"
    other = [c for c in range(33, 127) if not chr(c).isalnum() and c not in named]
    hits = sum(w in lexicon or any(w[:k] in lexicon for k in quality.PREFIXES if len(w) > k) for w in low)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / n, share(range(65, 91)), share(range(48, 58)), share(b"\t\r "), share(b"\n"), share(b".,;:"), share(b"!?"), share(b"#$%&*"),
        share(b"|"), share(other), share(range(128, 256)), len(count) / n, max(count.values(), default=0) / n, sum(a == b for a, b in zip(low, low[1:])) / n,
        sum(len(w) > 1 and all(65 <= c <= 90 for c in w) for w in words) / n, sum(c in b"#$%&*" for c in raw) / n, len(words) / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), max(map(len, words), default=0), hits, hits / n,
    ]


def test_statistics_equal_those_by_hand():
    rng = random.Random(6)
    odd = ["A|b #c $5 %&* d!", "\n\n x\n x \n", "AB CD ab 12,34; z. y: w? (q) [r] ~", "naïve déjà VU", "\t\r\n", "idiotic idiots clown", "word " * 40]
    texts = odd + ["".join(rng.choice("ab AB1 .,!?#|\n(é") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    lexicon = ["idiot", "clown", "ab", "a1"]
    got = quality.statistics(pa.array(texts, pa.large_string()), np.sort(bt.hash_words(lexicon)))
    for t, row in zip(texts, got):
        assert dict(zip(quality.STATISTICS, row)) == pytest.approx(dict(zip(quality.STATISTICS, by_hand(t, {x.encode() for x in lexicon})))), t


def test_lexicon_equals_counting():
    rng = random.Random(3)
    texts = [prose(rng, 30) for _ in range(60)]
    toxic = np.array([i % 4 == 0 for i in range(60)]).astype(int)
    texts = [t + " idiotic" + rng.choice(["", "ally", "ness"]) + " clown" * rng.randint(0, 1) if b else t + (" clown" if rng.random() < 0.02 else "") for t, b in zip(texts, toxic)]
    entries = lambda t: [x for w in re.findall(r"[a-z0-9]+", t) for x in [w, *(w[:k] for k in quality.PREFIXES if len(w) > k)]]
    occurs, inside = [Counter(), Counter()], Counter()
    for t, b in zip(texts, toxic):
        occurs[b].update(entries(t))
        if b:
            inside.update(set(entries(t)))
    total = [sum(c.values()) for c in occurs]
    want = {w for w, n in inside.items() if n >= max(quality.LEXICON_MIN, quality.LEXICON_SHARE * toxic.sum()) and occurs[1][w] / total[1] >= quality.LEXICON_RATIO * (occurs[0][w] + 0.5) / total[0]}
    assert "idiot" in want and set(quality.toxic_lexicon(pa.array(texts, pa.large_string()), toxic)) == set(bt.hash_words(sorted(want)))


def test_boosting_equals_a_plain_loop(monkeypatch):
    """Each node's split tried one by one, over the same quantile borders."""
    monkeypatch.setattr(quality, "TREES", 3)
    monkeypatch.setattr(quality, "DEPTH", 2)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(150, 3)), 1)
    y = (x[:, 0] + x[:, 1] ** 2 > 0.7).astype(float)
    feature, threshold, value, bias = quality.boost(x, y)
    raw = np.full(150, np.log(y.mean() / (1 - y.mean())))
    assert bias == pytest.approx(raw[0])
    for t in range(3):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(150, int)
        for w in range(3):
            at = node == w
            part = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.L2)
            best = (0.0, 0, np.inf)
            for f in range(3):
                for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1], method="lower")):
                    left, right = at & (x[:, f] <= c), at & (x[:, f] > c)
                    if min(h[left].sum(), h[right].sum()) >= quality.MIN_HESSIAN and part(left) + part(right) - part(at) > best[0] + 1e-9:
                        best = (part(left) + part(right) - part(at), f, c)
            assert (feature[t, w], threshold[t, w]) == best[1:]
            node[at] = 2 * w + 1 + (x[at, best[1]] > best[2])
        for leaf in range(4):
            m = node == leaf + 3
            assert value[t, leaf] == pytest.approx(quality.RATE * g[m].sum() / (h[m].sum() + quality.L2))
            raw[m] += value[t, leaf]


def test_the_sample_is_of_labels_that_have_a_document(spark, odd):
    many = spark.range(1000, 9000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").union(spark.createDataFrame([(1, 1, 0), (7, 0, 1), (10, 1, 0)], "doc_id bigint, quality int, toxic int"))
    assert quality.fit(odd, many, 100) is not None


def test_steps_do_not_matter():
    rng = random.Random(0)
    texts = pa.array([prose(rng, rng.randint(0, 300)) for _ in range(60)], pa.large_string())
    one = quality.statistics(texts, np.zeros(0, np.uint64))
    each = np.concatenate([quality.statistics(texts.slice(i, 1), np.zeros(0, np.uint64)) for i in range(60)])
    assert np.allclose(one, each)


def test_trees_step_as_nodes():
    """Vectorised traversal against walking each tree."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < 0)).astype(float)
    parts = quality.boost(x, y)
    model = quality.Model(*(np.stack([np.asarray(v)] * 2) for v in parts), np.zeros(0, np.uint64))
    p = quality.traverse(model, 1, x)
    for i in range(0, 400, 37):
        raw = parts[3]
        for f, t, v in zip(*parts[:3]):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (x[i, f[node]] > t[node])
            raw += v[node - len(f)]
        assert p[i] == pytest.approx(1 / (1 + np.exp(-raw)))
    assert ((p > 0.5) == y).mean() > 0.95


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_held_out_accuracy():
    """Fitted on half of some 4000 labelled rows. (On half of the 399 of sf0.01, 4 of 29 poor documents are kept.)"""
    docs = pq.read_table(f"{SF}/documents.parquet")
    labels = pq.read_table(f"{SF}/labels.parquet").to_pandas()
    row = {d: i for i, d in enumerate(docs["doc_id"].to_pylist())}
    texts = bt.to_string(docs["text"]).take(pa.array([row[d] for d in labels.doc_id]))
    even = np.arange(len(labels)) % 2 == 0
    model = quality.fit_texts(texts.take(pa.array(np.flatnonzero(even))), labels.quality.values[even], labels.toxic.values[even])
    got = quality.score(texts.take(pa.array(np.flatnonzero(~even))), model)
    good = np.asarray(got.field(0)) >= 0.5
    assert (good == labels.quality.values[~even]).mean() > 0.95
    keep, clean = np.asarray(got.field(2)), ((labels.quality == 1) & (labels.toxic == 0)).values[~even]
    assert keep[clean].mean() > 0.97 and keep[(labels.quality == 0).values[~even]].mean() < 0.1


def test_odd_rows(odd, none, labels):
    got = {}
    for r in quality.classify_documents(odd, labels).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(odd_rows())
    assert tuple(got[2][0]) == (2, None, None, False)
    assert got[3][0]["keep"] is False and got[3][0]["quality"] is not None and got[4][0]["keep"] is False
    assert got[1][0] == got[1][1] and len(got[None]) == 2
    assert quality.classify_documents(none, labels).count() == 0
    unlabelled = quality.classify_documents(odd, labels.limit(0)).collect()
    assert all(r["quality"] is None for r in unlabelled) and sum(r["keep"] for r in unlabelled) == 9
    kept = quality.keep_good(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == 9 and {r["size"] for r in kept.collect()} == {CLASHING["size"]}
