import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from semloom.llm import bytes_text as bt
from semloom.llm import language_id as li

from .conftest import odd_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("chunk", [1, 3, 7, 32])
def test_forward_backward_equals_the_chain(chunk, monkeypatch):
    monkeypatch.setattr(li, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    k = 3
    text = np.sort(rng.integers(0, 5, 140))
    scores, transition = rng.normal(size=(140, k)) * 2, rng.normal(size=(k, k))
    got = li.marginals(scores, text, transition)
    sum_exp = lambda a, axis: np.log(np.exp(a - a.max()).sum(axis)) + a.max()
    for t in np.unique(text):
        s = scores[text == t]
        forward, backward = [s[0]], [np.zeros(k)]
        for x in s[1:]:
            forward.append(sum_exp(forward[-1][:, None] + transition, 0) + x)
        for x in s[:0:-1]:
            backward.append(sum_exp(transition + (x + backward[-1])[None, :], 1))
        m = np.exp(np.array(forward) + np.array(backward[::-1]) - sum_exp(forward[-1], 0))
        assert np.allclose(m, got[text == t])
    assert len(li.marginals(np.zeros((0, k)), np.zeros(0, int), transition)) == 0


def by_hand(model, word):
    """A word's scores by language, window by window."""
    x = [32, *word, 32]
    hashed = lambda v, m, bits: (v * m & 0xFFFFFFFF) >> (32 - bits)
    at = [32, *word, 32, 32, 32]
    affix = [hashed(int.from_bytes(bytes(part), "big"), 0x85EBCA77, li.AFFIX_BITS) if len(word) >= li.AFFIX else 0 for part in (at[1:4], at[len(word) - 2 : len(word) + 1])]
    h = bt.span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]
    entry = list(model.lexicon).index(h) if h in model.lexicon else len(model.lexicon)
    out = []
    for c in range(len(model.labels)):
        v = float(model.entries[c][entry]) + sum(float(model.affixes[o, c][affix[o]]) for o in (0, 1))
        v += sum(float(model.grams[0, c][(a << 8) | b]) for a, b in zip(x, x[1:]))
        v += sum(float(model.grams[1, c][hashed((a << 16) | (b << 8) | d, 0x9E3779B1, li.GRAM_BITS)]) for a, b, d in zip(x, x[1:], x[2:]))
        out.append(v)
    return out


def small_model(words, k=3):
    rng = np.random.default_rng(1)
    lexicon = np.unique(bt.hash_words(words))
    tables = [rng.normal(size=s).astype(np.float32) for s in ((2, k, 1 << li.GRAM_BITS), (2, k, 1 << li.AFFIX_BITS), (k, len(lexicon) + 1))]
    return li.Model(list("abc")[:k], tables[0], tables[1], lexicon, tables[2], rng.normal(size=(k, k)))


def test_emissions_equal_the_windows_one_by_one():
    model = small_model(["the", "été"])
    texts = ["The été a ", "x1 of, THE\n ", "", "日本 ab "]
    b, off = bt.buffers(pa.array(texts, pa.large_string()))
    w = li.features(b, off, model.lexicon)
    words = [x for t in texts for x in t.lower().replace(",", " ").encode().split()]
    assert np.allclose(li.emissions(model, w), [by_hand(model, x) for x in words], atol=1e-4) and w.text.tolist() == [0, 0, 0, 1, 1, 1, 3, 3]


def test_gradient_is_that_of_the_likelihood():
    """Against differences of the log-likelihood, whose partition sums go over all labellings."""
    model = small_model(["one", "two"], 2)
    texts = ["one two ab ", "two cd one x "]
    b, off = bt.buffers(pa.array(texts, pa.large_string()))
    w, y = li.features(b, off, model.lexicon), np.array([0, 1, 1, 0, 0, 1, 0])

    def likelihood():
        s, out = li.emissions(model, w), 0.0
        for t in (0, 1):
            e, own = s[w.text == t], tuple(y[w.text == t])
            score = {z: sum(e[i, c] for i, c in enumerate(z)) + sum(model.transition[a, d] for a, d in zip(z, z[1:])) for z in itertools.product(range(2), repeat=len(e))}
            out += score[own] - np.log(sum(np.exp(v) for v in score.values()))
        return out

    found = li.gradient(model, w, y)
    for table, g in zip((model.grams, model.affixes, model.entries, model.transition), found):
        used = np.argwhere(g != 0)
        for i in map(tuple, used[:: max(1, len(used) // 6)]):
            before, step = table[i], 0.05
            table[i] = before + step
            up = likelihood()
            table[i] = before - step
            down = likelihood()
            table[i] = before
            assert (up - down) / (2 * step) == pytest.approx(g[i], abs=5e-3)


@pytest.fixture(scope="module")
def corpus():
    docs = pq.read_table(f"{SF}/documents.parquet")
    return bt.to_string(docs["text"]), docs["lang"].to_pylist()


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_held_out_accuracy(corpus):
    texts, langs = corpus
    even = [i for i in range(len(langs)) if i % 2 == 0]
    odd_ = [i for i in range(len(langs)) if i % 2]
    model = li.fit_texts(texts.take(pa.array(even)), [langs[i] for i in even])
    held = texts.take(pa.array(odd_))
    got = li.label_batch(held, model)
    assert np.mean([a == langs[i] for a, i in zip(got.field(0).to_pylist(), odd_)]) > 0.98
    # code-switched text of held-out documents, by word, with and without context
    mixed, tags = li._mixed(held, np.searchsorted(model.labels, [langs[i] for i in odd_]), np.random.default_rng(1))
    w = li.features(*bt.buffers(mixed), model.lexicon)
    scores, truth = li.emissions(model, w), np.concatenate(tags)
    context = (li.marginals(scores, w.text, model.transition).argmax(1) == truth).mean()
    assert context > 0.97 and context > (scores.argmax(1) == truth).mean()
    # one batch or many, the result is the same
    again = pa.concat_arrays([li.label_batch(held.slice(i, 50), model) for i in range(0, len(held), 50)])
    assert again.field(0).to_pylist() == got.field(0).to_pylist() and again.field(5).to_pylist() == got.field(5).to_pylist()


def test_odd_rows(odd, none):
    rows = li.identify_languages(odd).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    assert len(rows) == len(odd_rows())
    assert tuple(got[2][0]) == (2, None, None, None, None, None, None, False)
    for i in (3, 4):
        assert tuple(got[i][0])[1:] == (None, None, None, 0, 0, [], False)
    assert got[1][0] == got[1][1] and got[5][0]["n_words"] == 120_000 and got[5][0]["spans"][-1]["end"] == 120_000
    for r in rows:
        if r["n_words"]:
            at = [0] + [s["end"] for s in r["spans"]]
            assert [s["start"] for s in r["spans"]] == at[:-1] and at[-1] == r["n_words"] and r["n_switches"] == len(r["spans"]) - 1
    assert li.identify_languages(none).count() == 0
    unknown = li.identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r["lang"] is None for r in unknown) and sum(r["keep"] for r in unknown) == 9
    kept = li.keep_identified(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["keep"] for r in rows)
